"""Byte-level BPE encoding and decoding by recursive queries in DuckDB, one database per task.

Spark deals out the documents. A task splits its texts and asks DuckDB for the words it has
not met: token-position rows are joined with the merge table, each word contracts its leftmost
pair of the lowest rank, and the query recurs until no word has a pair that merges. Ordered
aggregates then give each word's ids and its decoded bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.llm.common import packed_row, table

WORDS = 1 << 15  # distinct words in a query
KNOWN = 600_000  # words a worker remembers; more are encoded again
STEP = 1024
_coders: dict[str, "Coder"] = {}

# A row is a token with its follower. A merged token takes the place of its right part, whose
# follower stays right; the row before gets a new follower, and the left part's row ends.
ENCODE = """
WITH RECURSIVE state(word, step, pos, token, after, follows) AS (
  SELECT word, 0, pos, token, lead(pos) OVER w, lead(token) OVER w FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  SELECT c.word, c.step + 1, c.pos,
    CASE WHEN c.pos = b."right" THEN b.best // 4294967296 ELSE c.token END,
    CASE WHEN c.after = b.best % 4294967296 THEN b."right" ELSE c.after END,
    CASE WHEN c.after = b.best % 4294967296 THEN b.best // 4294967296 ELSE c.follows END
  FROM state c
  JOIN (
    SELECT p.word, min(m.merged * 4294967296 + p.pos) AS best, arg_min(p.after, m.merged * 4294967296 + p.pos) AS "right"
    FROM state p JOIN merges m ON m.a = p.token AND m.b = p.follows
    GROUP BY p.word
  ) b ON b.word = c.word
  WHERE c.pos <> b.best % 4294967296
),
ends AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word, string_agg(v.id, ' ' ORDER BY s.pos) AS ids, string_agg(v.hex, '' ORDER BY s.pos) AS hex
FROM state s JOIN ends USING (word, step) JOIN vocab v ON v.token = s.token
GROUP BY s.word
"""


class Coder:
    """Words to ids as text and to decoded bytes, by a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = [
            (self.ranks[w[:k]], self.ranks[w[k:]], r)
            for w, r in self.ranks.items() for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks
        ]
        given = {"merges": pd.DataFrame(merges, columns=["a", "b", "merged"]), "vocab": pd.DataFrame([(r, str(r), w.hex()) for w, r in self.ranks.items()], columns=["token", "id", "hex"])}
        for name, frame in given.items():
            self.con.register("given", frame)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def learn(self, words: list[str]) -> None:
        """Words that are a token themselves stay whole; the others start as single bytes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.array([self.ranks.get(r, -1) for r in raw], np.int64)
        length = np.where(whole < 0, [len(r) for r in raw], 1)
        first = np.cumsum(length) - length
        token = self.bytes[np.frombuffer(b"".join([r if t < 0 else r[:1] for r, t in zip(raw, whole.tolist())]), np.uint8)]
        token[first[whole >= 0]] = whole[whole >= 0]
        at = np.repeat(np.arange(len(words)), length)
        self.con.register("start", pd.DataFrame({"word": at, "pos": np.arange(len(at)) - first[at], "token": token}))
        got = self.con.execute(ENCODE).fetchall()
        self.con.unregister("start")
        for k, ids, h in got:
            self.ids[words[k]] = ids
            self.decoded[words[k]] = bytes.fromhex(h)

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        split = [self.split(t) for t in texts]
        new = list(set().union(*split) - self.ids.keys())
        if len(self.ids) + len(new) > KNOWN:
            self.ids.clear()
            self.decoded.clear()
            new = list(set().union(*split))
        for k in range(0, len(new), WORDS):
            self.learn(new[k : k + WORDS])
        out = []
        for words in split:
            ids = " ".join(map(self.ids.__getitem__, words))
            out.append((ids.count(" ") + 1 if words else 0, ids, b"".join(map(self.decoded.__getitem__, words))))
        return out


def coder(path: str, pattern: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path, pattern)
    return _coders[path]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add (or replace) ``n_tokens``, ``ids`` (decimal, one space between) and ``decoded`` (bytes).

    Null and empty texts have no id. Special tokens' names are ordinary text. No shuffle; other
    columns stay, whatever their names; repeated rows are encoded alike.
    """

    @F.pandas_udf("n_tokens long, ids string, decoded binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        code = coder(path, pattern)
        for s in parts:
            texts = [t or "" for t in s]
            out = [x for k in range(0, len(texts), STEP) for x in code.encode(texts[k : k + STEP])]
            yield pd.DataFrame(out, columns=["n_tokens", "ids", "decoded"])

    rest = [c for c in df.columns if c not in ("n_tokens", "ids", "decoded")]
    out = df.select(packed_row(rest).alias("row"), run(F.col(text)).alias("bpe"))
    return out.select(*[F.col("row")[c].alias(c) for c in rest], "bpe.*")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["ENCODE", "encode", "op8_bpe"]
