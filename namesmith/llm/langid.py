"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three letters, words
padded by a boundary) in order of frequency. A text gets the language whose profile its own
ranks are least out of place against; a gram the profile lacks counts the largest distance.

Training counts every n-gram of every training text: tasks sum per language before the
shuffle, and only the ``top`` grams of each language reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.order import top_per_key
from namesmith.llm.common import STAGE_BATCH, give_back, held_out, memory, packed_row, short_batches, table, text_of

TOP = 400
CHUNK = 1 << 19  # letters counted at once


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to its lower-case letter; 1, the word boundary, for all that is no letter."""
    out = np.ones(0x110000, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; 21 bits a letter, so the order shows in the size."""
    s = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate(([1], s, [1]))
    keep = s > 1
    keep[1:] |= s[:-1] > 1  # one boundary after each word
    s = np.concatenate(([1], s[keep]))
    two = s[:-1] << 21 | s[1:]
    three = two[:-1] << 21 | s[2:]
    return np.concatenate((s[s > 1], two, three[s[1:-1] > 1]))


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent codes, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:top]]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memory("language")
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            part: list[str] = []
            size = 0
            for i, text in enumerate(texts):
                part.append(text)
                size += len(text)
                if size >= CHUNK or i == len(texts) - 1:
                    code, n = np.unique(np.concatenate([grams(t) for t in part]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": code, "n": n})
                    part, size = [], 0
    give_back()


def profiles(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Each language's grams in rank order, learned from all rows with a language and a text.
    At most ``top`` codes a language come to the driver."""
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    counts = rows.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = top_per_key(counts, ["lang"], [F.desc("n"), F.col("code")], top)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "rank", "code").collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {k: [c for _, c in sorted(v)] for k, v in sorted(out.items())}


def identify(df: DataFrame, learned: dict[str, list[int]], text: str = "text", top: int = TOP) -> DataFrame:
    """Add (or replace) ``lang_pred`` and ``score``.

    Null, empty and letterless texts get ``und`` and score 0. If nothing was learned, a text with
    letters gets null and score 0. Other columns stay, whatever their names; repeated rows are judged alike. Of equally near languages the first by name wins. ``score`` is one less the
    out-of-place distance, as a share of the largest possible one.
    """
    names = sorted(learned)
    vocab = np.unique(np.array([c for v in learned.values() for c in v], np.int64))
    ranks = np.full((len(names), len(vocab) + 1), -1, np.int64)
    for k, name in enumerate(names):
        ranks[k, np.searchsorted(vocab, np.array(learned[name], np.int64))] = np.arange(len(learned[name]))

    def judge(text: str | None) -> tuple[str | None, float]:
        codes = ranked(grams(text), top) if text else ()
        if not len(codes) or codes.max() == 1:
            return "und", 0.0
        if not names:
            return None, 0.0
        at = np.searchsorted(vocab, codes)
        at[vocab[np.minimum(at, len(vocab) - 1)] != codes] = len(vocab)
        found = ranks[:, at]
        far = np.where(found < 0, top, np.abs(found - np.arange(len(codes)))).sum(axis=1)
        k = int(far.argmin())
        return names[k], 1.0 - float(far[k]) / (top * len(codes))

    @F.pandas_udf("lang_pred string, score double")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory("language")
        for texts in parts:
            yield pd.DataFrame([judge(t) for t in texts], columns=["lang_pred", "score"])
        give_back()

    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    out = df.select(packed_row(rest).alias("row"), guess(F.col(text)).alias("guess"))
    return out.select(*[F.col("row")[c].alias(c) for c in rest], "guess.*")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    learned = profiles(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), learned).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter have no language and go. A missing language is filled in; a given
    one is taken as given. If no row has a language, nothing is learned and nothing filled in. Nulls,
    repeated rows and other columns stay as they are."""
    short_batches(spark, *STAGE_BATCH)
    learned = profiles(docs)
    out = identify(docs.select(packed_row(docs.columns).alias("row"), "text"), learned)
    out = out.filter(F.coalesce("lang_pred", F.lit("")) != "und")
    filled = {"lang": F.coalesce(F.col("row.lang"), F.col("lang_pred"))}
    return out.select(*[filled.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


__all__ = ["identify", "op2_language", "profiles", "stage", "text_of"]
