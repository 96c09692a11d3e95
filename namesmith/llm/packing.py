"""Packing of tokenised documents into sequences by bounded-space online best fit.

Each task packs the rows of its own input split, so there is no shuffle: a piece goes into
the open sequence with the least free space that holds it. Open sequences are kept by free
space, and an integer has a bit for each free space that occurs, so the search is a shift
and a lowest bit. If none fits and all places are taken, the fullest closes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from struct import pack as pack_ids

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesmith.llm.common import STAGE_BATCH, Recent, give_back, memory, short_batches, table

SIZE, OPEN, EOS = 1024, 1024, 2
KNOWN = 500_000  # words in each of two generations whose ids a worker remembers; others are encoded again
FEW = 100_000  # the same in the pipeline
STEP, STEP_BYTES = 1000, 4 << 20  # texts encoded at once, and about the most bytes of them


class Coder:
    """Ids of texts by a byte-level tokenizer file, as little-endian bytes.

    Such a tokenizer encodes each match of its splitting pattern by itself, so the ids of a
    match are asked for once and remembered. The file's model gets a match's bytes as the
    characters that stand for them, without the work done around a whole text. Texts that
    hold an added token are encoded whole, as these are cut out before the pattern. A file
    of another kind gets whole texts.
    """

    def __init__(self, path: str, known: int = KNOWN) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.split = regex.compile(public_tokenizers.PATTERN).findall if plain and not spec.get("normalizer") else None
        self.tokenize = self.tokenizer.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        self.letter = dict(zip([*shown, *(b for b in range(256) if b not in shown)], map(chr, [*shown, *range(256, 324)])))
        self.space = self.letter[32]
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        self.known = Recent(known)

    def fresh(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def matches(self, words: list[str]) -> Iterator[bytes]:
        letter, tokenize = self.letter.__getitem__, self.tokenize
        for word in words:
            shown = word.replace(" ", self.space) if word.isascii() and word.isprintable() else "".join(map(letter, word.encode()))
            ids = [t.id for t in tokenize(shown)]
            yield pack_ids(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return self.fresh(texts)
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if whole:
            out = dict(zip(whole, self.fresh([texts[i] for i in whole])))
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in out]))
            return [out[i] if i in out else next(rest) for i in range(len(texts))]
        words = [self.split(t) for t in texts]
        get = self.known.holding(set().union(*words), self.matches).__getitem__
        return [b"".join(map(get, w)) for w in words]


def coder(path: str, known: int = KNOWN) -> Coder:
    coders = memory("packing")
    if (path, known) not in coders:
        coders.clear()
        coders[path, known] = Coder(path, known)
    return coders[path, known]


class Packer:
    """Online best fit with a fixed number of open bins; ``place`` gives (bin, offset)."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.mask = self.open = self.bins = 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        found = self.at[free].pop()
        self.mask ^= 0 if self.at[free] else 1 << free
        self.open -= 1
        return found

    def place(self, n: int) -> tuple[int, int]:
        fits = self.mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, bin_ = self.size, self.bins
            self.bins += 1
        if free > n:
            self.at[free - n].append(bin_)
            self.mask |= 1 << (free - n)
            self.open += 1
        return bin_, self.size - free


def pack(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, most: int = OPEN, eos: int = EOS, known: int = KNOWN,
) -> DataFrame:
    """Pieces of all documents with their place: id, piece, start, length, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit ids. A null or empty text is the end id alone.
    Longer documents than ``size`` are cut so that all pieces but the first are full. Repeated
    rows are packed as often as they come; a null id stays null. Other columns are not read.
    A worker remembers the ids of ``known`` words in each of two generations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer, end = coder(path, known), Packer(size, most), eos.to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            step = max(1, min(STEP, STEP_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                rows: list[tuple] = []
                for row, ids in enumerate(code.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    cut = [0, *range(n % size or size, n + 1, size)]
                    for k in range(len(cut) - 1):
                        length = cut[k + 1] - cut[k]
                        rows.append((row, k, cut[k], length, ids[4 * cut[k] : 4 * cut[k + 1]], *packer.place(length)))
                at, *cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(at)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.binary()), pa.array([base + b for b in cols[4]], pa.int64()), pa.array(cols[5], pa.int64()),
                ], names=names)
        give_back()

    rows = df.select(F.col(doc_id), F.col(text).cast("string").alias("_text"))
    names = [doc_id, "piece", "start", "length", "ids", "sequence_id", "offset"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType()]
    schema = T.StructType([rows.schema[0], *(T.StructField(n, k) for n, k in zip(names[1:], kinds))])
    return rows.mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document, with a digest of its ids."""
    out = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark, *STAGE_BATCH)
    return pack(docs, tokenizer_path(), known=FEW)
