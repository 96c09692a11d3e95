"""Document fingerprints by locally consistent parsing.

A text is a string of symbols. Runs of one symbol become one; deterministic coin tossing
gives each symbol a label out of a few, from itself and its left neighbours alone; phrases
begin where a label is larger than both neighbours. A phrase's name is a hash of its
symbols, and the names are the symbols of the next level. Where a phrase is cut depends on a
few symbols beside it, so equal substrings have the same phrases inside, at any offset.

The fingerprint is the ``SIZE`` smallest phrase names of the last level; likeness is the
share of equal names among the smallest of both, an estimate of the Jaccard similarity.
Texts of a batch are parsed together as one array, with no phrase across texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.llm.common import LOWEST, table, text_of
from namesmith.session import checkpointed

LEVELS = 3
SIZE = 64
CHUNK = 1 << 20
ROWS = 512  # documents in a block of consecutive ids, on average

# Odd 64-bit multipliers of a finalising hash.
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


def coin(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit that differs from the left neighbour, plus that bit's value."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]  # lowest bit differs: a text's first label comes from itself
    low = x ^ left
    low &= -low
    at = np.bitwise_count(low - np.uint64(1))
    return (at.astype(np.uint64) << np.uint64(1)) | ((x & low) != 0)


def names(x: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases that begin at ``starts``, and where each text begins among them."""
    length = np.diff(starts, append=len(x))
    place = np.arange(len(x), dtype=np.uint64) - np.repeat(starts, length).astype(np.uint64)
    return mix(np.add.reduceat(mix(x + place * M3), starts) + length.astype(np.uint64)), np.searchsorted(starts, first)


def level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and text starts of the next level."""
    begin = np.empty(len(x), bool)
    begin[1:] = x[1:] != x[:-1]
    begin[first] = True
    if not begin.all():
        starts = np.flatnonzero(begin)
        length = np.diff(starts, append=len(x))
        x = np.where(length == 1, x[starts], mix(x[starts] + length.astype(np.uint64) * M3))
        first = np.searchsorted(starts, first)
    label = coin(coin(x, first), first).astype(np.int8)
    cut = np.zeros(len(x), bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    after = first[1:]
    cut[after[after < len(x)] - 1] = False  # a text's last symbol begins no phrase of its own
    cut[first] = True
    return names(x, np.flatnonzero(cut), first)


def fingerprints(texts: list[str], levels: int = LEVELS, size: int = SIZE) -> list[np.ndarray]:
    """Sorted smallest phrase names of each text; none for an empty text."""
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= CHUNK):
            chars += len(texts[hi])
            hi += 1
        at = [i for i in range(lo, hi) if texts[i]]
        lo = hi
        if not at:
            continue
        x = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first = np.cumsum([0, *(len(texts[i]) for i in at[:-1])])
        for _ in range(levels):
            x, first = level(x, first)
        small = (x >> np.uint64(32)).astype(np.uint32)
        for i, part in zip(at, np.split(small, first[1:])):
            out[i] = np.unique(part)[:size]
    return out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of equal names among the smallest of both; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def packed(a: np.ndarray) -> bytes:
    return a.astype(">u4").tobytes()


def fingerprint(df: DataFrame, text: str = "text", levels: int = LEVELS, size: int = SIZE) -> DataFrame:
    """Add (or replace) ``fingerprint``: eight hexadecimal digits a name, ascending. Null and
    empty texts have an empty one; equal texts, also in repeated rows, have equal ones."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([packed(a).hex() for a in fingerprints([t or "" for t in s], levels, size)])

    return df.withColumn("fingerprint", run(F.col(text)))


# Digests and names travel as bytes and are spelled in the last projection.
SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
SPELLED = ("edited_sha256", "fingerprint", "edited_fingerprint")


def compared(rows: list[tuple[int, str]]) -> list[tuple]:
    """A result row for each (id, text) but the last, which is only the next one of the row before."""
    import hashlib

    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
    own, other = fingerprints(texts), fingerprints(edited)
    return [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest(), packed(a), packed(b), likeness(a, b), likeness(a, n))
        for (i, t), e, a, b, n in zip(rows, edited, own, other, own[1:])
    ]


def blocks(df: DataFrame, doc_id: str, text: str, rows: int = ROWS) -> DataFrame:
    """``_block``, ``_id`` and ``_text``: blocks are ranges of ids as wide as holds ``rows`` ids on average; null ids have one of their own."""
    docs = df.select(F.col(doc_id).cast("long").alias("_id"), text_of(text).alias("_text"))
    n, low, high = docs.agg(F.count("_id"), F.min("_id"), F.max("_id")).first()
    width = F.lit(str(max(1, (high - low + 1) * rows // n) if n else 1)).cast("decimal(38,0)")
    place = F.floor((F.col("_id").cast("decimal(20,0)") - F.lit(low or 0)) / width).cast("long")
    return docs.select(F.coalesce("_id", F.lit(LOWEST)).alias("_id"), "_text", F.coalesce(place, F.lit(-1)).alias("_block"))


def next_block(found: DataFrame) -> DataFrame:
    """(_block, _to): the block after each, the first after the last. Chained in ranges of blocks,
    so that no task holds all; there is one row for every 4096 block numbers in the last step."""
    coarse = found.withColumn("_range", F.floor(F.col("_block") / 4096))
    ranges = coarse.groupBy("_range").agg(F.min("_block").alias("_first"))
    after = ranges.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))
    low = coarse.agg(F.min("_block").alias("_low"))  # one row
    inside = F.lead("_block").over(Window.partitionBy("_range").orderBy("_block"))
    chained = coarse.withColumn("_in", inside).join(after, "_range").crossJoin(F.broadcast(low))
    return chained.select("_block", F.coalesce("_in", "_after", "_low").alias("_to"))


def with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text (second half from the next row's start), and likenesses.

    Rows follow each other by id, null first, then by a hash of the text; the first follows the
    last. Texts are shuffled once, into blocks of consecutive ids; the first and last row of
    each block are written out, and the last ones meet the first ones of the blocks after.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in f"{SCHEMA}, _block long, _edge int, _text string".split(", ")]
        kept: list[tuple[int, str]] = []
        block = None
        edge = lambda kind: (kept[0 if kind == 1 else -1][0], *[None] * 6, block, kind, kept[0 if kind == 1 else -1][1])
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part, out = pdf.iloc[k : k + 256], []
                for b, group in part.groupby("_block", sort=True):
                    if b != block:
                        out += [edge(2)] if kept else []
                        block, kept = b, []
                    fresh = not kept
                    kept += zip(group["_id"], group["_text"])
                    out += [edge(1)] if fresh else []
                    out += [(*r, b, 0, None) for r in compared(kept)]
                    kept = kept[-1:]
                yield pd.DataFrame(out, columns=names)
        if kept:
            yield pd.DataFrame([edge(2)], columns=names)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [compared([(i, t), (0, n)])[0] for i, t, n in zip(pdf["doc_id"], pdf["_text"], pdf["_next"])]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    docs = blocks(df, doc_id, text).withColumn("_h", F.xxhash64("_text"))
    order = docs.repartition("_block").sortWithinPartitions("_block", "_id", "_h").drop("_h")
    found = checkpointed(order.mapInPandas(run, f"{SCHEMA}, _block long, _edge int, _text string"))
    first = found.filter("_edge = 1")
    starts = first.select(F.col("_block").alias("_to"), F.col("_text").alias("_next"))
    ends = found.filter("_edge = 2").select("doc_id", "_block", "_text").join(next_block(first.select("_block")), "_block").join(starts, "_to")
    out = found.filter("_edge = 0").drop("_block", "_edge", "_text").unionByName(ends.select("doc_id", "_text", "_next").mapInPandas(close, SCHEMA))
    return out.withColumns({"doc_id": F.when(F.col("doc_id") != LOWEST, F.col("doc_id")), **{c: F.lower(F.hex(c)) for c in SPELLED}})


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return with_edits(table(spark, sf_dir, "documents"))
