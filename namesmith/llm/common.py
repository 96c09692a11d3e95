"""What the operators of this package share: tables, row keys, splits and word classes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
LOWEST = -(1 << 63)
STAGE_BATCH = (250, "1m")  # rows and size of a batch in the pipeline, whose executors keep what its stages before have grown to
_memory: dict[str, dict] = {}


def memory(owner: str) -> dict:
    """What this worker remembers for one operator. Workers outlive stages, so what another one remembered is dropped."""
    if owner not in _memory:
        _memory.clear()
        _memory[owner] = {}
        give_back()
    return _memory[owner]


def give_back() -> None:
    """Hand what this worker has freed back to the system; Arrow and the C library would keep it for this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def short_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Hand Python tasks at most ``rows`` rows or ``size`` of whole texts at once, whichever comes first.

    By default a batch is 10,000 texts, which both the executor and its workers hold, some as pandas
    objects too. Plans read the setting when they run, so it stays set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Recent:
    """Values of keys met lately, in two generations of ``most`` keys; a key of the older one that is asked for moves on."""

    def __init__(self, most: int) -> None:
        self.most, self.old, self.young = most, {}, {}

    def holding(self, keys: set, make: Callable[[list], Iterable]) -> dict:
        """A mapping that has all of ``keys``; ``make`` gives the values of those not met."""
        missing = keys - self.young.keys()
        if len(self.young) + len(missing) > self.most:
            self.old, self.young, missing = self.young, {}, keys
        again = missing & self.old.keys()
        self.young.update((k, self.old[k]) for k in again)
        new = list(missing - again)
        if new:
            self.young.update(zip(new, make(new)))
        return self.young


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, of: int) -> Column:
    """True where crc32 of the id as text leaves 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == 2, F.lit(False))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def packed_row(columns: list[str]) -> Column:
    """A caller's columns as one struct, so that none meets a name of ours."""
    return F.struct(*(columns or [F.lit(0).alias("none")]))


def words_of(text: Column) -> Column:
    """Words between ASCII blanks; an empty array where there is none."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def row_key(doc_id: str, text: Column) -> list[Column]:
    """``_id`` and ``_h``: equal only for rows that repeat both id and text. A null id sorts first."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_id"), F.xxhash64(text).alias("_h")]
