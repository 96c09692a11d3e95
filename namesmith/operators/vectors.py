"""Distances of vectors and upkeep of the collections that are searched (``cells`` searches them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.order import first_per_key

METRICS = ("cosine", "l2")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - cosine (1 where a vector is zero), or the squared Euclidean distance."""
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"metric must be one of {METRICS}")


# -- upkeep ------------------------------------------------------------------------------

def recreate(df: DataFrame, path: str) -> None:
    """Replace a collection."""
    df.write.mode("overwrite").partitionBy("collection").parquet(path)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Incoming rows whose key is not there yet; of rows with one key the first by ``order`` (without it the smallest)."""
    return first_per_key(incoming.join(existing.select(*keys), keys, "left_anti"), keys, order or [c for c in incoming.columns if c not in keys])


def append_new(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Append only unknown keys; safe to repeat."""
    existing = spark.read.schema(incoming.schema).parquet(path)
    new_rows(existing, incoming, keys, order).write.mode("append").parquet(path)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Existing rows with those of the same key replaced; of incoming rows with one key the last by ``order`` holds."""
    latest = first_per_key(incoming, keys, order or [c for c in incoming.columns if c not in keys], last=True)
    return existing.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*existing.columns))


def collection_counts(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows per expected collection (a short list); missing ones are marked."""
    counts = documents.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return expected.join(counts, "collection", "left").select(
        "collection", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "미생성").otherwise("ok").alias("status")
    )


def metadata_of(requests: DataFrame, hanja: str, profiles: DataFrame, order: str) -> DataFrame:
    """Element and strokes of the first profile of each character, '' and 0 if unknown."""
    first = first_per_key(profiles.select("hanja", order, "resource_ohaeng", "strokes"), ["hanja"], [order])
    joined = requests.join(first.select(F.col("hanja").alias("_h"), "resource_ohaeng", "strokes"), F.col(hanja) == F.col("_h"), "left")
    return joined.select(*requests.columns, F.coalesce("resource_ohaeng", F.lit("")).alias("resource_ohaeng"), F.coalesce("strokes", F.lit(0)).alias("strokes"))
