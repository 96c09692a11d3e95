"""Incremental collection load: new files only, no id twice, only touched buckets read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from namesmith.operators.vectors import new_rows

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast(IntegerType())


def known_keys(spark: SparkSession, target: str, schema: StructType, keys: list[str], touched: list[int], but: str) -> DataFrame:
    """Keys that batches other than ``but`` have written to the touched buckets. Both are partition filters, and
    only the key columns are read, so a load reads what its own rows can collide with."""
    there = existing(spark, target, schema)
    return there.filter(F.col("bucket").isin(touched) & (F.col("batch") != but)).select(*keys)


def load_new(
    spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, keys: list[str], shape: list[Column] | None = None,
    glob: str = "*.parquet", buckets: int = BUCKETS, name: str = "load",
) -> None:
    """Append the records of files not seen before to ``target``, then stop.

    ``source`` is a folder, or a pattern of folders and files. The file source remembers what it has read in ``checkpoint``. Records are the columns ``shape`` of the file
    rows. Of several records with one key in a batch the first holds, by file time, file name and place in the
    file. The target is partitioned by key bucket and batch; a batch replaces its own partitions, so one that
    is run again after a failure leaves no second copy. All paths are shared folders. ``buckets`` must
    stay the same; loads with progress of their own need a ``name`` of their own.
    """
    files = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    at = [F.col(f"_metadata.{c}") for c in ("file_modification_time", "file_path", "row_index")]
    columns = shape or [F.col(c) for c in schema.names]
    records = files.select(*columns, F.struct(*at).alias("_at"))
    own = StructType([f for f in records.schema if f.name != "_at"])

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("bucket", bucket_of(keys, buckets))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        fresh = new_rows(known_keys(session, target, own, keys, touched, f"{name}-{batch_id}"), rows, keys, ["_at"]).drop("_at")
        dealt = fresh.withColumn("batch", F.lit(f"{name}-{batch_id}")).hint("rebalance", "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target)

    query = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def existing(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """What has been loaded so far, with bucket and batch; empty at first."""
    whole = StructType(schema.fields).add("bucket", IntegerType()).add("batch", StringType())
    try:
        return spark.read.schema(whole).option("basePath", target).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)
