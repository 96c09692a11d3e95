"""The corpus pipeline: language ID, line dedup, near-dedup, personal data, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows the one before kept. ``run``
writes each result as Parquet into the shared folder and reads it back as the next stage's
documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namesmith.llm import langid, lines, neardup, packing, private
from namesmith.llm.common import table
from namesmith.session import checkpointed

STAGES = [
    ("language", langid.stage),
    ("lines", lines.stage),
    ("neardup", neardup.stage),
    ("private", private.stage),
    ("packing", packing.stage),
]

# Rank profiles, darts and the tokenizer have no SQL form; tests/llm tests each stage, not the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
