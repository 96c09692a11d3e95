"""Removal of repeated runs of lines, found by winnowing over line hashes.

A window is the shortest run of consecutive lines with a word that holds at least ``LEAST``
words, taken forwards from each line and backwards from each line. A repeated run of that
many words holds a whole window, and is the union of the windows within it. Each window
selects its smallest line hash as fingerprint, so equal windows select equal fingerprints.

Positions are joined by fingerprint: only windows whose fingerprint occurs elsewhere go on.
A match is then extended both ways by the windows that overlap it: each must have occurred
earlier itself. Instead of pairs of positions, of which a frequent passage has the square,
one aggregate per window keeps the earliest position. What lies in a window that occurred
earlier is deleted; the first occurrence in order of (id, line) stays.

Lines are cut and put together in their own row; the shuffles carry hashes and positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.llm.common import SPACE, packed_row, row_key, table, text_of
from namesmith.session import checkpointed

LEAST = 50


def line_rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each line with a word: document, place, words, a 128-bit hash, words before and after it."""
    docs = df.select(*row_key(doc_id, text_of(text)), F.split(text_of(text), "\n").alias("_lines"))
    rows = docs.select("_id", "_h", F.posexplode("_lines").alias("pos", "line"))
    n = F.regexp_count("line", F.lit(f"[^{SPACE}]+"))
    rows = rows.select("_id", "_h", "pos", n.alias("n"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).filter("n > 0")
    rows = rows.dropDuplicates(["_id", "_h", "pos"])  # rows that repeat id and text are one document
    after = F.sum("n").over(Window.partitionBy("_id", "_h").orderBy("pos"))
    return rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("n"))


def windows(rows: DataFrame, least: int) -> DataFrame:
    """The windows: first and last line, the hash of their lines, the smallest line hash."""
    of = Window.partitionBy("_id", "_h")
    line = F.struct("a", "b")
    out = rows.select(
        "_id", "_h", "pos", "n",
        *[f.over(w).alias(f"{side}_{name}")
          for side, w in (("f", of.orderBy("before").rangeBetween(0, least - 1)), ("b", of.orderBy("after").rangeBetween(1 - least, 0)))
          for name, f in (("lines", F.collect_list(line)), ("words", F.sum("n")), ("mark", F.min(line)), ("first", F.min("pos")), ("last", F.max("pos")))],
    )
    both = F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("lines", "words", "mark", "first", "last")]) for s in "fb"])
    out = out.select("_id", "_h", F.explode(both).alias("w")).filter(F.col("w.words") >= least)
    return out.select(
        "_id", "_h", "w.first", "w.last", F.struct(F.xxhash64("w.lines.a").alias("a"), F.xxhash64(F.lit(1), "w.lines.b").alias("b")).alias("key"), "w.mark",
    )


def repeated_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Runs of lines to delete: ``_id``, ``_h`` and ``runs``, an array of (first, last) in order, without overlap."""
    found = checkpointed(windows(line_rows(df, doc_id, text), least))
    here = F.struct("_id", "_h", "first")
    # a fingerprint that occurs at one place only has nothing to join
    marks = found.groupBy("mark").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).filter(F.col("lo") != F.col("hi")).select("mark")
    shared = found.join(marks, "mark", "left_semi")
    firsts = shared.groupBy("key").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).filter(F.col("lo") != F.col("hi")).select("key", "lo")
    later = shared.join(firsts, "key").filter(here > F.col("lo")).select("_id", "_h", "first", "last")
    order = Window.partitionBy("_id", "_h").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = later.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    runs = begins.withColumn("run", F.sum("new").over(order)).groupBy("_id", "_h", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """All rows with later repeated runs of lines taken out of ``text``, and ``n_removed``, the lines taken out.

    Null texts stay null and empty ones empty; lines without a word are no part of a run but go
    with one that spans them. Rows that repeat id and text are one document and change alike.
    A text that loses every line becomes empty; its row stays. Other columns stay, whatever their
    names, but for one named ``n_removed``, which is replaced.
    """
    runs = repeated_runs(df, doc_id, text, least)
    key = row_key(doc_id, text_of(text))
    own = [c for c in df.columns if c != "n_removed"]
    docs = df.select(packed_row(own).alias("row"), *key)
    out = docs.join(runs, ["_id", "_h"], "left")
    whole, cut = F.col("row")[text], F.col("runs")
    lines = F.split(whole, "\n")
    gap = lambda i: F.slice(
        lines, F.coalesce(F.get(cut, i - 1)["last"] + 2, F.lit(1)),
        F.coalesce(F.get(cut, i)["first"], F.size(lines)) - F.coalesce(F.get(cut, i - 1)["last"] + 1, F.lit(0)),
    )
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), gap)), "\n")
    gone = F.aggregate(cut, F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    new = {text: F.when(cut.isNull(), whole).otherwise(kept)}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in own], F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later repeated runs of 50 words or more."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with such runs taken out, ``n_chars`` anew where it was given. Nulls, repeated rows and
    texts without a line left are treated as in ``dedup``; other columns stay, whatever their names."""
    out = dedup(docs.select(packed_row(docs.columns).alias("doc"), "doc_id", "text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
