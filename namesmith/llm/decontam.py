"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a set of word shingles, each ``GRAM`` words (an item of fewer words is
one shingle). Document shingles are looked up among the items' shingles; what is found gives
each shingle's frequency. A window can only occur where all its shingles do, so its rarest
shingle is a sufficient prefix: places of that one are joined with the window. The place and
the length of the window bound its start, and the other shingles are then looked up at
exactly the places the start implies. Shingles are compared word by word, so nothing rests
on a hash.

Texts never move: shingles are cut and looked up in the scan, and only the places found
(id, hash of the text, position) are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.llm.common import row_key, table, text_of
from namesmith.session import checkpointed

SIZE, GRAM = 10, 5
# Item shingles up to this number (some 40 MB) are sent to every executor; beyond it the places are shuffled to them.
SENT = 200_000
OTHER = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[^{OTHER}]+"), F.lit(0))


def shingle_rows(df: DataFrame, words: str, k: int) -> DataFrame:
    """A row for each run of k words: ``pos`` from 0, the words ``w0``, ``w1``, ... and their hash ``h``."""
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)])
    out = df.select(*[c for c in df.columns if c != words], F.posexplode(runs).alias("pos", "_run"))
    parts = [F.col("_run")[f"w{i}"].alias(f"w{i}") for i in range(k)]
    return out.select(*[c for c in df.columns if c != words], "pos", *parts, F.xxhash64(*parts).alias("h"))


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with an exact key: their hash, and a running number among those that share it."""
    return df.distinct().withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy(*columns)))


def item_windows(items: DataFrame, item_id: str, text: str, size: int = SIZE) -> DataFrame:
    """Distinct windows: ``item`` (null as empty), ``words``, ``k`` words a shingle."""
    ws = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(text_of(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    out = ws.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return out.distinct().withColumn("k", F.least(F.size("words"), F.lit(GRAM)))


def occurrences(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place a window occurs: ``_id``, ``_h``, ``first`` and ``last`` word, the window's ``words``."""
    found, needed = [], []
    texts = docs.select(*row_key(doc_id, text_of(text)), words_of(text_of(text)).alias("w")).withColumn("n_words", F.size("w"))
    distinct = windows.select("words", "k").distinct()
    for k in range(1, GRAM + 1):
        # one row says whether any window has shingles of k words; items of fewer words than GRAM are rare
        own = distinct.filter(F.col("k") == k).drop("k")
        if own.isEmpty():
            continue
        names = [f"w{i}" for i in range(k)]
        rows = shingle_rows(own.withColumn("_w", F.col("words")), "_w", k)
        shingles = checkpointed(numbered(rows.select("h", *names), names))
        side = F.broadcast(shingles) if shingles.count() <= SENT else shingles
        equal = reduce(lambda a, b: a & b, [F.col(f"d.{c}") == F.col(f"s.{c}") for c in ("h", *names)])
        hits = shingle_rows(texts, "w", k).alias("d").join(side.alias("s"), equal)
        found.append(hits.select("_id", "_h", "n_words", "pos", F.lit(k).alias("k"), "s.h", "tie"))
        needed.append(rows.join(shingles, ["h", *names]).select("words", F.col("pos").alias("j"), F.lit(k).alias("k"), "h", "tie"))
    if not found:
        return texts.select("_id", "_h", F.col("n_words").alias("first"), F.col("n_words").alias("last"), F.array().cast("array<string>").alias("words")).limit(0)
    # rows that repeat id and text are one document
    places = checkpointed(reduce(DataFrame.unionByName, found).distinct())
    parts = checkpointed(reduce(DataFrame.unionByName, needed))
    shingle = ["k", "h", "tie"]
    frequency = places.groupBy(*shingle).agg(F.count(F.lit(1)).alias("n"))
    size = F.size("words")
    # a window with a shingle that occurs nowhere is gone here
    rarest = (
        parts.join(frequency, shingle).groupBy("words", "k")
        .agg(F.count(F.lit(1)).alias("there"), F.min(F.struct("n", "h", "tie", "j")).alias("r"))
        .filter(F.col("there") == size - F.col("k") + 1)
        .select("words", "k", "r.h", "r.tie", "r.j")
    )
    start = F.col("pos") - F.col("j")
    tried = places.join(rarest, shingle).filter((start >= 0) & (start + size <= F.col("n_words")))
    tried = tried.select("_id", "_h", start.alias("first"), "words", "k", F.col("j").alias("_known"))
    single = tried.filter(size == F.col("k")).select("_id", "_h", "first", "words")
    asked = tried.filter(size > F.col("k")).join(parts, ["words", "k"]).filter("j <> _known")
    asked = asked.select("_id", "_h", "first", "words", "k", "h", "tie", (F.col("first") + F.col("j")).alias("pos"))
    there = asked.join(places.drop("n_words"), ["_id", "_h", "pos", *shingle], "left_semi")
    whole = there.groupBy("_id", "_h", "first", "words", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size - F.col("k"))
    both = single.unionByName(whole.select("_id", "_h", "first", "words"))
    return both.select("_id", "_h", "first", (F.col("first") + size - 1).alias("last"), "words")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, ``n_words``, ``n_hit`` (words inside an occurring window),
    ``n_items``, ``items`` (ids of items with an occurring window, sorted as strings), ``contaminated``.

    Null and empty texts have no words and are clean; an item without words has no window; a null
    item id is the empty string; items that share an id are one. Rows that repeat id and text get
    equal results. Other columns of either table are not looked at, whatever their names.
    """
    windows = checkpointed(item_windows(items, item_id, item_text))
    places = checkpointed(occurrences(docs, windows, doc_id, text))
    order = Window.partitionBy("_id", "_h").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("last").over(order), F.lit(-1))
    new = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reach), F.lit(0))
    hit = places.select("_id", "_h", "words", new.alias("new")).groupBy("_id", "_h")
    hit = checkpointed(hit.agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("words")).alias("set")))
    # documents with the same windows have the same items: listed once for all of them
    sets = hit.select("set").distinct()
    named = sets.select("set", F.explode("set").alias("words")).join(windows.select("words", "item"), "words")
    named = named.groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = hit.join(named, "set").drop("set")
    key = row_key(doc_id, text_of(text))
    out = docs.select(F.col(doc_id).alias("doc_id"), *key, F.size(words_of(text_of(text))).cast("long").alias("n_words")).join(result, ["_id", "_h"], "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"), (n_hit > 0).alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of which documents lie in windows of which benchmark items."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{OTHER}]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {SIZE}) AS size, array_to_string(w[k : k + {SIZE - 1}], ' ') AS txt
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {SIZE - 2}, 2))) AS k FROM i WHERE len(w) > 0)),
runs AS (SELECT rid, size, k, array_to_string(w[k : k + size - 1], ' ') AS txt
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM win))),
occ AS (SELECT rid, k, size, item FROM runs JOIN win USING (size, txt)),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT rid, k, size FROM occ)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
