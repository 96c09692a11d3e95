"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Every text is reduced to counts in its own row. Documents that pass the fixed rules get a
vector of transformed statistics; per (language, source) the minimum covariance determinant
estimate is found by concentration steps: take the half of the rows that lie nearest, refit
mean and covariance, repeat. The half's covariance is scaled to that of a normal cloud and
shrunk towards its language: the language's robust variances are added to it. Statistics that
are alike in more than half of a language's texts have no robust spread; they alone take a
fixed one. A document far from the estimate is rejected. All steps are aggregates over small vectors, so a hot source combines in each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.once import computed_once
from namesmith.llm.common import SPACE, row_key, table, text_of, words_of
from namesmith.session import checkpointed

FEATURES = ("log_words", "mean_chars", "symbols", "dup_lines", "repeats", "upper")
# Deviations of statistics whose median deviation in the language is zero: no half of its rows gives a scale.
FLOOR = (0.8, 0.5, 0.04, 0.12, 0.12, 0.08)
STEPS = 3
SHARE = 0.5
CONSISTENT = 1.786  # covariance of a normal cloud in six dimensions over that of its nearest half
FEW = 16
LEAST = 30  # rows a group needs for an estimate of its own; smaller ones share one a language
CUT = 45.0  # squared distance; beyond all but about one in ten million rows of a normal cloud in six dimensions


def counts(text: Column) -> list[tuple[dict[str, Column], list[str]]]:
    """Counts of a text, in layers that each read the one before, and the older columns that later ones read."""
    has_word = lambda line: line.rlike(f"[^{SPACE}]")
    words = F.col("_words")
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))),
    ).otherwise(F.array().cast("array<bigint>"))
    # positions of windows found twice, then the words that these cover; a sort of all positions only where many windows repeat
    dups = F.array_distinct(F.filter(F.col("_sorted"), lambda x, i: F.coalesce(x == F.get(F.col("_sorted"), i - 1), F.lit(False))))
    order = F.array_sort(F.transform(F.col("_windows"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    few = F.array_compact(F.transform(F.col("_windows"), lambda x, i: F.when(F.array_contains(F.col("_dups"), x), i)))
    many = F.array_sort(F.transform(
        F.filter(F.transform(F.col("_order"), lambda a, i: F.struct(a["i"].alias("i"), (
            (F.get(F.col("_order"), i - 1)["x"] == a["x"]) | F.coalesce(F.get(F.col("_order"), i + 1)["x"] == a["x"], F.lit(False))
        ).alias("again"))), lambda a: F.coalesce(a["again"], F.lit(False))),
        lambda a: a["i"],
    ))
    covered = F.aggregate(
        F.transform(F.col("_twice"), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_twice"), i + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return [
        ({"_words": words_of(text), "_lines": F.filter(F.split(text, "\n"), has_word)}, ["_text"]),
        ({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_windows": windows,
        }, []),
        ({"_sorted": F.when(again, F.sort_array("_windows"))}, ["_windows"]),
        ({"_dups": dups}, ["_windows"]),
        ({"_order": F.when(F.size("_dups") > FEW, order)}, ["_windows", "_dups"]),
        ({"_twice": F.when(F.size("_dups") > FEW, many).when(F.size("_dups") > 0, few)}, []),
        ({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}, []),
    ]


BASE = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Count columns of every whole text beside the columns of ``keep``; null and empty texts count nothing."""
    out, have = df.select(*keep, text_of(text).alias("_text")), [*keep]
    for layer, later in counts(F.col("_text")):
        out = computed_once(out, layer).select(*have, *layer, *later)
        have += [c for c in layer if not c.startswith("_")]
    return out.select(*keep, *BASE)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(n),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
    ]


def _fit(rows: DataFrame, keys: list[str], floors: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of each group's consistent covariance, raised by its floors f0..: columns m0.., c00.."""
    d = range(len(FEATURES))
    x = [F.col(c) for c in FEATURES]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(x[i]).alias(f"m{i}") for i in d],
        *[F.coalesce(F.covar_pop(x[i], x[j]), F.lit(0.0)).alias(f"s{i}{j}") for i in d for j in d if j <= i],
    ).join(floors, keys)
    for i in d:
        for j in range(i + 1):
            s = CONSISTENT * F.col(f"s{i}{j}") + (F.col(f"f{i}") ** 2 if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"c{j}{j}"))
    return out.select(*keys, "_n", *[f"m{i}" for i in d], *[f"c{i}{j}" for i in d for j in d if j <= i])


def _distance(rows: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the squared Mahalanobis distance ``_d`` to their group's fit."""
    d = range(len(FEATURES))
    own = [c for c in rows.columns if c != "_d"]
    out = rows.drop("_d").join(fit, keys, "left")
    for i in d:
        z = F.col(FEATURES[i]) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"c{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"c{i}{i}"))
    return out.select(*own, sum((F.col(f"z{i}") ** 2 for i in d), F.lit(0.0)).alias("_d"))


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Medians m0.. and scaled median deviations a0.. of each key, coordinate by coordinate."""
    centre = rows.groupBy(key).agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(FEATURES)])
    off = rows.join(centre, key).select(key, *[F.abs(F.col(c) - F.col(f"m{i}")).alias(c) for i, c in enumerate(FEATURES)])
    return centre.join(off.groupBy(key).agg(*[(1.4826 * F.percentile_approx(c, 0.5, 1000)).alias(f"a{i}") for i, c in enumerate(FEATURES)]), key)


def judge(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", steps: int = STEPS, cut: float = CUT,
) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` for every row of ``df``.

    Null languages and sources are groups of their own. Groups with fewer than ``LEAST`` rows
    join one rest group a language. ``distance`` is null where the fixed rules reject; an empty
    table gives an empty result; repeated rows are judged alike; other columns are not read.
    """
    rows = measured(df.select(F.col(doc_id), F.col(text).alias("_t"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(source), F.lit("")).alias("_source")), "_t", (doc_id, "_lang", "_source"))
    rows = checkpointed(rows.withColumn("base_failed", base_failed()))  # the texts are read once
    good = rows.filter(~F.col("base_failed"))
    sizes = good.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_rows"))
    at = F.when(F.col("_rows") >= LEAST, F.concat_ws("\u0001", F.col("_lang"), F.col("_source"))).otherwise(F.col("_lang")).alias("_group")
    named = sizes.select("_lang", "_source", at)
    vec = [v.alias(n) for v, n in zip(vector(), FEATURES)]
    points = checkpointed(good.select(doc_id, *BASE, "base_failed", "_lang", "_source", *vec).join(named, ["_lang", "_source"]).drop("_source"))
    only = points.select("_group", *FEATURES)
    floor = [F.when(F.col(f"a{i}") > 0, F.col(f"a{i}")).otherwise(FLOOR[i]).alias(f"f{i}") for i in range(len(FEATURES))]
    groups = named.select("_lang", "_group").distinct()
    floors = checkpointed(groups.join(_spread(points.select("_lang", *FEATURES), "_lang"), "_lang").select("_group", *floor))
    # start: medians and scaled median deviations
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in range(len(FEATURES)) for j in range(i)]
    scale = [F.sqrt(F.col(f"a{i}") ** 2 + F.col(f"f{i}") ** 2).alias(f"c{i}{i}") for i in range(len(FEATURES))]
    fit = _spread(only, "_group").join(floors, "_group").select("_group", *[f"m{i}" for i in range(len(FEATURES))], *scale, *zero)
    for _ in range(steps):
        near = _distance(only, fit, ["_group"])
        half = near.groupBy("_group").agg(F.percentile_approx("_d", SHARE, 1000).alias("_h"))
        fit = checkpointed(_fit(near.join(half, "_group").filter(F.col("_d") <= F.col("_h")), ["_group"], floors))
    far = _distance(points, fit.drop("_n"), ["_group"]).select(doc_id, *BASE, "base_failed", F.col("_d").alias("distance"))
    failed = rows.filter("base_failed").select(doc_id, *BASE, "base_failed", F.lit(None).cast("double").alias("distance"))
    return far.unionByName(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


__all__ = ["judge", "op9_quality", "row_key"]
