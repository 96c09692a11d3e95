"""Evaluation: judge replies, roll-ups, overlap metrics."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from namesmith.functions.once import computed_once
from namesmith.functions.text import strip

ERROR_MARK = "[오류]"


def judged(replies: DataFrame, raw: str, metrics: tuple[str, str, str]) -> DataFrame:
    """Three integer scores and the reason of each judge reply; zeros if it cannot be read."""
    body = strip(F.regexp_replace(raw, r"```json\s*|\s*```", ""))
    value = F.from_json(body, "MAP<STRING,STRING>")
    scores = [F.element_at("_v", m) for m in metrics]
    numeric = F.lit(True)
    for m, s in zip(metrics, scores):
        # a number may have decimals, a quoted one may not; an explicit null is no score
        quoted = F.col(raw).rlike(rf'"{m}"\s*:\s*"')
        fits = s.rlike(r"^\s*-?\d+\s*$") | (~quoted & s.rlike(r"^-?\d+(\.\d+)?$"))
        numeric = numeric & (~F.map_contains_key("_v", m) | F.coalesce(fits, F.lit(False)))
    scores = [F.coalesce(s, F.lit("0")) for s in scores]
    good = F.col("_v").isNotNull() & numeric
    return replies.withColumn("_v", value).select(
        *replies.columns, *[F.when(good, s.cast("double").try_cast("int")).otherwise(0).alias(m) for m, s in zip(metrics, scores)],
        F.when(good, F.coalesce(F.element_at("_v", "reason"), F.lit(""))).otherwise("[평가 오류]").alias("reason"),
    )


def case_rows(results: DataFrame, metrics: tuple[str, str, str]) -> DataFrame:
    """Mean and flag per case: below 3 is flagged unless the case is invalid."""
    a, b, c = (F.col(m) for m in metrics)
    mean = F.when(a > 0, (a + b + c) / 3).otherwise(F.lit(0.0))
    return results.withColumn("mean", mean).withColumn("flagged", (a > 0) & (mean < 3))


def summary(results: DataFrame, metrics: tuple[str, str, str]) -> DataFrame:
    """One row: valid and all cases, mean per metric over the valid ones, overall mean."""
    valid = F.col(metrics[0]) > 0
    means = [F.avg(F.when(valid, F.col(m))).alias(f"avg_{m}") for m in metrics]
    out = results.agg(F.count_if(valid).alias("valid"), F.count(F.lit(1)).alias("cases"), *means)
    a, b, c = (F.col(f"avg_{m}") for m in metrics)
    return out.withColumn("overall", (a + b + c) / 3)


def succeeded(answer: Column) -> Column:
    text = strip(F.coalesce(answer, F.lit("")))
    return (text != "") & ~text.startswith(ERROR_MARK)


# -- overlap metrics -------------------------------------------------------------------------

def tokens(text: Column) -> Column:
    """Tokens are runs of non-blank characters."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _overlaps(max_n: int):
    kind = "array<struct<n: int, matches: bigint, predicted: bigint, referred: bigint>>"

    @F.pandas_udf(kind)
    def overlaps(p: pd.Series, r: pd.Series) -> pd.Series:
        def rows(x, y) -> list[dict]:
            out = []
            for n in range(1, max_n + 1):
                a, b = (Counter(zip(*[w[i:] for i in range(n)])) for w in (x, y))
                small, large = (a, b) if len(a) < len(b) else (b, a)
                matches = sum(min(k, large[g]) for g, k in small.items() if g in large)
                out.append({"n": n, "matches": matches, "predicted": max(len(x) - n + 1, 0), "referred": max(len(y) - n + 1, 0)})
            return out

        return pd.Series([rows(list(x), list(y)) for x, y in zip(p, r)])

    return overlaps


def ngram_overlap(pairs: DataFrame, pair_id: str, prediction: str, reference: str, max_n: int) -> DataFrame:
    """Clipped matches and totals per pair and n, counted inside the row: no n-gram is shuffled. A pair without
    an n-gram has a row of zeros; null texts are empty."""
    p, r = (tokens(F.coalesce(F.col(c), F.lit(""))) for c in (prediction, reference))
    return pairs.select(pair_id, F.inline(_overlaps(max_n)(p, r)))


def rouge(overlap: DataFrame) -> DataFrame:
    """F-measure per pair and n."""
    f = F.when(F.col("matches") > 0, 2.0 * F.col("matches") / (F.col("predicted") + F.col("referred"))).otherwise(F.lit(0.0))
    return overlap.withColumn("f", f)


def bleu(overlap: DataFrame, max_n: int = 4) -> DataFrame:
    """Corpus BLEU: geometric mean of clipped precisions with a brevity penalty."""
    per_n = overlap.groupBy().agg(
        *[F.sum(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in range(1, max_n + 1) for c in ("matches", "predicted")],
        F.sum(F.when(F.col("n") == 1, F.col("referred"))).alias("referred1"),
    )
    logs, all_hit = F.lit(0.0), F.lit(True)
    for n in range(1, max_n + 1):
        m, t = F.coalesce(f"matches{n}", F.lit(0)), F.coalesce(f"predicted{n}", F.lit(0))
        all_hit = all_hit & (m > 0)
        logs = logs + F.log(m / F.nullif(t, F.lit(0))) / max_n
    ratio = F.col("predicted1") / F.col("referred1")
    penalty = F.when(ratio > 1, F.lit(1.0)).otherwise(F.exp(1 - 1 / ratio))
    return per_n.select(
        F.when(all_hit, penalty * F.exp(logs)).otherwise(F.lit(0.0)).alias("bleu"), penalty.alias("brevity_penalty"), F.col("predicted1").alias("predicted"),
        F.col("referred1").alias("referred"),
    )


@F.pandas_udf(IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays.

    One machine word per 64 tokens and one step per token: a table over both lengths, as
    a fold would build it, costs thousands of times more on long texts.
    """
    def length(x, y) -> int:
        where: dict[str, int] = {}
        for i, token in enumerate(x):
            where[token] = where.get(token, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            hit = row & where.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)])


def rouge_l(pairs: DataFrame, pair_id: str, prediction: str, reference: str) -> DataFrame:
    """F-measure over the longest common subsequence per pair."""
    p, r = (tokens(F.coalesce(F.col(c), F.lit(""))) for c in (prediction, reference))
    sized = pairs.select(pair_id, common_subsequence(p, r).alias("lcs"), F.size(p).alias("predicted"), F.size(r).alias("referred"))
    f = F.when(F.col("lcs") > 0, 2.0 * F.col("lcs") / (F.col("predicted") + F.col("referred"))).otherwise(F.lit(0.0))
    return sized.withColumn("f", f)


def corpus_rouge(overlap: DataFrame) -> DataFrame:
    """Mean F-measure over all pairs per n, and the number of pairs."""
    return rouge(overlap).groupBy("n").agg(F.avg("f").alias("mean_f"), F.count(F.lit(1)).alias("pairs"))
