"""Rows that must not stop a job."""

from pyspark.sql import functions as F

from namesmith.functions.order import running_index
from namesmith.functions.text import counted
from namesmith.operators import audit, candidates, evaluation, questions, vectors


def test_zero_vectors_are_far(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.d for r in df.select(vectors.distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1.0, 0.0]


def test_long_numbers_are_large_counts(spark):
    asked = ["123456789012개", "이름 2 개", "0000000000000007개", "없음", "99999999999999999999999999999999999999999999개", "10개"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    q = F.col("q")
    rows = df.select(candidates.character_sample_size(q).alias("c"), candidates.word_sample_size(q).alias("w"), questions.traits(q)["requested"].alias("n")).collect()
    assert [r.c for r in rows] == [80, 50, 56, 50, 80, 80]
    assert [r.w for r in rows] == [60, 30, 42, 30, 60, 60]
    assert [r.n for r in rows] == [999_999_999, 2, 7, 0, 999_999_999, 10]
    done = df.select(audit.finished(F.lit("## [이름 1] 가나다 (一二)"), q).alias("t")).collect()
    assert done[0].t.startswith("요청하신 123456789012개 중") and done[3].t.startswith("## [이름 1]")
    assert df.select(counted(F.lit("007"), 5).alias("x")).first().x == 5


def test_pairs_without_a_gram_have_a_row(spark):
    df = spark.createDataFrame([(1, "a b a", "a a c"), (2, "", "x"), (3, None, None)], "id int, p string, r string")
    got = {(r.id, r.n): (r.matches, r.predicted, r.referred) for r in evaluation.ngram_overlap(df, "id", "p", "r", 2).collect()}
    assert got == {(1, 1): (2, 3, 3), (1, 2): (0, 2, 2), (2, 1): (0, 0, 1), (2, 2): (0, 0, 0), (3, 1): (0, 0, 0), (3, 2): (0, 0, 0)}
    assert {r.n: (round(r.mean_f, 6), r.pairs) for r in evaluation.corpus_rouge(evaluation.ngram_overlap(df, "id", "p", "r", 2)).collect()} == {1: (0.222222, 3), 2: (0.0, 3)}


def test_every_subset_can_be_drawn(spark):
    """Pairs of places of 6 occur about equally often, neighbours no more than others."""
    pool = running_index(spark.range(6).withColumn("kind", F.lit("a")), "id", "rank", ("kind",)).withColumn("size", F.lit(6).cast("long"))
    asked = spark.range(6000).select(F.col("id").alias("q"), F.lit("a").alias("kind"), F.lit(3).alias("n"))
    rows = candidates.sampled(asked, pool, ["kind"], "q", "n").groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("s")).groupBy("s").count().collect()
    assert len(rows) == 20 and all(len(set(r.s)) == 3 for r in rows)
    assert min(r["count"] for r in rows) > 220 and max(r["count"] for r in rows) < 380
    assert candidates.sampled(asked.limit(3).withColumn("n", F.lit(50)), pool, ["kind"], "q", "n").count() == 18
