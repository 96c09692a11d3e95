"""Evaluation roll-ups, overlap metrics and the incremental load."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators import evaluation as V
from namesmith.plans import Registry
from namesmith.plans import standins as S
from namesmith.session import shared_dir
from namesmith.streaming.loads import existing, load_new

AREA = Registry()

JUDGE = ("context_relevance", "groundedness", "answer_relevance")
MODEL_JUDGE = ("factual_accuracy", "groundedness", "answer_relevance")


def _replies(spark: SparkSession, sf_dir: str, first: str) -> DataFrame:
    k = F.col("event_id") % 5
    body = F.concat(
        F.lit(f'{{"{first}": '), F.col("user_id") % 6, F.lit(', "groundedness": "'), F.col("event_id") % 4, F.lit('", "answer_relevance": 4.0'),
        F.when(k == 1, F.lit("")).otherwise(F.concat(F.lit(', "reason": "'), F.col("event_type"), F.lit('"'))), F.lit("}"),
    )
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 3, F.lit("cannot say")).when(k == 4, F.replace(body, F.lit("4.0"), F.lit('"high"'))).otherwise(body)
    return S.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def _judged_sql(first: str) -> str:
    return f"""SELECT event_id, CAST(CASE WHEN event_id % 5 >= 3 THEN 0 ELSE user_id % 6 END AS INT) AS {first}, CAST(CASE WHEN event_id % 5 >= 3 THEN 0 ELSE event_id % 4 END AS INT) AS groundedness,
      CAST(CASE WHEN event_id % 5 >= 3 THEN 0 ELSE 4 END AS INT) AS answer_relevance, CASE event_id % 5 WHEN 1 THEN '' WHEN 3 THEN '[평가 오류]' WHEN 4 THEN '[평가 오류]' ELSE event_type END AS reason FROM events"""


@AREA.add("e1_judge_replies", _judged_sql("context_relevance"))
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.judged(_replies(spark, sf_dir, "context_relevance"), "raw", JUDGE).drop("raw")


@AREA.add("e1_model_judge_replies", _judged_sql("factual_accuracy"))
def e1_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.judged(_replies(spark, sf_dir, "factual_accuracy"), "raw", MODEL_JUDGE).drop("raw")


S.VIEWS["scores"] = """SELECT doc_id, CAST(quality * 4 + 1 - CASE WHEN doc_id % 11 = 0 THEN quality * 4 + 1 ELSE 0 END AS INT) AS a, CAST((1 - toxic) * 4 + 1 AS INT) AS b, CAST(doc_id % 6 AS INT) AS c FROM labels JOIN documents USING (doc_id)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = S.table(spark, sf_dir, "labels").join(S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    first = F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("quality") * 4 + 1)
    return joined.select(
        "doc_id", first.cast("int").alias(JUDGE[0]), ((1 - F.col("toxic")) * 4 + 1).cast("int").alias(JUDGE[1]), (F.col("doc_id") % 6).cast("int").alias(JUDGE[2])
    )


@AREA.add(
    "e2_score_summary",
    S.with_views("scores", body="""SELECT CAST(count_if(a > 0) AS BIGINT) AS valid, count(*) AS cases, round(avg(a) FILTER (a > 0), 6) AS avg_context_relevance, round(avg(b) FILTER (a > 0), 6) AS avg_groundedness,
      round(avg(c) FILTER (a > 0), 6) AS avg_answer_relevance, round((avg(a) FILTER (a > 0) + avg(b) FILTER (a > 0) + avg(c) FILTER (a > 0)) / 3, 6) AS overall FROM scores"""),
)
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.summary(scores(spark, sf_dir), JUDGE)
    return out.select("valid", "cases", *[F.round(c, 6).alias(c) for c in (*[f"avg_{m}" for m in JUDGE], "overall")])


@AREA.add(
    "e2_score_cases",
    S.with_views("scores", body="""SELECT doc_id, a AS context_relevance, b AS groundedness, c AS answer_relevance, round(CASE WHEN a > 0 THEN (a + b + c) / 3.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS mean,
      a > 0 AND (a + b + c) / 3.0::DOUBLE < 3 AS flagged FROM scores"""),
)
def e2_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.case_rows(scores(spark, sf_dir), JUDGE).withColumn("mean", F.round("mean", 6))


@AREA.add("e3_successes", "SELECT source, CAST(count_if(doc_id % 7 NOT IN (0, 1)) AS BIGINT) AS passed, count(*) AS cases FROM documents GROUP BY 1")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 7
    answer = F.when(k == 0, F.lit(" \n")).when(k == 1, F.concat(F.lit("[오류] "), "text")).otherwise(F.col("text"))
    return S.table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(V.succeeded(answer)).alias("passed"), F.count(F.lit(1)).alias("cases"))


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its successor by id, an empty text where there is none."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("reference"))
    return docs.withColumnRenamed("text", "prediction").join(after, "doc_id", "left")


_OVERLAP = """WITH p AS (SELECT a.doc_id, a.text AS prediction, coalesce(b.text, '') AS reference FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1),
    t AS (SELECT doc_id, 1 AS side, list_filter(regexp_split_to_array(prediction, '\\s+'), lambda x: x <> '') AS w FROM p UNION ALL SELECT doc_id, 0, list_filter(regexp_split_to_array(reference, '\\s+'), lambda x: x <> '') FROM p),
    u AS (SELECT doc_id, side, unnest(w) AS t1, generate_subscripts(w, 1) AS i FROM t),
    l AS (SELECT *, lead(t1, 1) OVER k AS t2, lead(t1, 2) OVER k AS t3, lead(t1, 3) OVER k AS t4 FROM u WINDOW k AS (PARTITION BY doc_id, side ORDER BY i)),
    g AS (SELECT doc_id, side, n, CASE n WHEN 1 THEN t1 WHEN 2 THEN t1 || ' ' || t2 WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3 ELSE t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS gram FROM l, range(1, 5) AS r(n)
      WHERE CASE n WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 3 THEN t3 ELSE t4 END IS NOT NULL),
    c AS (SELECT doc_id, n, gram, CAST(sum(side) AS BIGINT) AS p, CAST(sum(1 - side) AS BIGINT) AS r FROM g GROUP BY 1, 2, 3),
    o AS (SELECT doc_id, n, coalesce(matches, 0) AS matches, coalesce(predicted, 0) AS predicted, coalesce(referred, 0) AS referred FROM (SELECT doc_id, n FROM p, range(1, 5) AS r(n)) LEFT JOIN
      (SELECT doc_id, n, CAST(sum(least(p, r)) AS BIGINT) AS matches, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(r) AS BIGINT) AS referred FROM c GROUP BY 1, 2) USING (doc_id, n))
    """
_F = "CASE WHEN matches > 0 THEN 2.0::DOUBLE * matches / (predicted + referred) ELSE 0.0::DOUBLE END"


@AREA.add("e4_corpus_means", _OVERLAP + f"SELECT CAST(n AS INT) AS n, round(avg({_F}), 6) AS mean_f, count(*) AS pairs FROM o WHERE n <= 2 GROUP BY n")
def e4_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of the whole corpus."""
    means = V.corpus_rouge(V.ngram_overlap(text_pairs(spark, sf_dir), "doc_id", "prediction", "reference", 2))
    return means.select("n", F.round("mean_f", 6).alias("mean_f"), "pairs")


@AREA.add("e4_corpus_rouge_l")
def e4_rouge_l_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L of the whole corpus."""
    return V.rouge_l(text_pairs(spark, sf_dir), "doc_id", "prediction", "reference").agg(F.round(F.avg("f"), 6).alias("mean_f"), F.count(F.lit(1)).alias("pairs"))


@AREA.add(
    "e4_rouge_n",
    _OVERLAP + "SELECT doc_id, CAST(n AS INT) AS n, matches, predicted, referred, round(CASE WHEN matches > 0 THEN 2.0::DOUBLE * matches / (predicted + referred) ELSE 0.0::DOUBLE END, 6) AS f FROM o WHERE n <= 2",
)
def e4_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rouge(V.ngram_overlap(text_pairs(spark, sf_dir), "doc_id", "prediction", "reference", 2)).withColumn("f", F.round("f", 6))


@AREA.add(
    "e4_bleu",
    _OVERLAP + """, s AS (SELECT n, sum(matches)::DOUBLE AS m, sum(predicted)::DOUBLE AS p, sum(referred)::DOUBLE AS r FROM o GROUP BY 1),
    b AS (SELECT CASE WHEN p > r THEN 1.0::DOUBLE ELSE exp(1 - r / p) END AS bp, p, r FROM s WHERE n = 1)
    SELECT round(CASE WHEN (SELECT min(m) FROM s) > 0 THEN bp * exp((SELECT sum(ln(m / p)) / 4 FROM s)) ELSE 0.0::DOUBLE END, 6) AS bleu, round(bp, 6) AS brevity_penalty, CAST(p AS BIGINT) AS predicted, CAST(r AS BIGINT) AS referred FROM b""",
)
def e4_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.bleu(V.ngram_overlap(text_pairs(spark, sf_dir), "doc_id", "prediction", "reference", 4))
    return out.select(F.round("bleu", 6).alias("bleu"), F.round("brevity_penalty", 6).alias("brevity_penalty"), "predicted", "referred")


@AREA.add("e4_rouge_l")
def e4_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.rouge_l(text_pairs(spark, sf_dir), "doc_id", "prediction", "reference").withColumn("f", F.round("f", 6))


def _record() -> list[Column]:
    return [F.lit("doc").alias("collection"), F.concat(F.lit("doc_"), "doc_id").alias("id"), F.md5("text").alias("body")]


@AREA.add("i1_incremental_load", """WITH n AS (SELECT 'doc_' || doc_id * 2 AS id, md5(text || 'x') AS body FROM documents)
    SELECT 'doc' AS collection, 'doc_' || doc_id AS id, md5(text) AS body FROM documents UNION ALL SELECT 'doc', id, body FROM n WHERE id NOT IN (SELECT 'doc_' || doc_id FROM documents)""")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources that share ids, each loaded twice: known ids stay as they are, the second runs find nothing new."""
    base = f"{shared_dir(spark)}/load-{uuid.uuid4().hex}"
    docs = S.table(spark, sf_dir, "documents")
    later = docs.withColumn("doc_id", F.col("doc_id") * 2).withColumn("text", F.concat("text", F.lit("x")))
    later.write.parquet(f"{base}/later")
    # the table may be one file or a folder of files; only a pattern may name either
    for name, source in (("first", f"{sf_dir}/{{documents}}.parquet"), ("second", f"{base}/later")):
        for _ in range(2):
            load_new(spark, source, docs.schema, f"{base}/target", f"{base}/progress-{name}", ["collection", "id"], _record(), buckets=16, name=name)
    return existing(spark, f"{base}/target", docs.select(*_record()).schema).drop("bucket", "batch")
