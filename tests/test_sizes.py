"""Cases that larger tables bring: numbers that are no character, tables in folders, fan-out behind small files."""

import pytest
from pyspark.sql import functions as F

from namesmith.functions.order import BLOCK, running_index
from namesmith.functions.text import char_of
from namesmith.operators import audit as A
from namesmith.operators import lookups as L
from namesmith.plans import candidates as CD
from namesmith.plans import evaluations as EV
from namesmith.plans import lookups as LP
from namesmith.plans import quality as QP
from namesmith.plans import segments as SG
from namesmith.plans import standins as S
from namesmith.plans import vectors as VC

SF = "/root/testdata/sf0.001"


def test_characters_of_all_planes(spark):
    points = [0x41, 0x4E00, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF, 0x110000, 2_700_000, -1]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(points)] + [(99, None)], "i int, p long")
    got = {r.i: r.c for r in rows.select("i", char_of(F.col("p")).alias("c")).collect()}
    for i, p in enumerate(points):
        assert got[i] == (chr(p) if 0 <= p <= 0x10FFFF and not 0xD800 <= p <= 0xDFFF else "�"), hex(p)
    assert got[99] is None


@pytest.fixture(scope="module")
def large_keys(spark, tmp_path_factory):
    """Tables whose keys reach the surrogates, the other planes and what lies beyond them."""
    path = str(tmp_path_factory.mktemp("large"))
    for name, keys in (("customer", ["c_custkey"]), ("orders", ["o_custkey"]), ("part", []), ("embeddings", ["vec_id"])):
        df = S.table(spark, SF, name)
        for k in keys:
            df = df.withColumn(k, F.col(k) * 20_000 + F.col(k) % 3)
        df.write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("query", [LP.j3, LP.j5, LP.j10, VC.v7, VC.v8])
def test_large_keys(spark, large_keys, query):
    assert query(spark, large_keys).count() > 0


def test_load_of_a_folder(spark, tmp_path):
    docs = S.table(spark, SF, "documents")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(map(tuple, EV.i1(spark, SF).select("collection", "id", "body").collect()))
    got = sorted(map(tuple, EV.i1(spark, str(tmp_path)).select("collection", "id", "body").collect()))
    assert len(want) > docs.count() and got == want


def broadcast_rows(df):
    """Runs the plan as one job; the largest number of rows that any broadcast in it held."""
    spark = df.sparkSession
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df.write.format("noop").mode("overwrite").save()
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            if nodes.apply(k).name() == "BroadcastExchange":
                for j in range(nodes.apply(k).metrics().size()):
                    metric = nodes.apply(k).metrics().apply(j)
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        most = max(most, int(str(value.get()).replace(",", "")))
    return most


def test_pools_are_what_is_broadcast(spark):
    # 10 surnames have 25 sound pairs each, there are 8 readings of 5 elements
    assert 0 < broadcast_rows(CD.g4(spark, SF)) <= 40


def test_documents_are_not_broadcast(spark):
    assert broadcast_rows(QP.d8(spark, SF)) < S.table(spark, SF, "part").count()


def test_fallback_is_dealt(spark):
    """Requests of one key without a permitted character meet every flagged one, in several tasks."""
    keys = "hangul string, resource_ohaeng string"
    asked = spark.range(500).selectExpr("id AS request_id", "'나' AS hangul", "'목' AS resource_ohaeng")
    flagged = spark.createDataFrame([("나", "목", f"p{i}") for i in range(7)] + [("가", "목", "q")], f"{keys}, profile_id string")
    plan = L.characters_of(asked, flagged.filter("hangul = '가'"), flagged)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = plan.withColumn("task", F.spark_partition_id()).select("request_id", "profile_id", "origin", "task").collect()
    finally:
        spark.conf.set(key, before)
    assert {(r.request_id, r.profile_id) for r in rows} == {(i, f"p{j}") for i in range(500) for j in range(7)} and len(rows) == 3500
    assert {r.origin for r in rows} == {"flagged"} and len({r.task for r in rows}) > 3
    assert "_deal" not in plan.columns


def test_fallback_takes_little_disk(spark, tmp_path):
    """Requests times characters are written as runs that repeat, far below a byte a row; copies and keys stay apart."""
    keys = "hangul string, resource_ohaeng string"
    asked = spark.range(1200).selectExpr("id AS request_id", "'나' AS hangul", "IF(id < 1000, '목', '화') AS resource_ohaeng")
    known = spark.range(4000).selectExpr("'나' AS hangul", "'목' AS resource_ohaeng", "format_string('OHE-%05d', id) AS profile_id")
    copies = spark.createDataFrame([("나", "화", "p")] * 3 + [("가", "목", "q"), (None, "목", "r")], f"{keys}, profile_id string")
    flagged = known.unionByName(copies)
    out = f"{tmp_path}/out"
    L.characters_of(asked, flagged.filter("hangul = '가'"), flagged).select("request_id", "profile_id", "origin").write.parquet(out)
    got = {r.request_id: (r.n, r.d) for r in spark.read.parquet(out).groupBy("request_id").agg(F.count("*").alias("n"), F.countDistinct("profile_id").alias("d")).collect()}
    assert got == {i: (4000, 4000) if i < 1000 else (3, 1) for i in range(1200)}
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.35 * 1000 * 4000


def test_answers_are_dealt(spark):
    """A file of few bytes is one task, whatever is done with its rows."""
    assert SG.answers(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_flows_are_read_once(spark):
    df = spark.createDataFrame([("김씨(목) → 첫째(화) → 둘째(수) — 상생\n박씨(목) → 이름(화) — 상극",)], "text string").select(A.verdicts_corrected(F.col("text")).alias("text"))
    assert df.first().text == "김씨(목) → 첫째(화) → 둘째(수) — 상극\n박씨(목) → 이름(화) — 상생"
    # two patterns of flows, in each the matches and the labels of a match
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 4


def test_same_reading_without_own_character(spark):
    """A character with more rows than the limit hides none of the others."""
    keys = "hangul string, hanja string, profile_id string"
    flagged = spark.createDataFrame([("가", "甲", f"a{i:02}") for i in range(40)] + [("가", chr(0x4E00 + i), f"b{i:02}") for i in range(12)], keys)
    issues = spark.createDataFrame([(1, "가", "甲"), (2, "가", "乙")], "issue_id int, hangul string, hanja string")
    plan = L.same_reading(issues, flagged, 10)
    got = sorted((r.issue_id, r["rank"], r.profile_id) for r in plan.collect())
    assert got == [(1, i + 1, f"b{i:02}") for i in range(10)] + [(2, i + 1, f"a{i:02}") for i in range(10)]
    # 20 rows of a reading are ranked anew, not all of it
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("_near") > 0


def test_blocks_of_documents(spark):
    """Texts of one block meet in one task: 2 ** 18 of them were most of the memory there is."""
    index = running_index(spark.range(70_000), "id").withColumn("task", F.spark_partition_id())
    assert index.filter("idx <> id + 1").isEmpty() and BLOCK * 2000 < 1 << 26


def test_questions_are_written_once(spark):
    """Conditions on a question do not each compose its text anew."""
    q = F.col("query")
    plan = S.questions(spark, SF).filter(q.contains("이름") & q.contains("추천") & q.isNotNull())
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") == 2  # {n} and {p}
