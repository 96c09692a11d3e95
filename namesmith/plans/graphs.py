"""The property graph built, merged and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.text import code_point_label
from namesmith.operators import graph as G
from namesmith.plans import Registry
from namesmith.plans import standins as S

AREA = Registry()

_DATASETS = "SELECT dataset, bool_or(is_person_name_hanja) AS p FROM chars GROUP BY 1"
S.VIEWS["nodes"] = f"""SELECT dataset, 'Hanja' AS label, profile_id AS key FROM chars UNION ALL SELECT DISTINCT dataset, 'Sound', hangul FROM chars
    UNION ALL SELECT DISTINCT dataset, 'Stroke', CAST(strokes AS VARCHAR) FROM chars
    UNION ALL SELECT dataset, 'Category:Ohaeng', unnest(['목','화','토','금','수']) FROM ({_DATASETS})
    UNION ALL SELECT dataset, 'Law', 'person_name_hanja_rule' FROM ({_DATASETS}) WHERE p"""
S.VIEWS["edges"] = """SELECT dataset, profile_id AS src, 'BELONGS_TO' AS rel, 'sound_ohaeng' AS kind, sound_ohaeng AS dst FROM chars
    UNION ALL SELECT dataset, profile_id, 'BELONGS_TO', 'resource_ohaeng', resource_ohaeng FROM chars
    UNION ALL SELECT dataset, profile_id, 'HAS_SOUND', '', hangul FROM chars UNION ALL SELECT dataset, profile_id, 'HAS_STROKES', '', CAST(strokes AS VARCHAR) FROM chars
    UNION ALL SELECT dataset, profile_id, 'PERMITTED_BY', '', 'person_name_hanja_rule' FROM chars WHERE is_person_name_hanja"""
S.VIEWS["expected"] = """WITH c AS (SELECT dataset, count(*) AS n, count_if(is_person_name_hanja) AS p, count(DISTINCT hangul) AS s, count(DISTINCT strokes) AS t FROM chars GROUP BY 1)
    SELECT dataset, item, CAST(expected AS BIGINT) AS expected FROM c, LATERAL (VALUES ('Hanja', n), ('Sound', s), ('Stroke', t), ('Category:Ohaeng', 5),
      ('Law', CASE WHEN p > 0 THEN 1 ELSE 0 END), ('HAS_SOUND', n), ('HAS_STROKES', n), ('BELONGS_TO', 2 * n), ('PERMITTED_BY', p), ('GENERATES', 5), ('CONTROLS', 5)) AS v(item, expected)"""


@AREA.add("n1_nodes", S.with_views("chars", "nodes", body="SELECT * FROM nodes"))
def n1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes_of(S.chars(spark, sf_dir)).drop("props")


@AREA.add("n1_edges", S.with_views("chars", "edges", body="SELECT * FROM edges"))
def n1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_of(S.chars(spark, sf_dir))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load: one in four profiles again, with the resource element moved on."""
    moved = E.label_of(F.col("seq") % 5 + F.lit(1) - F.when(F.col("seq") % 5 == 4, 5).otherwise(0))
    again = F.col("sound_meaning").like("%bolt%") | F.col("sound_meaning").like("%ring%")
    return S.chars(spark, sf_dir).filter(again).withColumn("resource_ohaeng", moved).withColumn("strokes", F.col("strokes") + 1)


_AGAIN = "(sound_meaning LIKE '%bolt%' OR sound_meaning LIKE '%ring%')"


@AREA.add(
    "n2_merged_edges",
    S.with_views("chars", "edges", body=f"""SELECT DISTINCT * FROM (SELECT e.dataset, src, rel, kind, CASE WHEN kind = 'resource_ohaeng' AND {_AGAIN}
      THEN {S.label_sql('(c.seq + 1) % 5')} ELSE dst END AS dst FROM edges e JOIN chars c ON c.profile_id = e.src AND c.dataset = e.dataset
      UNION ALL SELECT dataset, profile_id, 'HAS_STROKES', '', CAST(strokes + 1 AS VARCHAR) FROM chars WHERE {_AGAIN})"""),
)
def n2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merged_edges(G.edges_of(S.chars(spark, sf_dir)), G.edges_of(changed(spark, sf_dir)))


@AREA.add(
    "n2_merged_nodes",
    S.with_views("chars", "nodes", body=f"""SELECT n.dataset, label, n.key, CASE WHEN label = 'Hanja' THEN CAST(CASE WHEN {_AGAIN} THEN strokes + 1 ELSE strokes END AS VARCHAR) ELSE '' END AS strokes
      FROM (SELECT * FROM nodes UNION SELECT dataset, 'Stroke', CAST(strokes + 1 AS VARCHAR) FROM chars WHERE {_AGAIN}) n
      LEFT JOIN chars c ON n.label = 'Hanja' AND c.profile_id = n.key AND c.dataset = n.dataset"""),
)
def n2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = G.merged_nodes(G.nodes_of(S.chars(spark, sf_dir)), G.nodes_of(changed(spark, sf_dir)))
    return merged.select("dataset", "label", "key", F.coalesce(F.get_json_object("props", "$.strokes"), F.lit("")).alias("strokes"))


@AREA.add("n3_load_plan", S.with_views("chars", "expected", body="SELECT * FROM expected"))
def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.load_plan(S.chars(spark, sf_dir))


@AREA.add(
    "n4_load_status",
    S.with_views("chars", "nodes", "edges", "expected",
      a="""SELECT dataset, label AS item, count(*) AS actual FROM nodes GROUP BY 1, 2 UNION ALL SELECT dataset, rel, count(*) FROM edges WHERE dst <> '가' GROUP BY 1, 2
        UNION ALL SELECT DISTINCT dataset, unnest(['GENERATES', 'CONTROLS']), 5 FROM chars""",
      body="SELECT dataset, item, expected, coalesce(actual, 0) AS actual, CASE WHEN coalesce(actual, 0) = expected THEN 'OK' ELSE '확인 필요' END AS status FROM expected LEFT JOIN a USING (dataset, item)"),
)
def n4(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = S.chars(spark, sf_dir)
    ring = G.category_edges(chars).withColumn("kind", F.lit(""))
    # edges to one reading are lost, which the status has to show
    edges = G.edges_of(chars).filter("dst <> '가'").unionByName(ring)
    return G.load_status(G.nodes_of(chars), edges, G.load_plan(chars))


@AREA.add(
    "n5_element_pairs",
    S.with_views("chars", body=f"""SELECT dataset, {S.label_sql('a')} AS src, CASE d WHEN 1 THEN 'GENERATES' ELSE 'CONTROLS' END AS rel, {S.label_sql('(a + d) % 5')} AS dst
      FROM (SELECT DISTINCT dataset FROM chars), range(5) AS r(a), range(1, 3) AS s(d)"""),
)
def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.category_edges(S.chars(spark, sf_dir)).select("dataset", "src", "rel", "dst")


@AREA.add(
    "n6_surname_edges",
    S.with_views("surnames", body=f"""SELECT 'ds' AS dataset, printf('SUR-%05d', surname_id) AS src, 'BELONGS_TO' AS rel, k AS kind,
      CASE k WHEN 'sound_ohaeng' THEN {S.sound_sql('hangul')} ELSE resource_ohaeng END AS dst FROM surnames, (VALUES ('sound_ohaeng'), ('resource_ohaeng')) AS t(k)"""),
)
def n6(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = S.surnames(spark, sf_dir).select(
        F.lit("ds").alias("dataset"), F.format_string("SUR-%05d", "surname_id").alias("profile_id"), "hanja", "hangul",
        code_point_label(F.col("hanja")).alias("unicode"), "strokes", E.sound_element(F.col("hangul")).alias("sound_ohaeng"), "resource_ohaeng",
        F.lit(False).alias("is_person_name_hanja"),
    )
    return G.edges_of(profiles, with_sounds=False, with_permission=False)
