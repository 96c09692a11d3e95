"""Filters and joins for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import text as X
from namesmith.operators import corpus as C
from namesmith.operators import graph as G
from namesmith.operators import lookups as L
from namesmith.plans import Registry
from namesmith.plans import sources as SRC
from namesmith.plans import standins as S

AREA = Registry()

_NORMAL = "['목','화','토','금','수'][list_position(['목','화','토','금','수','木','火','土','金','水'], {x}) - CASE WHEN list_position(['목','화','토','금','수','木','火','土','金','水'], {x}) > 5 THEN 5 ELSE 0 END]"
_STROKES = "TRY_CAST(regexp_extract(query, '(\\d+)\\s*획', 1) AS INT)"
_ELEMENT = _NORMAL.format(x="regexp_extract(query, '([木火土金水목화토금수])오행', 1)")


@AREA.add(
    "f1_character_conditions",
    S.with_views("chars", "questions", c=f"SELECT question_id, {_STROKES} AS s, {_ELEMENT} AS e FROM questions",
      k="SELECT s, e, count(c.seq) AS n FROM (SELECT DISTINCT s, e FROM c) LEFT JOIN chars c ON (s IS NULL OR c.strokes = s) AND (e IS NULL OR c.resource_ohaeng = e) GROUP BY s, e",
      body="SELECT question_id, coalesce(c.s, -1) AS strokes, coalesce(c.e, '') AS element, k.n FROM c JOIN k ON c.s IS NOT DISTINCT FROM k.s AND c.e IS NOT DISTINCT FROM k.e"),
)
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = L.condition_counts(S.questions(spark, sf_dir), S.chars(spark, sf_dir), "query")
    return counted.select("question_id", F.coalesce("strokes", F.lit(-1)).alias("strokes"), F.coalesce("element", F.lit("")).alias("element"), "n")


@AREA.add(
    "f2_chunk_conditions",
    S.with_views("questions", body=f"""SELECT question_id, CASE WHEN {S.tag_sql('query', L.TABLE_WORDS)} THEN 'table'
      WHEN {S.tag_sql('query', L.TEXT_WORDS)} THEN 'text' ELSE 'any' END AS chunk_type FROM questions"""),
)
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.questions(spark, sf_dir).select("question_id", F.coalesce(L.chunk_condition(F.col("query")), F.lit("any")).alias("chunk_type"))


# Requests with optional conditions, one per order.
S.VIEWS["requests"] = f"""SELECT o_orderkey AS request_id,
    CASE WHEN o_orderkey % 3 = 0 THEN {S.sql_list(S.SYLLABLES)}[CAST(o_custkey % 8 AS INT) + 1] END AS hangul,
    CASE WHEN o_orderkey % 5 < 2 THEN {S.label_sql('o_custkey % 5')} END AS resource_ohaeng,
    CASE WHEN o_orderkey % 7 = 0 THEN {S.label_sql('o_custkey % 4')} END AS sound_ohaeng,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 50 + 1 AS INT) END AS strokes,
    CASE WHEN o_orderkey % 6 = 1 THEN {S.sql_list(S.WORDS)}[CAST(o_custkey % 8 AS INT) + 1] END AS meaning_keyword,
    CASE WHEN o_orderkey % 2 = 0 THEN chr(CAST({S.FIRST_CHAR} + o_custkey AS INT)) END AS hanja,
    CASE WHEN o_orderkey % 11 = 0 THEN printf('OHE-%05d', o_custkey) END AS profile_id,
    CAST(o_custkey % 40 - 3 AS INT) AS lim FROM orders"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return S.table(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.when(o % 3 == 0, S.picked(S.SYLLABLES, c % 8)).alias("hangul"),
        F.when(o % 5 < 2, F.concat(F.lit(" "), E.hanja_label_of(c % 5))).alias("resource_ohaeng"),
        F.when(o % 7 == 0, E.label_of(c % 4)).alias("sound_ohaeng"),
        F.when(o % 4 == 0, (c % 50 + 1).cast("int")).alias("strokes"),
        F.when(o % 6 == 1, S.picked(S.WORDS, c % 8)).alias("meaning_keyword"),
        F.when(o % 2 == 0, X.char_of(F.lit(S.FIRST_CHAR) + c)).alias("hanja"),
        F.when(o % 11 == 0, F.format_string("OHE-%05d", c)).alias("profile_id"),
        (c % 40 - 3).cast("int").alias("limit"),
    )


@AREA.add(
    "f3_recommend_by_conditions",
    S.with_views("chars", "requests",
      d="SELECT DISTINCT hangul, resource_ohaeng, sound_ohaeng, strokes, meaning_keyword FROM requests WHERE coalesce(hangul, resource_ohaeng, sound_ohaeng, meaning_keyword) IS NOT NULL OR strokes IS NOT NULL",
      m="""SELECT d.*, c.profile_id AS pid, c.hanja AS ch, row_number() OVER (PARTITION BY d.hangul, d.resource_ohaeng, d.sound_ohaeng, d.strokes, d.meaning_keyword ORDER BY c.profile_id) AS rn
        FROM d JOIN chars c ON c.is_person_name_hanja AND (d.hangul IS NULL OR c.hangul = d.hangul) AND (d.resource_ohaeng IS NULL OR c.resource_ohaeng = d.resource_ohaeng)
        AND (d.sound_ohaeng IS NULL OR c.sound_ohaeng = d.sound_ohaeng) AND (d.strokes IS NULL OR c.strokes = d.strokes)
        AND (d.meaning_keyword IS NULL OR contains(c.sound_meaning, d.meaning_keyword))""",
      body="""SELECT request_id, CAST(m.rn AS INT) AS rank, m.pid AS profile_id, m.ch AS hanja FROM requests r JOIN m ON m.rn <= greatest(1, least(r.lim, 30))
        AND r.hangul IS NOT DISTINCT FROM m.hangul AND r.resource_ohaeng IS NOT DISTINCT FROM m.resource_ohaeng AND r.sound_ohaeng IS NOT DISTINCT FROM m.sound_ohaeng
        AND r.strokes IS NOT DISTINCT FROM m.strokes AND r.meaning_keyword IS NOT DISTINCT FROM m.meaning_keyword"""),
)
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).drop("hanja", "profile_id")
    return L.recommend_characters(asked, S.chars(spark, sf_dir).filter("is_person_name_hanja")).select("request_id", "rank", "profile_id", "hanja")


@AREA.add("f4_permitted_flag", S.with_views("chars", body="SELECT dataset, count(*) AS n, sum(strokes)::BIGINT AS strokes FROM chars WHERE is_person_name_hanja GROUP BY 1"))
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.chars(spark, sf_dir).filter("is_person_name_hanja")
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("strokes").alias("strokes"))


# Native words, one per customer: gender remarks, a few one-syllable names.
_GENDERS = ("", "주로 남자에게 쓰임", "주로 여자에게 쓰임", "남자와 여자 모두")
S.VIEWS["words"] = f"""SELECT c_custkey AS word_id, CASE WHEN c_custkey % 10 = 0 THEN chr(CAST(44032 + c_custkey % 11172 AS INT)) ELSE c_name END AS name,
    {S.sql_list(_GENDERS)}[CAST(c_nationkey % 4 AS INT) + 1] AS gender FROM customer"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return S.table(spark, sf_dir, "customer").select(
        key.alias("word_id"), F.when(key % 10 == 0, X.char_of(F.lit(44032) + key % 11172)).otherwise(F.col("c_name")).alias("name"),
        S.picked(_GENDERS, F.col("c_nationkey") % 4).alias("gender"),
    )


@AREA.add(
    "f5_gender_pools",
    S.with_views("words", p="""SELECT * FROM words, (VALUES ('all'), ('girl'), ('boy')) AS k(pool)
      WHERE pool = 'all' OR pool = 'girl' AND NOT contains(gender, '남자에게') OR pool = 'boy' AND NOT contains(gender, '여자에게')""",
      body="""SELECT pool AS want_pool, s AS want_single, count(*) AS n, sum(word_id)::BIGINT AS ids FROM p, (VALUES (true), (false)) AS t(s)
      WHERE NOT s OR length(name) = 1 GROUP BY 1, 2"""),
)
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = L.word_pools(words(spark, sf_dir), "name", "gender")
    sizes = pools.groupBy("pool", "single").agg(F.count(F.lit(1)).alias("n"), F.sum("word_id").alias("ids"))
    return L.effective_pools(pools).join(sizes, ["pool", "single"]).select("want_pool", "want_single", "n", "ids")


@AREA.add("f7_safe_limit", "SELECT o_orderkey, CAST(greatest(1, least(CASE WHEN o_orderkey % 9 = 0 THEN 10 ELSE o_custkey % 60 - 10 END, 30)) AS BIGINT) AS lim FROM orders")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") % 60 - 10)
    return S.table(spark, sf_dir, "orders").select("o_orderkey", L.safe_limit(asked).alias("lim"))


_FRAMES = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 26 AS INT) AS s, CAST(l_quantity AS INT) AS a, CAST(l_partkey % 40 AS INT) AS b FROM lineitem"""


@AREA.add(
    "j11_four_frames",
    f"""WITH t AS ({_FRAMES}), g AS (SELECT *, s > 0 AND a > 0 AND b > 0 AS ok, {S.grade_sql('a + b')} AS g1, {S.grade_sql('s + a')} AS g2, {S.grade_sql('s + b')} AS g3, {S.grade_sql('s + a + b')} AS g4 FROM t),
    c AS (SELECT *, CAST(g1 IN ('凶','大凶') AS INT) + CAST(g2 IN ('凶','大凶') AS INT) + CAST(g3 IN ('凶','大凶') AS INT) + CAST(g4 IN ('凶','大凶') AS INT) AS bad FROM g)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN ok THEN a + b ELSE 0 END AS won, CASE WHEN ok THEN s + a ELSE 0 END AS hyung,
      CASE WHEN ok THEN s + b ELSE 0 END AS yi, CASE WHEN ok THEN s + a + b ELSE 0 END AS jung, CASE WHEN ok THEN g1 ELSE '' END AS won_g, CASE WHEN ok THEN g2 ELSE '' END AS hyung_g,
      CASE WHEN ok THEN g3 ELSE '' END AS yi_g, CASE WHEN ok THEN g4 ELSE '' END AS jung_g, CASE WHEN ok THEN bad ELSE 0 END AS bad_frames, ok AND bad = 0 AS all_good FROM c""",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 26).cast("int").alias("s"), F.col("l_quantity").cast("int").alias("a"),
        (F.col("l_partkey") % 40).cast("int").alias("b"),
    )
    return L.four_frame_verdicts(rows, S.grades(spark), "s", "a", "b").drop("s", "a", "b")


@AREA.add(
    "f8_checked_inputs",
    f"""WITH t AS ({_FRAMES}) SELECT CASE WHEN s > 0 AND a > 0 AND b > 0 THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM t GROUP BY 1""",
)
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j11(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_MANUAL = (("曾", "증", "토"), ("范", "범", "목"), ("蔣", "장", "목"))
S.VIEWS["manual"] = "SELECT * FROM (VALUES ('曾','증','토'), ('范','범','목'), ('蔣','장','목')) AS t(hanja, hangul, resource_ohaeng)"
S.VIEWS["surname_dictionary"] = """SELECT f.hanja, CASE WHEN p.hanja IS NOT NULL THEN f.hangul ELSE m.hangul END AS hangul,
    coalesce(translate(p.resource_raw, '木火土金水', '목화토금수'), m.resource_ohaeng, '') AS resource_ohaeng,
    CASE WHEN p.hanja IS NULL AND m.hanja IS NULL THEN 'missing' ELSE 'ok' END AS status, f.hangul AS csv_hangul
    FROM first_readings f LEFT JOIN people p ON p.hanja = f.hanja LEFT JOIN manual m ON m.hanja = f.hanja
    UNION ALL SELECT hanja, hangul, resource_ohaeng, 'ok', hangul FROM manual WHERE hanja NOT IN (SELECT hanja FROM first_readings)"""


def surname_dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    csv = SRC.R.first_readings(SRC.surname_csv(spark, sf_dir), "hanja", "hangul", "seq")
    people = SRC.R.people_rows(SRC.people_raw(spark, sf_dir), "raw", "seq")
    manual = spark.createDataFrame(list(_MANUAL), "hanja string, hangul string, resource_ohaeng string")
    return C.surname_dictionary(csv, people, manual)


@AREA.add(
    "j1_surname_dictionary",
    S.with_views("people", "first_readings", "manual", "surname_dictionary",
      body="SELECT hanja, CASE status WHEN 'ok' THEN hangul ELSE csv_hangul END AS hangul, resource_ohaeng, status FROM surname_dictionary"),
)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, missing = surname_dictionary(spark, sf_dir)
    absent = missing.withColumn("resource_ohaeng", F.lit("")).withColumn("status", F.lit("missing"))
    return found.withColumn("status", F.lit("ok")).unionByName(absent)


@AREA.add("j2_absent_keys", S.with_views("chars", "surnames", body="SELECT surname_id, hanja FROM surnames WHERE hanja NOT IN (SELECT hanja FROM chars)"))
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.surnames(spark, sf_dir).join(S.chars(spark, sf_dir).select("hanja"), "hanja", "left_anti").select("surname_id", "hanja")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chars = S.chars(spark, sf_dir)
    return chars, G.edges_of(chars)


@AREA.add(
    "j3_permission_check",
    S.with_views("chars", q=f"SELECT o_orderkey AS request_id, chr(CAST({S.FIRST_CHAR} + o_custkey * 3 AS INT)) AS hanja FROM orders",
      k="SELECT *, row_number() OVER (PARTITION BY hanja ORDER BY profile_id, dataset) AS rn FROM chars",
      body="""SELECT request_id, q.hanja AS asked, coalesce(k.profile_id, '') AS profile_id, CASE WHEN k.hanja IS NULL THEN '결과 없음' WHEN is_person_name_hanja THEN '허용 가능'
      ELSE '허용 근거 없음' END AS status, CASE WHEN is_person_name_hanja THEN '인명용 한자 규정' ELSE '-' END AS law_name FROM q LEFT JOIN k ON k.hanja = q.hanja AND k.rn <= 20"""),
)
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), X.char_of(F.lit(S.FIRST_CHAR) + F.col("o_custkey") * 3).alias("asked")
    )
    profiles, edges = graph(spark, sf_dir)
    checked = G.permission_check(asked, "asked", profiles, edges)
    return checked.select("request_id", "asked", F.coalesce("profile_id", F.lit("")).alias("profile_id"), "status", "law_name")


@AREA.add("j4_permitted_by_edge", S.with_views("chars", body="SELECT dataset, profile_id, hanja FROM chars WHERE is_person_name_hanja"))
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, edges = graph(spark, sf_dir)
    return G.permitted(profiles, edges).select("dataset", "profile_id", "hanja")


@AREA.add(
    "j5_lookup_characters",
    S.with_views("chars", "requests",
      d="SELECT DISTINCT hanja, hangul, profile_id FROM requests WHERE coalesce(hanja, hangul, profile_id) IS NOT NULL",
      m="""SELECT d.*, c.profile_id AS pid, c.strokes AS st, row_number() OVER (PARTITION BY d.hanja, d.hangul, d.profile_id ORDER BY c.profile_id) AS rn
        FROM d JOIN chars c ON (d.hanja IS NULL OR c.hanja = d.hanja) AND (d.hangul IS NULL OR c.hangul = d.hangul) AND (d.profile_id IS NULL OR c.profile_id = d.profile_id)""",
      body="""SELECT request_id, CAST(rn AS INT) AS rank, pid AS profile_id, st AS strokes FROM requests r JOIN m ON rn <= greatest(1, least(lim, 30)) AND r.hanja IS NOT DISTINCT FROM m.hanja
        AND r.hangul IS NOT DISTINCT FROM m.hangul AND r.profile_id IS NOT DISTINCT FROM m.profile_id"""),
)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).select("request_id", "hanja", "hangul", "profile_id", "limit")
    return L.lookup_characters(asked, S.chars(spark, sf_dir)).select("request_id", "rank", "profile_id", "strokes")


@AREA.add(
    "j6_characters_by_sound",
    S.with_views("chars", q=f"SELECT o_orderkey AS request_id, {S.sql_list(S.SYLLABLES)}[CAST(o_orderkey % 8 AS INT) + 1] AS hangul, {S.label_sql('o_custkey % 5')} AS e FROM orders",
      # the permission edges of one in three brands are taken to be missing
      p="SELECT *, row_number() OVER (PARTITION BY hangul, resource_ohaeng ORDER BY profile_id) AS rn FROM chars WHERE is_person_name_hanja AND hangul <> '나'",
      body="""SELECT request_id, profile_id, 'permitted' AS origin FROM q JOIN p ON p.hangul = q.hangul AND p.resource_ohaeng = q.e AND rn <= 5
        UNION ALL SELECT request_id, profile_id, 'flagged' FROM q JOIN chars c ON c.hangul = q.hangul AND c.resource_ohaeng = q.e AND c.hangul = '나' AND is_person_name_hanja"""),
)
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles, edges = graph(spark, sf_dir)
    shown = ["hangul", "resource_ohaeng", "profile_id"]
    flagged = profiles.filter("is_person_name_hanja").select(*shown)
    asked = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), S.picked(S.SYLLABLES, F.col("o_orderkey") % 8).alias("hangul"),
        E.label_of(F.col("o_custkey") % 5).alias("resource_ohaeng"),
    )
    # one reading has no permission edge here, so its requests take the fallback
    with_edge = G.permitted(profiles, edges).filter("hangul <> '나'").select(*shown)
    return L.characters_of(asked, with_edge, flagged).select("request_id", "profile_id", "origin")


@AREA.add(
    "j7_same_reading",
    S.with_views("chars", body="""SELECT i.seq AS issue_id, c.profile_id, CAST(c.rn AS INT) AS rank FROM (SELECT seq, hangul, hanja FROM chars) i,
      LATERAL (SELECT profile_id, row_number() OVER (ORDER BY profile_id) AS rn FROM (SELECT profile_id FROM top WHERE top.hangul = i.hangul AND top.hanja <> i.hanja)) c WHERE c.rn <= 10""",
      top="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hangul ORDER BY profile_id) AS r FROM chars WHERE is_person_name_hanja) WHERE r <= 11"),
)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = S.chars(spark, sf_dir)
    issues = chars.select(F.col("seq").alias("issue_id"), "hangul", "hanja")
    return L.same_reading(issues, chars.filter("is_person_name_hanja")).select("issue_id", "profile_id", "rank")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.element_pairs(G.category_edges(S.chars(spark, sf_dir)))


@AREA.add(
    "j8_element_relations",
    f"""WITH o AS (SELECT o_orderkey, {S.sql_list(('목', '火', 'x', '토', '金', '수'))}[CAST(o_orderkey % 6 AS INT) + 1] AS asked,
      [0, 1, NULL, 2, 3, 4][CAST(o_orderkey % 6 AS INT) + 1] AS c FROM orders)
    SELECT o_orderkey, asked, CASE WHEN c IS NULL THEN 'invalid_element' ELSE 'ok' END AS status, CASE WHEN c IS NULL THEN '-' ELSE {S.label_sql('c')} END AS source,
      CASE WHEN c IS NULL THEN '-' ELSE {S.label_sql('(c + 1) % 5')} END AS generates, CASE WHEN c IS NULL THEN '-' ELSE {S.label_sql('(c + 2) % 5')} END AS controls FROM o""",
)
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "orders").select("o_orderkey", S.picked(("목", "火", "x", "토", E.COMPAT_METAL, "수"), F.col("o_orderkey") % 6).alias("asked"))
    out = G.element_relations(asked, "asked", pairs(spark, sf_dir))
    return out.withColumn("asked", F.replace("asked", F.lit(E.COMPAT_METAL), F.lit("金")))


@AREA.add(
    "j9_generating_chain",
    f"""SELECT c_custkey, {S.label_sql('c_nationkey % 5')} AS element, {S.label_sql('(c_nationkey + 1) % 5')} AS next1, {S.label_sql('(c_nationkey + 2) % 5')} AS next2,
      '→ 전체 상생: 첫째 글자 자원오행=' || {S.label_sql('(c_nationkey + 1) % 5')} || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', 둘째 글자 자원오행=' || {S.label_sql('(c_nationkey + 2) % 5')} END AS hint FROM customer""",
)
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "customer").select("c_custkey", E.label_of(F.col("c_nationkey") % 5).alias("element"))
    chained = G.generating_chain(asked, "element", pairs(spark, sf_dir))
    return chained.withColumn("hint", G.chain_hint(F.col("c_custkey") % 3 == 0))


_HOMO = f"SELECT c_custkey, chr(CAST({S.FIRST_CHAR} + c_custkey AS INT)) AS hanja, chr(CAST(44032 + (c_custkey * c_custkey) % 997 AS INT)) AS hangul, {S.label_sql('c_nationkey % 5')} AS e FROM customer"


@AREA.add(
    "j10_homophones",
    f"""WITH d AS ({_HOMO}), u AS (SELECT hangul, max(hanja) AS hanja, max(e) AS e FROM d GROUP BY hangul HAVING count(*) = 1),
    q AS (SELECT o_orderkey, chr(CAST(44032 + o_orderkey % 1200 AS INT)) AS hangul FROM orders)
    SELECT o_orderkey, q.hangul, coalesce(u.hanja, '') AS hanja, coalesce(u.e, '') AS resource_ohaeng, CASE WHEN u.hanja IS NULL THEN 'undecided' ELSE 'resolved' END AS status FROM q LEFT JOIN u USING (hangul)""",
)
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    dictionary = S.table(spark, sf_dir, "customer").select(
        X.char_of(F.lit(S.FIRST_CHAR) + key).alias("hanja"), X.char_of(F.lit(44032) + key * key % 997).alias("hangul"), E.label_of(F.col("c_nationkey") % 5).alias("resource_ohaeng")
    )
    asked = S.table(spark, sf_dir, "orders").select("o_orderkey", X.char_of(F.lit(44032) + F.col("o_orderkey") % 1200).alias("hangul"))
    return L.resolve_homophones(asked, dictionary).fillna("", ["hanja", "resource_ohaeng"])


@AREA.add(
    "j12_name_statistics",
    """WITH q AS (SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS asked FROM orders)
    SELECT o_orderkey, asked, c_custkey IS NOT NULL AS found, coalesce(c_mktsegment, '') AS segment, coalesce(c_custkey, -1) AS c_custkey FROM q LEFT JOIN customer ON trim(c_name) = asked""",
)
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("  Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"), F.lit(" ")).alias("asked")
    )
    out = L.name_statistics(asked, "asked", SRC.R.name_table(S.table(spark, sf_dir, "customer")))
    return out.select(
        "o_orderkey", F.trim("asked").alias("asked"), "found", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey")
    )


_SN = "regexp_extract(query, '(?s)([가-힣]{1,2})씨(.*)', %d)"
S.VIEWS["element_dictionary"] = """SELECT hanja, resource_ohaeng FROM (SELECT hanja, resource_ohaeng, row_number() OVER (PARTITION BY hanja ORDER BY src, k) AS rn FROM
    (SELECT hanja, resource_ohaeng, 0 AS src, seq AS k FROM chars UNION ALL SELECT hanja, resource_ohaeng, 1, surname_id FROM surnames)) WHERE rn = 1"""
S.VIEWS["resolved"] = f"""SELECT question_id, surname, coalesce(hanja, '') AS hanja, coalesce(e, '') AS resource_ohaeng FROM (SELECT q.*, t.hanja, d.resource_ohaeng AS e,
      row_number() OVER (PARTITION BY q.question_id ORDER BY d.resource_ohaeng IS NULL, t.pos) AS rn FROM
      (SELECT question_id, coalesce(nullif(regexp_extract(query, '([가-힣]{{1,2}})씨\\s*[（\\(]([一-鿿]{{1,2}})[）\\)]', 1), ''),
          nullif(regexp_extract(query, '([가-힣]{{1,2}})\\s*[（\\(]([一-鿿]{{1,2}})[）\\)]\\s*씨', 1), ''), {_SN % 1}, '') AS surname,
        coalesce(nullif(regexp_extract(query, '([가-힣]{{1,2}})씨\\s*[（\\(]([一-鿿]{{1,2}})[）\\)]', 2), ''),
          nullif(regexp_extract(query, '([가-힣]{{1,2}})\\s*[（\\(]([一-鿿]{{1,2}})[）\\)]\\s*씨', 2), '')) AS br,
        list_filter(regexp_extract_all({_SN % 2}, '[一-鿿]+(?:오행)?'), lambda r: regexp_full_match(r, '[一-鿿]{{1,2}}')) AS runs FROM questions) q
      LEFT JOIN LATERAL (SELECT CASE WHEN br IS NOT NULL THEN br ELSE runs[pos] END AS hanja, pos FROM range(1, 30) AS g(pos) WHERE pos <= CASE WHEN br IS NOT NULL THEN 1 ELSE len(runs) END) t ON true
      LEFT JOIN element_dictionary d ON d.hanja = t.hanja) WHERE rn = 1"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = L.element_dictionary(S.chars(spark, sf_dir), S.surnames(spark, sf_dir), "seq")
    return L.resolve_surnames(S.questions(spark, sf_dir), dictionary, "question_id", "query")


@AREA.add("j13_resolved_surnames", S.with_views("chars", "surnames", "questions", "element_dictionary", "resolved", body="SELECT * FROM resolved"))
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)


@AREA.add(
    "j14_forbidden_next",
    f"""WITH e AS (SELECT CAST(l_partkey % 5 AS INT) AS a, CAST(l_suppkey % 5 AS INT) AS b FROM lineitem)
    SELECT {S.label_sql('a')} AS element, {S.label_sql('b')} AS forbidden, count(*) AS n FROM e WHERE (b - a + 5) % 5 IN (2, 3) GROUP BY 1, 2""",
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.broadcast(L.forbidden_next(pairs(spark, sf_dir)))  # at most ten rows
    seen = S.table(spark, sf_dir, "lineitem").select(E.label_of(F.col("l_partkey") % 5).alias("element"), E.label_of(F.col("l_suppkey") % 5).alias("forbidden"))
    return seen.join(rule, ["element", "forbidden"], "left_semi").groupBy("element", "forbidden").agg(F.count(F.lit(1)).alias("n"))
