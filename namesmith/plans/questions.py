"""Question rules over one question per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators import graph as G
from namesmith.operators import questions as Q
from namesmith.plans import Registry
from namesmith.plans import lookups as LP
from namesmith.plans import standins as S

AREA = Registry()

_FIRST = " ".join(f"WHEN contains(query, '{x}') THEN '{y}'" for x, y in zip("목화토금수木火土金水", "목화토금수목화토금수"))
_CLEAN = "replace(replace(replace(query, '발음오행', ' '), '자원오행', ' '), '오행', ' ')"


def _first(*alternatives: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({a}, '')" for a in alternatives) + ")"


def _stem(x: str) -> str:
    cases = " ".join(f"WHEN length({x}) > {len(s)} AND suffix({x}, '{s}') THEN left({x}, length({x}) - {len(s)})" for s in Q.SUFFIXES)
    return f"CASE {cases} ELSE {x} END"


_MEANINGS = "CASE " + " ".join(f"WHEN contains(query, '{w}') THEN '{w}'" for w in Q.MEANINGS) + " END"
S.VIEWS["extracts"] = f"""SELECT question_id, query, upper(nullif(regexp_extract(query, '(?i)\\b(OHE-[0-9]{{5}})\\b', 1), '')) AS profile_id,
    regexp_extract_all(query, '[㐀-䶿一-鿿]') AS chars, CASE {_FIRST} END AS element, TRY_CAST(regexp_extract(query, '([0-9]{{1,2}})\\s*획', 1) AS INT) AS strokes,
    {_first(f"regexp_extract({_CLEAN}, '(?:음|독음|발음|한글[ ]*음)[ ]*(?:은|는|이|가|:)?[ ]*([가-힣])', 1)", f"regexp_extract({_CLEAN}, '([가-힣])[ ]*(?:음|독음)', 1)")} AS sound,
    coalesce({_stem("nullif(regexp_extract(query, '([가-힣]{1,8})[ ]*(?:뜻|의미)', 1), '')")},
      {_stem("nullif(regexp_extract(query, '(?:뜻|의미)[ ]*(?:이|가|은|는|으로|와|과|:)?[ ]*[''“”‘’]?([가-힣]{1,8})', 1), '')")}, {_MEANINGS}) AS meaning FROM questions"""
S.VIEWS["routed"] = f"""SELECT *, CASE WHEN {S.tag_sql('query', Q.STATUS_WORDS)} AND len(chars) = 0 AND profile_id IS NULL THEN 'check_graph_status'
    WHEN {S.tag_sql('query', Q.PERMISSION_WORDS)} THEN CASE WHEN len(chars) > 0 THEN 'check_person_name_hanja' ELSE 'needs_hanja_for_permission' END
    WHEN element IS NOT NULL AND {S.tag_sql('query', Q.RELATION_WORDS)} AND NOT contains(query, '추천') THEN 'get_ohaeng_relations'
    WHEN {S.tag_sql('query', Q.RECOMMEND_WORDS)} AND (element IS NOT NULL OR coalesce(strokes, 0) <> 0 OR sound IS NOT NULL OR meaning IS NOT NULL) THEN 'recommend_hanja_by_ohaeng'
    WHEN profile_id IS NOT NULL OR len(chars) > 0 OR sound IS NOT NULL THEN 'lookup_hanja' ELSE 'unsupported' END AS tool FROM extracts"""


def nonnull(name: str, default="") -> F.Column:
    return F.coalesce(name, F.lit(default)).alias(name)


@AREA.add(
    "q1_extracted_terms",
    S.with_views("questions", "extracts", body="""SELECT question_id, coalesce(profile_id, '') AS profile_id, array_to_string(chars, '') AS characters, coalesce(element, '') AS element,
      coalesce(strokes, -1) AS strokes, coalesce(sound, '') AS sound FROM extracts"""),
)
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Q.extracted(S.questions(spark, sf_dir), "query")
    return df.select("question_id", nonnull("profile_id"), F.array_join("characters", "").alias("characters"), nonnull("element"), nonnull("strokes", -1), nonnull("sound"))


@AREA.add("q2_meaning_keywords", S.with_views("questions", "extracts", body="SELECT question_id, coalesce(meaning, '') AS meaning FROM extracts"))
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.questions(spark, sf_dir).select("question_id", F.coalesce(Q.meaning_in(F.col("query")), F.lit("")).alias("meaning"))


@AREA.add("q3_routed_questions", S.with_views("questions", "extracts", "routed", body="SELECT question_id, query, tool FROM routed"))
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.classified(S.questions(spark, sf_dir), "query").select("question_id", "query", "tool")


S.VIEWS["recommended"] = """SELECT * FROM (SELECT r.question_id, c.profile_id AS pid, c.hanja || ' ' || c.hangul || ' ' || c.strokes AS shown,
      row_number() OVER (PARTITION BY r.question_id ORDER BY c.profile_id) AS rank FROM routed r JOIN chars c ON c.is_person_name_hanja
      AND (r.element IS NULL OR CASE WHEN contains(r.query, '발음') THEN c.sound_ohaeng ELSE c.resource_ohaeng END = r.element) AND (r.sound IS NULL OR c.hangul = r.sound)
      AND (r.strokes IS NULL OR c.strokes = r.strokes) AND (r.meaning IS NULL OR contains(c.sound_meaning, r.meaning)) WHERE r.tool = 'recommend_hanja_by_ohaeng') WHERE rank <= 10"""
# meanings of the stand-in characters are English; questions ask in Korean, so one word is carried over
_RING = "replace(sound_meaning, 'ring', '밝은 ring')"


def korean_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chars(spark, sf_dir).withColumn("sound_meaning", F.replace("sound_meaning", F.lit("ring"), F.lit("밝은 ring")))


_CHARS = f"SELECT * REPLACE ({_RING} AS sound_meaning) FROM ({S.VIEWS['chars']})"


def _with_korean(*names: str, body: str) -> str:
    return S.with_views("questions", "extracts", "routed", body="SELECT 1").replace("\nSELECT 1", "") + f",\nchars AS ({_CHARS})" + "".join(
        f",\n{n} AS ({S.VIEWS[n]})" for n in names
    ) + "\n" + body


@AREA.add("g5_recommended_characters", _with_korean("recommended", body="SELECT question_id, CAST(rank AS INT) AS rank, pid AS profile_id FROM recommended"))
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = Q.classified(S.questions(spark, sf_dir), "query")
    permitted = korean_chars(spark, sf_dir).filter("is_person_name_hanja")
    return Q.recommended(routed, "question_id", "query", permitted).select("question_id", "rank", "profile_id")


@AREA.add(
    "q4_answered_questions",
    _with_korean("recommended", body=f"""SELECT question_id, 'recommend_hanja_by_ohaeng' AS tool, CAST(rank AS INT) AS rank, pid AS key, shown AS value FROM recommended
      UNION ALL SELECT question_id, tool, CAST(rk AS INT), pid, shown FROM (SELECT r.*, c.profile_id AS pid, c.hanja || ' ' || c.hangul || ' ' || c.strokes AS shown, row_number() OVER (PARTITION BY question_id ORDER BY c.profile_id) AS rk
        FROM routed r JOIN chars c ON CASE WHEN r.profile_id IS NOT NULL THEN c.profile_id = r.profile_id WHEN len(r.chars) > 0 THEN c.hanja = r.chars[1] ELSE c.hangul = r.sound END WHERE tool = 'lookup_hanja') WHERE rk <= 10
      UNION ALL SELECT question_id, tool, CAST(row_number() OVER (PARTITION BY question_id ORDER BY c.profile_id) AS INT), coalesce(c.profile_id, ''),
        CASE WHEN c.profile_id IS NULL THEN '결과 없음' WHEN is_person_name_hanja THEN '허용 가능' ELSE '허용 근거 없음' END FROM routed r LEFT JOIN chars c ON c.hanja = r.chars[1] WHERE tool = 'check_person_name_hanja'
      UNION ALL SELECT question_id, tool, CAST(1 AS INT), element, {S.label_sql(f"({S.code_sql('element')} + 1) % 5")} || '/' || {S.label_sql(f"({S.code_sql('element')} + 2) % 5")} FROM routed WHERE tool = 'get_ohaeng_relations'
      UNION ALL SELECT question_id, tool, CAST(1 AS INT), '', CASE tool WHEN 'unsupported' THEN '처리할 수 없는 질문 유형' WHEN 'needs_hanja_for_permission' THEN '한자를 포함해 질문해주세요'
        ELSE (SELECT count(*) || ' characters' FROM chars) END FROM routed WHERE tool IN ('unsupported', 'needs_hanja_for_permission', 'check_graph_status')"""),
)
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = korean_chars(spark, sf_dir)
    status = G.nodes_of(profiles).filter("label = 'Hanja'").agg(F.concat(F.count(F.lit(1)), F.lit(" characters")).alias("value"))
    return Q.answered(S.questions(spark, sf_dir), "question_id", "query", profiles, G.edges_of(profiles), LP.pairs(spark, sf_dir), status)


_NUMS = "regexp_extract_all(query, '[0-9]+')"
_TRIPLE = "regexp_extract_all(query, '[木火土金水]')"
_LUCKY, _COMBO = S.tag_sql("query", Q.LUCKY_WORDS), S.tag_sql("query", Q.TRIPLE_WORDS)


@AREA.add(
    "q5_calculation_routes",
    S.with_views("questions", body=f"""SELECT question_id, CASE WHEN {_LUCKY} THEN CASE WHEN len({_NUMS}) > 0 THEN 'lucky' ELSE 'guide_surname' END
      WHEN {_COMBO} THEN CASE WHEN len({_TRIPLE}) >= 3 THEN 'triple' ELSE 'guide_triple' END WHEN len({_NUMS}) >= 3 THEN 'frames' WHEN len({_NUMS}) = 1 THEN 'lucky' ELSE 'guide_strokes' END AS route,
      CASE WHEN {_LUCKY} THEN coalesce({_NUMS}[1], '') WHEN {_COMBO} THEN CASE WHEN len({_TRIPLE}) >= 3 THEN array_to_string({_TRIPLE}[1:3], ',') ELSE '' END
      WHEN len({_NUMS}) >= 3 THEN array_to_string({_NUMS}[1:3], ',') WHEN len({_NUMS}) = 1 THEN {_NUMS}[1] ELSE '' END AS arguments FROM questions"""),
)
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    route, args = Q.calculation_route(F.col("query"))
    return S.questions(spark, sf_dir).select("question_id", route.alias("route"), args.alias("arguments"))


def _stated(prefix: str) -> str:
    return f"""coalesce(translate(nullif(regexp_extract(query, '{prefix}([木火土金水])오행', 1), ''), '木火土金水', '목화토금수'), regexp_extract(query, '{prefix}([목화토금수])오행', 1))"""


_NATIVE = f"({S.tag_sql('query', Q.NATIVE)} OR contains(query, '우리말'))"


@AREA.add(
    "q6_question_traits",
    S.with_views("questions", body=f"""SELECT question_id, {_stated('')} AS element, {_stated('성에[ ]*')} AS surname_element, {S.tag_sql('query', Q.SINGLE)} AS single,
      {_NATIVE} AND contains(query, '한자') AS "both", {_NATIVE} AND NOT contains(query, '한자') AS native, {S.tag_sql('query', Q.GIRL)} AS girl, {S.tag_sql('query', Q.BOY)} AS boy,
      CAST(least(coalesce(TRY_CAST(regexp_extract(query, '([0-9]+)[ ]*개', 1) AS HUGEINT), 0), 999999999) AS INT) AS requested, '최근 2010~2020년대 ' || CASE WHEN {S.tag_sql('query', Q.GIRL)} THEN '여성' WHEN {S.tag_sql('query', Q.BOY)} THEN '남성' ELSE '남녀' END
      || ' 이름 선호 경향 트렌드 특징 받침 음절 패턴' AS paper_query FROM questions"""),
)
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.questions(spark, sf_dir).select("question_id", *[c.alias(n) for n, c in Q.traits(F.col("query")).items()])


@AREA.add(
    "q7_missing_slots",
    S.with_views("chars", "surnames", "questions", "element_dictionary", "resolved", body=f"""SELECT question_id, coalesce(nullif(array_to_string(list_filter([CASE WHEN NOT {S.tag_sql('query', Q.ANY_GENDER)} THEN 'gender' END,
      CASE WHEN NOT {S.tag_sql('query', Q.ANY_TYPE)} THEN 'type' END, CASE WHEN surname <> '' AND hanja = '' AND NOT ({S.tag_sql('query', Q.NATIVE)} AND NOT contains(query, '한자')) THEN 'surname' END], lambda x: x IS NOT NULL), ','), ''), 'more') AS missing
      FROM resolved JOIN questions USING (question_id)"""),
)
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.questions(spark, sf_dir).join(LP.resolved(spark, sf_dir), "question_id")
    return Q.missing_slots(found, "query").select("question_id", "missing")


_REPLIES = (
    '```json\n{"next": "internal_rag", "collections": ["hanja_col", "bad", "paper_col"]}\n```', 'so {"next": "graph_db", "collections": "x"} done',
    '{"next": "generate"}', "no json", '```json\n{"next": "sql_db", broken}\n``` {"next": "clarify", "collections": []}', '{"next": "dance"} {"next": "sql_db"}',
    '```json {"next": "dance"} ``` then', '{"next": "external_api", "collections": ["law_col"], "reason": "r"}',
)
# expected per reply: action and collections where the action has not been used yet
_EXPECTED = (("internal_rag", "hanja_col,paper_col"), ("graph_db", ""), ("generate", ""), ("generate", ""), ("generate", ""), ("generate", ""), ("generate", ""), ("external_api", "law_col"))


@AREA.add(
    "q8_routing_replies",
    f"""WITH e AS (SELECT event_id, CAST(event_id % 8 AS INT) + 1 AS i, {S.sql_list(tuple(a for a, _ in _EXPECTED))} AS a, {S.sql_list(tuple(c for _, c in _EXPECTED))} AS c, ['internal_rag', 'law', 'graph_db', 'clarify', 'external_api'][CAST(user_id % 5 AS INT) + 1] AS used FROM events)
    SELECT event_id, CASE WHEN a[i] = used THEN 'generate' ELSE a[i] END AS action, CASE WHEN a[i] = used THEN '' ELSE c[i] END AS collections FROM e""",
)
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.array(S.picked(("internal_rag", "law", "graph_db", "clarify", "external_api"), F.col("user_id") % 5))
    reply = Q.routing_reply(S.picked(_REPLIES, F.col("event_id") % 8), used)
    return S.table(spark, sf_dir, "events").select("event_id", reply.alias("r")).select("event_id", "r.action", F.array_join("r.collections", ",").alias("collections"))


_QUOTED, _BARE = "regexp_extract_all(query, '[''\"]([가-힣]+)[''\"]', 1)", "regexp_extract_all(query, '([가-힣]{2,4})(?:이|가|은|는|이라는|라는)', 1)"


@AREA.add(
    "q9_words_to_verify",
    S.with_views("questions", body=f"""SELECT question_id, CASE WHEN {S.tag_sql('query', Q.VERIFY_WORDS)} THEN array_to_string((CASE WHEN len({_QUOTED}) > 0 THEN {_QUOTED} ELSE {_BARE} END)[1:3], ',') ELSE '' END AS words FROM questions"""),
)
def q9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.questions(spark, sf_dir).select("question_id", F.array_join(Q.words_to_verify(F.col("query")), ",").alias("words"))
