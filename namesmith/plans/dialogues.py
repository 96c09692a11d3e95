"""Conversations with naming sentences added, and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.operators import dialogue as D
from namesmith.plans import Registry
from namesmith.plans import standins as S

AREA = Registry()

# Sentences added to the turns so that every branch occurs.
_ASSISTANT = ("\n## [이름 1] 김서연 (字)\n## [이름 2] {s}하나 (字)", " 아래 정보를 알려주세요", "", "\n## [이름 3] {s}지")
_USER = ("{s}씨 성의 한자 이름 3개 추천해줘.", "2 개 더 추천해줘", "순우리말 이름도 추가로 4개", "딸이에요 林", "고마워", "이름 하나만 작명 추천 해 줘")
_TURNS = f"""SELECT conv_id, turn, role, text || CASE role WHEN 'assistant' THEN replace({S.sql_list(_ASSISTANT)}[CAST((conv_id + turn) % 4 AS INT) + 1], '{{s}}', {S.sql_list(S.SYLLABLES)}[CAST(turn % 8 AS INT) + 1])
    WHEN 'user' THEN replace({S.sql_list(_USER)}[CAST((conv_id * 5 + turn // 2) % 6 AS INT) + 1], '{{s}}', {S.sql_list(S.SYLLABLES)}[CAST(conv_id % 8 AS INT) + 1]) ELSE '' END AS text FROM conversations"""
S.VIEWS["turns"] = _TURNS


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    assistant = F.replace(S.picked(_ASSISTANT, (conv + turn) % 4), F.lit("{s}"), S.picked(S.SYLLABLES, turn % 8))
    user = F.replace(S.picked(_USER, (conv * 5 + F.floor(turn / 2)) % 6), F.lit("{s}"), S.picked(S.SYLLABLES, conv % 8))
    added = F.when(F.col("role") == "assistant", assistant).when(F.col("role") == "user", user).otherwise("")
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat("text", added).alias("text"))


_W = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
S.VIEWS["history"] = f"""SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) {_W} AS pa, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) {_W} AS pu,
    first_value(CASE WHEN role = 'user' AND {S.tag_sql('text', D.CONTEXT)} THEN text END IGNORE NULLS) {_W} AS fc, last_value(CASE WHEN role = 'user' AND {S.tag_sql('text', D.REQUEST)} THEN text END IGNORE NULLS) {_W} AS lr,
    last_value(CASE WHEN role = 'user' AND contains(text, '씨') AND {S.tag_sql('text', D.CONTEXT)} THEN text END IGNORE NULLS) {_W} AS sb,
    last_value(CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '[一-鿿]{{1,2}}'), '') END IGNORE NULLS) {_W} AS lc, count(*) {_W} AS before,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN nullif(array_to_string(regexp_extract_all(text, '##\\s*\\[이름\\s*\\d+\\]\\s*([가-힣]{{2,5}})', 1), ', '), '') END, ', ') {_W}, '') AS names FROM turns"""


@AREA.add("t1_previous_names", S.with_views("turns", "history", body="SELECT conv_id, turn, role, names AS prev_names FROM history"))
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.previous_names(turns(spark, sf_dir), "conv_id", "turn", "role", "text")
    return out.withColumn("prev_names", F.array_join("prev_names", ", "))


def _sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _strip(x: str) -> str:
    return _sub(x, "^\\s+|\\s+$")


_NOTE = "CASE WHEN names <> '' THEN ' (이미 추천한 이름: ' || names || ' 제외)' ELSE '' END"
_COUNT = "coalesce(nullif(regexp_extract(text, '(\\d+\\s*개)', 1), ''), '3개')"
_KIND_WORD = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{w}'" for w in D.NATIVE) + " END"
_BASE = _strip(_sub("coalesce(sb, '이름')", "(한자\\s*이름|순우리말\\s*이름|우리말\\s*이름|한글\\s*이름)"))
_SWITCHED = _strip(_sub(f"{_BASE} || ' ' || {_KIND_WORD} || ' ' || {_COUNT} || ' 추천해줘' || coalesce(' 성씨 한자: ' || lc, '') || {_NOTE}", "\\s+", " "))
_PLAIN = _strip(_sub(_sub(_strip("lr"), "(하나만?|한\\s*개만?|\\d+\\s*개만?)"), "(추천\\s*해\\s*줘|추천\\s*해\\s*주세요|추천해)"))
_AGAIN = f"CASE WHEN lr IS NOT NULL THEN rtrim({_strip(_sub(_PLAIN, chr(92) + 's+', ' '))}, '.') || ' ' ELSE '이름 ' END || {_COUNT} || ' 추천해줘' || {_NOTE}"


@AREA.add(
    "t2_resolved_requests",
    S.with_views("turns", "history", k=f"""SELECT *, CASE WHEN before = 0 THEN 'unchanged' WHEN coalesce(contains(pa, '아래 정보를 알려주세요'), false) AND coalesce(pu, '') <> '' THEN 'clarified'
      WHEN {S.tag_sql('text', D.CONTINUATION)} THEN CASE WHEN {S.tag_sql('text', D.NATIVE)} THEN 'switched' ELSE 'continued' END
      WHEN {S.tag_sql('text', D.REQUEST)} AND names <> '' THEN 'fresh' ELSE 'unchanged' END AS kind FROM history WHERE role = 'user'""",
      body=f"""SELECT conv_id, turn, kind, CASE kind WHEN 'clarified' THEN CASE WHEN fc IS NOT NULL AND fc <> pu THEN fc || ' ' ELSE '' END || pu || ' ' || text WHEN 'switched' THEN {_SWITCHED} WHEN 'continued' THEN {_AGAIN}
        WHEN 'fresh' THEN text || ' (이미 추천한 이름 [' || names || ']과 겹치지 않는 다른 이름으로)' ELSE text END AS query FROM k"""),
)
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolved_requests(turns(spark, sf_dir), "conv_id", "turn", "role", "text")


_LEAK = "'[원본 추천 결과]' || chr(10) || text || chr(10) || '[참고 정보] a' || chr(10) || 'b' || CASE doc_id % 3 WHEN 0 THEN '' ELSE chr(10) || '--- end [원본 추천 결과] [참고 정보] z' END"


@AREA.add(
    "t3_cleaned_outputs",
    f"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace({_LEAK}, '[원본 추천 결과]' || chr(10), ''), '[원본 추천 결과]', ''), '(?s)\\[참고 정보\\].*?(---|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS output FROM documents""",
)
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, "").otherwise("\n--- end [원본 추천 결과] [참고 정보] z")
    leaky = F.concat(F.lit("[원본 추천 결과]\n"), "text", F.lit("\n[참고 정보] a\nb"), tail)
    return S.table(spark, sf_dir, "documents").select("doc_id", D.cleaned_output(leaky).alias("output"))


_OUT = f"CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '## [이름 1] ' END || {S.sql_list(S.SYLLABLES)}[CAST(o_custkey % 8 AS INT) + 1] || chr(CAST(44032 + o_custkey % 500 AS INT)) || ' (' || o_orderkey || ')'"


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namesmith.functions.text import char_of

    head = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("## [이름 1] ")
    text = F.concat(head, S.picked(S.SYLLABLES, F.col("o_custkey") % 8), char_of(F.lit(44032) + F.col("o_custkey") % 500), F.lit(" ("), "o_orderkey", F.lit(")"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", text.alias("output"))


@AREA.add(
    "t4_deduplicated_pairs",
    f"""WITH x AS (SELECT o_orderkey, o_orderstatus, {_OUT} AS output FROM orders), n AS (SELECT *, nullif(regexp_extract(output, '## \\[이름 1\\]\\s*([가-힣]+)', 1), '') AS name FROM x)
    SELECT o_orderkey, o_orderstatus, output FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o_orderkey) AS rn FROM n) WHERE name IS NULL OR rn = 1""",
)
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.deduplicated(outputs(spark, sf_dir), "o_orderkey", "output")


@AREA.add("t5_usable_responses", "SELECT event_id, event_type FROM events WHERE event_id % 7 NOT IN (0, 1) AND event_type <> 'error'")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 7 == 1, "Rate limit hit").when(F.col("event_type") == "error", "Error: x").otherwise(F.col("event_type"))
    return S.table(spark, sf_dir, "events").filter(D.usable_response(response)).select("event_id", "event_type")


def _hash(seed: str, size: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('prompt:{seed}:' || o_orderkey), 1, 8) AS BIGINT) % {size} AS INT)"


@AREA.add(
    "t6_name_prompts",
    f"""SELECT o_orderkey, {S.sql_list(tuple(D.SURNAMES))}[{_hash('surname', 24)} + 1] || '씨 성을 가진 ' || ['남자아이', '여자아이'][{_hash('gender', 2)} + 1] || ' ' || CASE WHEN {_hash('kind', 100)} < 60 THEN '한자'
      WHEN {_hash('kind', 100)} < 80 THEN '순우리말(한글)' ELSE '외자(한 글자) 한자' END || ' 이름 1개를 추천해줘. 성은 ' || {S.sql_list(tuple(D.SURNAMES.values()))}[{_hash('surname', 24)} + 1] || '야' AS prompt FROM orders""",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.name_prompts(S.table(spark, sf_dir, "orders"), "o_orderkey")


S.VIEWS["pairs"] = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN '인명용 한자 ''' || lang || '''의 뜻, 획수, 오행 정보를 알려줘.' WHEN 2 THEN '가족관계의 등록 등에 관한 법률 및 인명용 한자 관련 조항을 설명해줘.'
    ELSE source || '에 대해 설명해줘.' END AS instruction, CASE WHEN doc_id % 10 = 0 THEN source ELSE '' END AS input, text AS output FROM documents WHERE doc_id % 5 <> 4"""


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    pair = F.to_json(F.struct(F.col("lang").alias("instruction"), F.when(F.col("doc_id") % 10 == 0, F.col("source")).alias("input"), F.col("text").alias("output")))

    def doc(meta):
        return F.to_json(F.struct(F.col("text").alias("document"), meta.alias("metadata")))

    kind = F.when(k == 1, "hanja").when(k == 2, "law").otherwise("other")
    document = doc(F.create_map(F.lit("type"), kind, F.lit("hanja"), F.col("lang"), F.lit("collection"), F.col("source")))
    raw = F.when(k == 0, pair).when(k == 4, F.to_json(F.struct(F.col("text").alias("document")))).otherwise(document)
    return S.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@AREA.add("t7_training_pairs", S.with_views("pairs", body="SELECT * FROM pairs"))
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.training_pairs(training_rows(spark, sf_dir), "raw", ["doc_id"])


@AREA.add(
    "t8_chat_texts",
    S.with_views("pairs", body="""SELECT doc_id, '<|im_start|>user' || chr(10) || instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || output || '<|im_end|>' AS text FROM pairs"""),
)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t7(spark, sf_dir).select("doc_id", D.chat_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text"))
