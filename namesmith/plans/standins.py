"""Stand-in inputs derived from the given tables, in Spark and in SQL.

The dictionaries and word lists the operators are written for are not available, so
each is modelled as a projection of a given table. A view and its SQL twin hold the
same rows; registered queries read the former, their SQL the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.once import computed_once
from namesmith.functions.text import char_of, code_point_label

# First words of part names and the syllable each stands for.
WORDS = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
SYLLABLES = ("가", "나", "하", "서", "민", "지", "보", "윤")
FIRST_CHAR = 0x4E00
CHAR_SPAN = 20992


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table for work that is long per row. A file of small rows is one task or a few, and their number
    is given: by the size of so small rows they would be put together again."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def picked(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_list(values: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def reading_of(name: Column) -> Column:
    first = F.substring_index(name, " ", 1)
    out = F.lit("")
    for word, syllable in zip(reversed(WORDS), reversed(SYLLABLES)):
        out = F.when(first == word, F.lit(syllable)).otherwise(out)
    return out


def chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character profiles, one per part."""
    key = F.col("p_partkey")
    hangul = reading_of(F.col("p_name"))
    hanja = char_of(F.lit(FIRST_CHAR) + key % CHAR_SPAN)
    return table(spark, sf_dir, "part").select(
        key.alias("seq"),
        F.col("p_brand").alias("dataset"),
        F.format_string("OHE-%05d", key + 1).alias("profile_id"),
        hangul.alias("hangul"),
        hanja.alias("hanja"),
        code_point_label(hanja).alias("unicode"),
        F.col("p_name").alias("sound_meaning"),
        F.col("p_size").alias("strokes"),
        E.sound_element(hangul).alias("sound_ohaeng"),
        E.label_of(key % 5).alias("resource_ohaeng"),
        (F.col("p_type") != "PROMO").alias("is_person_name_hanja"),
    )


def surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surname profiles, one per supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("surname_id"),
        char_of(F.lit(FIRST_CHAR) + (key * 37) % CHAR_SPAN).alias("hanja"),
        picked(SYLLABLES, key % 8).alias("hangul"),
        (key % 25 + 1).cast("int").alias("strokes"),
        E.label_of(F.col("s_nationkey") % 5).alias("resource_ohaeng"),
    )


def grades(spark: SparkSession) -> DataFrame:
    """Grade of each number 1..81 by rule; a lookup input of the frame operators."""
    n = F.col("id").cast("int")
    return spark.range(1, 82).select(
        n.alias("num"),
        F.format_string("%d격(格)", n).alias("gyeok"),
        F.format_string("%d운(運)", n).alias("fortune"),
        F.when(n % 7 == 0, "大凶").when(n % 5 == 0, "大吉").when(n % 3 == 0, "凶").when(n % 4 == 0, "半吉")
        .when(n % 11 == 0, "中吉").otherwise("吉").alias("grade"),
        F.format_string("풀이 %d", n).alias("description"),
    )


_GRADE_SQL = (
    "CASE WHEN n % 7 = 0 THEN '大凶' WHEN n % 5 = 0 THEN '大吉' WHEN n % 3 = 0 THEN '凶' "
    "WHEN n % 4 = 0 THEN '半吉' WHEN n % 11 = 0 THEN '中吉' ELSE '吉' END"
)


def label_sql(code: str) -> str:
    return f"substr('목화토금수', CAST({code} AS INT) + 1, 1)"


def code_sql(label: str) -> str:
    return f"(strpos('목화토금수', {label}) - 1)"


def sound_sql(reading: str) -> str:
    by_initial = sql_list([E.INITIAL_ELEMENT.get(c, "") for c in E.INITIALS])
    point = f"unicode({reading})"
    return (
        f"CASE WHEN {point} BETWEEN 44032 AND 55203 "
        f"THEN {by_initial}[CAST(floor(({point} - 44032) / 588) AS INT) + 1] ELSE '' END"
    )


def relation_sql(a: str, b: str) -> str:
    """Name rule on element codes."""
    d = f"(({b} - {a} + 5) % 5)"
    return f"CASE WHEN {d} = 1 THEN '상생' WHEN {d} IN (2, 3) THEN '상극' ELSE '중립' END"


def grade_sql(n: str) -> str:
    """Grade of a raw sum, for use where a join would be clumsy."""
    wrapped = f"((({n}) - 1) % 81 + 1)"
    return "(" + _GRADE_SQL.replace("n %", f"{wrapped} %") + ")"


_READING_SQL = (
    f"{sql_list(SYLLABLES)}[list_position({sql_list(WORDS)}, split_part(p_name, ' ', 1))]"
)
_HANJA_SQL = f"chr(CAST({FIRST_CHAR} + p_partkey % {CHAR_SPAN} AS INT))"

VIEWS: dict[str, str] = {
    "chars": f"""SELECT p_partkey AS seq, p_brand AS dataset,
        printf('OHE-%05d', p_partkey + 1) AS profile_id, {_READING_SQL} AS hangul, {_HANJA_SQL} AS hanja,
        printf('U+%04X', unicode({_HANJA_SQL})) AS unicode, p_name AS sound_meaning, p_size AS strokes,
        {sound_sql(_READING_SQL)} AS sound_ohaeng, {label_sql('p_partkey % 5')} AS resource_ohaeng,
        p_type <> 'PROMO' AS is_person_name_hanja FROM part""",
    "surnames": f"""SELECT s_suppkey AS surname_id,
        chr(CAST({FIRST_CHAR} + (s_suppkey * 37) % {CHAR_SPAN} AS INT)) AS hanja,
        {sql_list(SYLLABLES)}[CAST(s_suppkey % 8 AS INT) + 1] AS hangul,
        CAST(s_suppkey % 25 + 1 AS INT) AS strokes,
        {label_sql('s_nationkey % 5')} AS resource_ohaeng FROM supplier""",
    "grades": f"""SELECT CAST(n AS INT) AS num, n || '격(格)' AS gyeok, n || '운(運)' AS fortune,
        {_GRADE_SQL} AS grade, '풀이 ' || n AS description FROM range(1, 82) AS r(n)""",
}


def with_views(*names: str, body: str, **extra: str) -> str:
    """``WITH`` the named stand-ins and any extra CTEs in front of a body."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


# Question texts. {n} number, {c} character, {e} element, {h} reading, {p} five digits.
QUESTIONS = (
    "김씨({n}획) 성에 어울리는 吉수 획수 조합과 밝은 뜻의 木오행 한자를 추천해줘",
    "木火土 오행 조합이 상생인지 알려줘",
    "밝고 아름다운 뜻의 순우리말 이름 {n}개 추천해줘",
    "인명용 한자에 관한 법령을 찾아줘",
    "최근 한국 이름 트렌드와 음절 특성 연구 결과 표를 알려줘",
    "{e} 오행 상생 상극 관계를 그래프로 알려줘",
    "성씨 획수 8, 이름 첫째 {n}획 둘째 6획일 때 81수리 4격을 계산해줘",
    "최씨 성에 {e}오행이고 吉수이며 지혜로운 뜻의 한자 이름을 추천해줘",
    "순우리말 외자 이름 {n}개 추천해줘",
    "임씨({c}) 성에 어울리는 순우리말 외자 이름 2개 추천해줘",
    "박씨 성을 가진 여자아이 한자 이름 2개 추천해줘 {c}",
    "그래프 상태 확인해줘",
    "ohe-{p} 한자 조회해줘",
    "{c} 한자는 인명용으로 허용되나요?",
    "{e} 오행이고 밝은 뜻 한자 추천해줘",
    "발음 {h} 인 글자 후보를 보여줘",
    "{c} 알려줘",
    "음은 {h} 이다",
    "오늘 날씨 어때",
    "인명용으로 쓸 수 있는 글자는?",
    "{n}획 {h}음 강한 의미 글자 찾아줘",
    "'가람' 실제 단어인지 검증해줘. '나래'도, '다솜'도, '라온'도",
    "하늘이 존재하는 말인가, 바다는 어떤가, 검증",
    "윤({c})씨 남자 이름 {n}개 본문 내용만",
    "정씨 성에 {c}오행 말고 {c}{c}{c}, 또 {c}{c} 이름 지어줘",
    "획수 {n} 에 맞는 길한 획수",
    "성에 火오행 이름, 여아 외자",
    "순우리말 한 글자 이름 123456789012개 추천해줘",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per event, numbers and characters filled in from the row."""
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    text = picked(QUESTIONS, key % len(QUESTIONS))
    fills = (
        ("{n}", k), ("{c}", char_of(F.lit(FIRST_CHAR) + F.col("user_id") * 31 % 2500)), ("{e}", E.label_of(F.col("user_id") % 5)),
        ("{h}", picked(SYLLABLES, F.col("user_id") % 8)), ("{p}", F.lpad(k, 5, "0")),
    )
    for mark, value in fills:
        text = F.replace(text, F.lit(mark), value)
    rows = dealt(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "event_id")
    return computed_once(rows, {"query": text}).select(key.alias("question_id"), "query")


def _questions_sql() -> str:
    text = f"{sql_list(QUESTIONS)}[CAST(event_id % {len(QUESTIONS)} AS INT) + 1]"
    fills = (
        ("{n}", "k"), ("{c}", f"chr(CAST({FIRST_CHAR} + user_id * 31 % 2500 AS INT))"), ("{e}", label_sql("user_id % 5")),
        ("{h}", f"{sql_list(SYLLABLES)}[CAST(user_id % 8 AS INT) + 1]"), ("{p}", "lpad(k, 5, '0')"),
    )
    for mark, value in fills:
        text = f"replace({text}, '{mark}', {value})"
    return (
        f"SELECT event_id AS question_id, {text} AS query "
        "FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"
    )


VIEWS["questions"] = _questions_sql()


def tag_sql(text: str, words: tuple[str, ...] | list[str]) -> str:
    """True where any word occurs."""
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
