"""Corpus construction over the stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions import frames as FR
from namesmith.functions import text as X
from namesmith.operators import corpus as C
from namesmith.plans import Registry
from namesmith.plans import sources as SRC
from namesmith.plans import standins as S

AREA = Registry()


def flat(df: DataFrame, *fields: str) -> DataFrame:
    return df.select("id", "document", *[f"metadata.{f}" for f in fields])


@AREA.add(
    "p1_split_pairs",
    """SELECT p_partkey, p_name AS outer_text,
      CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS inner_text FROM part""",
)
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_name")).otherwise(
        F.concat("p_name", F.lit(" ( "), "p_type", F.lit(") tail (x)"))
    )
    outer, inner = X.split_ko_hanja(text)
    return S.table(spark, sf_dir, "part").select("p_partkey", outer.alias("outer_text"), inner.alias("inner_text"))


@AREA.add(
    "p2_number_documents",
    """WITH r AS (SELECT o_custkey % 82 AS num, o_orderstatus AS ko, o_orderpriority AS fo, o_orderkey AS k,
        CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'd' || o_orderkey END AS description FROM orders)
    SELECT 'suri_' || num AS id, num || '수 ' || ko || '(格) ' || fo || '() [吉] — ' || description AS document,
      CAST(num AS INT) AS suri_num, ko AS gyeok_ko, '格' AS gyeok_hanja, fo AS fortune_ko, '' AS fortune_hanja, '吉' AS gilhyung
    FROM r WHERE num <> 0 AND description <> ''""",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 82).cast("int").alias("num"), F.concat("o_orderstatus", F.lit("(格)")).alias("gyeok"),
        F.col("o_orderpriority").alias("fortune"), F.lit("吉").alias("grade"),
        F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("d"), "o_orderkey")).alias("description"),
    )
    return flat(C.number_documents(rows), "suri_num", "gyeok_ko", "gyeok_hanja", "fortune_ko", "fortune_hanja", "gilhyung")


S.VIEWS["triples"] = """SELECT o_orderkey AS seq, CAST(o_orderkey % 5 AS INT) AS a, CAST(o_custkey % 5 AS INT) AS b,
    CAST((o_orderkey // 5) % 5 AS INT) AS c, CASE WHEN o_orderkey % 9 = 4 THEN '' ELSE 'd' || o_custkey END AS description FROM orders"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return S.table(spark, sf_dir, "orders").select(
        key.alias("seq"), (key % 5).cast("int").alias("a"), (F.col("o_custkey") % 5).cast("int").alias("b"),
        (F.floor(key / 5) % 5).cast("int").alias("c"),
        F.when(key % 9 == 4, "").otherwise(F.concat(F.lit("d"), "o_custkey")).alias("description"),
    )


@AREA.add(
    "p3_triple_documents",
    S.with_views("triples", body="""SELECT id, '오행 조합 ' || e1 || e2 || e3 || ' (' || e1 || '→' || e2 || '→' || e3 || ') — ' || description AS document,
      e1 || e2 || e3 AS combo, p1 AS pair1_relation, p2 AS pair2_relation,
      CASE WHEN p1 = '상생' AND p2 = '상생' THEN '전체상생' WHEN p1 = '상극' OR p2 = '상극' THEN '상극포함'
        WHEN p1 = '비화' AND p2 = '비화' THEN '전체비화' ELSE '부분상생' END AS flow
      FROM (SELECT *, 'ohaeng_' || row_number() OVER (ORDER BY seq) AS id, substr('木火土金水', a + 1, 1) AS e1, substr('木火土金水', b + 1, 1) AS e2,
        substr('木火土金水', c + 1, 1) AS e3,
        CASE (b - a + 5) % 5 WHEN 1 THEN '상생' WHEN 2 THEN '상극' ELSE '비화' END AS p1,
        CASE (c - b + 5) % 5 WHEN 1 THEN '상생' WHEN 2 THEN '상극' ELSE '비화' END AS p2 FROM triples) WHERE description <> ''"""),
)
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    combo = F.concat(*[E.hanja_label_of(F.col(c)) for c in "abc"])
    rows = triples(spark, sf_dir).select(
        "seq", F.when(F.col("seq") % 2 == 0, F.replace(combo, F.lit("金"), F.lit(E.COMPAT_METAL))).otherwise(combo).alias("combo"), "description"
    )
    return flat(C.triple_documents(rows, "seq"), "combo", "pair1_relation", "pair2_relation", "flow")


_CHAR_TEXT = """'한자 ' || hanja || '(' || hangul || ')은 뜻이 ''' || {m} || '''인 {kind} 한자이다. 유니코드는 ' || unicode || ', 획수는 ' || {s}
    || '획, 발음오행은 ' || {o} || ', 자원오행은 ' || resource_ohaeng || '이다.'"""


@AREA.add(
    "p4_character_documents",
    S.with_views("chars", body="SELECT 'hanja_' || profile_id AS id, "
      + _CHAR_TEXT.format(m="sound_meaning", kind="인명용", s="strokes", o="sound_ohaeng")
      + " AS document, hanja, strokes, true AS is_person_name_hanja FROM chars"),
)
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(C.character_documents(S.chars(spark, sf_dir)), "hanja", "strokes", "is_person_name_hanja")


@AREA.add(
    "p5_surname_documents",
    S.with_views("chars", "surnames", "people", body="SELECT 'hanja_' || profile_id AS id, "
      + _CHAR_TEXT.format(m="meaning", kind="성씨", s="st", o="so")
      + """ AS document, hanja, greatest(st, 1) AS strokes, CASE WHEN so = '' THEN resource_ohaeng ELSE so END AS sound_ohaeng
      FROM (SELECT s.hanja, s.hangul, s.resource_ohaeng, printf('SUR-%05d', row_number() OVER (ORDER BY s.surname_id)) AS profile_id,
        printf('U+%04X', unicode(s.hanja)) AS unicode, coalesce(p.strokes, 0) AS st, coalesce(p.sound_meaning, '') AS meaning,
        """ + S.sound_sql("s.hangul") + """ AS so FROM surnames s LEFT JOIN people p ON p.hanja = s.hanja
        WHERE s.hanja NOT IN (SELECT hanja FROM chars WHERE is_person_name_hanja))"""),
)
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = SRC.R.people_rows(SRC.people_raw(spark, sf_dir), "raw", "seq")
    existing = S.chars(spark, sf_dir).filter("is_person_name_hanja")
    docs = C.surname_documents(S.surnames(spark, sf_dir), people, existing, "surname_id")
    return flat(docs, "hanja", "strokes", "sound_ohaeng")


@AREA.add(
    "p6_law_documents",
    """WITH a AS (SELECT doc_id, source, (doc_id % 40) || '조' AS num, lang AS title, text, doc_id % 2 AS odd FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY source, num ORDER BY doc_id) AS rn FROM a)
    SELECT 'law_' || source || '_' || num AS id, '[' || source || '] 제' || num || '조(' || title || ')' || chr(10)
      || CASE WHEN odd = 1 THEN text ELSE 'n:' || text END AS document, title FROM f WHERE rn = 1""",
)
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = S.table(spark, sf_dir, "documents").select(
        F.col("doc_id"), "source", F.concat(F.col("doc_id") % 40, F.lit("조")).alias("article_num"), F.col("lang").alias("title"),
        F.col("text").alias("raw_text"),
        F.when(F.col("doc_id") % 2 == 1, "").otherwise(F.concat(F.lit("n:"), "text")).alias("normalized_text"),
    )
    return flat(C.law_documents(articles, "doc_id"), "title")


@AREA.add(
    "p7_word_documents",
    """WITH w AS (SELECT o_orderkey AS k, o_orderpriority || o_custkey % 300 AS name, o_orderstatus AS g, * FROM orders),
    f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k) AS rn FROM w)
    SELECT 'urimalsam_' || name AS id, '[순우리말 이름] ' || name || chr(10) || '뜻: ' || k || chr(10) || '성별 경향: ' || g || chr(10)
      || '최근 추세: 증가' AS document, name, g AS gender FROM f WHERE rn = 1""",
)
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat("o_orderpriority", F.col("o_custkey") % 300).alias("name"),
        F.col("o_orderkey").cast("string").alias("meaning"), F.col("o_orderstatus").alias("gender"), F.lit("증가").alias("trend"),
    )
    return flat(C.word_documents(words, "k"), "name", "gender")


@AREA.add(
    "p8_paper_documents",
    """SELECT 'paper_' || source || '_' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 30 AS VARCHAR) END || '_'
      || (row_number() OVER (ORDER BY doc_id) - 1) AS id, text AS document, source,
      CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id % 30 AS VARCHAR) END AS page_number, CASE lang WHEN 'en' THEN '' ELSE lang END AS chunk_type,
      'title ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'author ' || doc_id % 7 END AS author, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, 'paper' AS type FROM documents""",
)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = S.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 30).alias("page_number"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("chunk_type"), F.col("text").alias("content"),
        F.concat(F.lit("title "), "doc_id").alias("title"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("author "), F.col("doc_id") % 7)).alias("author"),
        (F.col("doc_id") % 30 + 1990).cast("string").alias("year"), F.lit("paper").alias("type"),
    )
    return flat(C.paper_documents(chunks, "doc_id"), "source", "page_number", "chunk_type", "title", "author", "year", "type")


_SYL = "chr(CAST(44032 + (c_custkey * 97) % 11172 AS INT))"


@AREA.add(
    "p9_sound_element",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE {_SYL} END AS reading,
      CASE WHEN c_custkey % 5 = 0 THEN '' ELSE {S.sound_sql(_SYL)} END AS element FROM customer""",
)
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    reading = F.when(key % 5 == 0, F.col("c_name")).otherwise(X.char_of(F.lit(44032) + key * 97 % 11172))
    return S.table(spark, sf_dir, "customer").select("c_custkey", reading.alias("reading"), E.sound_element(reading).alias("element"))


@AREA.add("p10_nfkc", """SELECT c_custkey, c_name || '金' AS key_text FROM customer""")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate("c_name", "Customer#0123456789", "Ｃｕｓｔｏｍｅｒ＃０１２３４５６７８９")
    return S.table(spark, sf_dir, "customer").select("c_custkey", X.nfkc(F.concat(wide, F.lit(E.COMPAT_METAL))).alias("key_text"))


_REL_A = "(['비화','상생','상극','역상극','역상생'])[CAST((({1}) - ({0}) + 5) % 5 AS INT) + 1]"


@AREA.add(
    "p11_lookup_relations",
    S.with_views("triples", body="SELECT seq, " + _REL_A.format("a", "b") + " AS first_pair, " + _REL_A.format("b", "c") + """ AS second_pair,
      CASE WHEN (b - a + 5) % 5 = 1 AND (c - b + 5) % 5 = 1 THEN '전체 상생' WHEN (b - a + 5) % 5 = 1 OR (c - b + 5) % 5 = 1 THEN '부분 상생'
      ELSE '상생 없음' END AS flow FROM triples"""),
)
def p11a(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return triples(spark, sf_dir).select(
        "seq", E.lookup_relation(a, b).alias("first_pair"), E.lookup_relation(b, c).alias("second_pair"), E.lookup_flow(a, b, c).alias("flow")
    )


@AREA.add(
    "p11_name_relations",
    S.with_views("triples", body=f"""SELECT seq, r1, r2, CASE WHEN r1 = '상극' OR r2 = '상극' THEN '상극' WHEN r1 = '상생' AND r2 = '상생' THEN '상생'
      ELSE '중립' END AS overall FROM (SELECT seq, {S.relation_sql('a', 'b')} AS r1, {S.relation_sql('b', 'c')} AS r2 FROM triples)"""),
)
def p11c(spark: SparkSession, sf_dir: str) -> DataFrame:
    r1, r2 = E.name_relation(F.col("a"), F.col("b")), E.name_relation(F.col("b"), F.col("c"))
    return triples(spark, sf_dir).select("seq", r1.alias("r1"), r2.alias("r2"), E.overall_relation(r1, r2).alias("overall"))


@AREA.add(
    "p12_code_points",
    "SELECT c_custkey, " + _SYL + " AS c, printf('U+%04X', unicode(" + _SYL + ")) AS label, printf('U+%04X', unicode(c_name)) AS first_label FROM customer",
)
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.char_of(F.lit(44032) + F.col("c_custkey") * 97 % 11172)
    return S.table(spark, sf_dir, "customer").select(
        "c_custkey", c.alias("c"), X.code_point_label(c).alias("label"), X.code_point_label(F.col("c_name")).alias("first_label")
    )


_LABELS = (" 목 ", "火", "金", E.COMPAT_METAL, "水\n", "x", "", "목화", "토", "木")


@AREA.add(
    "p13_normalized_labels",
    f"""SELECT o_orderkey, {S.sql_list(_LABELS)}[CAST(o_orderkey % 10 AS INT) + 1] AS raw,
      {S.sql_list(['목', '화', '금', '금', '수', '-', '-', '-', '토', '목'])}[CAST(o_orderkey % 10 AS INT) + 1] AS element FROM orders""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.picked(_LABELS, F.col("o_orderkey") % 10)
    return S.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), F.coalesce(E.normalized(raw), F.lit("-")).alias("element"))


@AREA.add(
    "p14_wrapped_grades",
    f"""SELECT o_orderkey, CAST(o_custkey - 5 AS BIGINT) AS n, CASE WHEN o_custkey - 5 <= 0 THEN '?' ELSE {S.grade_sql('o_custkey - 5')} END AS n_g FROM orders""",
)
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "orders")
    return FR.with_grades(df, S.grades(spark), {"n": F.col("o_custkey") - 5}, missing="?").select("o_orderkey", "n", "n_g")


def law_text() -> F.Column:
    header = F.concat(F.lit("법제처  "), F.col("doc_id"), F.lit("  국가법령정보센터\n가족법(령)\n"))
    return F.concat(
        F.lit(" "), header, F.lit("가\n나\n다- \n하이-\n픈  \t 끝・줄\n"), F.replace("text", F.lit("e"), F.lit("e  ")), header, F.lit("\n나 \n"), F.lit("  ")
    )


_LAW_SQL = """regexp_replace(' ' || h || '가' || chr(10) || '나' || chr(10) || '다- ' || chr(10) || '하이-' || chr(10) || '픈  ' || chr(9) || ' 끝・줄' || chr(10)
    || replace(text, 'e', 'e  ') || h || chr(10) || '나 ' || chr(10) || '  ', '법제처\\s+\\d+\\s+국가법령정보센터\\n가족법\\(령\\)\\n', '', 'g')"""


@AREA.add(
    "p15_law_text",
    f"""WITH d AS (SELECT *, '법제처  ' || doc_id || '  국가법령정보센터' || chr(10) || '가족법(령)' || chr(10) AS h FROM documents),
    a AS (SELECT doc_id, replace({_LAW_SQL}, '-' || chr(10), '') AS t FROM d),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([가-힣])\\n([가-힣])', '\\1\\2', 'g'), '([가-힣])\\n([가-힣])', '\\1\\2', 'g') AS t FROM a)
    SELECT doc_id, regexp_replace(replace(regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g'), '・', ', '), '^\\s+|\\s+$', '', 'g') AS clean FROM b""",
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = X.law_text_normalized(X.law_page_headers_removed(law_text(), "가족법(령)"))
    return S.table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))


_STOP = ("the", "of", "and", "de", "der", "die", "le", "la", "que", "in")


@AREA.add(
    "p16_content_tokens",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '([0-9]+|[A-Za-z]+|[\\p{{L}}]+)'),
        lambda x: NOT list_contains({S.sql_list(_STOP)}, x) AND (length(x) >= 2 OR regexp_full_match(x, '[0-9A-Za-z]+'))) AS k FROM documents)
    SELECT doc_id, CAST(len(k) AS INT) AS n_tokens, array_to_string(k, ' ') AS tokens FROM t""",
)
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = X.content_tokens(F.col("text"), _STOP)
    return S.table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@AREA.add(
    "p17_spacing_need",
    """WITH f AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    s AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, ' ', ''))) AS BIGINT) AS blanks
      FROM f WHERE rn <= 5 GROUP BY source)
    SELECT source, chars, blanks, CAST(blanks AS DOUBLE) / chars * 100 AS blank_percent, CAST(blanks AS DOUBLE) / chars * 100 < 5 AS needs_spacing FROM s""",
)
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.spacing_need(S.table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@AREA.add(
    "p18_markdown_tables",
    """WITH t AS (SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda l: '| ' || array_to_string(list_transform(string_split(l, ','),
        lambda x: coalesce(x, '')), ' | ') || ' |') AS r, len(string_split(string_split(text, chr(10))[1], ',')) AS w FROM documents)
    SELECT doc_id, '**[통계 표 기준 연도: 2024년]** *(출처: ' || source || ')*' || chr(10) || r[1] || chr(10)
      || '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'
      || CASE WHEN len(r) > 1 THEN chr(10) || array_to_string(r[2:], chr(10)) ELSE '' END AS md FROM t""",
)
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, ","), lambda x: F.nullif(x, F.lit(""))))
    return S.table(spark, sf_dir, "documents").select("doc_id", X.markdown_table(rows, F.lit("2024"), F.col("source")).alias("md"))


@AREA.add(
    "p19_rendered_results",
    """WITH d AS (SELECT *, CASE lang WHEN 'en' THEN 500 WHEN 'fr' THEN 300 ELSE 200 END AS cut FROM documents)
    SELECT doc_id, round(1 - CAST(doc_id % 97 AS DOUBLE) / 64, 4) AS similarity, substr(text, 1, cut) || CASE WHEN length(text) > cut THEN '...' ELSE '' END AS content,
      'doc_id: ' || doc_id || ' | lang: ' || lang AS meta FROM d""",
)
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("lang") == "en", 500).when(F.col("lang") == "fr", 300).otherwise(200)
    entries = F.create_map(
        F.lit("type"), F.lit("doc"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("doc_id"), F.col("doc_id").cast("string")
    )
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", X.similarity((F.col("doc_id") % 97) / F.lit(64)).alias("similarity"), X.clipped(F.col("text"), limit).alias("content"),
        X.metadata_line(entries).alias("meta"),
    )


@AREA.add(
    "p20_context_tail",
    """SELECT doc_id, CASE WHEN length(text) > 8000 THEN '...(앞부분 생략)...' || chr(10) || right(text, 8000) ELSE text END AS context FROM documents""",
)
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", X.tail_context(F.col("text")).alias("context"))


_NAMES = tuple(C.SURNAME_STROKES) + ("갈", "독고")
_COUNTS = ", ".join(str(v) for v in C.SURNAME_STROKES.values())


@AREA.add(
    "p21_surname_strokes",
    f"""WITH c AS (SELECT c_custkey, CAST(c_custkey % {len(_NAMES)} AS INT) + 1 AS i, {S.sql_list(_NAMES)}[CAST(c_custkey % {len(_NAMES)} AS INT) + 1] AS s FROM customer)
    SELECT c_custkey, s AS clean_surname, CAST(coalesce([{_COUNTS}][i], 0) AS INT) AS surname_strokes, CASE WHEN i > {len(C.SURNAME_STROKES)} THEN 'error' ELSE 'success' END AS status FROM c""",
)
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.picked(_NAMES, F.col("c_custkey") % len(_NAMES))
    written = F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit("씨"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), name, F.lit("가 "))).otherwise(name)
    df = S.table(spark, sf_dir, "customer").select("c_custkey", written.alias("surname"))
    return C.surname_strokes(df, "surname").drop("surname")
