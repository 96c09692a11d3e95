"""Sources over text derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.text import char_of
from namesmith.plans import Registry
from namesmith.plans import standins as S
from namesmith.session import shared_dir
from namesmith.sources import payloads as P
from namesmith.sources import readers as R

AREA = Registry()


@AREA.add(
    "s1_commented_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events""",
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(
            F.lit("// event "), F.col("event_id"), F.lit('\n{"props":\n  // inner "note"\n'), F.col("props"),
            F.lit(',\n"type": "'), F.col("event_type"), F.lit('"}\n//end'),
        ).alias("text"),
    )
    value = F.from_json(R.without_comment_lines(F.col("text")), "props STRUCT<k:INT>, type STRING")
    return files.select("event_id", value.alias("v")).select(
        "event_id", F.col("v.props.k").alias("k"), F.col("v.type").alias("event_type")
    )


@AREA.add(
    "s2_positional_arrays",
    """WITH raw AS (SELECT o_orderkey AS seq, o_custkey AS k, o_orderkey % 5 AS tail, * FROM orders),
    last AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM raw)
    SELECT CAST(k AS VARCHAR) AS num, CASE WHEN tail >= 1 THEN o_orderstatus ELSE '' END AS gyeok,
      CASE WHEN tail >= 2 THEN o_orderpriority ELSE '' END AS fortune,
      CASE WHEN tail >= 3 THEN '吉' ELSE '' END AS grade,
      CASE WHEN tail >= 4 THEN 'd' || seq ELSE '' END AS description, seq FROM last WHERE rn = 1""",
)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(
        F.col("o_custkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')),
        F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')), F.lit('"吉"'),
        F.concat(F.lit('"d'), F.col("o_orderkey"), F.lit('"')),
    )
    some = F.slice(cells, F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int"))
    raw = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("["), F.array_join(some, ", "), F.lit("]")).alias("raw")
    )
    return R.positional_rows(raw, "raw", R.NUMBER_FIELDS, "seq")


@AREA.add(
    "s3_record_files",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'source_json_must_be_list' ELSE 'ok' END AS status,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'doc_' || doc_id END AS id,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(text) END AS text_md5,
      CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS lang FROM documents""",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(
        F.struct(
            F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.col("text").alias("document"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
        )
    )
    files = S.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, record).otherwise(F.concat(F.lit(" ["), record, F.lit("]"))).alias("raw")
    )
    rows = R.document_records(files, "raw", ["doc_id"])
    return rows.select(
        "doc_id", "status", F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce(F.md5("document"), F.lit("")).alias("text_md5"), F.coalesce(F.col("metadata")["lang"], F.lit("")).alias("lang"),
    )


@AREA.add(
    "s4_surname_map",
    S.with_views("chars", body="""SELECT seq, hanja, hangul, resource_ohaeng FROM chars
      UNION ALL SELECT seq, sound_meaning, 'x' || hangul, sound_ohaeng FROM chars"""),
)
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    def entry(key: str, hangul, element: str):
        value = F.to_json(F.struct(hangul.alias("hangul"), F.col(element).alias("resource_ohaeng")))
        return F.concat(F.lit('"'), F.col(key), F.lit('": '), value)

    raw = S.chars(spark, sf_dir).select(
        "seq",
        F.concat(
            F.lit("{"), entry("hanja", F.col("hangul"), "resource_ohaeng"), F.lit(", "),
            entry("sound_meaning", F.concat(F.lit("x"), F.col("hangul")), "sound_ohaeng"), F.lit("}"),
        ).alias("raw"),
    )
    return R.surname_map_rows(raw, "raw", ["seq"])


def people_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional people rows, two per character, some too short and some no list."""
    c = S.chars(spark, sf_dir)
    strokes = F.when(F.col("strokes") % 7 == 0, F.lit('"?"')).otherwise(F.col("strokes").cast("string"))
    cells = [
        F.concat(F.lit('"'), F.col("hanja"), F.lit('"')), F.lit('"木"'),
        F.concat(F.lit('"'), F.translate("resource_ohaeng", "목화토금수", "木火土金水"), F.lit('"')), strokes,
        F.concat(F.lit('"'), F.when(F.col("strokes") % 3 == 0, "姓 , ").otherwise(""), F.col("sound_meaning"), F.lit(', extra"')),
        F.lit('"部"'), F.concat(F.lit('"'), F.col("hangul"), F.lit('"')),
    ]
    full = F.concat(F.lit("["), F.concat_ws(", ", *cells), F.lit("]"))
    short = F.concat(F.lit("["), F.concat_ws(", ", *cells[:6]), F.lit("]"))
    kind = F.col("seq") % 11
    return c.select("seq", F.when(kind == 0, short).when(kind == 1, F.lit('"note"')).otherwise(full).alias("raw"))


S.VIEWS["people"] = f"""SELECT hanja, CASE WHEN strokes % 7 = 0 THEN 0 ELSE strokes END AS strokes, sound_meaning,
    translate(resource_ohaeng, '목화토금수', '木火土金水') AS resource_raw, '部' AS radical, hangul AS reading, seq
    FROM (SELECT *, row_number() OVER (PARTITION BY hanja ORDER BY seq DESC) AS rn FROM ({S.VIEWS['chars']})
          WHERE seq % 11 NOT IN (0, 1)) WHERE rn = 1"""


@AREA.add("s5_people_dictionary", S.with_views("people", body="SELECT * FROM people"))
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.people_rows(people_raw(spark, sf_dir), "raw", "seq")


def surname_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV-like surname rows, one per customer: repeated keys, some blank or two-character."""
    key = F.col("c_custkey")
    hanja = char_of(F.lit(S.FIRST_CHAR) + key * 7 % 1499)
    return S.table(spark, sf_dir, "customer").select(
        key.alias("seq"),
        F.when(key % 13 == 0, F.concat(hanja, hanja)).when(key % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), hanja)).alias("hanja"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(" ")).otherwise(S.picked(S.SYLLABLES, key % 8)).alias("hangul"),
    )


S.VIEWS["surname_csv"] = f"""SELECT c_custkey AS seq, CASE WHEN c_custkey % 13 = 0 THEN 'xx' WHEN c_custkey % 17 = 0 THEN NULL
    ELSE chr(CAST({S.FIRST_CHAR} + c_custkey * 7 % 1499 AS INT)) END AS hanja,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE {S.sql_list(S.SYLLABLES)}[CAST(c_custkey % 8 AS INT) + 1] END AS hangul
    FROM customer"""
S.VIEWS["first_readings"] = f"""SELECT seq, hanja, hangul FROM (SELECT *, row_number() OVER (PARTITION BY hanja ORDER BY seq) AS rn
    FROM ({S.VIEWS['surname_csv']}) WHERE length(hanja) = 1 AND hangul <> '') WHERE rn = 1"""


@AREA.add("s6_first_reading", S.with_views("first_readings", body="SELECT * FROM first_readings"))
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_readings(surname_csv(spark, sf_dir), "hanja", "hangul", "seq")


@AREA.add(
    "s7_page_lines",
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS n, lang FROM documents)
    SELECT doc_id, CAST(n + (n - 1) // 4 + 1 AS INT) AS line_no, CAST((n - 1) // 4 + 1 AS INT) AS page,
      CASE WHEN lang = 'en' THEN '색인' ELSE '본문' END AS section, line FROM lines""",
)
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("lang") == "en", "색인").otherwise("본문")
    marked = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            i % 4 == 0,
            F.concat(F.lit("=== PAGE "), F.floor(i / 4) + 1, F.lit(" ["), section, F.lit("] ===\n"), line),
        ).otherwise(line),
    )
    ocr = S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("ocr"))
    return R.page_lines(ocr, "ocr", ["doc_id"])


_LI = "(?s)<li\\b[^>]*>(.*?)</li>"


@AREA.add(
    "s8_html_rows",
    f"""WITH cells AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '{_LI}', 1) AS c FROM pages),
    t AS (SELECT page_id, c, list_transform(c, lambda x: trim(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;', '&'))) AS v FROM cells)
    SELECT page_id, CAST(0 AS INT) AS row_no, v[1] AS name, v[2] AS meaning, v[3] AS gender, v[4] AS trend
    FROM t WHERE len(v) >= 4 AND v[1] <> ''""",
)
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table_rows(
        S.table(spark, sf_dir, "pages"), "html", ["page_id"], scope="(?s)<nav>(.*?)</nav>", row_tag="ul", cell_tags="li",
        header_rows=0,
    )


# Lists inside lists: the page stands in a row of its own list, and its lists stay whole rows of their element.
@AREA.add(
    "s8_all_list_rows",
    f"""WITH lists AS (SELECT page_id, unnest(l) AS ul, generate_subscripts(l, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul(?:>|\\s[^>]*>)(.*?)</ul>', 1) AS l FROM pages)),
    t AS (SELECT page_id, n, list_transform(regexp_extract_all(ul, '{_LI}', 1), lambda x: trim(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;', '&'))) AS v FROM lists)
    SELECT page_id, CAST(n - 1 AS INT) AS row_no, len(v) AS n_cells, v[1] AS first, array_to_string(v, '|') AS cells FROM t WHERE len(v) >= 2 AND v[1] <> ''""",
)
def s8_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit('<div class="page"><div>'), "html", F.lit("</div></div><div>open"))
    pages = S.table(spark, sf_dir, "pages").select("page_id", whole.alias("html"))
    # scope: the outer div, rows: lists anywhere in it, cells: list items
    rows = P.listed_rows(pages.withColumn("html", F.regexp_replace("html", r"</?(?:nav|body|html)[^>]*>", "")), "html", ["page_id"], "div", "ul", "li", 2)
    return rows.select("page_id", "row_no", F.size("cells").cast("bigint").alias("n_cells"), F.get("cells", F.lit(0)).alias("first"), F.array_join("cells", "|").alias("cells"))


@AREA.add(
    "s11_written_records",
    """SELECT 'doc_' || doc_id AS id, text AS document, lang, 'ok' AS status, (SELECT count(*) FROM documents) AS records FROM documents""",
)
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and their report written to the shared folder and read back."""
    base = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    docs = S.table(spark, sf_dir, "documents")
    records = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("id"), F.col("text").alias("document"), F.create_map(F.lit("lang"), "lang").alias("metadata"))
    report = docs.agg(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("records"))
    R.write_documents(records, f"{base}/records")
    R.write_report(report, f"{base}/report")
    back = spark.read.schema(R.DOCUMENT_SCHEMA).json(f"{base}/records")
    one = R.read_report(spark, f"{base}/report", "status string, records bigint")
    return back.crossJoin(F.broadcast(one)).select("id", "document", F.col("metadata")["lang"].alias("lang"), "status", "records")


def _law_payload() -> F.Column:
    k = F.get_json_object("props", "$.k")
    one = F.concat(F.lit('{"법령명한글":"'), F.col("event_type"), F.lit('","법령일련번호":"'), F.col("event_id"), F.lit('"}'))
    two = F.concat(F.lit('{"법령일련번호":"b'), k, F.lit('","시행일자":"2024"}'))
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda _i: F.concat(one, F.lit(","), two)), ",")
    law = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), many, F.lit("]"))).otherwise(one)
    return F.concat(F.lit('{"LawSearch":{"totalCnt":"'), k, F.lit('","law":'), law, F.lit("}}"))


@AREA.add(
    "s9_law_list",
    """WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events),
    n AS (SELECT e.*, r FROM e, range(1, 11) AS t(r) WHERE event_id % 2 = 0 OR r = 1)
    SELECT event_id, k AS total, CAST(r AS INT) AS rank, CASE WHEN r % 2 = 1 THEN event_type ELSE '이름 없음' END AS law_name,
      CASE WHEN r % 2 = 1 THEN CAST(event_id AS VARCHAR) ELSE 'b' || k END AS mst,
      CASE WHEN r % 2 = 1 THEN '정보 없음' ELSE '2024' END AS effective FROM n""",
)
def s9_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "events").select("event_id", _law_payload().alias("payload"))
    return P.law_list(df, "payload", ["event_id"])


def _article_payload() -> F.Column:
    def unit(number, content):
        return F.to_json(F.struct(number.alias("조문번호"), content.alias("조문내용")))

    text = F.concat(F.lit(" "), F.col("text"))
    a = unit(F.concat(F.lit("제"), F.col("doc_id") % 9, F.lit("조")), text)
    b = unit(F.lit("제3조의2"), F.col("lang"))
    units = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))).otherwise(a)
    return F.concat(
        F.lit('{"법령":{"기본정보":{"법령명_한글":"'), F.col("source"), F.lit('"},"조문":{"조문단위":'), units, F.lit("}}}")
    )


_FIRST_LINE = "substr(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], 1, 30)"


@AREA.add(
    "s9_law_articles",
    f"""SELECT doc_id, source AS law_name, CAST(0 AS INT) AS pos, '제' || doc_id % 9 || '조' AS number,
      CAST(doc_id % 9 AS VARCHAR) AS article_key, {_FIRST_LINE} AS title, md5(' ' || text) AS content_md5 FROM documents
    UNION ALL SELECT doc_id, source, CAST(1 AS INT), '제3조의2', '3의2', lang, md5(lang) FROM documents WHERE doc_id % 2 = 0""",
)
def s9_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "documents").select("doc_id", _article_payload().alias("payload"))
    return P.law_articles(df, "payload", ["doc_id"]).withColumn("content_md5", F.md5("content")).drop("content")


@AREA.add(
    "s9_law_article_lookup",
    """SELECT doc_id, source AS law_name, CASE WHEN doc_id % 4 = 1 THEN '3' ELSE '3의2' END AS article_key,
      CASE WHEN doc_id % 4 = 1 THEN md5(' ' || text) ELSE md5(lang) END AS content_md5 FROM documents
    WHERE doc_id % 2 = 0 AND doc_id % 4 <> 1 OR doc_id % 4 = 1 AND doc_id % 9 = 3""",
)
def s9_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "documents").select("doc_id", _article_payload().alias("payload"))
    wanted = F.when(F.col("doc_id") % 4 == 1, "제3조").otherwise("3의2")
    found = P.article_lookup(P.law_articles(df, "payload", ["doc_id"]), ["doc_id"], wanted)
    return found.withColumn("content_md5", F.md5("content")).drop("content")


@AREA.add(
    "s9_word_senses",
    """WITH e AS (SELECT event_id, event_type AS word, event_id % 5 AS kind FROM events)
    SELECT event_id, word, CASE kind WHEN 0 THEN 'failed' WHEN 1 THEN 'api_error' ELSE 'ok' END AS status,
      CASE WHEN kind = 1 THEN '020' ELSE '' END AS error_code, CAST(CASE WHEN kind <= 1 THEN 0 ELSE kind END AS INT) AS total,
      CAST(0 AS INT) AS entry, CAST(0 AS INT) AS sense, '' AS definition, '' AS link FROM e WHERE kind <= 1
    UNION ALL SELECT event_id, word, 'ok', '', CAST(kind AS INT), CAST(1 AS INT), CAST(1 AS INT), 'd' || event_id, 'u' FROM e WHERE kind >= 2
    UNION ALL SELECT event_id, word || '2', 'ok', '', CAST(kind AS INT), CAST(2 AS INT), CAST(s AS INT), CASE s WHEN 1 THEN '뜻풀이 없음' ELSE 'z' END, ''
      FROM e, range(1, 3) AS t(s) WHERE kind >= 3""",
)
def s9_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit('{"sense":{"definition":"d'), F.col("event_id"), F.lit('","link":"u"}}'))
    b = F.concat(F.lit('{"word":"'), F.col("event_type"), F.lit('2","sense":[{"x":"y"},{"definition":"z"}]}'))
    kind = F.col("event_id") % 5
    channel = F.when(kind == 0, F.lit('{"channel":{"total":0}}')).when(
        kind == 1, F.lit('{"error":{"error_code":"020","message":"m"}}')
    ).when(kind == 2, F.concat(F.lit('{"channel":{"total":2,"item":'), a, F.lit("}}"))).otherwise(
        F.concat(F.lit('{"channel":{"total":'), kind, F.lit(',"item":['), a, F.lit(","), b, F.lit("]}}"))
    )
    df = S.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("q"), channel.alias("payload"))
    return P.word_senses(df, "payload", "q", ["event_id"])


@AREA.add(
    "s10_name_table",
    """SELECT trim(c_name) AS name, count(*) AS n, max(c_custkey) AS last_key FROM customer GROUP BY 1""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = R.name_table(S.table(spark, sf_dir, "customer"))
    return named.groupBy(F.col("_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last_key"))
