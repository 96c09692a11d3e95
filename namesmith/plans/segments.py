"""Segmentation over the documents, line items and composed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.once import bound
from namesmith.operators import chunk as K
from namesmith.plans import Registry
from namesmith.plans import standins as S

AREA = Registry()


@AREA.add(
    "k1_law_articles",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    g AS (SELECT *, (n - 1) // 3 AS g, (n - 1) % 3 AS r FROM l),
    b AS (SELECT doc_id, g, string_agg(CASE WHEN r = 0 THEN CASE g WHEN 0 THEN t ELSE '제' || n || CASE WHEN n % 2 = 0 THEN '조의2(제목 ' ELSE '조(제목 ' END || n || ') ' || t END ELSE t END, chr(10) ORDER BY n) AS x,
      min(n) AS n FROM g GROUP BY 1, 2)
    SELECT doc_id, CAST(g - 1 AS INT) AS article_no, n || CASE WHEN n % 2 = 0 THEN '조의2' ELSE '조' END AS article_num, '제목 ' || n AS title, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS raw_text
    FROM b WHERE g > 0 AND length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 20""",
)
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit(1)
    headed = F.transform(
        F.split("text", "\n"),
        lambda t, i: F.when(
            (i % 3 == 0) & (i > 0),
            F.concat(F.lit("제"), i + n, F.when((i + n) % 2 == 0, "조의2(제목 ").otherwise("조(제목 "), i + n, F.lit(") "), t),
        ).otherwise(t),
    )
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(headed, "\n").alias("law"))
    return K.law_articles(docs, "law", ["doc_id"])


S.VIEWS["paragraphs"] = """WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    k AS (SELECT *, length(t) >= 50 AS long FROM l WHERE t <> ''),
    g AS (SELECT *, coalesce(sum(CAST(long AS INT)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw, sum(CAST(long AS INT)) OVER (PARTITION BY doc_id) AS longs FROM k)
    SELECT doc_id, CAST(least(raw, greatest(longs - 1, 0)) AS INT) AS paragraph_no, string_agg(t, ' ' ORDER BY n) AS p FROM g GROUP BY 1, 2"""


def paragraphs(df: DataFrame):
    return K.merged_paragraphs(F.col("text"), "\n")


@AREA.add("k2_merged_paragraphs", S.with_views("paragraphs", body="SELECT doc_id, paragraph_no, p AS paragraph FROM paragraphs"))
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(paragraphs(docs)).alias("paragraph_no", "paragraph"))


_STARTS = """list_reduce(list_prepend({'l': 0, 'c': 0, 'i': 0, 'b': [1]}, list_transform(s, lambda x: {'l': length(x), 'c': 0, 'i': 0, 'b': [1]})),
    lambda a, x: {'l': x.l, 'c': CASE WHEN a.c + x.l > 500 AND a.c > 0 THEN 0 ELSE a.c END + x.l + 1, 'i': a.i + 1,
      'b': CASE WHEN a.c + x.l > 500 AND a.c > 0 THEN list_append(a.b, a.i + 1) ELSE a.b END}).b"""


@AREA.add(
    "k3_sentence_chunks",
    S.with_views("paragraphs",
      s="SELECT doc_id, paragraph_no, CASE WHEN length(p) > 500 THEN string_split(regexp_replace(p, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)) ELSE [p] END AS s FROM paragraphs",
      b=f"SELECT *, {_STARTS} AS b FROM s",
      c="SELECT doc_id, paragraph_no, s, b, unnest(range(len(b))) AS j FROM b",
      body="""SELECT doc_id, paragraph_no, CAST(j AS INT) AS chunk_no, trim(array_to_string(s[b[j + 1] : coalesce(b[j + 2] - 1, len(s))], ' ')) AS chunk FROM c
        WHERE trim(array_to_string(s[b[j + 1] : coalesce(b[j + 2] - 1, len(s))], ' ')) <> ''"""),
)
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    return K.packed_chunks(docs, paragraphs(docs), ["doc_id"])


S.VIEWS["layout"] = """SELECT l_orderkey AS page, l_partkey AS part, l_linenumber AS n, l_quantity AS x0, l_quantity + l_linenumber AS x1, CAST(l_partkey % 100 AS DOUBLE) AS top,
    CAST(l_partkey % 100 + l_linenumber AS DOUBLE) AS bottom, l_returnflag = 'R' AS box, l_suppkey AS supp, l_extendedprice AS price FROM lineitem"""


@AREA.add(
    "k4_outside_tables",
    S.with_views("layout", body="""SELECT page, part, n, supp, price FROM layout o WHERE NOT box AND NOT EXISTS (SELECT 1 FROM layout b WHERE b.box AND b.page = o.page
      AND o.x1 > b.x0 AND o.x0 < b.x1 AND o.bottom > b.top AND o.top < b.bottom)"""),
)
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("l_partkey") % 100
    layout = S.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x1"),
        top.cast("double").alias("top"), (top + F.col("l_linenumber")).cast("double").alias("bottom"), "l_returnflag",
    )
    key = ["page", "part", "n", "supp", "price"]
    # line items have no single key; equal rows overlap the same boxes, so they may share one
    kept = K.outside_boxes(layout.filter("l_returnflag <> 'R'"), layout.filter("l_returnflag = 'R'"), [*key, "x0"])
    return kept.select(*key)


# -- composed answers --------------------------------------------------------------------

_TEMPLATE_CHARS = 1777
S.VIEWS["answers"] = f"""WITH a AS (SELECT c_custkey AS answer_id, c_custkey AS k, {S.sql_list(S.SYLLABLES)}[CAST(c_custkey % 8 AS INT) + 1] AS surname,
      {S.label_sql('c_nationkey % 5')} AS surname_ohaeng, CAST(c_custkey % 26 AS INT) AS surname_strokes, CAST(CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 1 + c_custkey % 6 END AS INT) AS names FROM customer),
    i AS (SELECT *, i, chr(CAST({S.FIRST_CHAR} + (k * 7 + i * 13) % {_TEMPLATE_CHARS} AS INT)) AS c1, chr(CAST({S.FIRST_CHAR} + (k * 11 + i * (3 + k % 3)) % 40 AS INT)) AS c2,
      {S.sql_list(S.SYLLABLES)}[CAST((k + i) % 8 AS INT) + 1] AS h1, {S.sql_list(S.SYLLABLES)}[CAST((k + i * 3) % 8 AS INT) + 1] AS h2, CAST((k * 3 + i * 5) % 30 + 1 AS INT) AS s1,
      CAST((k * 5 + i * 7) % 30 + 1 AS INT) AS s2, {S.label_sql('(k + i) % 5')} AS e1, {S.label_sql('(k + i * i) % 5')} AS e2 FROM a, range(1, 8) AS t(i) WHERE i <= names),
    s AS (SELECT answer_id, i, chr(10) || '## [이름 ' || i || '] ' || surname || h1 || h2 || ' (' || c1 || c2 || ')' || chr(10) || '- 첫째 글자(' || c1 || '): ' || h1 || ', ' || s1 || '획 [' || e1 || ']' || chr(10)
      || '- 둘째 글자(' || c2 || '): ' || h2 || ', ' || s2 || '획 [' || e2 || ']' || chr(10) || '**오행 흐름**: ' || surname || '씨(' || surname_ohaeng || ') → 첫째(' || e1 || ') → 둘째(' || e2 || ') — '
      || CASE (k + i) % 3 WHEN 0 THEN '상극' ELSE '상생' END || chr(10) || CASE WHEN (k + i) % 4 = 0 THEN '**수리**: 원격1(吉)' || chr(10) WHEN (k + i) % 29 = 1 THEN '[수리 계산 완료]' || chr(10) ELSE '' END AS section FROM i)
    SELECT a.*, '추천 이름입니다.' || chr(10) || coalesce((SELECT string_agg(section, '' ORDER BY i) FROM s WHERE s.answer_id = a.answer_id), '') AS text FROM a"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One composed answer per customer: up to six name sections with printed values that
    are partly wrong."""
    from namesmith.functions import elements as E
    from namesmith.functions.text import char_of

    k = F.col("c_custkey")
    surname = S.picked(S.SYLLABLES, k % 8)
    element = E.label_of(F.col("c_nationkey") % 5)
    names = F.when(k % 17 == 0, 0).otherwise(1 + k % 6).cast("int")

    def section(i):
        return bound(F.struct(char_of(F.lit(S.FIRST_CHAR) + (k * 7 + i * 13) % _TEMPLATE_CHARS).alias("c1"), char_of(F.lit(S.FIRST_CHAR) + (k * 11 + i * (F.lit(3) + k % 3)) % 40).alias("c2")), lambda c: written(i, c["c1"], c["c2"]))

    def written(i, c1, c2):
        h1, h2 = S.picked(S.SYLLABLES, (k + i) % 8), S.picked(S.SYLLABLES, (k + i * 3) % 8)
        e1, e2 = E.label_of((k + i) % 5), E.label_of((k + i * i) % 5)
        return F.concat(
            F.lit("\n## [이름 "), i, F.lit("] "), surname, h1, h2, F.lit(" ("), c1, c2, F.lit(")\n- 첫째 글자("), c1, F.lit("): "), h1, F.lit(", "),
            (k * 3 + i * 5) % 30 + 1, F.lit("획 ["), e1, F.lit("]\n- 둘째 글자("), c2, F.lit("): "), h2, F.lit(", "), (k * 5 + i * 7) % 30 + 1, F.lit("획 ["), e2,
            F.lit("]\n**오행 흐름**: "), surname, F.lit("씨("), element, F.lit(") → 첫째("), e1, F.lit(") → 둘째("), e2, F.lit(") — "),
            F.when((k + i) % 3 == 0, "상극").otherwise("상생"), F.lit("\n"),
            F.when((k + i) % 4 == 0, "**수리**: 원격1(吉)\n").when((k + i) % 29 == 1, "[수리 계산 완료]\n").otherwise(""),
        )

    numbers = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= names)
    text = F.concat(F.lit("추천 이름입니다.\n"), F.array_join(F.transform(numbers, section), ""))
    return S.dealt(S.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(
        k.alias("answer_id"), k.alias("k"), surname.alias("surname"), element.alias("surname_ohaeng"), (k % 26).cast("int").alias("surname_strokes"),
        names.alias("names"), text.alias("text"),
    )


S.VIEWS["answer_sections"] = """SELECT answer_id, n - 1 AS section_no, CASE WHEN n = 1 THEN s ELSE chr(10) || s END AS section FROM
    (SELECT answer_id, unnest(string_split(replace(text, chr(10) || '## [이름', chr(1) || '## [이름'), chr(1))) AS s, generate_subscripts(string_split(replace(text, chr(10) || '## [이름', chr(1) || '## [이름'), chr(1)), 1) AS n FROM answers)"""


@AREA.add("k5_answer_sections", S.with_views("answers", "answer_sections", body="SELECT answer_id, CAST(section_no AS INT) AS section_no, section FROM answer_sections"))
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.name_sections(answers(spark, sf_dir), "text", ["answer_id"])
