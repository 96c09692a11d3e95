"""Vector search over the embeddings and upkeep of the text collections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.text import char_of
from namesmith.operators import cells as N
from namesmith.operators import retrieval as RT
from namesmith.operators import vectors as V
from namesmith.operators.retrieval import COLLECTIONS, INVALID, MISSING, NOTHING
from namesmith.plans import Registry
from namesmith.plans import standins as S
from namesmith.session import shared_dir

AREA = Registry()

# Each label is a collection; element and strokes are metadata. Every hundredth vector asks.
_E = S.label_sql("(vec_id + vec_id // 7) % 5")
S.VIEWS["vectors"] = f"SELECT vec_id AS id, label AS collection, {_E} AS resource_ohaeng, CAST(vec_id // 5 % 3 + 1 AS INT) AS strokes, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
S.VIEWS["vector_queries"] = """SELECT id AS query_id, collection, CASE WHEN strpos('목화토', resource_ohaeng) > 0 THEN resource_ohaeng END AS cond, CASE WHEN id // 100 % 2 = 1 THEN strokes END AS lines,
    CASE WHEN id // 100 % 5 < 4 THEN resource_ohaeng END AS own, id // 100 % 3 = 1 AS single, CAST(3 + id // 100 % 13 * 4 AS INT) AS n_results, v FROM vectors WHERE id % 100 = 0"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    return S.table(spark, sf_dir, "embeddings").select(
        key.alias("id"), F.col("label").alias("collection"), E.label_of((key + F.floor(key / 7)) % 5).alias("resource_ohaeng"), (F.floor(key / 5) % 3 + 1).cast("int").alias("strokes"), "embedding"
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, own = F.floor(F.col("id") / 100), F.col("resource_ohaeng")
    return vectors(spark, sf_dir).filter(F.col("id") % 100 == 0).select(
        F.col("id").cast("string").alias("query_id"), "collection", F.when(step % 5 < 4, own).alias("own"), F.when(own.isin("목", "화", "토"), own).alias("resource_ohaeng"),
        F.when(step % 2 == 1, F.col("strokes")).alias("strokes"), (step % 3 == 1).alias("single"), (step % 13 * 4 + 3).cast("int").alias("n_results"), F.col("embedding").alias("vector"),
    )


_COS = "1 - list_dot_product(q.v, d.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(d.v, d.v))"
_L2 = "list_sum(list_transform(list_zip(q.v, d.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _search_sql(dist: str) -> str:
    return S.with_views(
        "vectors", "vector_queries",
        r=f"""SELECT q.query_id, n_results, d.id, {dist} AS distance FROM vector_queries q JOIN vectors d ON d.collection = q.collection
          AND (q.cond IS NULL OR d.resource_ohaeng = q.cond) AND (q.lines IS NULL OR d.strokes = q.lines)""",
        k="SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r",
        body="SELECT query_id, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM k WHERE rank <= greatest(1, least(n_results, 30))",
    )


CONDITIONS = ["resource_ohaeng", "strokes"]


def _found(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    found = N.search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), CONDITIONS, metric=metric)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", "id", F.round("distance", 6).alias("distance"))


@AREA.add("v1_filtered_search", _search_sql(_COS))
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "cosine")


@AREA.add("v2_euclidean_search", _search_sql(_L2))
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "l2")


@AREA.add(
    "g8_chain_search",
    S.with_views("vectors", "vector_queries",
      parts="""SELECT *, CASE WHEN own IS NULL THEN 'own' WHEN s = 1 THEN 'first' ELSE 'second' END AS part, strpos('목화토금수', own) - 1 AS e, CASE WHEN own IS NULL OR single THEN n_results ELSE n_results // 2 END AS n
        FROM vector_queries, (VALUES (1), (2)) AS t(s) WHERE s = 1 OR own IS NOT NULL AND NOT single""",
      r=f"""SELECT q.query_id, part, n, d.id, {_COS} AS distance FROM parts q JOIN vectors d ON d.collection = q.collection AND (lines IS NULL OR d.strokes = lines)
        AND CASE WHEN own IS NULL THEN cond IS NULL OR d.resource_ohaeng = cond ELSE strpos('목화토금수', d.resource_ohaeng) - 1 = (e + s) % 5 END""",
      k="SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY distance, id) AS rank FROM r",
      body="SELECT query_id, part, CAST(rank AS INT) AS rank, id, round(distance, 6) AS distance FROM k WHERE rank <= greatest(1, least(n, 30))"),
)
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = N.build_cells(vectors(spark, sf_dir), CONDITIONS)
    found = N.searched_by_chain(vector_queries(spark, sf_dir), index, "own", "n_results", "single")
    return found.select(F.col("query_id").cast("long").alias("query_id"), "part", "rank", "id", F.round("distance", 6).alias("distance"))


# The text collections: one row per document, page, benchmark item and character.
S.VIEWS["collections"] = """SELECT 'doc' AS collection, 'doc_' || doc_id AS id, md5(text) AS body FROM documents UNION ALL SELECT 'page', 'page_' || page_id, md5(html) FROM pages
    UNION ALL SELECT 'bench', 'bench_' || item_id, md5(text) FROM benchmark UNION ALL SELECT 'char', 'hanja_' || profile_id, md5(sound_meaning) FROM chars"""


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, prefix: str, df: DataFrame, key: str, text: str) -> DataFrame:
        return df.select(F.lit(name).alias("collection"), F.concat(F.lit(prefix), F.col(key)).alias("id"), F.md5(text).alias("body"))

    return (
        part("doc", "doc_", S.table(spark, sf_dir, "documents"), "doc_id", "text")
        .unionByName(part("page", "page_", S.table(spark, sf_dir, "pages"), "page_id", "html"))
        .unionByName(part("bench", "bench_", S.table(spark, sf_dir, "benchmark"), "item_id", "text"))
        .unionByName(part("char", "hanja_", S.chars(spark, sf_dir), "profile_id", "sound_meaning"))
    )


# A second load of documents: half of the ids are known, half are new, each comes twice with different bodies.
S.VIEWS["second_load"] = """SELECT 'doc' AS collection, 'doc_' || doc_id * 2 AS id, md5(text || k) AS body, doc_id * 2 + k AS seq FROM documents, (VALUES (0), (1)) AS t(k)"""


def second_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = S.table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return twice.select(
        F.lit("doc").alias("collection"), F.concat(F.lit("doc_"), F.col("doc_id") * 2).alias("id"), F.md5(F.concat("text", F.col("k").cast("string"))).alias("body"), (F.col("doc_id") * 2 + F.col("k")).alias("seq")
    )


@AREA.add("v3_collections", S.with_views("chars", "collections", body="SELECT * FROM collections"))
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections after they were replaced once."""
    path, rows = f"{shared_dir(spark)}/collections-{uuid.uuid4().hex}", collections(spark, sf_dir)
    for part in (rows.filter("collection = 'bench'"), rows):
        V.recreate(part, path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@AREA.add(
    "v4_appended_rows",
    S.with_views("chars", "collections", "second_load", body="SELECT * FROM collections UNION ALL SELECT collection, id, arg_min(body, seq) FROM second_load WHERE id NOT IN (SELECT id FROM collections) GROUP BY ALL"),
)
def v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = collections(spark, sf_dir)
    return there.unionByName(V.new_rows(there, second_load(spark, sf_dir), ["collection", "id"], ["seq"]).drop("seq"))


@AREA.add(
    "v5_upserted_rows",
    S.with_views("chars", "collections", "second_load", body="SELECT * FROM collections WHERE id NOT IN (SELECT id FROM second_load) UNION ALL SELECT collection, id, arg_max(body, seq) FROM second_load GROUP BY ALL"),
)
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.upserted(collections(spark, sf_dir), second_load(spark, sf_dir), ["collection", "id"], ["seq"])


@AREA.add(
    "v6_collection_counts",
    S.with_views("chars", "collections", body="""SELECT e.collection, count(c.id) AS n, CASE WHEN count(c.id) = 0 THEN '미생성' ELSE 'ok' END AS status
      FROM (VALUES ('doc'), ('page'), ('char'), ('paper')) AS e(collection) LEFT JOIN collections c USING (collection) GROUP BY 1"""),
)
def v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("doc",), ("page",), ("char",), ("paper",)], "collection string")
    return V.collection_counts(collections(spark, sf_dir), expected)


@AREA.add(
    "v7_metadata_of",
    S.with_views("chars", f="SELECT hanja, min_by(resource_ohaeng, seq) AS e, min_by(strokes, seq) AS s FROM chars GROUP BY 1",
      q=f"SELECT o_orderkey, chr(CAST({S.FIRST_CHAR} + o_custkey * 2 AS INT)) AS asked FROM orders",
      body="SELECT o_orderkey, asked, coalesce(e, '') AS resource_ohaeng, coalesce(s, 0) AS strokes FROM q LEFT JOIN f ON f.hanja = asked"),
)
def v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "orders").select("o_orderkey", char_of(F.lit(S.FIRST_CHAR) + F.col("o_custkey") * 2).alias("asked"))
    return V.metadata_of(asked, "asked", S.chars(spark, sf_dir), "seq")


# -- questions asked of collections ----------------------------------------------------------

_NAMES = ("suri_col", "ohaeng_col", "hanja_col", "law_col", "hanja_col", "paper_col", "hanja_col", "paper_col")
_SHORT = ("밝은 뜻의 木오행 한자 2획", "이름 통계 표", "본문 내용만", "수리 81획", "3 획 이고 토오행", "법령", "")
S.VIEWS["library"] = f"""SELECT vec_id AS id, {S.sql_list(_NAMES)}[CAST(label % 8 AS INT) + 1] AS collection, repeat('글 ' || vec_id || ' ', CAST(vec_id % 90 AS INT)) AS document, CAST(vec_id // 5 % 3 + 1 AS INT) AS strokes,
    {S.label_sql("(vec_id + vec_id // 7) % 5")} AS e, CASE WHEN vec_id % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type, 'title ' || vec_id % 11 AS title, CAST(1990 + vec_id % 30 AS VARCHAR) AS year, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"""
S.VIEWS["asked"] = f"""SELECT vec_id AS request_id, {S.sql_list(_SHORT)}[CAST(vec_id // 20 % {len(_SHORT)} AS INT) + 1] AS query, v,
    {S.sql_list((*COLLECTIONS, "nope_col"))}[CAST(vec_id // 20 % 13 % 7 AS INT) + 1] AS collection, CAST(vec_id // 20 % 12 * 5 - 2 AS INT) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE vec_id % 20 = 0"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    strokes, element, chunk = (F.floor(key / 5) % 3 + 1).cast("int"), E.label_of((key + F.floor(key / 7)) % 5), F.when(key % 3 == 0, "table").otherwise("text")
    pairs = {
        "hanja": char_of(F.lit(S.FIRST_CHAR) + key), "strokes": strokes.cast("string"), "resource_ohaeng": element, "chunk_type": chunk, "title": F.concat(F.lit("title "), key % 11),
        "year": (key % 30 + 1990).cast("string"), "source": F.lit("hidden"), "is_person_name_hanja": (key % 2 == 0).cast("string"),
    }
    return S.table(spark, sf_dir, "embeddings").select(
        key.alias("id"), S.picked(_NAMES, F.col("label") % 8).alias("collection"), F.expr("repeat(concat('글 ', vec_id, ' '), cast(vec_id % 90 as int))").alias("document"), strokes.alias("strokes"),
        element.alias("resource_ohaeng"), chunk.alias("chunk_type"), F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("metadata"), "embedding",
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.floor(F.col("vec_id") / 20)
    return S.table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(
        F.col("vec_id").alias("request_id"), S.picked(_SHORT, step % len(_SHORT)).alias("query"), S.picked((*COLLECTIONS, "nope_col"), step % 13 % 7).alias("collection"),
        (step % 12 * 5 - 2).cast("int").alias("n_results"), F.col("embedding").alias("vector"),
    )


_Q = "'[검색 결과] ''' || query || ''' — hanja_col ('"
_LIKE = "regexp_replace(regexp_replace(printf('%.4f', round(1 - distance, 4)), '0+$', ''), '\\.$', '.0')"
_CUT = "substr(document, 1, {n}) || CASE WHEN length(document) > {n} THEN '...' ELSE '' END"
_PERMITTED = "CASE WHEN id % 2 = 0 THEN '예' ELSE '아니오' END"


@AREA.add(
    "v8_searched_questions",
    S.with_views("library", "asked",
      a=f"""SELECT *, CASE WHEN collection = 'hanja_col' THEN TRY_CAST(regexp_extract(query, '(\\d+)\\s*획', 1) AS INT) END AS s, CASE WHEN collection = 'hanja_col' THEN nullif(translate(regexp_extract(query, '([木火土金水목화토금수])오행', 1), '木火土金水', '목화토금수'), '') END AS el,
        CASE WHEN collection = 'paper_col' THEN CASE WHEN contains(query, '표') OR contains(query, '통계') THEN 'table' WHEN contains(query, '본문') THEN 'text' END END AS ct FROM asked""",
      r=f"""SELECT a.request_id, a.query, a.collection, n, s, el, ct, d.id, document, d.strokes, d.e, d.chunk_type, title, year, {_COS.replace('q.v', 'a.v')} AS distance FROM a JOIN library d ON d.collection = a.collection AND (s IS NULL OR d.strokes = s) AND (el IS NULL OR d.e = el) AND (ct IS NULL OR d.chunk_type = ct)""",
      k="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS rank FROM r) WHERE rank <= greatest(1, least(n, 30))",
      l=f"""SELECT request_id, rank, CASE collection WHEN 'hanja_col' THEN '[' || rank || '] ' || chr(CAST({S.FIRST_CHAR} + id AS INT)) || '() | 획수: ' || strokes || '획 | 자원오행: ' || e || ' | 발음오행: ? | 뜻:  | 인명용: ' || {_PERMITTED} || chr(10) || '    [한자: 자원오행표 ' || e || '오행]'
        WHEN 'paper_col' THEN '  [' || rank || '] 유사도: ' || {_LIKE} || ' | ' || chunk_type || chr(10) || '      ' || title || '(' || year || ') —  | p.?' || chr(10) || '      ' || CASE chunk_type WHEN 'table' THEN {_CUT.format(n=500)} ELSE {_CUT.format(n=300)} END
        ELSE '  [' || rank || '] 유사도: ' || {_LIKE} || chr(10) || '      메타: chunk_type: ' || chunk_type || ' | hanja: ' || chr(CAST({S.FIRST_CHAR} + id AS INT)) || ' | is_person_name_hanja: ' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END
          || ' | resource_ohaeng: ' || e || ' | strokes: ' || strokes || ' | title: ' || title || ' | year: ' || year || chr(10) || '      내용: ' || {_CUT.format(n=200)} || chr(10) || '      [출처: ' || collection || ']' END AS line FROM k""",
      g="SELECT request_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS lines FROM l GROUP BY 1",
      t=f"""SELECT a.request_id, query, collection, coalesce(g.n, 0) AS n, lines, concat_ws(', ', '획수 ' || s || '획', '자원오행 ' || el, 'chunk_type=' || ct) AS described,
        CASE WHEN collection = 'nope_col' THEN 'error' WHEN collection NOT IN (SELECT collection FROM library) THEN 'missing' WHEN g.n IS NULL THEN 'none' ELSE 'ok' END AS status FROM a LEFT JOIN g USING (request_id)""",
      body=f"""SELECT request_id, status, n, CASE status WHEN 'error' THEN '{INVALID[0].replace("'", "''")}' || collection || '{INVALID[1].replace("'", "''")}{", ".join(COLLECTIONS)}' WHEN 'missing' THEN '{MISSING[0].replace("'", "''")}' || collection || '{MISSING[1].replace("'", "''")}'
        WHEN 'none' THEN '{NOTHING[0].replace("'", "''")}' || query || '{NOTHING[1].replace("'", "''")}' ELSE CASE collection WHEN 'hanja_col' THEN {_Q} || n || '건)' || CASE WHEN described <> '' THEN ' [조건 필터: ' || described || ']' ELSE '' END
        ELSE '[' || collection || '] ''' || query || ''' 검색 결과 ' || n || '건' || CASE WHEN collection = 'paper_col' AND described <> '' THEN ' [필터: ' || described || ']' ELSE '' END END || chr(10) || chr(10) || lines END AS text FROM t"""),
)
def v8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered from their collection, with error and no-result answers."""
    return RT.searched(asked(spark, sf_dir), library(spark, sf_dir))
