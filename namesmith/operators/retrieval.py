"""Search of a collection from the text of a question, as rendered answers.

The collection decides which conditions a question states and how a hit is shown. Every
request has an answer: hits, a no-result line, or an error for a name that is no collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions import text as X
from namesmith.functions.once import computed_once
from namesmith.operators import cells as N
from namesmith.operators import lookups as L

# The collections, and the phrases of the answers.
COLLECTIONS = ("suri_col", "ohaeng_col", "hanja_col", "law_col", "urimalsam_col", "paper_col")
HANJA, PAPER = "hanja_col", "paper_col"
INVALID = ("[오류] '", "'은 유효하지 않은 컬렉션입니다.\n사용 가능: ")
MISSING = ("[결과 없음] '", "' 컬렉션이 존재하지 않습니다.\n인덱싱이 완료되지 않았거나 경로가 잘못되었습니다.")
NOTHING = ("[결과 없음] '", "'에 대한 유사 문서를 찾지 못했습니다.")
CONDITIONS = ["strokes", "resource_ohaeng", "chunk_type"]


def shown_number(c: Column) -> Column:
    """A rounded number with up to four decimals, at least one."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), r"\.$", ".0")


def conditions(df: DataFrame, query: str, collection: str) -> DataFrame:
    """Add the conditions a question states for its collection, and ``described``, their text ('' without any)."""
    q, hanja = F.col(query), F.col(collection) == HANJA
    strokes, element = L.character_conditions(q)
    chunk = F.when(F.col(collection) == PAPER, L.chunk_condition(q))
    df = computed_once(df, {"strokes": F.when(hanja, strokes), "resource_ohaeng": F.when(hanja, element), "chunk_type": chunk})
    parts = F.concat_ws(", ", F.concat(F.lit("획수 "), "strokes", F.lit("획")), F.concat(F.lit("자원오행 "), "resource_ohaeng"), F.concat(F.lit("chunk_type="), "chunk_type"))
    return df.withColumn("described", parts)


def _meta(name: str, missing: str = "") -> Column:
    return F.coalesce(F.try_element_at("metadata", F.lit(name)), F.lit(missing))


def hit_text(collection: Column) -> Column:
    """One hit as it is shown: rank, document, metadata (map) and distance are columns of the row."""
    no, content = F.col("rank").cast("string"), F.col("document")
    permitted = F.when(_meta("is_person_name_hanja").isin("true", "True", "1"), "예").otherwise("아니오")
    character = F.concat(
        F.lit("["), no, F.lit("] "), _meta("hanja"), F.lit("("), _meta("hangul"), F.lit(") | 획수: "), _meta("strokes", "?"), F.lit("획 | 자원오행: "), _meta("resource_ohaeng", "?"),
        F.lit(" | 발음오행: "), _meta("sound_ohaeng", "?"), F.lit(" | 뜻: "), _meta("sound_meaning"), F.lit(" | 인명용: "), permitted, F.lit("\n    [한자: 자원오행표 "), _meta("resource_ohaeng", "?"), F.lit("오행]"),
    )
    like = shown_number(X.similarity(F.col("distance")))
    kind = _meta("chunk_type", "text")
    paper = F.concat(
        F.lit("  ["), no, F.lit("] 유사도: "), like, F.lit(" | "), kind, F.lit("\n      "), _meta("title"), F.lit("("), _meta("year"), F.lit(") — "), _meta("author"), F.lit(" | p."), _meta("page_number", "?"),
        F.lit("\n      "), X.clipped(content, F.when(kind == "table", 500).otherwise(300)),
    )
    plain = F.concat(
        F.lit("  ["), no, F.lit("] 유사도: "), like, F.lit("\n      메타: "), X.metadata_line(F.col("metadata")), F.lit("\n      내용: "), X.clipped(content, F.lit(200)), F.lit("\n      [출처: "), collection, F.lit("]"),
    )
    return F.when(collection == HANJA, character).when(collection == PAPER, paper).otherwise(plain)


def headline(query: Column, collection: Column, n: Column, described: Column) -> Column:
    note = lambda label: F.when(described != "", F.concat(F.lit(f" [{label}: "), described, F.lit("]"))).otherwise(F.lit(""))
    hanja = F.concat(F.lit("[검색 결과] '"), query, F.lit("' — hanja_col ("), n, F.lit("건)"), note("조건 필터"))
    other = F.concat(F.lit("["), collection, F.lit("] '"), query, F.lit("' 검색 결과 "), n, F.lit("건"), F.when(collection == PAPER, note("필터")).otherwise(F.lit("")))
    return F.concat(F.when(collection == HANJA, hanja).otherwise(other), F.lit("\n"))


def searched(requests: DataFrame, documents: DataFrame, metric: str = "cosine") -> DataFrame:
    """request_id, ``status`` (ok, none, missing, error), ``n`` hits and the rendered ``text``.

    ``requests``: request_id, query, collection, n_results (at most 30), vector. ``documents``: id, collection,
    document, metadata (map), embedding, and strokes, resource_ohaeng and chunk_type to filter by. Hits are at most
    30 a request, so an answer is put together from few rows. A null query is empty.
    """
    asked = requests.withColumn("query", F.coalesce("query", F.lit(""))).withColumn("collection", F.coalesce("collection", F.lit("")))
    asked = conditions(asked, "query", "collection")
    index = N.build_cells(documents, CONDITIONS, metric, ("document", "metadata"))
    valid = asked.filter(F.col("collection").isin(*COLLECTIONS)).withColumnRenamed("request_id", "query_id")
    hits = N.search_cells(valid.select("query_id", "collection", "vector", "n_results", *CONDITIONS), index, columns=("document", "metadata"))
    hits = hits.join(valid.select("query_id", "collection"), "query_id")
    shown = hits.select("query_id", "rank", hit_text(F.col("collection")).alias("line")).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("lines")
    )
    there = index.cells.select("collection").distinct().withColumn("there", F.lit(True))  # a short list
    out = asked.join(shown.withColumnRenamed("query_id", "request_id"), "request_id", "left").join(there, "collection", "left")
    status = F.when(~F.col("collection").isin(*COLLECTIONS), "error").when(F.col("there").isNull(), "missing").when(F.col("n").isNull(), "none").otherwise("ok")
    around = lambda parts, c: F.concat(F.lit(parts[0]), F.col(c), F.lit(parts[1]))
    text = (
        F.when(F.col("status") == "error", F.concat(around(INVALID, "collection"), F.lit(", ".join(COLLECTIONS))))
        .when(F.col("status") == "missing", around(MISSING, "collection"))
        .when(F.col("status") == "none", around(NOTHING, "query"))
        .otherwise(F.concat(headline(F.col("query"), F.col("collection"), F.col("n").cast("string"), F.col("described")), F.lit("\n"), "lines"))
    )
    out = out.withColumn("status", status)
    return out.select("request_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), text.alias("text"))
