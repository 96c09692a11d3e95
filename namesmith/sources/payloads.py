"""Landed API payloads and HTML tables as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.text import strip


def ensured_list(fragment: Column) -> Column:
    """JSON fragment that is an object or an array, as array text; anything else is empty."""
    return (
        F.when(fragment.startswith("{"), F.concat(F.lit("["), fragment, F.lit("]")))
        .when(fragment.startswith("["), fragment)
        .otherwise(F.lit("[]"))
    )


def law_list(df: DataFrame, payload: str, keep: list[str], limit: int = 10) -> DataFrame:
    """First laws of a search payload, with defaults for missing fields."""
    fragment = F.get_json_object(payload, "$.LawSearch.law")
    laws = F.from_json(ensured_list(fragment), "ARRAY<MAP<STRING,STRING>>")
    return df.select(
        *keep,
        F.coalesce(F.get_json_object(payload, "$.LawSearch.totalCnt"), F.lit("0")).alias("total"),
        F.posexplode(F.slice(laws, 1, limit)).alias("pos", "law"),
    ).select(
        *keep, "total", (F.col("pos") + 1).alias("rank"),
        F.coalesce(F.col("law")["법령명한글"], F.lit("이름 없음")).alias("law_name"),
        F.coalesce(F.col("law")["법령일련번호"], F.lit("")).alias("mst"),
        F.coalesce(F.col("law")["시행일자"], F.lit("정보 없음")).alias("effective"),
    )


def article_key(number: Column) -> Column:
    """Digits and ``의`` of an article number: ``제12조의2`` to ``12의2``."""
    return F.array_join(F.regexp_extract_all(number, F.lit("([0-9의])"), F.lit(1)), "")


def law_articles(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Articles of a law payload: key for lookup, title from the first line, text."""
    fragment = F.get_json_object(payload, "$.법령.조문.조문단위")
    articles = F.from_json(ensured_list(fragment), "ARRAY<MAP<STRING,STRING>>")
    content = F.coalesce(F.col("jo")["조문내용"], F.lit(""))
    first_line = F.get(F.split(strip(content), "\r\n|\r|\n"), F.lit(0))
    return df.select(
        *keep,
        F.coalesce(F.get_json_object(payload, "$.법령.기본정보.법령명_한글"), F.lit("법령명 미상")).alias("law_name"),
        F.posexplode(articles).alias("pos", "jo"),
    ).select(
        *keep, "law_name", "pos", F.coalesce(F.col("jo")["조문번호"], F.lit("?")).alias("number"),
        article_key(F.coalesce(F.col("jo")["조문번호"], F.lit(""))).alias("article_key"),
        F.substring(first_line, 1, 30).alias("title"), content.alias("content"),
    )


def article_lookup(articles: DataFrame, keep: list[str], number: Column) -> DataFrame:
    """First article of each payload whose key equals the requested number's key."""
    hits = articles.filter(F.col("article_key") == article_key(number))
    return hits.groupBy(*keep).agg(F.min_by(F.struct("law_name", "article_key", "content"), "pos").alias("_h")).select(*keep, "_h.*")


def word_senses(df: DataFrame, payload: str, word: str, keep: list[str]) -> DataFrame:
    """Dictionary payload to one row per sense; no entry gives one failed row."""
    total = F.coalesce(F.get_json_object(payload, "$.channel.total").try_cast("int"), F.lit(0))
    items = F.from_json(ensured_list(F.get_json_object(payload, "$.channel.item")), "ARRAY<MAP<STRING,STRING>>")
    code = F.get_json_object(payload, "$.error.error_code")
    status = F.when(F.get_json_object(payload, "$.error").isNotNull(), "api_error").when(total == 0, "failed").otherwise("ok")
    rows = df.select(
        *keep, F.col(word).alias("word"), status.alias("status"), F.coalesce(code, F.lit("")).alias("error_code"),
        total.alias("total"), F.when(status == "ok", items).alias("_items"),
    ).select(
        *keep, "word", "status", "error_code", "total", F.posexplode_outer("_items").alias("_i", "_item")
    )
    senses = F.from_json(ensured_list(F.col("_item")["sense"]), "ARRAY<MAP<STRING,STRING>>")
    flat = rows.select(
        *keep, "status", "error_code", "total", F.coalesce(F.col("_i") + 1, F.lit(0)).alias("entry"),
        F.coalesce(F.col("_item")["word"], F.col("word")).alias("word"), F.posexplode_outer(senses).alias("_s", "_sense"),
    ).filter((F.col("status") != "ok") | F.col("_sense").isNotNull())
    return flat.select(
        *keep, "word", "status", "error_code", "total", "entry", F.coalesce(F.col("_s") + 1, F.lit(0)).alias("sense"),
        F.when(F.col("status") == "ok", F.coalesce(F.col("_sense")["definition"], F.lit("뜻풀이 없음"))).otherwise("").alias("definition"),
        F.coalesce(F.col("_sense")["link"], F.lit("")).alias("link"),
    )


# The entities that occur in plain table text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def element_text(html: Column) -> Column:
    """Text of an element: tags cut out, each piece trimmed, pieces joined."""
    pieces = F.transform(F.split(html, "<[^>]*>"), lambda p: strip(_unescaped(p)))
    return F.array_join(pieces, "")


def _unescaped(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def table_rows(
    df: DataFrame, html: str, keep: list[str], scope: str = r'(?s)<table[^>]*class="standard-table"[^>]*>(.*?)</table>',
    row_tag: str = "tr", cell_tags: str = "td|th", header_rows: int = 1, min_cells: int = 4,
) -> DataFrame:
    """Rows of the first matching table: header skipped, short rows and empty names dropped."""
    body = F.regexp_extract(html, scope, 1)
    rows = F.regexp_extract_all(body, F.lit(rf"(?s)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"), F.lit(1))
    rows = F.slice(rows, header_rows + 1, F.greatest(F.size(rows), F.lit(1)))
    cells = F.regexp_extract_all("_row", F.lit(rf"(?s)<(?:{cell_tags})\b[^>]*>(.*?)</(?:{cell_tags})>"), F.lit(1))
    return (
        df.select(*keep, F.posexplode(rows).alias("row_no", "_row"))
        .select(*keep, "row_no", F.transform(cells, element_text).alias("_c"))
        .filter(F.size("_c") >= min_cells)
        .select(*keep, "row_no", *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(("name", "meaning", "gender", "trend"))])
        .filter(F.col("name") != "")
    )


def balanced(html: Column, tag: str) -> Column:
    """Outermost elements of a tag, elements of the same tag inside them included.

    The text is cut before each opening and behind each closing tag; the running depth of the pieces says where an
    element ends. What is never closed is no element.
    """
    opening, closing = rf"<{tag}(?=[\s>/])", f"</{tag}>"
    pieces = F.split(html, rf"(?={opening})|(?<={closing})")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.rlike(f"^{opening}"), piece.endswith(closing)
        inside = (state["depth"] > 0) | opens
        depth = F.when(inside, state["depth"] + opens.cast("int") - closes.cast("int")).otherwise(0)
        text = F.when(inside, F.concat(state["open"], piece)).otherwise("")
        ended = inside & (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when(ended, "").otherwise(text).alias("open"), F.when(ended, F.array_append(state["done"], text)).otherwise(state["done"]).alias("done")
        )

    return F.aggregate(pieces, start, step)["done"]


def inner(element: Column) -> Column:
    """What stands between an element's own tags."""
    return F.regexp_extract(element, r"(?s)^<[^>]*>(.*)</[^>]*>$", 1)


def listed_rows(df: DataFrame, html: str, keep: list[str], scope: str, row: str, cell: str, min_cells: int = 4) -> DataFrame:
    """Rows of all outermost ``scope`` elements of a page: (scope_no, row_no, cells). Nested elements stay part of
    their cell. Rows with fewer cells or an empty first cell are left out."""
    scopes = df.select(*keep, F.posexplode(balanced(F.col(html), scope)).alias("scope_no", "_e"))
    rows = scopes.select(*keep, "scope_no", F.posexplode(balanced(inner(F.col("_e")), row)).alias("row_no", "_r"))
    cells = rows.select(*keep, "scope_no", "row_no", F.transform(balanced(inner(F.col("_r")), cell), lambda c: strip(element_text(inner(c)))).alias("cells"))
    return cells.filter((F.size("cells") >= min_cells) & (F.get("cells", F.lit(0)) != ""))
