"""Segmentation of documents: articles, paragraphs, sentence chunks, answer sections.

A document is one row, so its parts are found inside the row; nothing is shuffled. Only
the table-box filter joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namesmith.functions.once import bound, computed_once
from namesmith.functions.text import strip

MARK = "\u0001"
# Header patterns and size limits.
ARTICLE = r"(제\d+조의?\d*\([^)]+\))"
MIN_ARTICLE = 20
SHORT_PARAGRAPH = 50
CHUNK_SIZE = 500
SECTION = r"(?=\n## \[이름 \d+\])"


def law_articles(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Articles by header; bodies shorter than 20 characters are dropped."""
    marked = F.regexp_replace(text, ARTICLE, MARK + "$1")
    parts = F.slice(F.split(marked, MARK), F.lit(2), F.greatest(F.size(F.split(marked, MARK)), F.lit(1)))
    body = strip(F.col("_part"))
    return (
        df.select(*keep, F.posexplode(parts).alias("article_no", "_part"))
        .select(
            *keep, "article_no", F.regexp_extract("_part", r"제(\d+조의?\d*)", 1).alias("article_num"),
            F.regexp_extract("_part", r"\(([^)]+)\)", 1).alias("title"), body.alias("raw_text"),
        )
        .filter(F.length("raw_text") >= MIN_ARTICLE)
    )


def merged_paragraphs(text: Column, separator: str = r"\n\s*\n", short: int = SHORT_PARAGRAPH) -> Column:
    """Paragraphs with short ones put in front of the next; a short tail joins the last."""
    clean = F.filter(F.transform(F.split(text, separator), lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")
    joined = F.array_join(F.transform(clean, lambda p: F.concat(p, F.when(F.length(p) < short, " ").otherwise(MARK))), "")
    # what follows the last mark is the tail of short paragraphs
    last = F.substring_index(joined, MARK, -1)
    tail = strip(last)
    body = F.substring(joined, F.lit(1), F.length(joined) - F.length(last) - 1)
    whole = F.when(~F.contains(joined, F.lit(MARK)), tail).when(tail == "", body).otherwise(F.concat(body, F.lit(" "), tail))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(whole, MARK))


def _chunk_starts(sentences: Column, size: int) -> Column:
    """1-based indices of the sentences that open a chunk.

    Each depends on how full the chunk before it is, so this is a fold; it carries two
    numbers and the indices, never the text.
    """
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("i"), F.array(F.lit(1)).alias("starts"))

    def step(state: Column, length: Column) -> Column:
        full = (state["length"] + length > size) & (state["length"] > 0)
        return F.struct(
            (F.when(full, 0).otherwise(state["length"]) + length + 1).alias("length"), (state["i"] + 1).alias("i"),
            F.when(full, F.array_append(state["starts"], state["i"] + 1)).otherwise(state["starts"]).alias("starts"),
        )

    return F.aggregate(F.transform(sentences, F.length), start, step)["starts"]


def packed_chunks(df: DataFrame, paragraphs: Column, keep: list[str], size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of at most ``size`` characters from whole sentences; short paragraphs stay
    whole and so does a longer single sentence."""
    paras = df.select(*keep, F.posexplode(paragraphs).alias("paragraph_no", "_p"))
    sentences = F.when(F.length("_p") > size, F.split("_p", r"(?<=[.?!])\s+")).otherwise(F.array("_p"))
    cut = paras.select(*keep, "paragraph_no", sentences.alias("_s"))
    cut = computed_once(cut, {"_starts": _chunk_starts(F.col("_s"), size)})
    chunks = F.transform(
        "_starts",
        lambda s, i: F.array_join(F.slice("_s", s, F.coalesce(F.get("_starts", i + 1), F.size("_s") + 1) - s), " "),
    )
    return (
        cut.select(*keep, "paragraph_no", F.posexplode(chunks).alias("chunk_no", "_c"))
        .select(*keep, "paragraph_no", "chunk_no", strip(F.col("_c")).alias("chunk")).filter("chunk <> ''")
    )


def outside_boxes(objects: DataFrame, boxes: DataFrame, object_id: list[str], tile: tuple[float, float] = (32.0, 32.0)) -> DataFrame:
    """Objects that overlap no box on their page; touching edges do not overlap.

    Both sides carry page, x0, top, x1, bottom. Pages are cut into a grid, objects and boxes enter every cell they
    reach, and the join runs per (page, cell): a crowded page spreads over its cells in both directions. A pair that
    shares several cells is looked at in one of them, that of the corner where the overlap begins.
    """
    wide, high = tile
    edges = ("x0", "top", "x1", "bottom")

    def spread(df: DataFrame) -> DataFrame:
        across = F.explode(F.sequence(F.floor(F.col("x0") / wide), F.floor(F.col("x1") / wide))).alias("_cx")
        return df.select("*", across).select("*", F.explode(F.sequence(F.floor(F.col("top") / high), F.floor(F.col("bottom") / high))).alias("_cy"))

    o = spread(objects.select("page", *edges, *[c for c in object_id if c not in ("page", *edges)])).alias("o")
    b = spread(boxes.select("page", *edges)).alias("b")
    of = lambda side, c: F.col(f"{side}.{c}")
    overlap = (of("o", "x1") > of("b", "x0")) & (of("o", "x0") < of("b", "x1")) & (of("o", "bottom") > of("b", "top")) & (of("o", "top") < of("b", "bottom"))
    here = (F.floor(F.greatest(of("o", "x0"), of("b", "x0")) / wide) == of("o", "_cx")) & (F.floor(F.greatest(of("o", "top"), of("b", "top")) / high) == of("o", "_cy"))
    same = (of("o", "page") == of("b", "page")) & (of("o", "_cx") == of("b", "_cx")) & (of("o", "_cy") == of("b", "_cy"))
    hit = o.join(b, same & overlap & here, "left_semi").select(*object_id)
    return objects.join(hit, object_id, "left_anti")


def sections_of(text: Column) -> Column:
    """Preamble first, then one element per numbered name section."""
    def cut(normalized: Column) -> Column:
        parts = F.split(normalized, SECTION)
        # a split at the very start leaves no empty piece before it
        return F.when(normalized.rlike(rf"^{SECTION}"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)

    return bound(bound(text, lambda t: F.when(t.startswith("\n"), t).otherwise(F.concat(F.lit("\n"), t))), cut)


def name_sections(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(preamble, section_no, section) per numbered section; 0 is the preamble itself."""
    parts = df.select(*keep, F.posexplode(sections_of(F.col(text))).alias("section_no", "section"))
    return parts.select(
        *keep, "section_no", F.when(F.col("section_no") == 0, F.regexp_replace("section", r"^\n+", "")).otherwise(F.col("section")).alias("section")
    )
