"""Personal data: patterns, then information-theoretic sanitisation of the terms that reveal it.

Base spans (email, ip, card, phone) are found by patterns in their own row. What they hold is
the set of protected entities. Over the whole corpus, documents are counted per term, per
entity and per both; the pointwise mutual information of a term and an entity, as a share of
the entity's information content, is the part of the entity that the term discloses. In
every document, with or without the entity, a term that discloses more than ``REMOVE`` of any
entity is removed and one beyond ``GENERALISE`` is replaced by its general kind. An entity or pair counts only with support:
``SUPPORT`` documents, and as many different neighbourhoods of the term there, so that copies
of one passage are one witness.

All of it is DataFrame operations. Term counts combine in each task before the shuffle; only
documents with a supported entity give (entity, term) rows; a hot term or entity is a key of
aggregates and of joins whose other side has one row for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.once import computed_once
from namesmith.llm.common import SPACE, packed_row, row_key, table, text_of, words_of
from namesmith.session import checkpointed

# The kinds and their patterns. Possessive repeats and the start conditions
# keep the matches those of the plain patterns, without a stack or a square in the length.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
BLOCK = 128


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^(?:0*[0-9]{{1,2}}|0*1[0-9]{{2}}|0*2[0-4][0-9]|0*25[0-5])(?:\.(?:0*[0-9]{{1,2}}|0*1[0-9]{{2}}|0*2[0-4][0-9]|0*25[0-5])){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def running(values: Column, start: Column, step) -> Column:
    """Running sum or maximum of an array, block by block: no step is the square of the array's size."""
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, BLOCK), start, step))
    before = lambda i: F.aggregate(F.slice(whole, 1, F.floor(i / BLOCK).cast("int")), start, step)
    own = lambda i: F.aggregate(F.slice(values, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, (i % BLOCK + 1).cast("int")), start, step)
    return F.transform(values, lambda _, i: step(before(i), own(i)))


def placed(text: Column, pattern: Column, prefix: str) -> list[dict[str, Column]]:
    """Layers that give ``{prefix}`` as an array of (start, end, match) for all matches of a pattern."""
    m, g, e = F.col(f"{prefix}_m"), F.col(f"{prefix}_g"), F.col(f"{prefix}_e")
    return [
        {f"{prefix}_m": F.regexp_extract_all(text, pattern, F.lit(0))},
        {f"{prefix}_g": F.when(F.size(m) > 0, F.zip_with(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), F.length), m, lambda a, b: a + F.length(b)))},
        {f"{prefix}_e": F.when(F.size(m) > 0, running(g, F.lit(0), lambda s, x: s + x))},
        {prefix: F.when(F.size(m) > 0, F.zip_with(e, m, lambda e, x: F.struct((e - F.length(x)).alias("start"), e.alias("end"), x.alias("match"))))},
    ]


NO_SPANS = "array<struct<k:int,start:int,end:int,match:string>>"


def layered(df: DataFrame, layers: list[dict[str, Column]]) -> DataFrame:
    out = df
    for layer in layers:
        out = computed_once(out, layer)
    return out


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``_base``: an array of (k, start, end, match) by kind as listed, then start."""
    steps = zip(*[placed(F.col(text), F.lit(PATTERNS[k]), f"_{k}") for k in KINDS])
    out = layered(df, [{k: v for part in step for k, v in part.items()} for step in steps])
    good = lambda k, kind: F.transform(
        F.filter(F.col(f"_{kind}"), lambda s: holds(kind, s["match"])),
        lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")),
    )
    spans = F.concat(*[F.coalesce(good(k, kind), F.array().cast(NO_SPANS)) for k, kind in enumerate(KINDS)])
    return computed_once(out, {"_base": spans}).select(*df.columns, "_base")


def revealing(docs: DataFrame, support: int, generalise: float) -> DataFrame:
    """(term, share) of the terms that disclose at least ``generalise`` of an entity, the largest
    share of each, from documents with ``_id``, ``_h``, ``_text`` and ``_base``."""
    hit = docs.filter(F.size("_base") > 0)
    held = hit.select("_id", "_h", F.explode(F.array_distinct(F.transform("_base", lambda s: s["match"]))).alias("entity"))
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support)
    of = held.join(entities, "entity").groupBy("_id", "_h").agg(F.collect_set(F.struct("entity", "n_e")).alias("of"))
    w = F.col("w")
    beside = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    words = F.transform(w, lambda x, i: F.struct(F.lower(x).alias("term"), F.xxhash64(beside(i - 1), beside(i + 1)).alias("place")))
    near = hit.join(of, ["_id", "_h"]).select("_id", "_h", "of", words_of(F.col("_text")).alias("w"))
    near = near.select("_id", "_h", "of", F.explode(F.array_distinct(words)).alias("t"))
    near = near.select("_id", "_h", F.explode("of").alias("e"), "t.term", "t.place").filter(~F.contains("term", F.lower("e.entity")))
    pairs = near.groupBy("e", "term").agg(F.count_distinct("_id", "_h").alias("n_te"), F.count_distinct("place").alias("places"))
    pairs = pairs.filter((F.col("n_te") >= support) & (F.col("places") >= support)).select("e.entity", "e.n_e", "term", "n_te")
    terms = docs.select(F.explode(F.array_distinct(F.transform(words_of(F.col("_text")), F.lower))).alias("term"))
    terms = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row
    share = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))) / F.log2(F.col("n") / F.col("n_e"))
    found = pairs.join(terms, "term").crossJoin(F.broadcast(total)).filter(F.col("n_e") < F.col("n"))
    found = found.select("term", share.alias("share")).filter(F.col("share") >= generalise)
    return found.groupBy("term").agg(F.max("share").alias("share"))


def find(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """All rows with ``spans``: an array of (kind, start, end, match), base kinds first.

    Positions are code points, the end exclusive. Kind ``term`` is a term to generalise and
    ``removed`` one to remove; such a span never overlaps a base span. Null and empty texts have
    no span. Rows that repeat id and text are one document; a column named ``spans`` is replaced.
    """
    own = [c for c in df.columns if c != "spans"]
    rest = [c for c in own if c != text]  # the text is written once
    keyed = df.select(packed_row(rest).alias("_row"), *row_key(doc_id, text_of(text)), text_of(text).alias("_text"), F.col(text).isNull().alias("_null"))
    docs = checkpointed(base_spans(keyed, "_text"))
    distinct = docs.select("_id", "_h", "_text", "_base")
    terms = checkpointed(revealing(distinct, support, generalise))  # its size is known below: no shuffle of all words where it is small
    words = distinct.select("_id", "_h", F.explode(F.array_distinct(F.transform(words_of(F.col("_text")), F.lower))).alias("term"))
    flags = words.join(terms, "term").groupBy("_id", "_h")
    flags = checkpointed(flags.agg(F.array_sort(F.collect_set(F.struct("term", "share"))).alias("_terms")))
    quoted = F.transform("_terms", lambda t: F.regexp_replace(t["term"], r"([^\p{L}\p{N}])", r"\\$1"))
    pattern = F.concat(F.lit(rf"(?<![^{SPACE}])(?iu:"), F.array_join(quoted, "|"), F.lit(rf")(?![^{SPACE}])"))
    flagged = computed_once(docs.join(flags, ["_id", "_h"], "left"), {"_pattern": F.when(F.col("_terms").isNotNull(), pattern)})
    flagged = layered(flagged, placed(F.col("_text"), F.col("_pattern"), "_found"))
    gone = lambda s: F.exists("_terms", lambda t: (t["term"] == F.lower(s["match"])) & (t["share"] >= remove))
    free = F.filter(F.col("_found"), lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.transform(free, lambda s: F.struct(F.when(gone(s), 5).otherwise(4).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
    more = F.array_sort(F.coalesce(more, F.array().cast(NO_SPANS)))
    out = flagged.withColumn("_base", F.concat("_base", more))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term", "removed")])
    spans = F.transform("_base", lambda s: F.struct(F.get(names, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))
    whole = F.when(~F.col("_null"), F.col("_text")).alias(text)
    return out.select(*[whole if c == text else F.col("_row")[c].alias(c) for c in own], spans.alias("spans"))


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with each span of ``text`` replaced by its kind in angle brackets, or by nothing
    where the term is to be removed. Of overlapping spans the first names the whole; a null text stays
    null. Repeated rows change alike; other columns stay, whatever their names."""
    rest = [c for c in df.columns if c != text]
    found = find(df.select(packed_row(rest).alias("doc"), F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", "text")
    shown = lambda new: [F.col(new).alias(c) if c == text else F.col("doc")[c].alias(c) for c in df.columns]
    s, top, at = F.col("_s"), F.col("_top"), F.col("_at")
    begin = lambda j: F.get(s, F.get(at, j))["start"]
    stop = lambda j: F.get(top, F.coalesce(F.get(at, j + 1), F.size(s)) - 1)
    name = lambda j: F.get(s, F.get(at, j))["kind"]
    piece = lambda j: F.concat(
        F.substring(F.col("text"), F.coalesce(stop(j - 1), F.lit(0)) + 1, F.coalesce(begin(j), F.length("text")) - F.coalesce(stop(j - 1), F.lit(0))),
        F.when(name(j).isNull() | (name(j) == "removed"), "").otherwise(F.concat(F.lit("<"), F.upper(name(j)), F.lit(">"))),
    )
    hit = layered(found.filter(F.size("spans") > 0), [
        {"_s": F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))},
        {"_top": running(F.transform("_s", lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))},
        {"_at": F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(top, i - 1)))},
        {"_new": F.array_join(F.transform(F.sequence(F.lit(0), F.size("_at")), piece), "")},
    ])
    return found.filter(F.size("spans") == 0).select(*shown("text")).unionByName(hit.select(*shown("_new")))


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the personal data in every document."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, ``n_chars`` anew (0 for null) where it was given; else as ``sanitise``."""
    out = sanitise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
