"""Audit of how far the sources of a language diverge in their terms.

Terms a language keeps are numbered, frequent ones first, so that the rare ones, which most
sources lack, lie together. A source's counts in the order of those numbers are the leaves of
a segment tree. Nodes are hash-consed: equal subtrees of counts are one node, whichever source
and place they come from. Two trees are compared by walking them at once from the root; pairs
of nodes that occur again within a pair of trees are met once, with the number of times, and
each distinct pair of leaves is priced once.

Trees are cut into blocks of ``BLOCK`` numbers and groups of sources into tiles of ``TILE``, so
a task holds at most 2 * TILE * BLOCK counts, whatever the vocabulary or the number of sources.
Above a block a node's price is the sum of its children's, which is an aggregate over blocks.
All arithmetic is in integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.functions.order import running_index
from namesmith.llm.common import table
from namesmith.session import checkpointed

LEAST_DOCS, TOP = 3, 200
BLOCK, TILE = 1 << 10, 32
UNIT = 1_000_000_000  # shares are counted in parts of it
# A task hands on its counts when it holds so many terms or bytes of them.
HELD_TERMS, HELD_BYTES = 200_000, 1 << 24
# Sources of all languages up to this number (some 10 MB) are sent to every task.
SENT = 100_000


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``n`` occurrences and ``d`` documents of each term in each (lang, source). The empty term marks that the group occurs."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(part(lang).alias("lang"), part(source).alias("source"), part(text).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in UTF-8 every byte beyond ASCII belongs to a character beyond ASCII
        word = re.compile(rb"[a-z\x80-\xff]+")
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (own_lang, own_source), (n, d) in groups.items():
                k = len(n) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own_lang] * k), pa.array([own_source] * k), pa.array([b"", *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "d"],
                )
            groups.clear()

        held = weight = 0
        for batch in batches:
            for own_lang, own_source, own_text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, d = groups.setdefault((own_lang, own_source), (Counter(), Counter()))
                found = word.findall(own_text.lower())
                before = len(n)
                n.update(found)
                once = set(found)
                d.update(once)
                if len(n) > before:
                    held += len(n) - before
                    weight += sum(map(len, once))
                if held > HELD_TERMS or weight > HELD_BYTES:
                    yield from rows()
                    held = weight = 0
        yield from rows()

    counts = texts.mapInArrow(counted, "lang string, source string, term string, n long, d long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def vocabulary(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Kept terms of each language: ``total`` occurrences and ``id`` from 0, classes of like totals in descending order."""
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).filter(F.col("d") >= least)
    size = 64 - F.length(F.bin("total"))
    kept = kept.select("lang", "term", "total", (size.cast("long") * (1 << 44) + F.shiftrightunsigned(F.xxhash64("term"), 20)).alias("_seq"))
    return running_index(kept, "_seq", "id", ("lang",), 1 << 34, ("term",)).select("lang", "term", "total", (F.col("id") - 1).cast("long").alias("id"))


def groups_of(counts: DataFrame, kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every (lang, source): its number ``sid`` in the language, ``own_n`` kept occurrences, and of the language
    ``V`` kept terms, ``all_n`` occurrences of them and the last tile of sources. One row a source."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = F.lit(0).cast("long")
    out = counts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    of = Window.partitionBy("lang")
    out = out.withColumn("sid", F.row_number().over(of.orderBy("source")) - 1)
    tiles = F.shiftright(F.max("sid").over(of), 5).alias("tiles")
    return out.select("lang", "source", "sid", F.coalesce("own_n", zero).alias("own_n"), F.coalesce("V", zero).alias("V"), F.coalesce("all_n", zero).alias("all_n"), tiles)


def _whole(x: Column, m: Column) -> Column:
    """Quotient in whole numbers."""
    return F.call_function("div", x, m)


def share(n: Column, whole: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / whole) in two steps, both below 2^63 for a whole of up to 2 * 10^14."""
    a, b = 31_250, 32_000  # a * b = UNIT
    top = (n + 1) * a
    return 1 + _whole(top, whole) * b + _whole((top % whole) * b, whole)


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for an array of counts (rows: groups with their N + V)."""
    top = (counts.astype(np.int64) + 1) * 31_250
    m = whole.astype(np.int64)
    return 1 + top // m * 32_000 + top % m * 32_000 // m


def consed(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Segment trees over the rows of ``counts``: distinct leaves, for each level upwards the children of its
    distinct nodes, and the root of each row. Nodes are numbers on their level."""
    leaves, level = np.unique(counts, return_inverse=True)
    level, stores, n = level.reshape(counts.shape), [], len(leaves)
    while level.shape[1] > 1:
        nodes, up = np.unique(level[:, ::2] * n + level[:, 1::2], return_inverse=True)
        stores.append((nodes // n, nodes % n))
        level, n = up.reshape(len(level), -1), len(nodes)
    return leaves, stores, level[:, 0]


def leaf_pairs(roots: np.ndarray, stores: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, n_leaves: int):
    """Walk the trees of rows ``left`` and ``right`` at once. Gives (pair of trees, leaf, leaf, times), each once."""
    at, u, v = np.arange(len(left)), roots[left], roots[right]
    times = np.ones(len(left), np.int64)
    for level in range(len(stores) - 1, -1, -1):
        a, b = stores[level]
        n = len(stores[level - 1][0]) if level else n_leaves
        key = np.concatenate([(at * n + x[u]) * n + x[v] for x in (a, b)])
        key, where = np.unique(key, return_inverse=True)
        times = np.bincount(where, np.concatenate([times, times]), len(key)).astype(np.int64)
        at, u, v = key // (n * n), key // n % n, key % n
    return at, u, v, times


def block_prices(rows: pd.DataFrame) -> pd.DataFrame:
    """Prices of all pairs of one block between two tiles: ``sid``, ``other``, ``value`` of the group's p against the other's."""
    rows = rows.sort_values("sid").reset_index(drop=True)
    width = int(rows["width"][0])
    counts = np.full((len(rows), BLOCK), -1, np.int64)  # what lies beyond the vocabulary has p = q = 1 and costs nothing
    counts[:, :width] = 0
    for k, (pos, n) in enumerate(zip(rows["pos"], rows["n"])):
        if pos is not None:
            counts[k, np.asarray(pos, np.int64)] = np.asarray(n, np.int64)
    tile = (rows["sid"] // TILE).to_numpy()
    first, second = np.nonzero((tile[:, None] == rows["ti"][0]) & (tile[None, :] == rows["tj"][0]))
    once = first < second
    first, second = first[once], second[once]
    leaves, stores, roots = consed(counts)
    at, u, v, times = leaf_pairs(roots, stores, first, second, len(leaves))
    whole = np.maximum((rows["own_n"] + rows["V"]).to_numpy(np.int64), 1)[:, None]
    p = shares(leaves[None, :], whole)
    x, y = p[first[at], u], p[second[at], v]
    squared = (x - y) ** 2
    sid, lang = rows["sid"].to_numpy(), rows["lang"][0]
    out = []
    for mine, theirs, f in ((first, second, squared // y), (second, first, squared // x)):
        value = np.zeros(len(first), np.int64)
        np.add.at(value, at, f * times)
        out.append(pd.DataFrame({"lang": lang, "sid": sid[mine], "other": sid[theirs], "value": value}))
    return pd.concat(out)


def sent(groups: DataFrame, most: int = SENT) -> DataFrame:
    """The groups for a join with all terms: sent to every task where there are few, else joined as they are."""
    return F.broadcast(groups) if groups.count() <= most else groups


def pair_prices(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``sid``, ``other``, ``value`` for each ordered pair of groups of a language."""
    block = F.shiftright("id", 10)
    cells = kept.join(sent(groups.select("lang", "source", "sid")), ["lang", "source"])
    cells = cells.groupBy("lang", "sid", block.alias("block")).agg(F.collect_list(F.struct((F.col("id") % BLOCK).cast("int").alias("pos"), "n")).alias("cells"))
    last = F.greatest(F.shiftright(F.col("V") - 1, 10), F.lit(0).cast("long"))
    grid = groups.drop("source").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    grid = grid.withColumn("width", F.least(F.col("V") - F.col("block") * BLOCK, F.lit(BLOCK).cast("long")))
    grid = grid.join(cells, ["lang", "sid", "block"], "left")
    tile = F.shiftright("sid", 5)
    grid = grid.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles"))))
    grid = grid.select(
        "lang", "block", F.least(tile, F.col("_o")).alias("ti"), F.greatest(tile, F.col("_o")).alias("tj"), "sid", "own_n", "V", "width", F.col("cells.pos").alias("pos"), F.col("cells.n").alias("n")
    )
    parts = grid.groupBy("lang", "block", "ti", "tj").applyInPandas(block_prices, "lang string, sid int, other int, value long")
    return parts.groupBy("lang", "sid", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank for each group (lang, source) of ``docs``.

    Null text, lang and source are the empty string, and a group without terms is a group. A row is a
    document, so repeated rows count again. A language with a single source has no `pair` row. Other
    columns are not looked at. An empty table gives an empty result.
    """
    counts = checkpointed(term_counts(docs, text, lang, source))
    vocab = checkpointed(vocabulary(counts, least))
    kept = checkpointed(counts.drop("d").join(vocab, ["lang", "term"]))
    sizes = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("total").alias("all_n"))
    groups = checkpointed(groups_of(counts, kept, sizes))
    names = groups.select("lang", "sid", "source")
    pairs = pair_prices(kept, groups).join(names, ["lang", "sid"]).join(names.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    p, q = F.col("p"), F.col("q")
    terms = kept.join(sent(groups), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("own_n") + F.col("V")).alias("p"), share(F.col("total"), F.col("all_n") + F.col("V")).alias("q"))
    terms = terms.filter(p > q).select("lang", "source", "item", _whole((p - q) * (p - q), q).alias("value"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources, and the terms that set each source apart."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_SHARE = "1 + (1000000000::HUGEINT * ({n} + 1)) // ({whole})"
_PRICE = "CAST(((p - q) * (p - q)) // q AS BIGINT)"
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM docs),
vocab AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
sizes AS (SELECT lang, count(*) AS V, sum(total) AS all_n FROM vocab GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN vocab USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(V, 0) AS V, coalesce(all_n, 0) AS all_n, coalesce(N, 0) AS N FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN sizes USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS N FROM c GROUP BY ALL) USING (lang, source)),
share AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", whole="g.N + g.V")} AS p, {_SHARE.format(n="v.total", whole="g.all_n + g.V")} AS q
  FROM g JOIN vocab v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
priced AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({_PRICE}) AS BIGINT) AS value
  FROM (SELECT lang, source, term, p FROM share) a JOIN (SELECT lang, source, term, p AS q FROM share) b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, {_PRICE} FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
