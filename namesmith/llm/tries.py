"""Trie of conversation prefixes by whole-sequence collapse.

Equal rebuilt conversations become one weighted sequence with the list of those that end
there; from then on a sequence stands for all its copies. Sequences that are a proper prefix
of another are found by an anti-join, the rest are the leaves. Prefixes of the weighted
sequences are then aggregated to nodes.

A prefix is named by the sum, over its turns, of a 126-bit hash of (place, role, text). Sums
are built per block of turns and chained by one row a block, so a long conversation is no
single task's work, and the name of a parent is the name less the last turn's hash. Digests
stand for texts from the first step on; texts themselves are not shuffled.

A subtree's saving is summed without listing pairs of nodes: each node belongs to the
sequence of its smallest member, so a sequence holds the sum of its own nodes from a depth
down, and a node adds up those of the sequences that pass it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namesmith.functions.order import running_index
from namesmith.llm.common import LOWEST, table, text_of
from namesmith.session import checkpointed

SHARED, EVERY, HEADS = 100, 6, 5
BLOCK = 1 << 12
RING = "cast(9223372036854775808 as decimal(20,0))"
NODE = ["depth", "k1", "k2"]


def turns(df: DataFrame) -> DataFrame:
    """``c``, ``r`` (place from 1), ``digest`` of role and text, ``chars``: by turn, null first, ties by digest."""
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(LOWEST)).alias("_turn"),
        F.col("turn").isNotNull().alias("_given"), digest.alias("digest"), F.length(text).cast("long").alias("chars"),
    )
    return running_index(rows, "_turn", "r", ("c",), BLOCK, ("_given", "digest")).select("c", F.col("r").cast("long").alias("r"), "digest", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (``c``, ``pos`` from 1, ``digest``, ``chars``) and all ids (``c``)."""
    c = F.col("c")
    base, h = c - c % SHARED, F.crc32(c.cast("string").cast("binary")) % EVERY
    convs = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", base.alias("base"), h.alias("h"), "n")
    sizes = convs.select(F.col("c").alias("base"), F.col("n").alias("_n"))
    convs = checkpointed(convs.join(sizes, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("taken")))
    heads = own.filter(F.col("r") <= HEADS).select(F.col("c").alias("base"), F.col("r").alias("pos"), "digest", "chars")
    first = convs.select("c", "base", "h").join(heads, "base").filter(F.col("pos") <= F.col("h")).select("c", "pos", "digest", "chars")
    rest = own.filter(F.col("r") > h).join(convs.select("c", "taken", "h"), "c")
    rest = rest.select("c", (F.col("r") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars")
    return first.unionByName(rest), convs.select("c")


def chained(df: DataFrame, key: str, at: str, sums: dict[str, str]) -> DataFrame:
    """Add running sums (name to column) by ``at`` (0, 1, ... a key): inside blocks, and the blocks before by one row each."""
    rows = df.withColumn("_b", F.floor(F.col(at) / BLOCK))
    inside = Window.partitionBy(key, "_b").orderBy(at)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_b").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    blocks = blocks.select(key, "_b", *[F.sum(n).over(before).alias(f"_{n}") for n in sums]).filter("_b > 0")
    rows = rows.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    out = rows.join(blocks, [key, "_b"], "left")
    return out.select(*df.columns, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums])


def _part(salt: int, pos: str, digest: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), pos, digest), 1).cast("decimal(20,0)")


def _ring(total: Column) -> Column:
    return F.pmod(total, F.expr(RING)).cast("long")


def collapsed(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each conversation ends (``c``, depth, k1, k2), and the distinct sequences with ``weight`` and ``rep``, their smallest id."""
    hashes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("depth"), F.sum(_part(1, "pos", "digest")).alias("a"), F.sum(_part(2, "pos", "digest")).alias("b"))
    zero = F.lit(0).cast("long")
    ends = convs.join(hashes, "c", "left").select(
        "c", F.coalesce("depth", zero).alias("depth"), F.coalesce(_ring(F.col("a")), zero).alias("k1"), F.coalesce(_ring(F.col("b")), zero).alias("k2")
    )
    ends = checkpointed(ends)
    return ends, checkpointed(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("rep")))


def prefixes(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence, the empty one included: node, parent's key, ``chars`` of the last turn."""
    seqs = sequences.select("rep", "weight", F.col("depth").alias("length"))
    own = rows.join(seqs, rows["c"] == seqs["rep"]).select("rep", "weight", "length", "pos", "chars", _part(1, "pos", "digest").alias("a"), _part(2, "pos", "digest").alias("b"))
    summed = chained(own.withColumn("_at", F.col("pos") - 1), "rep", "_at", {"s1": "a", "s2": "b"})
    keys = [_ring(F.col(f"s{i}")).alias(f"k{i}") for i in (1, 2)]
    parents = [_ring(F.col(f"s{i}") - F.col(x)).alias(f"p{i}") for i, x in ((1, "a"), (2, "b"))]
    full = summed.select("rep", "weight", "length", F.col("pos").alias("depth"), *keys, *parents, "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = seqs.select("rep", "weight", "length", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    return full.unionByName(root)


def digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each end list. Ids are joined in chunks side by side; only the hash itself runs through a list in order, one chunk at a time."""
    chunks = ends.groupBy(*NODE, F.shiftright("c", 12).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for part in parts:
            done = []
            for d, a, b, ids in zip(part["depth"], part["k1"], part["k2"], part["ids"]):
                if key != (d, a, b):
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (d, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return dealt.mapInPandas(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(df: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``df`` has conv_id, turn, role and text; other columns are not looked at. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out. Turns of one
    conversation that share a number follow their digest; repeated rows are turns of their own. An
    empty table has no node. ``c - c % 100`` keeps the sign of c, so -5 shares with 0.
    """
    own = checkpointed(turns(df))
    rows, convs = rebuilt(own)
    rows = checkpointed(rows)
    ends, sequences = collapsed(rows, convs)
    steps = checkpointed(prefixes(rows, sequences))
    proper = steps.filter("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = steps.groupBy(*NODE).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    nodes = checkpointed(nodes)
    # what a sequence's own nodes save; the root saves nothing and needs no lookup
    zero = F.lit(0).cast("long")
    saved = F.when(F.col("conv_id") == F.col("rep"), (F.col("n_convs") - 1) * F.col("chars")).otherwise(zero)
    found = steps.filter("depth > 0").select("rep", "length", *NODE).join(nodes.select(*NODE, "conv_id", "n_convs", "chars"), NODE)
    worth = found.select("rep", "length", *NODE, saved.alias("worth")).unionByName(steps.filter("depth = 0").select("rep", "length", *NODE, zero.alias("worth")))
    below = chained(worth.withColumn("_up", F.col("length") - F.col("depth")), "rep", "_up", {"below": "worth"}).join(leaves, "rep", "left")
    below = below.groupBy(*NODE).agg(F.sum("below").alias("saved_tokens"), F.count("leaf").alias("n_leaves"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, NODE).join(children, NODE, "left").join(digests(ends), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# CRC-32 by its table of 256 remainders; 3988292384 is the reversed polynomial.
SQL = f"""
WITH remainders AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) AS r(i))),
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % {SHARED} AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda x, b: xor(x >> 8, t[CAST(xor(x, b) & 255 AS INT) + 1]))) % {EVERY} AS h FROM (SELECT DISTINCT c FROM own), remainders),
heads AS (SELECT convs.c, own.r AS pos, role, text FROM convs JOIN own ON own.c = base AND own.r <= h),
rows AS (SELECT * FROM heads UNION ALL
  SELECT c, coalesce(n, 0) + own.r - h, role, text FROM own JOIN convs USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM heads GROUP BY c) USING (c) WHERE own.r > h),
paths AS (SELECT c, pos AS depth, list([role, text]) OVER (PARTITION BY c ORDER BY pos) AS p, length(text) AS chars FROM rows
  UNION ALL SELECT c, 0, [], 0 FROM convs),
nodes AS (SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, count(*) - 1 AS extra FROM paths GROUP BY p, depth),
kids AS (SELECT p[1 : depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, depth) AS p FROM paths GROUP BY c) GROUP BY p),
up AS (SELECT p[1 : d] AS p, extra * chars AS saved, kids.n IS NULL AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) LEFT JOIN kids USING (p)),
below AS (SELECT p, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM up GROUP BY p)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN kids k USING (p) LEFT JOIN ends e USING (p) JOIN below b USING (p) LEFT JOIN nodes q ON n.depth > 0 AND q.p = n.p[1 : n.depth - 1]"""
