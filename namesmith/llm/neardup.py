"""Near-duplicate groups by DartMinHash signatures and banded joining.

A document is a set of word shingles, each weighing as often as it occurs. Darts fall on the plane of (weight, rank) of
each element, one a unit of area on average, at places that a hash fixes. Those below the
element's weight hit; of the hits in each of ``COORDINATES`` coordinates the earliest by rank
stays. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity, and only about k log k darts are thrown, however many elements there are.

Equal signatures in a band put documents into a bucket. Within a bucket pairs are not
enumerated: all are compared with one hub, exactly, on their shingle sets; then, in buckets
whose documents are not in one group yet, with a second hub; then those of different groups
with each other, where the join's condition counts the shingles of both, so that it puts out links
alone. So a large group of near copies costs a multiple of its size, and no link between groups is
left out. Exact copies are one node from the start.

Four bits of every coordinate are kept beside the bands. Candidates that agree in so few
coordinates that a pair at the threshold would do so once in ``RARE`` are not fetched. A pair
meets in the least of the buckets that both have, and only there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namesmith.llm.common import LOWEST, STAGE_BATCH, give_back, memory, packed_row, short_batches, table, text_of
from namesmith.llm.components import components
from namesmith.llm.parsing import M1, M3, mix
from namesmith.session import checkpointed

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
PLANES = 4  # bits kept of a coordinate
RARE = 1e-7
CELLS = 1 << 16  # cells of darts thrown at once; a dozen arrays of that length are held
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)])


def word_hashes(text: str) -> np.ndarray:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split()  # ASCII blanks
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``n`` words and their counts; a shorter text is one run, a wordless one none."""
    w = word_hashes(text)
    n = min(n, len(w))
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = w[: len(w) - n + 1].copy()
    for j in range(1, n):
        s = s * M3 + w[j : len(w) - n + 1 + j]
    return np.unique(mix(s), return_counts=True)


def occurrences(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A name for each occurrence: the shingle for its first, a hash of shingle and number for the others.
    The weighted similarity of two texts is the Jaccard similarity of these sets."""
    many = n > 1
    again = np.repeat(s[many], n[many] - 1)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(n[many] - 1) - (n[many] - 1), n[many] - 1) + 1
    return np.concatenate((s, mix(again ^ mix(nth.astype(np.uint64) * M1))))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def throw(h: np.ndarray, x: np.ndarray, doc: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits of all elements (hash, weight, document) with a rank below their document's ``reach``:
    slot (document and coordinate), rank and name. Weight is cut into [0, 1), [1, 2), [2, 4), ...
    and rank into slabs that make cells of area one, so that cells do not depend on the document."""
    out = []
    low, width, level = 0.0, 1.0, 0
    while True:
        own = np.flatnonzero(x > low)
        if not len(own):
            break
        slabs = np.ceil(reach[doc[own]] * width).astype(np.int64)
        at = np.repeat(own, slabs)
        slab = np.arange(len(at)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        cell = mix(mix(h[at] + np.array([level + 1], np.uint64) * M3) + slab.astype(np.uint64) * M1)
        n = np.searchsorted(POISSON, unit(cell), side="right")
        c = np.repeat(np.arange(len(at)), n)
        j = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
        name = mix(cell[c] + (j + 1).astype(np.uint64) * M3)
        rank = (slab[c] + unit(mix(name + M1))) / width
        place = low + unit(mix(name ^ M3)) * width
        e = at[c]
        hit = (place < x[e]) & (rank < reach[doc[e]])
        e, name = e[hit], name[hit]
        out.append((doc[e] * k + (((name >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64), rank[hit], name))
        low, width, level = (1.0, 1.0, 1) if level == 0 else (low * 2, width * 2, level + 1)
    return tuple(np.concatenate(p) for p in zip(*out))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """A row of ``k`` names for each non-empty weighted set. Documents with an empty coordinate
    throw again twice as far; the earliest dart of a coordinate is the same then."""
    best = np.full(len(sets) * k, np.inf)
    sig = np.zeros(len(sets) * k, np.uint64)
    todo = np.arange(len(sets))
    reach = np.zeros(len(sets))
    reach[:] = (k * np.log(k) + 2 * k) / np.array([float(w.sum()) for _, w in sets])
    while len(todo):
        doc = np.repeat(todo, [len(sets[i][0]) for i in todo])
        slot, rank, name = throw(np.concatenate([sets[i][0] for i in todo]), np.concatenate([sets[i][1] for i in todo]).astype(float), doc, reach, k)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        sig[slot[first]] = name[first]
        todo = todo[np.isinf(best.reshape(-1, k)[todo]).any(axis=1)]
        reach[todo] *= 2
    return sig.reshape(-1, k)


def planes(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of the coordinates: two longs for each of ``PLANES`` bits."""
    bits = sig[:, :, None] >> np.arange(PLANES, dtype=np.uint64) & np.uint64(1)
    bits = np.pad(bits.transpose(0, 2, 1).astype(np.uint8), ((0, 0), (0, 0), (0, 128 - sig.shape[1])))
    return np.packbits(bits, axis=2).reshape(len(sig), -1).view(np.int64)


def least_agreeing(similar: float) -> int:
    """Coordinates in which all but ``RARE`` of the pairs of similarity ``similar`` agree, as far as their planes show."""
    p = similar + (1 - similar) / 2**PLANES
    t, below = 0, (1 - p) ** COORDINATES
    while below <= RARE and t < COORDINATES:
        t += 1
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
    return t


def agreeing(x: Column, y: Column) -> Column:
    """Number of coordinates whose planes are equal."""
    differ = []
    for half in (0, 1):
        d = F.get(x, F.lit(half)).bitwiseXOR(F.get(y, F.lit(half)))
        for p in range(1, PLANES):
            d = d.bitwiseOR(F.get(x, F.lit(2 * p + half)).bitwiseXOR(F.get(y, F.lit(2 * p + half))))
        differ.append(F.bit_count(d))
    return F.lit(COORDINATES) - differ[0] - differ[1]


def bands(texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """Bucket of each band, and the planes; none for a wordless text."""
    sets = [shingles(t) for t in texts]
    full = [i for i, (s, _) in enumerate(sets) if len(s)]
    out: list[list[int]] = [[] for _ in texts]
    kept: list[list[int]] = [[] for _ in texts]
    lo = 0
    while lo < len(full):
        hi, cells = lo, 0
        while hi < len(full) and (hi == lo or cells < CELLS):
            cells += 1024 + 2 * len(sets[full[hi]][0])
            hi += 1
        sig = signatures([sets[i] for i in full[lo:hi]])
        for i, row in zip(full[lo:hi], planes(sig).tolist()):
            kept[i] = row
        sig = sig.reshape(hi - lo, BANDS, ROWS)
        b = np.tile(np.arange(BANDS, dtype=np.uint64), (hi - lo, 1))
        for r in range(ROWS):
            b = mix(b * M3 + sig[:, :, r])
        for i, row in zip(full[lo:hi], b.view(np.int64).tolist()):
            out[i] = row
        lo = hi
    return out, kept


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("bands", "planes")]))
def bands_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    memory("neardup")
    for texts in batches:
        parts = [bands(list(texts[k : k + 512])) for k in range(0, len(texts), 512)]
        yield pd.DataFrame({name: [x for part in parts for x in part[k]] for k, name in enumerate(("bands", "planes"))})
    give_back()


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes. The same sort-merge join at every size; the texts move once."""
    rows = docs.select(node_of(F.col("_text")).alias("node"), "_text").join(nodes.hint("merge"), "node", "left_semi")
    return checkpointed(rows.groupBy("node").agg(F.first("_text").alias("text")))


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of nodes whose weighted shingles are alike enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets: dict[bytes, np.ndarray] = {}
            for node, text in zip([*pdf["a"], *pdf["b"]], [*pdf["text_a"], *pdf["text_b"]]):
                if node not in sets:
                    sets[node] = occurrences(*shingles(text))
            alike = [jaccard(sets[a], sets[b]) >= similar for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf.loc[alike, ["a", "b"]]

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    return checkpointed(rows.mapInPandas(run, "a binary, b binary"))


def in_common(nodes: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(node, size, common) of the nodes that can be in a pair with another of ``nodes``.

    ``common`` holds the occurrences of shingles that another node has too: all that a pair can
    share. A node with fewer of them than the smallest partner needs is in no pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 64):
                part = pdf.iloc[k : k + 64]
                sets = [occurrences(*shingles(t)) for t in part["text"]]
                n = [len(s) for s in sets]
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), n), "size": np.repeat(n, n), "shingle": np.concatenate(sets).view(np.int64)})

    cells = texts.join(nodes, "node", "left_semi").mapInPandas(run, "node binary, size int, shingle long")
    often = cells.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = cells.join(often, "shingle").groupBy("node", "size").agg(F.collect_list("shingle").alias("common"))
    return checkpointed(rows.filter(F.size("common") >= F.ceil(similar * F.col("size") - 1e-6)))


def likely(pairs: DataFrame, signs: DataFrame, enough: int) -> DataFrame:
    """The pairs (a, b) that agree in enough coordinates."""
    side = lambda x: signs.select(F.col("node").alias(x), F.col("planes").alias(f"planes_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    return checkpointed(rows.filter(agreeing(F.col("planes_a"), F.col("planes_b")) >= enough).select("a", "b"))


def ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def torn(seats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets whose nodes have several labels, with another hub of the bucket."""
    named = checkpointed(seats.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    hub = F.min_by(F.struct("node", "label"), F.xxhash64("node", "bucket"))
    ends = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), hub.alias("hub"))
    ends = ends.filter(F.col("lo") != F.col("hi")).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label"))
    return named.join(ends, "bucket")


def between(rows: DataFrame, similar: float, enough: int) -> DataFrame:
    """The links (a, b) between nodes of different labels that share a bucket; each is put out in their least one.

    The last condition, after cheap bounds, counts what both hold: no pair leaves the join but a link.
    """
    side = lambda x: rows.select("bucket", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "bucket"])
    x, y = side("x"), side("y")
    least = (similar * (F.col("x_size") + F.col("y_size")) - 1e-6) / (1 + similar)
    link = (x["bucket"] == y["bucket"]) & (F.col("x_label") < F.col("y_label"))
    link = link & (F.least(F.size("x_common"), F.size("y_common")) >= least)
    link = link & (agreeing(F.col("x_planes"), F.col("y_planes")) >= enough)
    link = link & (x["bucket"] == F.array_min(F.array_intersect("x_bands", "y_bands")))
    link = link & (F.size(F.array_intersect("x_common", "y_common")) >= least)
    return x.join(y, link).select(*ordered("x_node", "y_node"))


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(_id, node, label) for all rows: the id (null as the least), the text's digest, and the group's least digest.

    Wordless texts have only exact copies. Repeated rows are copies of each other.
    """
    docs = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_id"), text_of(text).alias("_text"))
    hashed = docs.select(node_of(F.col("_text")).alias("node"), bands_of("_text").alias("s"))
    hashed = hashed.groupBy("node").agg(F.first("s").alias("s")).select("node", "s.*")
    hashed = checkpointed(hashed.filter(F.size("bands") > 0))
    seats = hashed.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    ends = seats.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter(F.col("hub") != F.col("far"))
    shared = checkpointed(seats.join(ends.select("bucket", "hub"), "bucket"))
    signs = checkpointed(hashed.join(shared.select("node").distinct(), "node"))
    enough = least_agreeing(similar)
    tested = likely(shared.filter(F.col("node") != F.col("hub")).select(*ordered("node", "hub")).distinct(), signs, enough)
    texts = texts_of(docs, shared.select("node").distinct())
    edges = verified(tested, texts, similar)
    labels = components(edges)
    hubs = torn(shared.drop("hub"), labels)
    pairs = hubs.filter(F.col("label") != F.col("hub_label")).select(*ordered("node", "hub")).distinct()
    pairs = likely(pairs.join(tested, ["a", "b"], "left_anti"), signs, enough)
    edges = checkpointed(edges.unionByName(verified(pairs, texts, similar)))
    labels = components(edges)
    rest = checkpointed(torn(shared.drop("hub"), labels).select("bucket", "node", "label"))
    may = in_common(rest.select("node").distinct(), texts, similar)
    links = between(rest.join(may, "node").join(signs, "node"), similar, enough)
    labels = components(checkpointed(edges.unionByName(links)))
    keys = docs.select("_id", node_of(F.col("_text")).alias("node"))
    return keys.join(labels, "node", "left").select("_id", "node", F.coalesce("label", "node").alias("label"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for all rows: the class is the least id of the group. A null id is the least and names its class null."""
    found = checkpointed(groups(df, doc_id, text, similar))
    least = found.groupBy("label").agg(F.min("_id").alias("class_id"))
    real = lambda c: F.when(F.col(c) != LOWEST, F.col(c)).alias(c if c != "_id" else doc_id)
    return found.join(least, "label").select(real("_id"), real("class_id"))


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row of each group, that of the least id (then the least text digest); all columns stay, whatever their names.
    Repeated rows are one; wordless texts (null as empty) are one group for each text."""
    found = groups(df, doc_id, text, similar)
    first = found.groupBy("label").agg(F.min(F.struct("_id", "node")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = checkpointed(first.select("f.*", "n"))
    rows = df.select(packed_row(df.columns).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_id"), node_of(text_of(text)).alias("node"))
    rows = rows.join(first, ["_id", "node"])
    # of rows that repeat id and text one stays; only groups of several rows are looked at
    single = rows.filter("n = 1").unionByName(rows.filter("n > 1").dropDuplicates(["_id", "node"]))
    return single.select(*[F.col("row")[c].alias(c) for c in df.columns])


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark, *STAGE_BATCH)
    return dedup(docs)
