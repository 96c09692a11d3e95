"""Language-model scores by a hierarchical Pitman-Yor model.

Words sit in restaurants of the two words before them, whose parents are those of the one word
before, whose parent is the restaurant without context; a new table there draws its word from a
model of symbols, whose restaurants are the contexts of up to three symbols before, down to the
even distribution. The tables of a restaurant are the customers of its parent. Seating is
sampled by Gibbs steps that reseat all customers of one dish, given the tables of the others
as the sweep before left them; so dishes are independent within a sweep and Spark deals them
out. Long rows of customers are seated in doubling blocks with a Poisson number of new
tables. After a burn-in the seatings of word contexts, and the predictive probabilities of
words and symbols, are averaged.

What is counted is every token of every training text. In word contexts the ``TOP`` most
frequent words have numbers of their own. A rarer word is there one dish, "rare", and, as a
context, one of ``RARE`` classes by its crc32; which rare word it is costs its share of the
rare mass in the restaurant without context, and a word not met its spelling. So probabilities
of all words add up to one. Three numbers make a long. Cells (two words before, word) are
dealt into slices of about ``SLICE`` tokens by the word before; a very frequent word before
has several slices, by the word before it, and each is a restaurant of its own. All
cells of a slice are seated together. Scoring deals the texts out once: what is learned from
and what is asked meet in one group of a slice, as compressed runs of ascending cells.

Symbols are 64 by rule, so that contexts are 64 ** 3 at most and the symbol model 64 MB at
most, which is what tasks get as a broadcast. Rarer words are dealt into buckets by their
crc32, where they meet their counts and probabilities; only those not met there are spelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.llm.common import give_back, held_out, short_batches, table, text_of
from namesmith.session import checkpointed

TOP = 1 << 16
HELD = 1 << 19  # distinct words a task holds before it hands on their counts
PART = 1 << 17  # words whose symbols are counted at once
SWEEPS, BURN_IN = 3, 1
INNER = 3
STRENGTH, DISCOUNT = 1.0, 0.5
# of word contexts; by a fold of the training texts of sf0.001 (remainder 3), README says what was seen before
CONTEXT_STRENGTH, CONTEXT_DISCOUNT = 0.1, 0.75
RARE = 1 << 15
BITS = 17
MASK = (1 << BITS) - 1
SLICE = 1 << 20  # tokens of a slice
TEXTS = 12 << 20  # bytes of the texts that a task deals out at once
END = b"\t"  # the end of a text as a word; no word holds a blank


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point, and how many code points share each symbol: 0 the end of a word,
    a-z, U+00DF-U+00FF, full stop, comma, the rest of ASCII, all others."""
    of = np.full(0x110000, 63, np.int64)
    of[:128] = 62
    of[ord("a") : ord("z") + 1] = np.arange(1, 27)
    of[0xDF:0x100] = np.arange(27, 60)
    of[ord(".")], of[ord(",")], of[ord("\n")] = 60, 61, 0
    return of, np.bincount(of, minlength=64)


def code_points(words: list[bytes]) -> np.ndarray:
    return np.frombuffer((b"\n".join(words) + b"\n").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def shares(words: DataFrame) -> np.ndarray:
    """log10 of each code point's share of its symbol, by how often distinct words hold it.
    At most as many rows reach the driver as there are code points."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, size = alphabet()
        for pdf in batches:
            x, n = np.unique(code_points(list(pdf["word"])), return_counts=True)
            on = size[of[x]] > 1
            yield pd.DataFrame({"x": x[on].astype(np.int64), "n": n[on]})

    of, size = alphabet()
    met = np.zeros(0x110000)
    for r in words.select("word").mapInPandas(count, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).collect():
        met[r["x"]] = r["n"]
    return np.log10((met + 1 / size[of]) / (np.bincount(of, met, 64)[of] + 1)).astype(np.float32)


def symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols of the words with three symbols of context, and where each word begins."""
    x = code_points(words)
    s = alphabet()[0][x]
    ends = np.flatnonzero(s == 0)
    p = np.concatenate(([0, 0, 0], s))
    one = p[2:-1]
    two = np.where(one > 0, p[1:-2], 0)
    three = np.where(two > 0, p[:-3], 0)
    return three << 18 | two << 12 | one << 6 | s, np.concatenate(([0], ends[:-1] + 1))


class SymbolModel:
    """Predictive log10 probabilities: a row of 64 for each context met, and the row of every context."""

    def __init__(self, rows: list[tuple[int, int, bytes]], root: np.ndarray, share: np.ndarray) -> None:
        self.share = share
        probs = [root]
        at = np.zeros(64**3, np.int64)
        for level in (1, 2, 3):
            own = [(c, p) for lv, c, p in rows if lv == level]
            ids = np.zeros(64**level, np.int64)
            ids[[c for c, _ in own]] = np.arange(len(probs), len(probs) + len(own))
            probs += [np.frombuffer(p, np.float32) for _, p in own]
            found = ids[np.arange(64**3) % 64**level]
            at = np.where(found > 0, found, at)
        self.at, self.log = at.astype(np.int32), np.log10(np.array(probs, np.float64)).astype(np.float32)

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word, its end included."""
        if not words:
            return np.empty(0)
        code, first = symbols(words)
        s = code & 63
        return np.add.reduceat(self.log[self.at[code >> 6], s].astype(np.float64) + self.share[code_points(words)], first)


def seat(rng: np.random.Generator, c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, strength: float) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, base probability ``p`` and ``others`` tables beside them."""
    t = np.ones(len(c))
    size = 1
    while (on := np.flatnonzero(c > size)).size:
        step = np.minimum(1 if size < 8 else size, c[on] - size)
        new = (strength + d * (others[on] + t[on])) * p[on]
        old = size - d * t[on]
        if size < 8:
            t[on] += rng.random(len(on)) < new / (new + old)
        else:
            t[on] += np.minimum(rng.poisson(new * np.log1p(step / (new + old))), step)
        size += 1 if size < 8 else size
    return t


def seated(pdf: pd.DataFrame, root: np.ndarray, seed: int, inner: int = INNER) -> list[tuple[int, int, bytes]]:
    """Seating of all contexts that end in one symbol: predictive rows, and the tables of the shortest as level 0."""
    code, n = pdf["code"].to_numpy(), pdf["n"].to_numpy().astype(float)
    d, strength = DISCOUNT, STRENGTH
    rng = np.random.default_rng([seed, int(code[0] >> 6 & 63)])
    long, at_long = np.unique(code >> 6, return_inverse=True)
    u3, in3 = np.unique(code & 0x3FFFF, return_inverse=True)
    mid, at_mid = np.unique(u3 >> 6, return_inverse=True)
    w4, w3 = code & 63, u3 & 63
    w2, in2 = np.unique(w3, return_inverse=True)
    t4, t3, t2 = np.ones(len(code)), np.ones(len(u3)), np.ones(len(w2))
    sums = [np.zeros((k, 64)) for k in (1, len(mid), len(long))]

    def fill(cells, base, k):
        (of, w, customers, tables) = cells
        out = (strength + d * np.bincount(of, tables, k))[:, None] * base
        np.add.at(out, (of, w), customers - d * tables)
        return out / (strength + np.bincount(of, customers, k))[:, None]

    zero = np.zeros(len(w2), np.int64)
    for sweep in range(inner + 1):
        n3, n2 = np.bincount(in3, t4, len(u3)), np.bincount(in2, t3, len(w2))
        p2 = fill((zero, w2, n2, t2), root[None, :], 1)
        p3 = fill((at_mid, w3, n3, t3), p2, len(mid))
        if sweep > inner // 2:
            p4 = fill((at_long, w4, n, t4), p3[np.searchsorted(mid, long & 4095)], len(long))
            for total, p in zip(sums, (p2, p3, p4)):
                total += p / (inner - inner // 2)
        if sweep < inner:
            t4 = seat(rng, n, p3[at_mid[in3], w4], np.bincount(at_long, t4)[at_long] - t4, d, strength)
            n3 = np.bincount(in3, t4, len(u3))
            t3 = seat(rng, n3, p2[0, w3], np.bincount(at_mid, t3)[at_mid] - t3, d, strength)
            n2 = np.bincount(in2, t3, len(w2))
            t2 = seat(rng, n2, root[w2], t2.sum() - t2, d, strength)
    out = [(lv, int(c), p.astype(np.float32).tobytes()) for lv, cs, ps in ((1, [code[0] >> 6 & 63], sums[0]), (2, mid, sums[1]), (3, long, sums[2])) for c, p in zip(cs, ps)]
    return [*out, (0, 0, np.bincount(w2, t2, 64).astype(np.float32).tobytes())]


def symbol_model(tables: DataFrame, root: np.ndarray, share: np.ndarray, seed: int) -> tuple[SymbolModel, np.ndarray]:
    """The symbol model of words with ``t`` tables each, and the root for the next sweep.
    At most 64 groups of at most 64 ** 3 cells; the rows that reach the driver are 64 MB at most."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, n = np.empty(0, np.int64), np.empty(0)
        words, t = [], []

        def count() -> None:
            nonlocal code, n
            new, first = symbols(words)
            weight = np.repeat(np.concatenate(t), np.diff(first, append=len(new)))
            code, at = np.unique(np.concatenate((code, new)), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, weight)), len(code))
            words.clear()
            t.clear()

        for pdf in batches:
            words.extend(pdf["word"])
            t.append(pdf["t"].to_numpy(float))
            if len(words) >= PART:
                count()
        if words:
            count()
        if len(code):
            yield pd.DataFrame({"code": code, "n": n.astype(np.int64)})

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(seated(pdf, root, seed), columns=["level", "context", "row"])

    counts = tables.select("word", "t").mapInPandas(cells, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    last = F.shiftright("code", 6).bitwiseAND(63)
    rows = counts.withColumn("last", last).groupBy("last").applyInPandas(group, "level int, context int, row binary").collect()
    n1 = np.sum([np.zeros(64), *(np.frombuffer(r["row"], np.float32) for r in rows if r["level"] == 0)], axis=0)
    dishes = np.flatnonzero(n1)
    t1 = np.zeros(64)
    t1[dishes] = seat(np.random.default_rng(seed), n1[dishes], np.full(len(dishes), 1 / 64), np.full(len(dishes), len(dishes) - 1.0), DISCOUNT, STRENGTH)
    new = (n1 - DISCOUNT * t1 + (STRENGTH + DISCOUNT * t1.sum()) / 64) / (STRENGTH + n1.sum())
    return SymbolModel([(r["level"], r["context"], bytes(r["row"])) for r in rows if r["level"]], root, share), new


class Split:
    """Words of many texts in a row, as numbers into the list of distinct ones, and how many each text has."""

    def __init__(self, texts: pa.Array) -> None:
        found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words, whole = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False)
        there = pc.greater(pc.binary_length(words), 0)
        of = np.repeat(np.arange(len(texts)), whole)[there.to_numpy(zero_copy_only=False)]
        self.size = np.bincount(of, minlength=len(texts))
        listed = words.filter(there).dictionary_encode()
        self.distinct = listed.dictionary.cast(pa.binary())
        self.at, self.of = listed.indices.to_numpy(), of


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, c) over all rows; tasks sum before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for texts in gathered(batches, 1):
            split = Split(texts.column(0).combine_chunks())
            c = np.bincount(split.at, minlength=len(split.distinct))
            held.append(pa.table({"word": pa.concat_arrays([split.distinct, pa.array([END])]), "c": np.append(c, len(split.size))}))
            if len(held) == 8:
                held = [summed()]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches(1 << 16)
        if held:
            yield from summed().to_batches(1 << 16)
        give_back()

    return df.select(text_of(text).alias("t")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """Batches put together until their texts have ``TEXTS`` bytes or rows are as many as two bytes can number."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            if held and (rows + part.num_rows > 1 << 16 or size + part.column(text - 1).nbytes > TEXTS):
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
            held.append(part)
            rows += part.num_rows
            size += part.column(text - 1).nbytes
    if held:
        yield pa.Table.from_batches(held)


def packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which a shuffle compresses well where they are small."""
    return np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpressed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as their differences."""
    return np.diff(keys, prepend=np.int64(0))


class Vocabulary:
    """Numbers of words in word contexts, and the slices of cells: what a task needs to deal out a text."""

    def __init__(self, listed: list[tuple[bytes, int]], n: int) -> None:
        self.ids = {w: i for i, (w, _) in enumerate(listed, 1)}
        self.slices = 1 + n // SLICE
        self.buckets = 1 + n // (8 * SLICE)  # of rarer words
        counts = np.zeros(MASK + 1, np.int64)
        counts[1 : len(listed) + 1] = [c for _, c in listed]
        self.split = 1 + 2 * counts // SLICE
        self.log = np.log10(counts + 1.0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        x = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        for i in np.flatnonzero(x == 0):
            x[i] = len(self.ids) + 1 + crc32(words[i]) % RARE
        return x

    def cells(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """For each token of all texts its cell, and the text it is of. Before a text there are two ends."""
        return self.following(self.numbers([w for t in texts for w in t]), np.array([len(t) for t in texts]))

    def following(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the tokens' numbers."""
        end = self.numbers([END])
        one, two = np.concatenate((end, x[:-1])), np.concatenate((end, end, x[:-2]))[: len(x)]
        two[np.cumsum(size) - size] = end  # what is before a text in ``one`` is the end of another
        return two << 2 * BITS | one << BITS | np.where(x > len(self.ids), 0, x), np.repeat(np.arange(len(size)), size)

    def dealt(self, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each slice that ascending cells meet, and where they are."""
        one, two = cells >> BITS & MASK, cells >> 2 * BITS
        at = ((one * 0x9E3779B1 + two % self.split[one] * 0x85EBCA6B & 0xFFFFFFFF) >> 8) % self.slices
        order = np.argsort(at.astype(np.uint16) if self.slices <= 1 << 16 else at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        for lo, hi in zip(first, [*first[1:], len(order)]):
            yield int(at[order[lo]]), order[lo:hi]


DEALT = "slice int, chunk long, size int, learned int, keys binary, c binary, texts binary, about binary"


def dealt(rows: DataFrame, sent) -> DataFrame:
    """Texts of (_row, _t, _learn) dealt out: rows of a slice with a chunk's cells there, and of a bucket (-1 and less) with its rarer words.

    A row without ``_row`` is only learned from. In a chunk texts stand in this order: those only learned from, those learned
    from and asked for, those only asked for; the first ``learned`` count. ``keys`` ascend, ``texts`` has the text of each; a
    chunk that asks for nothing has each key once, with its count ``c``. One row of a chunk has ``about``: ids, numbers of
    tokens, of known tokens among the listed, and their log10 (count + 1) summed.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, chunk = sent.value, TaskContext.get().partitionId() << 36
        for part in gathered(batches, 2):
            row, learn = part.column(0).combine_chunks(), part.column(2).to_numpy()
            asked = row.is_valid().to_numpy(zero_copy_only=False)
            order = np.argsort(np.where(asked, np.where(learn, 1, 2), 0), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            yield pa.RecordBatch.from_pylist(list(rows_of(vocabulary, Split(part.column(1).combine_chunks()), place, chunk, asked, learn, row)), SCHEMA)
            chunk += 1
        give_back()

    return rows.select("_row", "_t", "_learn").mapInArrow(deal, DEALT)


SCHEMA = pa.schema([("slice", pa.int32()), ("chunk", pa.int64()), ("size", pa.int32()), ("learned", pa.int32()), *((c, pa.binary()) for c in ("keys", "c", "texts", "about"))])


def rows_of(vocabulary: Vocabulary, split: Split, place: np.ndarray, chunk: int, asked: np.ndarray, learn: np.ndarray, row: pa.Array) -> Iterator[dict]:
    """The rows of one chunk; ``place`` is each text's place in it."""
    base = {"chunk": chunk, "size": len(place), "learned": int(learn.sum())}
    distinct = split.distinct.to_pylist()
    number, size = vocabulary.numbers(distinct), split.size + 1
    x = np.full(size.sum(), vocabulary.numbers([END])[0])
    inner = np.ones(len(x), bool)
    inner[np.cumsum(size) - 1] = False
    x[inner] = number[split.at]
    cells, of = vocabulary.following(x, size)
    if not asked.any():
        cells, c = np.unique(cells, return_counts=True)
        for s, at in vocabulary.dealt(cells):
            yield {**base, "slice": s, "keys": pressed(packed(steps(cells[at]))), "c": pressed(packed(c[at]))}
        return
    of = place[of]
    w = cells & MASK
    ids = np.empty(len(place), np.int64)
    ids[place] = row.fill_null(0).to_numpy(zero_copy_only=False)
    n, log = np.empty(len(place), np.int64), np.bincount(of, vocabulary.log[w], len(place))
    n[place] = size
    known = np.bincount(of, vocabulary.log[w] > 0, len(place)).astype(np.int64)
    first = len(place) - int(asked.sum())
    about = b"".join(x[first:].tobytes() for x in (ids, n, known, log))
    order = np.argsort(cells)
    cells, of = cells[order], of[order]
    for s, at in vocabulary.dealt(cells):
        texts = pressed(of[at].astype(np.uint16).tobytes())
        yield {**base, "slice": s, "keys": pressed(packed(steps(cells[at]))), "texts": texts, "about": about}
        about = None
    rarer = np.flatnonzero(number > len(vocabulary.ids))
    rank = np.full(len(distinct), -1)
    words = [distinct[i] for i in rarer]
    bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % vocabulary.buckets
    order = np.argsort(bucket, kind="stable")
    rank[rarer[order]] = np.arange(len(rarer))
    words, bucket = [words[i] for i in order], bucket[order]
    at, of = rank[split.at], place[split.of]
    if END not in vocabulary.ids:  # nothing was learned
        words, bucket = [*words, END], np.append(bucket, bucket.max(initial=0))
        at, of = np.append(at, np.full(len(place), len(words) - 1)), np.append(of, place)
    on = (at >= 0) & (of >= first)
    at, of = at[on], of[on]
    order = np.argsort(at, kind="stable")
    of, c = of[order], np.bincount(at, minlength=len(words))
    ends, start = np.cumsum(c), np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(start, [*start[1:], len(bucket)]):
        texts = of[ends[lo] - c[lo] : ends[hi - 1]].astype(np.uint16)
        keys, counts = pressed(b"\n".join(words[lo:hi])), pressed(packed(c[lo:hi]))
        yield {**base, "slice": -1 - int(bucket[lo]), "keys": keys, "c": counts, "texts": pressed(texts.tobytes())}


def learned(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray | None]]]:
    """Cells of a slice that are learned from and how often each occurs; and the cells and texts of each row."""
    held, counts, asked = [], [], []
    for keys, c, texts, n in zip(*(rows.column(x).to_pylist() for x in ("keys", "c", "texts", "learned"))):
        cells, of = np.cumsum(unpacked(unpressed(keys))), None
        if texts is None:
            held.append(cells)
            counts.append(unpacked(unpressed(c)))
        else:
            of = np.frombuffer(unpressed(texts), np.uint16)
            mine, c = np.unique(cells[of < n], return_counts=True)
            held.append(mine)
            counts.append(c)
        asked.append((cells, of))
    cells, at = np.unique(np.concatenate(held), return_inverse=True)
    return cells, np.bincount(at, np.concatenate(counts), len(cells)), asked


class Seating:
    """Averaged seating of the word contexts of a slice, given the probabilities ``root`` of words without context."""

    def __init__(self, cells: np.ndarray, c: np.ndarray, root: np.ndarray, seed: int, inner: int = INNER) -> None:
        rng, d, s = np.random.default_rng([seed, 7]), CONTEXT_DISCOUNT, CONTEXT_STRENGTH
        self.cells, self.root = cells, root
        self.two, in_two = np.unique(cells >> BITS, return_inverse=True)
        self.pairs, in_pair = np.unique(cells & (1 << 2 * BITS) - 1, return_inverse=True)
        self.one, in_one = np.unique(self.pairs >> BITS, return_inverse=True)
        p0 = root[self.pairs & MASK]
        t2, t1 = np.ones(len(cells)), np.ones(len(self.pairs))
        sums, self.tables, n1 = np.zeros(len(cells)), np.zeros(len(self.pairs)), np.bincount(in_pair, t2, len(self.pairs))
        more = np.flatnonzero(c > 1)  # a single customer has one table
        for sweep in range(inner):
            all1 = np.bincount(in_one, t1, len(self.one))
            p1 = n1 - d * t1 + (s + d * all1)[in_one] * p0
            p1 /= (s + np.bincount(in_one, n1, len(self.one)))[in_one]
            all2 = np.bincount(in_two, t2, len(self.two))
            t2[more] = seat(rng, c[more], p1[in_pair[more]], all2[in_two[more]] - t2[more], d, s)
            n1 = np.bincount(in_pair, t2, len(self.pairs))
            on = np.flatnonzero(n1 > 1)
            new = seat(rng, n1[on], p0[on], all1[in_one[on]] - t1[on], d, s)
            t1 = np.ones(len(self.pairs))
            t1[on] = new
            if sweep >= inner // 2:
                sums += t2 / (inner - inner // 2)
                self.tables += t1 / (inner - inner // 2)
        n2, n1 = np.bincount(in_two, c, len(self.two)), np.bincount(in_pair, sums, len(self.pairs))
        all1 = np.bincount(in_one, n1, len(self.one))
        self.own2 = (c - d * sums) / (s + n2)[in_two]
        self.on2 = (s + d * np.bincount(in_two, sums, len(self.two))) / (s + n2)
        self.own1 = (n1 - d * self.tables) / (s + all1)[in_one]
        self.on1 = (s + d * np.bincount(in_one, self.tables, len(self.one))) / (s + all1)

    def probabilities(self, cells: np.ndarray) -> np.ndarray:
        def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
            if not len(keys):
                return np.full(len(asked), other)
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[at] == asked, values[at], other)

        pair = cells & (1 << 2 * BITS) - 1
        one = found(self.pairs, self.own1, pair, 0.0) + found(self.one, self.on1, pair >> BITS, 1.0) * self.root[cells & MASK]
        return found(self.cells, self.own2, cells, 0.0) + found(self.two, self.on2, cells >> BITS, 1.0) * one


def context_tables(train: DataFrame, sent, root) -> dict[int, float]:
    """Tables of each numbered word in the restaurants of one word before: its customers without context."""

    def tables(rows: pa.Table) -> pa.Table:
        cells, c, _ = learned(rows)
        seating = Seating(cells, c, root.value, rows.column("slice")[0].as_py())
        t = np.bincount(seating.pairs & MASK, seating.tables)
        del seating
        give_back()
        return pa.table({"w": np.flatnonzero(t), "t": t[t > 0]})

    only = train.select(F.lit(None).cast("long").alias("_row"), "_t", F.lit(True).alias("_learn"))
    rows = dealt(only, sent).groupBy("slice").applyInArrow(tables, "w long, t double").groupBy("w").agg(F.sum("t").alias("t")).collect()
    return {r["w"]: r["t"] for r in rows}


class Model:
    """What scoring needs: totals, the training texts, the samples' symbol models with their weight, the
    table of words with probabilities, and the probabilities of numbered words without context, 0 all rare and new ones."""

    def __init__(self, spark: SparkSession, train: DataFrame, text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> None:
        sc = spark.sparkContext
        words = checkpointed(word_counts(train, text))
        self.n, self.v = (x or 0 for x in words.agg(F.sum("c"), F.count(F.lit(1))).first())
        top = words.orderBy(F.desc(F.col("word") == F.lit(END)), F.desc("c"), "word").limit(TOP).collect()
        listed = [(bytes(r["word"]), r["c"]) for r in top]
        self.vocabulary = sc.broadcast(Vocabulary(listed, self.n))
        self.train = train.select(text_of(text).alias("_t"))
        first = np.array([0, *(c for _, c in listed)]) / max(1, self.n + self.v)
        first[0] = 1 - first.sum()
        tables = context_tables(self.train, self.vocabulary, sc.broadcast(first))
        customers = spark.createDataFrame([(w, max(1, round(tables[i]))) for i, (w, _) in enumerate(listed, 1)], "word binary, k long")
        words = words.join(F.broadcast(customers), "word", "left").select("word", "c", F.coalesce("k", "c").alias("k"))
        words = checkpointed(words)
        r = words.agg(F.sum("k"), F.sum((F.col("k") == 1).cast("long")), F.sum((F.col("k") == 2).cast("long"))).first()
        all_k, once, twice = (x or 0 for x in r)
        self.discount = d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        seats = words.select("*", F.lit(1.0).alias("t"), F.lit(0.0).alias("p"))
        share = shares(words)
        root, total, self.samples = np.full(64, 1 / 64), float(self.v), []
        kept = max(1, sweeps - burn_in)
        for sweep in range(sweeps):
            model, root = symbol_model(seats, root, share, sweep)
            sent, others = sc.broadcast(model), total

            def reseat(batches: Iterator[pd.DataFrame], sent=sent, others=others, sweep=sweep) -> Iterator[pd.DataFrame]:
                rng = np.random.default_rng([sweep, TaskContext.get().partitionId()])
                for pdf in batches:
                    p0 = 10.0 ** sent.value.words(list(pdf["word"]))
                    t = seat(rng, pdf["k"].to_numpy(float), p0, others - pdf["t"].to_numpy(), d, STRENGTH)
                    yield pdf.assign(t=t, p0=p0)

            new = checkpointed(seats.mapInPandas(reseat, "word binary, c long, k long, t double, p double, p0 double"))
            total = float(new.agg(F.sum("t")).first()[0] or 0.0)
            base = (STRENGTH + d * total) / (STRENGTH + all_k)
            here = (F.col("k") - d * F.col("t")) / (STRENGTH + all_k) + base * F.col("p0")
            if sweep >= burn_in or sweep == sweeps - 1:
                self.samples.append((sent, np.log10(base / kept)))
                new = new.withColumn("p", F.col("p") + here / kept)
            seats = new.drop("p0")
        self.words = seats.select("word", "c", F.log10("p").alias("lp"))
        found = self.words.join(F.broadcast(customers.select("word")), "word").collect()
        known = np.zeros(len(listed) + 1)
        for r in found:
            known[self.vocabulary.value.ids[bytes(r["word"])]] = 10.0 ** r["lp"]
        known[0] = max(1.0 - known.sum(), 1e-12)
        self.root = sc.broadcast(known)


def unseen(samples, words: list[bytes]) -> np.ndarray:
    """log10 of the averaged probability of words that no training text holds."""
    return np.logaddexp.reduce([np.log(10) * (sent.value.words(words) + w) for sent, w in samples], axis=0) / np.log(10)


def answered(asked: DataFrame, model: Model) -> DataFrame:
    """(_row, n_tokens, n_known, _lc, score) of the dealt rows that have a ``_row``."""
    samples, root, buckets = model.samples, model.root, model.vocabulary.value.buckets
    answers = pa.schema([("chunk", pa.int64()), ("score", pa.binary()), ("rarer", pa.binary()), ("about", pa.binary())])

    def in_contexts(rows: pa.Table) -> Iterator[tuple[bytes, None]]:
        cells, c, asked = learned(rows)
        seating = Seating(cells, c, root.value, rows.column("slice")[0].as_py())
        for (cells, of), size in zip(asked, rows.column("size").to_pylist()):
            score = None if of is None else np.bincount(of, np.log10(seating.probabilities(cells)), size)
            yield None if score is None else pressed(score.astype(np.float32).tobytes()), None

    def rarer(words: pa.Table, rows: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        """Rarer words share the mass of the rare ones; those not met are spelled."""
        lists = [unpressed(x).split(b"\n") for x in rows.column("keys").to_pylist()]
        asked = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        at = pc.index_in(asked.dictionary, value_set=words.column("word").combine_chunks())
        met = at.is_valid().to_numpy(zero_copy_only=False)
        c, lp = np.zeros(len(met)), np.zeros(len(met))
        found = at.drop_null().to_numpy()
        c[met], lp[met] = words.column("c").to_numpy()[found], words.column("lp").to_numpy()[found]
        new = asked.dictionary.filter(pc.invert(at.is_valid())).to_pylist()
        lp[~met] = np.concatenate([np.empty(0), *(unseen(samples, new[k : k + PART]) for k in range(0, len(new), PART))])
        lp -= np.log10(root.value[0])
        word, lo = asked.indices.to_numpy(), 0
        for x, n, texts, size in zip(lists, *(rows.column(k).to_pylist() for k in ("c", "texts", "size"))):
            of, w = np.frombuffer(unpressed(texts), np.uint16), np.repeat(word[lo : lo + len(x)], unpacked(unpressed(n)))
            score, known, log = (np.bincount(of, v[w], size) for v in (lp, met, np.log10(c + 1)))
            yield pressed(score.astype(np.float32).tobytes()), pressed(known.tobytes() + log.tobytes())
            lo += len(x)

    def answer(words: pa.Table, rows: pa.Table) -> pa.Table:
        found = [] if not rows.num_rows else [*(rarer(words, rows) if rows.column("slice")[0].as_py() < 0 else in_contexts(rows))]
        give_back()
        score, rare = zip(*found) if found else ((), ())
        chunk, about = (rows.column(c).combine_chunks() for c in ("chunk", "about"))
        return pa.table([chunk, pa.array(score, pa.binary()), pa.array(rare, pa.binary()), about], schema=answers)

    def total(rows: pa.Table) -> pa.Table:
        ids, n, known, log = np.frombuffer(next((x for x in rows.column("about").to_pylist() if x is not None), b""), np.int64).reshape(4, -1)
        log, known, score = log.view(float).copy(), known.astype(float), np.zeros(len(ids))
        if len(ids):
            for s, r in zip(rows.column("score").to_pylist(), rows.column("rarer").to_pylist()):
                score += np.frombuffer(unpressed(s), np.float32)[-len(ids) :]
                if r is not None:
                    more = np.frombuffer(unpressed(r)).reshape(2, -1)[:, -len(ids) :]
                    known, log = known + more[0], log + more[1]
        return pa.table({"_row": ids, "n_tokens": n, "n_known": known.round().astype(np.int64), "_lc": log, "score": score})

    words = model.words.select((-1 - F.crc32("word") % buckets).cast("int").alias("slice"), "word", "c", "lp")
    rows = dealt(asked, model.vocabulary).groupBy("slice")
    found = words.groupBy("slice").cogroup(rows).applyInArrow(answer, "chunk long, score binary, rarer binary, about binary")
    return found.filter("score is not null").groupBy("chunk").applyInArrow(total, "_row long, n_tokens long, n_known long, _lc double, score double")


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), learn: str | None = None) -> DataFrame:
    """``keep`` columns and n_tokens, n_known, train_tokens, base_score, score for each row of ``df``.

    A word that no training text holds costs what its restaurants leave to new words and its symbols. Null and empty
    texts have the end alone. Rows that repeat both text and ``keep`` are put together by a hash and come as often
    as they occur; other columns are not read. If ``df`` holds the very rows that the model has learned from, ``learn``
    names the boolean column that tells them, and their texts are dealt out once.
    """
    given = F.coalesce(F.col(learn), F.lit(False)) if learn else F.lit(False)
    rows = df.select(F.struct(*keep).alias("_keep"), text_of(text).alias("_t"), given.alias("_learn")).withColumn("_row", F.xxhash64("_keep", "_t"))
    asked = rows.select("_row", "_t", "_learn")
    if not learn:
        asked = asked.unionByName(model.train.select(F.lit(None).cast("long").alias("_row"), "_t", F.lit(True).alias("_learn")))
    out = rows.select("_row", "_keep").join(answered(asked, model).dropDuplicates(["_row"]), "_row")
    base = F.col("_lc") - F.col("n_tokens") * F.log10(F.lit(float(model.n + model.v + 1)))
    return out.select(
        "_keep.*", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    short_batches(spark, 10_000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7).alias("held_out"))
    docs = docs.withColumn("_learned", ~F.col("held_out"))
    return score(docs, Model(spark, docs.filter("_learned")), keep=("doc_id", "held_out"), learn="_learned")
