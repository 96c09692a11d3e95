"""Order-dependent steps that stay distributed.

A plain window without PARTITION BY sends the whole table to one task, and a window
per key does the same for a hot key. Rows here carry an explicit unique integer
position, so a block of positions holds at most ``block`` rows whatever the data
looks like: rows are numbered inside blocks and the blocks are chained by a prefix
sum over one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14  # rows of a block meet in one task, texts and all


def running_index(df: DataFrame, seq: str, name: str = "idx", keys: tuple[str, ...] = (), block: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """1-based running number of rows by ``seq`` (then ``ties``), per key or over the whole table."""
    keyed = df.withColumn("_block", F.floor(F.col(seq) / block))
    at = [*keys, "_block"]
    sizes = keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    # one row per key and block, not per row
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*at).orderBy(seq, *ties)
    return (
        keyed.withColumn("_at", F.row_number().over(inside))
        .join(offsets, at)
        .withColumn(name, F.col("_offset") + F.col("_at"))
        .drop("_block", "_at", "_offset")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key as a partial aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    by = F.struct(*[F.col(c) for c in order])
    pick = F.max_by(row, by) if last else F.min_by(row, by)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """First ``limit`` rows per key. The literal bound lets Spark cut each task's rows
    to ``limit`` per key before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= limit)


HASH_BLOCK = 1 << 44


def permuted(df: DataFrame, kinds: list[str], unique: str, seed: str) -> DataFrame:
    """Seeded random order of each kind's rows: ``rank`` from 1 and the kind's ``size``.

    Rows are ordered by 60 bits of a keyed digest. Its top bits are evenly spread, so
    the blocks the running number is built from are even as well, for a kind of any size.
    """
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.col(unique).cast("string"))), 1, 15)
    hashed = df.withColumn("_hash", F.conv(digest, 16, 10).cast("bigint"))
    sizes = df.groupBy(*kinds).agg(F.count(F.lit(1)).alias("size"))  # one row per kind
    ranked = running_index(hashed, "_hash", "rank", tuple(kinds), HASH_BLOCK, (unique,)).drop("_hash")
    return ranked.join(sizes, kinds)


def carried(
    df: DataFrame, keys: list[str], pos: str, firsts: dict[str, tuple[Column, Column]], lasts: dict[str, tuple[Column, Column]],
    lists: dict[str, Column] | None = None, block: int = 1 << 12,
) -> DataFrame:
    """Per row: first/last value with a condition among the rows *before* it, per key.

    ``firsts``/``lasts`` map a name to (condition, value); ``lists`` map a name to an array
    column, and the row gets the arrays before it, joined. A window per key would put a
    long group into one task; here a task sees at most ``block`` rows of a key, and the
    blocks of a key are chained by one summary row each.
    """
    lists = lists or {}
    blocked = df.withColumn("_b", F.floor(F.col(pos) / block))
    order = F.col(pos)
    sums = [F.min_by(v, F.when(c, order)).alias(n) for n, (c, v) in firsts.items()]
    sums += [F.max_by(v, F.when(c, order)).alias(n) for n, (c, v) in lasts.items()]
    for n, items in lists.items():
        pieces = F.array_sort(F.collect_list(F.when(F.size(items) > 0, F.struct(order.alias("p"), items.alias("items")))))
        sums.append(F.flatten(F.transform(pieces, lambda x: x["items"])).alias(n))
    per_block = blocked.groupBy(*keys, "_b").agg(*sums)
    chain = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_block.select(
        *keys, "_b", *[F.first(n, ignorenulls=True).over(chain).alias(f"_e_{n}") for n in firsts],
        *[F.last(n, ignorenulls=True).over(chain).alias(f"_e_{n}") for n in lasts],
        *[F.flatten(F.collect_list(n).over(chain)).alias(f"_e_{n}") for n in lists],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocked.select(
        "*", *[F.first(F.when(c, v), ignorenulls=True).over(inside).alias(f"_i_{n}") for n, (c, v) in firsts.items()],
        *[F.last(F.when(c, v), ignorenulls=True).over(inside).alias(f"_i_{n}") for n, (c, v) in lasts.items()],
        *[F.flatten(F.collect_list(items).over(inside)).alias(f"_i_{n}") for n, items in lists.items()],
    ).join(earlier, [*keys, "_b"])
    out = {n: F.coalesce(f"_e_{n}", f"_i_{n}") for n in firsts}
    out |= {n: F.coalesce(f"_i_{n}", f"_e_{n}") for n in lasts}
    out |= {n: F.concat(f"_e_{n}", f"_i_{n}") for n in lists}
    return rows.select(*df.columns, *[c.alias(n) for n, c in out.items()])
