"""Exact filtered vector top-k over cells.

Each collection is cut into cells around a few of its own vectors. Rows are stored by
(collection, cell), and per cell and condition values their number and largest distance from
the cell's centre. Cells make up sheets of a bounded size: small ones share a sheet, a
large one has several. A query looks first into the sheet of its nearest cell; the distance of
its last answer there bounds what any other cell must offer. By the triangle inequality a cell
whose centre lies further than that bound and its radius together cannot, and only sheets with
other cells are looked into. Results are those of comparing everything.

Where vectors of many dimensions are spread evenly nearly all sheets are left, so a sheet and its
queries are compared as one product of matrices. That only finds who may be among the nearest, with
some slack; their distances are then summed up in order, so equal vectors have equal distances.

Cosine distance is pruned as the Euclidean distance of unit vectors, of which it is half the
square. Distances are ranked as computed; rounding is left to whoever prints them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namesmith.functions import elements as E
from namesmith.functions.order import top_per_key
from namesmith.operators.lookups import MAX_LIMIT, safe_limit
from namesmith.operators.vectors import dot
from namesmith.session import checkpointed, shared_dir

# Cells of a collection, numbers in all centres together (they pass the driver: 32 MB), rows below which a collection is one cell.
CELLS, NUMBERS, LEAST = 256, 1 << 22, 1000
SLACK = 1e-6
# Numbers in the rows of a sheet (about), in the queries that meet it at once, and in the distances that are held at once.
SHEET, TILE = 1 << 19, 1 << 21


@dataclass(frozen=True)
class Cells:
    """``rows`` and ``cells`` of an index, its metric, the condition columns it counts by and the centres of large collections."""

    rows: DataFrame
    cells: DataFrame
    metric: str
    condition: tuple[str, ...]
    centres: dict[object, np.ndarray]


def _position(v: Column, square: Column, metric: str) -> Column:
    """Where a vector lies for pruning: on the unit sphere for cosine (a zero vector stays at the origin)."""
    if metric == "l2":
        return v
    return F.when(square > 0, F.transform(v, lambda x: x / F.sqrt(square))).otherwise(v)


def _nearest(centres: dict[object, np.ndarray]):
    @F.pandas_udf("cell int, away double")
    def nearest(collection: pd.Series, position: pd.Series) -> pd.DataFrame:
        cell, away = np.zeros(len(position), np.int32), np.zeros(len(position))
        for name, at in collection.groupby(collection, dropna=False).indices.items():
            x = np.stack([np.asarray(p, float) for p in position.iloc[at]])
            c = centres.get(name)
            if c is None:
                away[at] = np.linalg.norm(x, axis=1)
                continue
            cell[at] = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
            away[at] = np.linalg.norm(x - c[cell[at]], axis=1)
        return pd.DataFrame({"cell": cell, "away": away})

    return nearest


def _apart(centres: dict[object, np.ndarray]):
    """Distances from all centres of the collection; without a centre the one cell lies around the origin."""

    @F.pandas_udf("array<double>")
    def apart(collection: pd.Series, position: pd.Series) -> pd.Series:
        out = np.empty(len(position), object)
        for name, at in collection.groupby(collection, dropna=False).indices.items():
            c = centres.get(name)
            if c is None:
                for i in at:
                    out[i] = [float(np.linalg.norm(np.asarray(position.iloc[i], float)))]
                continue
            x = np.stack([np.asarray(p, float) for p in position.iloc[at]])
            for i, row in zip(at, np.stack([np.linalg.norm(x - y, axis=1) for y in c], axis=1)):
                out[i] = row
        return pd.Series(out)

    return apart


def build_cells(documents: DataFrame, condition: list[str], metric: str = "cosine", columns: tuple[str, ...] = (), cells: int = CELLS, least: int = LEAST) -> Cells:
    """Index ``documents`` (id, collection, embedding, condition columns) in the shared folder.

    Centres are a bounded sample in hash order, every row is indexed. Rows without a vector are left out.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    v = F.col("embedding").cast("array<double>")
    rows = documents.filter(F.col("embedding").isNotNull()).select("id", "collection", *condition, *columns, v.alias("_d"), dot(v, v).alias("_dd"))
    rows = rows.withColumn("_p", _position(F.col("_d"), F.col("_dd"), metric))
    sizes = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("_p")).alias("_dim")).filter(F.col("_n") >= least)
    large, width = sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("_dim"), F.lit(1))).first()
    each = min(cells, NUMBERS // max(1, large * width))
    schema = "collection {}, cell int, centre array<double>".format(documents.schema["collection"].dataType.simpleString())
    centres = documents.sparkSession.createDataFrame([], schema)
    by_name: dict[object, np.ndarray] = {}
    if large and each > 1:
        drawn = top_per_key(rows.join(sizes.select("collection", "_n"), "collection"), ["collection"], [F.xxhash64("id"), F.col("id")], each, "_r")
        drawn = drawn.filter(F.col("_r") <= F.ceil(F.sqrt("_n"))).select("collection", (F.col("_r") - 1).cast("int").alias("cell"), F.col("_p").alias("centre"))
        centres = checkpointed(drawn)
        found = centres.orderBy("collection", "cell").toPandas()  # at most ``NUMBERS`` numbers
        by_name = {k: np.stack([np.asarray(c, float) for c in g]) for k, g in found.groupby("collection")["centre"]}
    alone = F.struct(F.lit(0).alias("cell"), F.sqrt(dot(F.col("_p"), F.col("_p"))).alias("away"))
    placed = rows.withColumn("_c", _nearest(by_name)("collection", "_p") if by_name else alone).select("id", *condition, *columns, "_d", "_dd", F.col("_c.away").alias("_away"), F.monotonically_increasing_id().alias("_row"), "collection", F.col("_c.cell").alias("cell"))
    path = f"{shared_dir(documents.sparkSession)}/cells-{uuid.uuid4().hex}"
    # rebalanced: small cells share a task, a cell of many rows is split over several
    placed.hint("rebalance", "collection", "cell").write.partitionBy("collection", "cell").parquet(path)
    stored = documents.sparkSession.read.schema(placed.schema).parquet(path)
    kinds = stored.groupBy("collection", "cell", *condition).agg(F.count(F.lit(1)).alias("_n"), F.max("_away").alias("_radius"))
    return Cells(stored, kinds.join(centres, ["collection", "cell"], "left"), metric, tuple(condition), by_name)


def _compared(condition: tuple[str, ...], metric: str):
    """The nearest rows of a sheet for each of the queries that meet it. All in one: what a worker calls need not be installed there."""

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as rows, filled up with zeros, and their lengths (-1 where a number is missing)."""
        lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten()
        if not values.null_count and (lengths == width).all():
            return values.to_numpy(zero_copy_only=False).astype(float).reshape(len(lengths), width), lengths
        out = np.zeros((len(lengths), width))
        for i, v in enumerate(lists.to_pylist()):
            lengths[i] = -1 if None in v else len(v)
            out[i, : len(v)] = [x or 0.0 for x in v]
        return out, lengths

    def longest(*columns: pa.ChunkedArray) -> int:
        return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns), default=0)

    def codes_of(rows: pa.ChunkedArray, queries: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """A condition as numbers: -1 where a row has none, -2 where a query has none, -3 where no row has the query's."""
        number: dict[object, int] = {}
        own = np.array([-1 if v is None else number.setdefault(v, len(number)) for v in rows.to_pylist()], np.int64)
        return own, np.array([-2 if v is None else number.get(v, -3) for v in queries.to_pylist()], np.int64)

    def best(q: np.ndarray, x: np.ndarray, q_square: np.ndarray, x_square: np.ndarray, unlike: np.ndarray | None, k: np.ndarray):
        """(query, row, distance) of the ``k`` nearest rows of each query, earlier rows first where distances are equal.

        ``unlike`` marks pairs without a common length: at distance 1 (cosine), or before all others (-inf).
        """
        n = len(x)
        if metric == "cosine":
            size = lambda v, square: v / np.where(square > 0, np.sqrt(square), 1.0)[:, None]
            near, slack = size(q, q_square) @ -size(x, x_square).T, np.full(len(q), 1e-9)
        else:
            near, slack = x_square[None, :] - 2 * (q @ x.T), 1e-10 * (q_square + x_square.max())
        if unlike is not None:
            near[unlike] = 0.0 if metric == "cosine" else -np.inf
        last = np.full(len(q), np.inf)
        some = k < n
        if some.any():
            nearest = np.sort(np.partition(near[some], k[some].max() - 1, axis=1)[:, : k[some].max()], axis=1)
            last[some] = nearest[np.arange(len(nearest)), k[some] - 1]
        i, j = np.nonzero(~(near > (last + slack)[:, None]))  # what is no number is looked at as well
        total = np.zeros(len(i))
        for a, b in zip(np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)):
            total += a[i] * b[j] if metric == "cosine" else (a[i] - b[j]) * (a[i] - b[j])
        if metric == "cosine":
            root = np.sqrt(q_square[i] * x_square[j])
            total = 1 - np.where(root == 0, 0.0, total / root)
        if unlike is not None:
            total[unlike[i, j]] = 1.0 if metric == "cosine" else -np.inf
        order = np.lexsort((j, total, i))
        i, j, total = i[order], j[order], total[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k[i]
        return i[kept], j[kept], total[kept]

    def compared(rows: pa.Table, queries: pa.Table) -> pa.Table:
        queries_of, rows_of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(queries):
            rows = rows.take(pc.sort_indices(rows["id"], null_placement="at_start"))
            width = longest(rows["_d"], queries["_q"])
            (x, x_length), (q, q_length) = matrix(rows["_d"], width), matrix(queries["_q"], width)
            x_square, q_square = (c.to_numpy().astype(float) for c in (rows["_dd"], queries["_qq"]))
            ragged = len({*x_length, *q_length}) > 1 or -1 in x_length
            k = queries["_k"].to_numpy()
            codes = [codes_of(rows[c], queries[c]) for c in condition]
            kinds, kind = np.unique(np.array([c for _, c in codes], np.int64).reshape(len(codes), len(q)), axis=1, return_inverse=True)
            for number, wanted in enumerate(kinds.T):
                fits = np.ones(len(x), bool)
                for (own, _), value in zip(codes, wanted):
                    fits &= (own == value) | (value == -2)
                at, asking = np.flatnonzero(fits), np.flatnonzero(kind.ravel() == number)
                step = max(1, TILE // max(1, len(at)))
                for some in np.split(asking, range(step, len(asking), step)) if len(at) else []:
                    unlike = (q_length[some, None] != x_length[at]) | (x_length[at] < 0) if ragged else None
                    with np.errstate(all="ignore"):
                        i, j, total = best(q[some], x[at], q_square[some], x_square[at], unlike, k[some])
                    queries_of.append(some[i])
                    rows_of.append(at[j])
                    found.append(total)
        i, j, total = np.concatenate(queries_of), np.concatenate(rows_of), np.concatenate(found)
        distance = pa.array(total, mask=np.isneginf(total) if metric == "l2" else None)
        return pa.table([queries["query_id"].take(pa.array(i)), queries["_k"].take(pa.array(i)), rows["id"].take(pa.array(j)), rows["_row"].take(pa.array(j)), distance], ["query_id", "_k", "id", "_row", "distance"])

    return compared


def _reach(distance: Column, metric: str) -> Column:
    return F.sqrt(F.greatest(2 * distance if metric == "cosine" else distance, F.lit(0.0)))


def search_cells(queries: DataFrame, index: Cells, n_results: str = "n_results", columns: tuple[str, ...] = (), maximum: int = MAX_LIMIT) -> DataFrame:
    """Nearest rows of each query within its collection and under its conditions.

    ``queries``: query_id, collection, vector, n_results (1 to ``maximum``) and one column per condition, null where
    the query does not ask for it. Queries without a vector get no rows.
    """
    condition, metric = index.condition, index.metric
    v = F.col("vector").cast("array<double>")
    asked = queries.filter(F.col("vector").isNotNull()).select(
        "query_id", F.col("collection"), *condition, safe_limit(F.col(n_results), maximum=maximum).alias("_k"), v.alias("_q"), dot(v, v).alias("_qq")
    )
    position = _position(F.col("_q"), F.col("_qq"), metric)
    asked = checkpointed(asked.withColumn("_apart", _apart(index.centres)("collection", position)))
    # where the rows of a cell are: in sheets of so many rows, small cells together, and once for each slot of queries
    width = F.greatest(F.max(F.size("_q")), F.lit(1))
    loads = asked.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) * width / SHEET).alias("_slots"), F.greatest(F.floor(SHEET / width), F.lit(1)).alias("_room"))
    places = index.cells.groupBy("collection", "cell").agg(F.sum("_n").alias("_n"), F.max("_radius").alias("_radius")).join(loads, "collection")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("collection").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = checkpointed(places.select("collection", "cell", "_radius", "_slots", (F.floor(before / F.col("_room")) * (1 << 32)).alias("_sheet"), F.ceil(F.col("_n") / F.col("_room")).alias("_parts")))
    keys = ["collection", "_sheet", "_slot"]
    part = F.pmod(F.xxhash64("_row"), F.col("_parts"))
    placed = index.rows.join(places, ["collection", "cell"]).select("collection", (F.col("_sheet") + part).alias("_sheet"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slots") - 1)).alias("_slot"), "id", "_row", *condition, "_d", "_dd")
    lists = places.groupBy("collection").agg(F.first("_slots").alias("_slots"), F.collect_list(F.struct("cell", "_sheet", "_parts", "_radius")).alias("_places"))
    session = asked.sparkSession
    tasks = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    schema = "query_id {}, _k int, id {}, _row bigint, distance double".format(*(x.schema[c].dataType.simpleString() for x, c in ((asked, "query_id"), (index.rows, "id"))))

    def located(some: DataFrame) -> DataFrame:
        away = F.transform("_places", lambda p: F.struct(F.element_at("_apart", p["cell"] + 1).alias("apart"), p["_sheet"].alias("sheet"), p["_parts"].alias("parts"), p["_radius"].alias("radius")))
        there = some.join(lists, "collection").withColumn("_slot", F.pmod(F.xxhash64("query_id"), F.col("_slots"))).withColumn("_away", away)
        return there.withColumn("_home", F.array_min("_away")["sheet"])

    def compared(some: DataFrame) -> DataFrame:
        wanted = some.select(*keys, "query_id", "_k", *condition, "_q", "_qq").repartition(tasks, *keys)
        return placed.repartition(tasks, *keys).groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_compared(condition, metric), schema)

    def best(hits: DataFrame) -> DataFrame:
        return top_per_key(hits, ["query_id"], [F.col("distance"), F.col("id")], maximum).filter(F.col("rank") <= F.col("_k"))

    first = checkpointed(compared(located(asked).withColumn("_sheet", F.col("_home"))))
    bound = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"), F.max("distance").alias("_last"))
    reach = F.when(F.col("_found") >= F.col("_k"), _reach(F.col("_last"), metric) * (1 + SLACK)).otherwise(F.lit(float("inf")))
    rest = located(asked.join(bound, "query_id", "left").withColumn("_reach", reach))
    left = F.filter("_away", lambda p: p["apart"] - p["radius"] <= F.col("_reach") + SLACK * (1 + p["apart"]))
    sheets = F.flatten(F.transform(left, lambda p: F.transform(F.sequence(F.lit(0).cast("bigint"), p["parts"] - 1), lambda i: p["sheet"] + i)))
    rest = rest.withColumn("_sheet", F.explode(F.array_except(sheets, F.array("_home"))))
    found = best(first.unionByName(compared(rest))).drop("_k")
    if columns:
        found = found.join(index.rows.select("_row", *columns), "_row")
    return found.select("query_id", "id", *columns, "distance", "rank")


def search(queries: DataFrame, documents: DataFrame, condition: list[str], n_results: str = "n_results", metric: str = "cosine", columns: tuple[str, ...] = ()) -> DataFrame:
    """Index and search in one go."""
    return search_cells(queries, build_cells(documents, condition, metric, columns), n_results, columns)


def searched_by_chain(queries: DataFrame, index: Cells, element: str, size: str, single: str) -> DataFrame:
    """Search along the generating chain of a surname's element.

    Two searches under each of the next two elements, half the results each; for a one-character name one
    search under the next element with all of them; where the surname's element is unknown one search
    under the question's own condition. A question's stroke condition always holds. The index has the conditions
    resource_ohaeng and strokes.
    """
    code = E.code_of(F.col(element))
    known = E.normalized(F.col(element)).isNotNull()
    full = F.least(F.col(size), F.lit(MAX_LIMIT)).cast("int")
    half = F.least(F.floor(F.col(size) / 2).cast("int"), F.lit(MAX_LIMIT))
    step = lambda k: E.label_of(F.pmod(code + k, F.lit(5)))
    search_of = lambda name, label, n: F.struct(F.lit(name).alias("part"), label.alias("resource_ohaeng"), n.alias("n_results"))
    kinds = (
        F.when(~known, F.array(search_of("own", F.col("resource_ohaeng"), full)))
        .when(F.col(single), F.array(search_of("first", step(1), full)))
        .otherwise(F.array(search_of("first", step(1), half), search_of("second", step(2), half)))
    )
    asked = queries.select("query_id", "collection", "vector", "strokes", F.explode(kinds).alias("_s"))
    asked = asked.select(F.concat("query_id", F.lit(":"), F.col("_s.part")).alias("query_id"), "collection", "vector", "strokes", "_s.resource_ohaeng", "_s.n_results")
    found = search_cells(asked, index)
    return found.select(F.regexp_extract("query_id", "(?s)^(.*):", 1).alias("query_id"), F.substring_index("query_id", ":", -1).alias("part"), "rank", "id", "distance")
