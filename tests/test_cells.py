"""Cell-partitioned search: what is pruned is no answer."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesmith.operators import cells as N
from namesmith.operators import vectors as V
from namesmith.session import shared_dir

SCHEMA = "id long, collection string, colour string, embedding array<double>"


def clustered(spark, n=1500):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 6, (12, 8))
    rows = [(i, "ab"[i % 2], ("red", "blue", None)[i % 3], (middles[i % 12] + rng.normal(0, 0.3, 8)).tolist()) for i in range(n)]
    rows += [(n, "a", "red", [0.0] * 8), (n + 1, "a", "red", rows[0][3]), (n + 2, "a", None, None), (n + 3, "only", "red", [1.0] * 8)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows, query, k, metric):
    _, collection, colour, q = query
    q, out = np.array(q), []
    for i, c, own, v in rows:
        if v is None or c != collection or (colour is not None and own != colour):
            continue
        v = np.array(v)
        size = np.sqrt((q @ q) * (v @ v))
        out.append(((1 - (q @ v / size if size else 0.0)) if metric == "cosine" else ((q - v) ** 2).sum(), i))
    return sorted(out)[:k]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pruned_search_is_exact(spark, metric):
    rows, df = clustered(spark)
    asked = [(f"q{j}", c, colour, rows[j * 7][3]) for j in range(8) for c in ("a", "b") for colour in (None, "red")][:24]
    asked = [(f"{q[0]}{j}", *q[1:]) for j, q in enumerate(asked)] + [("zero", "a", "red", [0.0] * 8), ("none", "missing", None, [1.0] * 8), ("solo", "only", None, [2.0] * 8)]
    queries = spark.createDataFrame([(*q, 5) for q in asked], "query_id string, collection string, colour string, vector array<double>, n_results int")
    index = N.build_cells(df, ["colour"], metric, least=64)
    assert index.rows.select("collection", "cell").distinct().count() > 20
    got = {}
    for r in N.search_cells(queries, index).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    for q in asked:
        want = brute(rows, q, 5, metric)
        have = [(i, d) for _, i, d in sorted(got.get(q[0], []))]
        assert [round(d, 9) for _, d in have] == [round(d, 9) for d, _ in want], q[0]
        if q[0] != "zero":
            assert {i for i, _ in have} <= {i for d, i in brute(rows, q, 8, metric)}


def test_far_cells_are_not_read(spark):
    rows, df = clustered(spark)
    index = N.build_cells(df, ["colour"], "l2", least=64)
    queries = spark.createDataFrame([("q", "a", None, rows[4][3], 3)], "query_id string, collection string, colour string, vector array<double>, n_results int")
    found = N.search_cells(queries, index)
    assert found.count() == 3
    bound = max(r.distance for r in found.collect()) ** 0.5
    near = [c for c in index.cells.filter("collection = 'a'").collect() if np.linalg.norm(np.array(c.centre) - np.array(rows[4][3])) - c._radius <= bound]
    assert sum(c._n for c in near) < 400 < 750


ASKED = "query_id string, collection string, colour string, vector array<double>, n_results int"


def test_even_vectors_are_not_paired(spark):
    """Where nothing can be pruned no row is written for each question, cell and condition value."""
    v = np.random.default_rng(5).normal(0, 1, (2100, 32))
    df = spark.createDataFrame([(i, "a", "rgb"[i % 3], x.tolist()) for i, x in enumerate(v[:2000])], SCHEMA)
    queries = spark.createDataFrame([(str(i), "a", None, x.tolist(), 5) for i, x in enumerate(v[2000:])], ASKED)
    index = N.build_cells(df, ["colour"])
    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.glob("stage-*"))
    got = {}
    for r in N.search_cells(queries, index).collect():
        got.setdefault(int(r.query_id), []).append((r["rank"], r.id))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    order = np.argsort(-unit[2000:] @ unit[:2000].T, axis=1)[:, :5]
    assert {i: [j for _, j in sorted(hits)] for i, hits in got.items()} == {i: list(map(int, row)) for i, row in enumerate(order)}
    written = [spark.read.parquet(str(p)).count() for p in set(root.glob("stage-*")) - before]
    assert written and max(written) <= 100 * 30  # before: 100 questions, 45 cells, 3 colours


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_sheets_and_slots(spark, monkeypatch, metric):
    """Cells in one sheet, cells in several and questions in several slots; equal vectors go by id."""
    monkeypatch.setattr(N, "SHEET", 8 * 40)
    monkeypatch.setattr(N, "TILE", 500)
    rows, df = clustered(spark)
    rows += [(5000 - i, "a", "red", rows[6][3]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [(f"q{i}", "ab"[i % 2], (None, "red", "green")[i % 3], rows[i * 3][3], (5, 12)[i % 2]) for i in range(120)] + [("copies", "a", "red", rows[6][3], 7)]
    index = N.build_cells(df, ["colour"], metric, least=64)
    got = {}
    for r in N.search_cells(spark.createDataFrame(asked, ASKED), index).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    for *q, k in asked:
        want = brute(rows, q, k, metric)
        have = sorted(got.get(q[0], []))
        assert [r for r, _, _ in have] == list(range(1, len(want) + 1)), q[0]
        assert [round(d, 9) for _, _, d in have] == [round(d, 9) for d, _ in want], q[0]
    assert [i for _, i, _ in sorted(got["copies"])] == [6, *range(4801, 4807)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_odd_vectors(spark, metric):
    """Other lengths, missing numbers, zeros and no number; text ids, no condition: as comparing one by one."""
    odd = [[0.0, 0.0], [1.0, 2.0], [2.0, 1.0, 3.0], [1.0, None], [], [float("nan"), 1.0], None, [1e6, -2e6]]
    df = spark.createDataFrame([(f"가{i}", "a", v) for i, v in enumerate(odd * 2)], "id string, collection string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", "a", v, 9) for i, v in enumerate(odd)], "query_id string, collection string, vector array<double>, n_results int")
    pairs = queries.filter("vector IS NOT NULL").join(df.filter("embedding IS NOT NULL"), "collection").withColumn("distance", V.distance(F.col("vector"), F.col("embedding"), metric))
    want = N.top_per_key(pairs, ["query_id"], [F.col("distance"), F.col("id")], 9).select("query_id", "rank", "id", "distance")
    got = N.search(queries, df, [], metric=metric).select("query_id", "rank", "id", "distance")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
