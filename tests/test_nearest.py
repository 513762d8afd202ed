"""Exact nearest rows: equal to brute force on any vectors, and cells that can't hold a better row are skipped."""

import numpy as np
import pyarrow as pa
import pytest

from surveymend.operators import vectors
from surveymend.plans import catalog

SF = "/root/testdata/sf0.001"


def frame(spark, x, key):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in enumerate(x)], f"{key} long, v array<double>").repartition(3)


def brute(q, x, k):
    out = set()
    for i, a in enumerate(q):
        s = (x * a).sum(axis=1)
        out |= {(i, int(j), float(s[j])) for j in np.lexsort((np.arange(len(x)), -s))[:k]}
    return out


def clustered(rng, n, dim, clusters, spread=0.05):
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))


def found(spark, q, x, k, products=None):
    return {tuple(r) for r in vectors.nearest_rows(frame(spark, q, "query_id"), frame(spark, x, "vec_id"), k, products).collect()}


@pytest.fixture
def small(monkeypatch):
    for name, size in (("BLOCK", 64), ("STEP", 16), ("ASKED", 20)):
        monkeypatch.setattr(vectors, name, size)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "lengths", "ties", "zero"])
def test_equals_brute_force(spark, small, kind):
    rng = np.random.default_rng(7)
    x = {
        "isotropic": lambda: rng.normal(size=(900, 8)),
        "clustered": lambda: clustered(rng, 900, 8, 12),
        "lengths": lambda: rng.normal(size=(900, 8)) * rng.lognormal(sigma=2, size=(900, 1)),
        "ties": lambda: rng.integers(-1, 2, size=(900, 4)).astype(float),
        "zero": lambda: np.where(rng.random((900, 1)) < 0.3, 0.0, rng.normal(size=(900, 8))),
    }[kind]()
    q = x[::11]
    assert found(spark, q, x, 3) == brute(q, x, 3)


def test_cells_are_skipped_where_vectors_cluster_or_differ_in_length(spark, small):
    rng = np.random.default_rng(8)
    for x, share in ((clustered(rng, 3000, 16, 30), 0.25), (rng.normal(size=(3000, 16)) * rng.lognormal(sigma=1.5, size=(3000, 1)), 0.75)):
        q = x[::10] / np.linalg.norm(x[::10], axis=1, keepdims=True)
        products = spark.sparkContext.accumulator(0)
        assert found(spark, q, x, 1, products) == brute(q, x, 1)
        assert 0 < products.value < share * len(q) * len(x)


def test_one_block_makes_every_product_once(spark):
    x = np.random.default_rng(9).normal(size=(200, 5))
    products = spark.sparkContext.accumulator(0)
    assert found(spark, x, x, 2, products) == brute(x, x, 2) and products.value == 200 * 200


def test_nulls_few_rows_and_empty_tables(spark):
    x = [[1.0, 0.0], None, [0.0, 2.0], [0.0, 2.0]]
    got = vectors.nearest_rows(frame(spark, x, "query_id"), frame(spark, x, "vec_id"), 5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(q, v) for q in (0, 2, 3) for v in (0, 2, 3)]
    assert [r["vec_id"] for r in vectors.nearest_rows(frame(spark, x[2:], "query_id"), frame(spark, x, "vec_id")).collect()] == [2, 2]
    assert vectors.nearest_rows(frame(spark, x, "query_id"), frame(spark, [], "vec_id")).collect() == []
    assert vectors.nearest_rows(frame(spark, [], "query_id"), frame(spark, x, "vec_id")).collect() == []


def test_a_query_goes_to_a_block_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(11)
    pivots = rng.normal(size=(40, 5))
    rows = rng.integers(0, 60, 40)
    rows[7] = 450
    cells = vectors.Cells(pivots, rows, np.full(40, 9.0), np.full(40, 9.0))
    sizes = np.bincount(cells.group, rows)
    assert all(n <= 100 for g, n in enumerate(sizes) if g != cells.group[7])
    assert cells.parts[cells.group[7]] >= 5 and len(cells.parts) < 25
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([rng.normal(size=5).tobytes()]), pa.array([-np.inf]), pa.array([np.packbits(np.zeros(40, bool)).tobytes()], pa.binary())], names=["id", "v", "best", "seen"])
    (out,) = vectors._visits(cells, None)([batch])
    places = list(zip(out.column("group").to_pylist(), out.column("part").to_pylist(), strict=True))
    assert len(places) == len(set(places)) == cells.parts[np.unique(cells.group[rows > 0])].sum()


def test_bounds_hold():
    rng = np.random.default_rng(10)
    x, q = clustered(rng, 500, 6, 9), rng.normal(size=(40, 6))
    pivots = vectors.fit_pivots(x, 12)
    cell, far = vectors.nearest_pivot(x, pivots)
    per = lambda v: np.array([v[cell == c].max(initial=0) for c in range(len(pivots))])
    cells = vectors.Cells(pivots, np.bincount(cell, minlength=len(pivots)), per(far), per(np.linalg.norm(x, axis=1)))
    most = cells.bounds(q)
    assert all((q @ x.T)[:, cell == c].max(axis=1, initial=-np.inf).__le__(most[:, c]).all() for c in range(len(pivots)))


def test_a_large_table_has_few_groups():
    """A query that must look everywhere is sent to no more places in a table of 600,000 rows than of 60,000."""
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(1000, 3))
    few, many = (vectors.Cells(pivots, np.full(1000, n), np.full(1000, 9.0), np.full(1000, 9.0)).parts.sum() for n in (60, 600))
    assert many <= few + 8 and many <= 24


def test_cells_are_chosen_for_few_queries_at_once():
    rng = np.random.default_rng(6)
    pivots = rng.normal(size=(200, 4))
    cells = vectors.Cells(pivots, np.full(200, 2000), np.full(200, 9.0), np.full(200, 9.0))
    n = 5000
    none = np.packbits(np.zeros(200, bool)).tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([r.tobytes() for r in rng.normal(size=(n, 4))]), pa.array(np.full(n, -np.inf)), pa.array([none] * n, pa.binary())], names=["id", "v", "best", "seen"])
    out = list(vectors._visits(cells, None)([batch]))
    assert sum(b.num_rows for b in out) == n * cells.parts.sum() and max(b.num_rows for b in out) <= vectors.CHOOSING * cells.parts.sum()


def test_blocks_are_searched_in_tiles(monkeypatch):
    monkeypatch.setattr(vectors, "AT_ONCE", 1)
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(7, 5)), np.round(rng.normal(size=(700, 5)))
    ids, runs = rng.permutation(700), [(0, 300), (300, 310), (310, 700)]
    asks = rng.random((7, 3)) < 0.7
    for k in (1, 3, 90):
        who, at, score = vectors.best_rows(q, x, ids, np.full(7, -np.inf), k, asks, runs)
        for i in range(7):
            rows = [j for (a, b), yes in zip(runs, asks[i], strict=True) if yes for j in range(a, b)]
            exact = {j: (q[i] * x[j]).sum() for j in rows}
            assert at[who == i].tolist() == sorted(rows, key=lambda j: (-exact[j], ids[j]))[:k]


def test_trips_ends_alone_are_searched_for(spark, monkeypatch):
    asked = []
    whole = vectors.nearest_rows
    monkeypatch.setattr(vectors, "nearest_rows", lambda queries, rows, *a: (asked.append(queries.count()), whole(queries, rows, *a))[1])
    assert catalog.QUERIES["rag_augment"](spark, SF).count() > 0
    assert asked[0] <= 20
