"""Centroid clustering against direct computation with Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from surveymend.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def direct(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and (isinstance(x, int) or math.isfinite(x)) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    own, every = {}, sum(d for *_, d in out)
    for _, j, d in out:
        own[j] = own.get(j, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    return sorted([(i, j, fits(d), fits(own[j]), fits(every), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out], key=repr)


def run(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in centroids.cluster(df, k, rounds, dim).collect()], key=repr)


def test_equals_direct_computation(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=6) * (1 + k % 5) + (k % 3)).tolist()) for k in range(300)]
    assert run(spark, rows, 8, 10, 6) == direct(rows, 8, 10, 6)


def test_odd_vectors_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 0.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [-0.0001, 0.9999]), (None, [0.5, 0.5]), (None, [0.25, 0.5]), (11, [0.5, 1.0]), (11, [1.0, 0.5])]
    for k in (1, 3, 4, 40):
        assert run(spark, rows, k, 4, 2) == direct(rows, k, 4, 2)
    assert run(spark, [(4, None)], 3, 2, 2) == [] and run(spark, rows[:1], 3, 2, 2) == direct(rows[:1], 3, 2, 2)


def test_equal_distances_go_to_the_smaller_number(spark):
    rows = [(k, [float(x), float(y)]) for k, (x, y) in enumerate([(a, b) for a in range(-3, 4) for b in range(-3, 4)])]
    assert run(spark, rows, 8, 3, 2) == direct(rows, 8, 3, 2)


@pytest.mark.parametrize("size", [1e5, 1e7, 1e18, 1e300, 1.7e308])
def test_large_components_are_exact(spark, size):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=3) * (1.0 if k % 4 else size / 10)).tolist()) for k in range(40)]
    assert run(spark, rows, 5, 3, 3) == direct_large(rows, 5, 3, 3)


def direct_large(rows, k, rounds, dim):
    # floor(1024 * x) of a double is that of its product, or the whole number times 1024 where that overflows.
    floor = lambda x: math.floor(1024 * x) if math.isfinite(1024 * x) else int(x) * 1024
    return direct([(i, [floor(x) for x in v]) for i, v in rows], k, rounds, dim, scale=1)


def test_candidates_are_a_run_of_norms(spark):
    rng = np.random.default_rng(3)
    c = centroids.Centroids([(rng.normal(size=16) * 400 * 1.3**k).astype(int).tolist() for k in range(32)])
    x = np.concatenate([(np.array(r) + rng.normal(size=(50, 16)) * 20).astype(int) for r in c.rows])
    found, distance = c.nearest(x)
    every = ((x[:, None, :] - c.c) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert c.compared < 0.25 * every.size


def test_no_round_changes_what_has_settled(spark):
    rows = [(k, [float(k % 2 * 10), 1.0]) for k in range(20)]
    assert run(spark, rows, 2, 50, 2) == direct(rows, 2, 50, 2)
