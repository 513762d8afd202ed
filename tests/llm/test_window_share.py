"""Windows of the curves: what they cost, and that splitting ranges changes nothing."""

import numpy as np
import pytest

from surveymend.llm import neighbours


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def found(df):
    return {(r["query_id"], r["vec_id"]): (r["rank"], r["score"]) for r in neighbours.search(df).collect()}


def test_tail_is_the_normal_one():
    from math import erfc

    z = np.linspace(-5, 6, 50)
    assert neighbours.tail(z) == pytest.approx([erfc(x / 2**0.5) / 2 for x in z], abs=2e-7)


def indexed(ids, x, k=20):
    """The index of vectors, built and calibrated as tasks do, and the ranges of every vector."""
    n = len(x)
    bands = neighbours.bands_of(np.linalg.norm(x, axis=1))
    p = neighbours.curve_places(ids, x, bands)
    ranges = max(1, min(neighbours.RANGES, n // neighbours.RANGE_ROWS))
    index = neighbours.Index([np.sort(p[:, c])[np.arange(1, ranges) * n // ranges] for c in range(neighbours.CURVES)], bands)
    at = index.of(p)
    flat = at + np.arange(neighbours.CURVES) * ranges
    both = neighbours.CURVES * ranges
    index.count = np.bincount(flat.ravel(), minlength=both).astype(float)
    rows = np.maximum(index.count, 1)
    index.mean = np.stack([np.bincount(flat.ravel(), np.repeat(x[:, j], neighbours.CURVES), both) for j in range(x.shape[1])], 1) / rows[:, None]
    squares = np.bincount(flat.ravel(), np.repeat((x * x).sum(axis=1), neighbours.CURVES), both) / rows
    index.spread = np.sqrt(np.maximum(squares - (index.mean**2).sum(axis=1), 0) / x.shape[1])
    index.measure(ids, x)
    products = 0
    asked = np.flatnonzero(ids % 20 == 0)
    some = np.random.default_rng(1).permutation(asked)[: min(max(len(asked) // neighbours.SAMPLED_PART, neighbours.SAMPLED[0]), neighbours.SAMPLED[1])]
    if n < neighbours.CALIBRATED:
        index.take(neighbours.LEVELS.index(neighbours.FIRST), index.costs(ids[some], x[some], k))
    else:
        index.calibrate(ids[some], x[some], k, [at[i] for i in nearest(x, some, k)])
        products = len(some) * n
    return index, at, products


def nearest(x, asked, k=20):
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    return np.argsort(-score, axis=1)[:, :k]


def vectors_of(kind, n, dim=64):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    clusters = lambda spread: rng.normal(size=(30, dim))[rng.integers(0, 30, n)] + spread * rng.normal(size=(n, dim))
    return {
        "unit": lambda: unit(rng.normal(size=(n, dim))), "unit clusters": lambda: unit(clusters(0.3)), "clusters": lambda: clusters(0.3), "wide clusters": lambda: clusters(1.0), "normal": lambda: rng.normal(size=(n, dim)),
        "lognormal lengths": lambda: rng.normal(size=(n, dim)) * rng.lognormal(size=(n, 1)), "few dimensions": lambda: rng.normal(size=(n, 6)) @ rng.normal(size=(6, dim)) + 0.05 * rng.normal(size=(n, dim)), "skewed": lambda: rng.exponential(size=(n, dim)),
    }[kind]()


@pytest.mark.parametrize(
    ("kind", "n", "share"),
    [
        ("unit", 800, 1.05), ("unit", 3000, 1.2), ("unit", 12000, 0.8), ("unit clusters", 3000, 0.9), ("clusters", 6000, 0.7), ("wide clusters", 6000, 0.9), ("lognormal lengths", 6000, 0.7), ("normal", 6000, 1.0), ("few dimensions", 6000, 0.6), ("skewed", 6000, 0.7),
        ("lognormal lengths", 900, 1.1), ("clusters", 900, 1.1), ("unit clusters", 2000, 0.9), ("normal", 900, 1.1), ("unit", 2000, 0.95),
    ],
)
def test_recall_with_fewer_products_than_brute_force(kind, n, share):
    x, ids = vectors_of(kind, n), np.arange(n)
    index, at, products = indexed(ids, x)
    asked = ids[ids % 20 == 0]
    chosen = index.windows(ids[asked], x[asked], 20, index.level)
    best = nearest(x, asked)
    hit = np.zeros(best.shape, bool)
    for c in range(neighbours.CURVES):
        hit |= np.take_along_axis(chosen, at[best, c] + c * index.ranges, 1)
    products += (chosen * index.count).sum() + (len(asked) * len(index.count) if index.level else 0)
    print(kind, n, index.level, round(hit.mean(), 3), round(hit.mean(axis=1).min(), 2), round(products / len(asked) / n, 2))
    assert hit.mean() >= 0.9
    assert products < share * len(asked) * n


def test_windows_hold_the_ranges_around_a_query_in_every_band():
    x, ids = vectors_of("lognormal lengths", 4000), np.arange(4000)
    index, at, _ = indexed(ids, x)
    own = index.own(ids[:50], x[:50])
    for c in range(neighbours.CURVES):
        for d in range(-neighbours.NEXT, neighbours.NEXT + 1):
            assert own[np.arange(50), c * index.ranges + np.clip(at[:50, c] + d, 0, index.ranges - 1)].all()
    assert len(index.bands) > 2 and (own <= index.windows(ids[:50], x[:50], 20, index.level)).all()
    assert not len(neighbours.bands_of(np.full(500, 3.0))) and not len(neighbours.bands_of(np.zeros(0)))


@pytest.mark.parametrize("kind", ["clusters", "lognormal lengths", "unit"])
def test_recall_of_the_search(spark, kind):
    n = 4000
    x = vectors_of(kind, n, 24)
    asked = np.arange(0, n, 20)
    best = nearest(x, asked)
    got = found(frame(spark, x))
    assert len(got) == len(asked) * 20
    hits = sum((int(q), int(v)) in got for q, row in zip(asked, best, strict=True) for v in row)
    assert hits >= 0.9 * best.size


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(1500, 16))
    whole = found(frame(spark, x))
    assert len(whole) == 75 * 20
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    assert neighbours.blocks_of(1500, 187) == (15, 1)
    assert found(frame(spark, x)) == whole
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 4)
    monkeypatch.setattr(neighbours, "STEP", 7)
    assert neighbours.blocks_of(1500, 187) == (187, 3)
    assert found(frame(spark, x)) == whole


def test_every_length_is_a_table(spark):
    rows = [(i, [1.0 + i, 2.0]) for i in range(30)] + [(100 + i, [1.0, float(i), 1.0]) for i in range(5)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {q for q, _ in got} == {0, 20, 100} and len(got) == 20 + 20 + 4
    assert {v for q, v in got if q == 100} == {101, 102, 103, 104}


def test_a_cluster_gives_every_query_its_number(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 32))
    x[500:900] = x[0] + 0.01 * rng.normal(size=(400, 32))
    got = found(frame(spark, x))
    assert len(got) == 100 * 20
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = [len({v for a, v in got if a == q} & set(np.argsort(-s[q])[:20])) for q in range(500, 900, 20)]
    # All of them have about the same twenty nearest, so their recalls vary together.
    assert sum(hits) >= 0.8 * 20 * len(hits)
