"""Centroid clustering of integer vectors with exact sums, by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid of nearest norm bounds its distance to the nearest one;
by the triangle inequality that one's norm differs from the vector's by no more than the bound, so the candidates are a
run of the sorted centroids, found by binary search. The run is widened for rounding, so centroids on its border are in
it; candidates are compared by exact integer distances, ties going to the smaller number.

Vectors that are null, of another number of components, or hold null or non-finite components are left out. Components
count as floor(scale * x). Rows of one id, or equal rows, are vectors of their own; starts of equal hash (rows of one id)
are told apart by their components, and rows without an id come last. Fewer vectors than ``k`` give as many centroids; an
empty table gives no rows; other columns are ignored. Integers of any size are exact: beyond 2**27 they are computed as
Python's, and a distance or inertia that no long holds is null.

Each round reads the vectors once; a task sends one sum for each of its clusters, and k centroids go back to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, out_batch, ready

#: Components of a vector, clusters, rounds, what components are multiplied by, and the seed of the starts.
DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Below this, squared distances of 64 components are exact as doubles (2**22) or as longs (2**27).
IN_DOUBLE, IN_LONG = 1 << 22, 1 << 27
#: Vectors that are assigned at once.
STEP = 8192

Vectors = np.ndarray


def integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, Vectors]:
    """(which rows are usable, floor(scale * x) of those): longs, or Python integers if any is large."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = column.is_valid().to_numpy(zero_copy_only=False) & (np.asarray(column.value_lengths().fill_null(-1)) == dim)
    values = column.filter(pa.array(fits)).flatten()
    values = values.fill_null(float("nan")) if values.null_count else values
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    rows = np.flatnonzero(fits)[good]
    return rows, _whole(x[good], scale)


def _whole(x: np.ndarray, scale: int) -> Vectors:
    if not x.size or np.abs(x).max() < IN_LONG / scale:
        return np.floor(x * scale).astype(np.int64)
    # The product is a double, as for small components, unless it overflows.
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    out = np.empty(x.shape, object)
    out[:] = [[int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(r, s, strict=True)] for r, s in zip(x.tolist(), y.tolist(), strict=True)]
    return out


def _squared(x: Vectors, c: Vectors) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    d = x - c
    return (d * d).sum(axis=1)


class Centroids:
    """Centroids with their norms in ascending order."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        large = max((abs(v) for r in rows for v in r), default=0)
        self.kind = object if large >= IN_LONG else np.int64
        self.c = np.array(rows, self.kind).reshape(len(rows), len(rows[0]) if rows else 0)
        self.small = large < IN_DOUBLE
        norm = np.sqrt((self.c.astype(np.float64) ** 2).sum(axis=1)) if self.kind is np.int64 else np.zeros(len(rows))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.compared = 0

    def nearest(self, x: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every row; ``compared`` counts exact distances."""
        cluster, distance = [], []
        for lo in range(0, len(x), STEP):
            a, b = self._nearest(x[lo : lo + STEP])
            cluster.append(a)
            distance.append(b)
        return np.concatenate(cluster), np.concatenate(distance)

    def _nearest(self, x: Vectors) -> tuple[np.ndarray, np.ndarray]:
        c = self.c
        if self.kind is object or x.dtype == object:
            x, c = x.astype(object), c.astype(object)
        elif self.small and np.abs(x).max() < IN_DOUBLE:
            x, c = x.astype(np.float64), c.astype(np.float64)  # whole numbers below 2**53
        n, k = len(x), len(c)
        if x.dtype == object:  # norms may pass the range of doubles, so all centroids are candidates
            d = np.stack([_squared(x, v) for v in c], axis=1)
            self.compared += n * k
            cluster = np.array([min(range(k), key=r.__getitem__) for r in d.tolist()])
            return cluster, d[np.arange(n), cluster]
        own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        right = np.clip(np.searchsorted(self.norm, own), 1, max(k - 1, 1))
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, k - 1)
        first = self.order[np.where(np.abs(self.norm[left] - own) <= np.abs(self.norm[right] - own), left, right)]
        best, cluster = np.empty(n, x.dtype), first.copy()
        for j in np.unique(first):
            some = first == j
            best[some] = _squared(x[some], c[j])
        bound = np.sqrt(best.astype(np.float64))
        room = 1e-6 + 1e-9 * (bound + own)
        low = np.searchsorted(self.norm, own - bound - room, "left")
        high = np.searchsorted(self.norm, own + bound + room, "right")
        self.compared += n
        for place, j in enumerate(self.order):
            some = np.flatnonzero((low <= place) & (place < high) & (first != j))
            if len(some):
                self.compared += len(some)
                d = _squared(x[some], c[j])
                closer = (d < best[some]) | (d == best[some]) & (j < cluster[some])
                best[some[closer]], cluster[some[closer]] = d[closer], j
        return cluster, best.astype(np.int64)


_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("inertia", pa.string())])
_SUMS_DDL = "cluster int, n long, sums array<string>, inertia string"


class _Sums:
    """Numbers, component sums and distance sums of clusters, as integers of any size."""

    def __init__(self):
        self.held: dict[int, list] = {}

    def add(self, cluster: int, n: int, sums: list[int], inertia: int) -> None:
        have = self.held.setdefault(cluster, [0, [0] * len(sums), 0])
        have[0] += n
        have[1] = [a + b for a, b in zip(have[1], sums, strict=True)]
        have[2] += inertia

    def batch(self) -> pa.RecordBatch:
        # A sum may be longer than any type of number, so sums travel as text.
        rows = sorted(self.held.items())
        return out_batch(_SUMS, {"cluster": [k for k, _ in rows], "n": [v[0] for _, v in rows], "sums": [list(map(str, v[1])) for _, v in rows], "inertia": [str(v[2]) for _, v in rows]})


def _add(total: _Sums, x: Vectors, cluster: np.ndarray, distance: np.ndarray) -> None:
    for j in np.unique(cluster).tolist():
        some = cluster == j
        mine, far = x[some], distance[some]
        # Halves of longs are added apart, so no sum of a batch overflows.
        if x.dtype == object or far.dtype == object:
            sums, inertia = mine.sum(axis=0).tolist(), sum(far.tolist())
        else:
            sums, inertia = mine.sum(axis=0).tolist(), (int((far >> 32).sum()) << 32) + int((far & 0xFFFFFFFF).sum())
        total.add(j, int(some.sum()), list(map(int, sums)), int(inertia))


def _vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def starts(vectors: DataFrame, k: int = K, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The k usable vectors of smallest sha256 of ``seed:vec_id``."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = _vectors(vectors).filter((F.size("v") == dim) & finite)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = usable.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).toArrow().to_pylist()
    return [list(map(int, _whole(np.array([r["v"]]), scale)[0].tolist())) for r in first]


def totals(vectors: DataFrame, centroids: list[list[int]], dim: int = DIM, scale: int = SCALE) -> dict[int, tuple[int, list[int], int]]:
    """(number, component sums, distance sum) of every cluster that isn't empty: k rows reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, total = Centroids(centroids), _Sums()
        for batch in batches:
            _, x = integers(batch.column("v"), dim, scale)
            if len(x):
                _add(total, x, *near.nearest(x))
        yield total.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Sums()
        for batch in batches:
            for r in batch.to_pylist():
                total.add(r["cluster"], r["n"], list(map(int, r["sums"])), int(r["inertia"]))
        yield total.batch()

    sums = mapped(_vectors(vectors).select("v"), part, _SUMS_DDL)
    rows = mapped(sums.repartition("cluster"), merge, _SUMS_DDL).toArrow().to_pylist()
    return {r["cluster"]: (r["n"], list(map(int, r["sums"])), int(r["inertia"])) for r in rows}


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The centroids after so many rounds; empty clusters keep theirs."""
    ready(vectors.sparkSession)
    centroids = starts(vectors, k, dim, scale, seed)
    for _ in range(rounds if centroids else 0):
        found = totals(vectors, centroids, dim, scale)
        moved = [[s // found[j][0] for s in found[j][1]] if j in found else c for j, c in enumerate(centroids)]
        if moved == centroids:  # further rounds change nothing
            break
        centroids = moved
    return centroids


_OUT = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Every usable vector of (vec_id, embedding): its cluster, squared distance, the sums of distances over its cluster and
    over all, and a digest of its final centroid."""
    ready(vectors.sparkSession)
    centroids = fit(vectors, k, rounds, dim, scale, seed)
    found = totals(vectors, centroids, dim, scale) if centroids else {}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = [_long(found[j][2]) if j in found else 0 for j in range(len(centroids))]
    every = _long(sum(v[2] for v in found.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(centroids)
        for batch in batches:
            rows, x = integers(batch.column("v"), dim, scale)
            if not len(x):
                continue
            c, d = near.nearest(x)
            c = c.tolist()
            yield out_batch(_OUT, {"vec_id": batch.column("vec_id").take(pa.array(rows)), "cluster": c, "distance": [_long(v) for v in d.tolist()], "cluster_inertia": pa.array([own[j] for j in c], pa.int64()), "inertia": pa.array([every] * len(c), pa.int64()), "centroid_sha256": [digest[j] for j in c]})

    return mapped(_vectors(vectors), run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
