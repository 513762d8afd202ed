"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors are put in bands by length, projected on some random directions for each curve, shifted, and ordered by band and
Hilbert key. Each curve is cut into ranges of equal size, up to ``RANGES``; Spark deals out runs of neighbouring ranges, so
that a task holds a stretch of one curve. On each curve a query searches a window around its own key, in every band, and
further windows where it expects neighbours as well: how many rows of a range should pass its k-th score follows from the
range's mean, its spread, and how vectors vary within ranges along the query's direction; ranges are taken from the densest
down, over all curves, until the expected recall is reached. What the windows find is merged and ranked by the exact measure.

How far expectations hold differs from table to table, so they are calibrated: a bounded sample of queries is compared with
all rows, and of ``LEVELS``, from narrow windows to all of the table, the first is taken that finds ``TARGET`` of its
neighbours. So windows are narrow where vectors cluster, and as wide as need be where they don't. Small tables aren't worth
it: they take the widest level that is still cheaper than comparing all.

Equal vectors are searched once, and stand for their ``K + 1`` smallest ids, more than which can't be among the nearest,
so no number of copies makes a long range, and ties at equal vectors are exact. Keys that tie are told apart by a hash
of the id, so ranges are even.
Null vectors, zero vectors, vectors with null or non-finite components, and null ids take no part. Inner products are of
vectors of one length: every length is a table of its own. A query without candidates gives no rows; repeated ids are
queries and candidates once; an empty table gives no rows; other columns are ignored. Very long vectors only take longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, mapped, mix64, out_batch, ready

K, QUERY_EVERY = 20, 20
#: Curves, directions of each, and bits of each direction.
CURVES, DIRECTIONS, BITS = 2, 16, 2
#: Expected recall and what spreads are multiplied by, from narrow windows to wide ones; beyond the last, all is searched.
LEVELS = ((0.93, 1.0), (0.94, 1.0), (0.95, 1.0), (0.96, 1.0), (0.975, 1.0), (0.975, 1.3), (0.985, 1.6), (0.99, 2.0), (0.995, 2.5), (0.999, 3.0), (0.9999, 4.0))
#: The least level of small tables of vectors as long as each other.
FIRST = LEVELS[1]
#: The share of the sampled queries' neighbours that a level must find, less 1.5 standard errors; queries sampled, at least and at most, and as a part
#: of all; distinct vectors from which on a table is calibrated; and the share of so many
#: products that a query may always make.
TARGET, SAMPLED, SAMPLED_PART, CALIBRATED, SPENT = 0.93, (20, 96), 8, 2500, 0.85
#: Ranges to either side of a query's own that are searched in any case.
NEXT = 2
#: Rows of a range in small tables, and ranges of a curve in large ones.
RANGE_ROWS, RANGES = 12, 2048
#: Bands of length at most, and vectors of the longest; lengths nearer than this share are alike.
BANDS, BAND_ROWS, ALIKE = 8, 64, 0.02
#: Vectors whose keys place the ranges' borders: a bounded sample, the first by a hash of the id. Numbers of those vectors
#: that variation within ranges is measured on.
SAMPLE, MEASURED = 65_536, 1 << 20
#: Rows of a curve that a task holds, and queries that it compares with them at once.
BLOCK_ROWS, STEP = 8192, 256
#: Groups of equal vectors whose digests are broadcast at most: 12 MB.
BROADCAST_GROUPS = 250_000
SEED = 5


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, d) below 2**bits, by undoing the curve's rotations bit by bit."""
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            high = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def bands_of(length: np.ndarray) -> np.ndarray:
    """Lengths at which bands begin: the longest half of each band is the next one; none where lengths are alike."""
    if not len(length) or length.max() <= (1 + ALIKE) * length.min():
        return np.zeros(0)
    return np.array([np.quantile(length, 1 - 0.5**j) for j in range(1, BANDS) if len(length) * 0.5**j >= BAND_ROWS])


def curve_places(ids: np.ndarray, x: np.ndarray, bands: np.ndarray | None = None, seed: int = SEED) -> np.ndarray:
    """(n, CURVES) places: the band, Hilbert keys of vectors scaled to unit length, and below them bits of a hash of the id."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    own = min(DIRECTIONS, dim)
    axes = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-CURVES * own // dim))], axis=1)
    length = np.linalg.norm(x, axis=1)
    unit = x / length[:, None]
    band = np.searchsorted(bands, length, "right").astype(np.int64) << 56 if bands is not None else np.zeros(len(x), np.int64)
    tie = (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(40)).astype(np.int64)
    out = np.empty((len(x), CURVES), np.int64)
    for c in range(CURVES):
        # One standard deviation of a random direction is a quarter of the grid; the shift moves cell borders.
        y = (unit @ axes[:, c * own : (c + 1) * own] * dim**0.5 / 4 + 0.5 + rng.uniform(-0.06, 0.06, own)) * (1 << BITS)
        out[:, c] = band | hilbert(np.clip(y, 0, (1 << BITS) - 1).astype(np.int64), BITS) << 24 | tie
    return out


def tail(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above z, to seven places."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = np.exp(-a * a / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, p, 1 - p)


@dataclass
class Index:
    """Where ranges begin on each curve, where bands begin, the rows, mean and spread of every range (2 * 2048 means at most),
    how vectors vary within ranges, and the level of the windows; None is all of the table."""

    bounds: list[np.ndarray]
    bands: np.ndarray
    count: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    within: np.ndarray | None = None
    level: tuple[float, float] | None = FIRST

    @property
    def ranges(self) -> int:
        return len(self.bounds[0]) + 1

    def places(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return curve_places(ids, x, self.bands)

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, places[:, c], "right") for c, b in enumerate(self.bounds)], axis=1)

    def measure(self, ids: np.ndarray, x: np.ndarray) -> None:
        """How a sample of vectors varies around the means of its ranges on the first curve."""
        apart = x - self.mean[self.of(self.places(ids, x))[:, 0]]
        self.within = apart.T @ apart / max(len(x), 1)

    def own(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(queries, CURVES * ranges): windows around each query's own key, in every band."""
        n, key = self.ranges, self.places(ids, q) & ((1 << 56) - 1)
        out = np.zeros((len(q), CURVES * n), bool)
        near = np.arange(-NEXT, NEXT + 1)
        for band in range(len(self.bands) + 1):
            at = self.of(key | band << 56)
            for c in range(CURVES):
                out[np.arange(len(q))[:, None], c * n + np.clip(at[:, c, None] + near, 0, n - 1)] = True
        return out

    def windows(self, ids: np.ndarray, q: np.ndarray, k: int, level: tuple[float, float] | None) -> np.ndarray:
        """(queries, CURVES * ranges): the ranges that each query searches at a level: those around its own key, and those
        that hold the expected share of its k nearest."""
        n = self.ranges
        if level is None:  # one curve holds all rows
            return np.broadcast_to(np.arange(CURVES * n) < n, (len(q), CURVES * n))
        expected, wide = level
        size = np.linalg.norm(q, axis=1, keepdims=True)
        along = np.sqrt(np.maximum(((q @ self.within) * q).sum(axis=1, keepdims=True), 0))
        # A range varies along a direction as all do, in proportion to its own spread.
        usual = max(float(np.sqrt(np.trace(self.within) / q.shape[1])), 1e-300)
        score, deviation = q @ self.mean.T, np.maximum(along * self.spread / usual * wide, 1e-12 * size)
        # The k-th score: where the rows expected above it, counted on the first curve, are k.
        s, d, rows = score[:, :n], deviation[:, :n], self.count[:n]
        low, high = (s - 2 * d).min(axis=1), (s + 8 * d).max(axis=1)
        for _ in range(14):
            middle = (low + high) / 2
            many = (rows * tail((middle[:, None] - s) / d)).sum(axis=1) > k
            low, high = np.where(many, middle, low), np.where(many, high, middle)
        density = tail((low[:, None] - score) / deviation)
        order = np.argsort(-density, axis=1, kind="stable")
        gain = np.take_along_axis(density * self.count, order, 1)
        missed, held = np.ones(density.shape), np.zeros(density.shape)
        for c in range(CURVES):
            caught = np.cumsum(np.where(order // n == c, gain, 0), axis=1)
            missed *= np.clip(1 - caught / np.maximum(caught[:, -1:], 1e-300), 0, 1)
            held = np.maximum(held, np.cumsum(np.where(order // n == c, self.count[order], 0), axis=1))
        # Windows hold the query and k others in any case.
        need = np.maximum((missed > 1 - expected).sum(axis=1), (held < k + 1).sum(axis=1)) + 1
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        return (rank < need[:, None]) | self.own(ids, q)

    def costs(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[float]:
        """Products that a query makes at each level, with means and with rows, by a sample of queries."""
        return [(self.windows(ids, q, k, level) * self.count).sum() / max(len(q), 1) + len(self.count) for level in LEVELS]

    def take(self, least: int, costs: list[float]) -> None:
        """A level, or a wider one that makes no more products than a query may always make; all of the table, if that costs less."""
        n = self.count[: self.ranges].sum()
        i = max([least, *(j for j, c in enumerate(costs) if c <= SPENT * min(n, CALIBRATED))])
        self.level = LEVELS[i] if costs[i] < n else None

    def calibrate(self, ids: np.ndarray, q: np.ndarray, k: int, near: list[np.ndarray]) -> None:
        """Take the first level whose windows hold ``TARGET`` of the neighbours, less 1.5 standard errors of the sample, or a wider
        one that a query affords; ``near`` has each query's neighbours' ranges, (neighbours, CURVES)."""
        some = [i for i, at in enumerate(near) if len(at)]
        self.level = None if some else FIRST
        for i, level in enumerate(LEVELS if some else ()):
            chosen = self.windows(ids, q, k, level)
            found = np.array([np.any([chosen[j, c * self.ranges + near[j][:, c]] for c in range(CURVES)], axis=0).mean() for j in some])
            if found.mean() - 1.5 * found.std() / len(found) ** 0.5 >= TARGET:
                self.take(i, self.costs(ids, q, k))
                return


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as an (n, length) array of doubles; nulls become NaN."""
    values = column.flatten()
    values = values.fill_null(float("nan")) if values.null_count else values
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of usable vectors; a zero has one sign only, so that equal vectors have equal digests."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("v"))
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        rows = (x[good] + 0.0).astype("<f4" if pa.types.is_float32(batch.schema.field("v").type.value_type) else "<f8")
        yield out_batch(_CLEAN, {"id": batch.column("id").filter(pa.array(good)), "vector": [r.tobytes() for r in rows]})


_CLEAN = pa.schema([("id", pa.int64()), ("vector", pa.binary())])
_PLACES = pa.schema([("places", pa.binary())])
_SUMS = pa.schema([("curve", pa.int32()), ("range", pa.int32()), ("n", pa.int64()), ("squares", pa.float64()), ("total", pa.binary())])
_PLACED = pa.schema([("curve", pa.int32()), ("block", pa.int64()), ("query", pa.bool_()), ("range", pa.int32()), ("vid", pa.int64()), ("vector", pa.binary()), ("windows", pa.binary())])
_NEAR = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("score", pa.float64()), ("at", pa.binary())])
_FOUND = pa.schema([("q", pa.int64()), ("v", pa.int64()), ("score", pa.float64())])


def _read(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors from their bytes."""
    if not len(column):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _lengths(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(_read(batch.column("vector"), kind), axis=1))], names=["length"])

    return run


def _keys(kind: str, bands: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = curve_places(batch.column("vid").to_numpy(), _read(batch.column("vector"), kind), bands)
                yield out_batch(_PLACES, {"places": [r.tobytes() for r in p]})

    return run


def _sums(kind: str, index: Index):
    """Rows, squared lengths and vector sums by range: at most one row for each range from a task."""
    n = index.ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, squares, total = np.zeros(CURVES * n, np.int64), np.zeros(CURVES * n), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _read(batch.column("vector"), kind)
            total = np.zeros((CURVES * n, x.shape[1])) if total is None else total
            at = index.of(index.places(batch.column("vid").to_numpy(), x)) + np.arange(CURVES) * n
            length = (x * x).sum(axis=1)
            for c in range(CURVES):
                order = np.argsort(at[:, c], kind="stable")
                which, first = np.unique(at[order, c], return_index=True)
                rows[which] += np.diff(np.append(first, len(order)))
                squares[which] += np.add.reduceat(length[order], first)
                total[which] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(rows)
        yield out_batch(_SUMS, {"curve": some // n, "range": some % n, "n": rows[some], "squares": squares[some], "total": [total[i].tobytes() for i in some]})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the ranges that a task was dealt."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for c, r, n, s, t in zip(*(batch.column(f.name).to_pylist() for f in _SUMS), strict=True):
            have = held.setdefault((c, r), [0, 0.0, 0.0])
            have[0] += n
            have[1] += s
            have[2] = have[2] + np.frombuffer(t)
    yield out_batch(_SUMS, {"curve": [k[0] for k in held], "range": [k[1] for k in held], "n": [v[0] for v in held.values()], "squares": [v[1] for v in held.values()], "total": [v[2].tobytes() for v in held.values()]})


def blocks_of(n: int, ranges: int) -> tuple[int, int]:
    """(runs of ranges of a curve, parts of a range): a block is a run, or a part of one range, of about BLOCK_ROWS rows."""
    want = max(1, -(-n // BLOCK_ROWS))
    return min(want, ranges), max(1, -(-want // ranges))


def _placed(kind: str, index: Index, n: int, k: int):
    """Each row on every curve, and each query once for every block that one of its windows meets."""
    ranges = index.ranges
    runs, parts = blocks_of(n, ranges)
    run_of = np.arange(ranges) * runs // ranges
    first = np.searchsorted(run_of, np.arange(runs + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vid = batch.column("vid").to_numpy()
            x = _read(batch.column("vector"), kind)
            at = index.of(index.places(vid, x))
            part = (mix64(vid.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)
            none = pa.nulls(batch.num_rows, pa.binary())
            for c in range(CURVES):
                yield out_batch(_PLACED, {"curve": np.full(len(vid), c, np.int32), "block": run_of[at[:, c]] * parts + part, "query": np.zeros(len(vid), bool), "range": at[:, c], "vid": vid, "vector": batch.column("vector"), "windows": none})
            asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            if not len(asked):
                continue
            chosen = index.windows(vid[asked], x[asked], k, index.level).reshape(len(asked), CURVES, ranges)
            for c in range(CURVES):
                for b in range(runs):
                    mine = chosen[:, c, first[b] : first[b + 1]]
                    some = np.flatnonzero(mine.any(axis=1))
                    if len(some):
                        bits = [r.tobytes() for r in np.packbits(mine[some], axis=1)]
                        who = np.tile(some, parts)
                        yield out_batch(
                            _PLACED,
                            {"curve": np.full(len(who), c, np.int32), "block": b * parts + np.repeat(np.arange(parts), len(some)), "query": np.ones(len(who), bool), "range": np.full(len(who), first[b]), "vid": vid[asked[who]], "vector": batch.column("vector").take(pa.array(asked[who])), "windows": bits * parts},
                        )

    return run


def best_of(score: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, exact score) of the k best rows of each query by score, then id; -inf stands for rows not searched."""
    out = []
    most = min(score.shape[1], k + 8)
    at = np.argpartition(-score, most - 1, axis=1)[:, :most]
    rough = np.take_along_axis(score, at, 1)
    last = np.sort(rough, axis=1)[:, -min(k, most)]
    many = (score >= (last - 1e-9 * np.maximum(1, np.abs(last)))[:, None]).sum(axis=1) > most
    for i in np.flatnonzero(many & np.isfinite(last)):  # ties beyond those kept
        found = np.flatnonzero(score[i] >= last[i] - 1e-9 * max(1.0, abs(last[i])))
        exact = (rows[found] * queries[i]).sum(axis=1)
        order = np.lexsort((ids[found], -exact))[:k]
        out.append((np.full(len(order), i), ids[found[order]], exact[order]))
        rough[i] = -np.inf
    # Product by product, so equal vectors have equal scores wherever they are.
    exact = np.where(np.isfinite(rough), (rows[at] * queries[:, None, :]).sum(axis=2), -np.inf)
    who = np.repeat(np.arange(len(at)), most)
    order = np.lexsort((ids[at].ravel(), -exact.ravel(), who)).reshape(len(at), most)[:, :k].ravel()
    order = order[np.isfinite(exact.ravel()[order])]
    out.append((who[order], ids[at].ravel()[order], exact.ravel()[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _searched(kind: str, k: int):
    """Blocks arrive one after another, rows by range before queries; only one block's rows are held."""

    def close(block: list, queries: list) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(r[2] for r in block), kind).reshape(len(block), -1).astype(np.float64)
        ids, own = np.array([r[1] for r in block]), np.array([r[0] for r in block])
        which, begin = np.unique(own, return_index=True)
        end = np.append(begin[1:], len(own))
        q = np.frombuffer(b"".join(r[2] for r in queries), kind).reshape(len(queries), -1).astype(np.float64)
        first = np.array([r[0] for r in queries])
        bits = np.unpackbits(np.stack([np.frombuffer(r[3], np.uint8) for r in queries]), axis=1).astype(bool)
        score = np.full((len(q), len(x)), -np.inf)
        for r, b, e in zip(which, begin, end, strict=True):
            asks = np.flatnonzero(bits[:, r - first[0]])
            if len(asks):
                score[asks, b:e] = q[asks] @ x[b:e].T
        who, found, exact = best_of(score, q, x, ids, k)
        return out_batch(_FOUND, {"q": np.array([r[1] for r in queries])[who], "v": found, "score": exact})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, queries = None, [], []
        for batch in batches:
            for curve, number, query, *row in zip(*(batch.column(f.name).to_pylist() for f in _PLACED), strict=True):
                if (curve, number) != place:
                    if block and queries:
                        yield close(block, queries)
                    place, block, queries = (curve, number), [], []
                if not query:
                    block.append(row)
                elif block:
                    queries.append(row)
                    if len(queries) == STEP:
                        yield close(block, queries)
                        queries = []
        if block and queries:
            yield close(block, queries)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table that has been cut, if it has few rows; else Spark chooses."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def _first(rows: DataFrame, n: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of n rows, the first by a hash of the id; all, if there are fewer."""
    share = 1 << 20
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64("vid", F.lit(salt)), F.lit(share)) < max(1, int(most / n * share)))


def _bounds(same: DataFrame, kind: str, n: int) -> Index:
    """Bands, and where the ranges of each curve begin, from the lengths and places of a bounded sample."""
    part = _first(same.select("vid", "vector"), n, SAMPLE, 55)
    bands = bands_of(mapped(part, _lengths(kind), "length double").toArrow().column("length").to_numpy())
    places = mapped(part, _keys(kind, bands), "places binary").toArrow().column("places").to_pylist()
    p = np.sort(np.frombuffer(b"".join(places), np.int64).reshape(-1, CURVES), axis=0)
    ranges = max(1, min(RANGES, n // RANGE_ROWS, len(p)))
    return Index([p[np.arange(1, ranges) * len(p) // ranges, c] for c in range(CURVES)], bands)


def _exact(kind: str, index: Index, ids: np.ndarray, q: np.ndarray, k: int):
    """Of a task's rows the k nearest to each of a few queries, with their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            vid, x = batch.column("vid").to_numpy(), _read(batch.column("vector"), kind)
            who, found, score = best_of(q @ x.T, q, x, vid, k + 1)
            order = np.argsort(vid)
            at = index.of(index.places(vid, x))[order[np.searchsorted(vid[order], found)]]
            held.append([who, found, score, at])
            if len(held) == 16:
                held = [_best_found(held, k)]
        if held:
            who, found, score, at = _best_found(held, k)
            yield out_batch(_NEAR, {"q": ids[who], "v": found, "score": score, "at": [r.astype("<i4").tobytes() for r in at]})

    return run


def _best_found(held: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    who, found, score, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((found, -score, who))
    keep = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) <= k]
    return [who[keep], found[keep], score[keep], at[keep]]


def _calibrated(same: DataFrame, kind: str, index: Index, n: int, k: int) -> None:
    """Set the level by a bounded sample of queries, which all rows are compared with."""
    asked = same.filter("asked").select("vid", "vector")
    m = asked.count()
    t = _first(asked, m, min(max(m // SAMPLED_PART, SAMPLED[0]), SAMPLED[1]), 56).toArrow()
    ids, q = t.column("vid").to_numpy(), _read(t.column("vector"), kind)
    if n < CALIBRATED or not len(ids):
        if len(ids):
            index.take(LEVELS.index(FIRST), index.costs(ids, q, k))
        return
    near = mapped(same.select("vid", "vector"), _exact(kind, index, ids, q, k), "q long, v long, score double, at binary")
    best = W.partitionBy("q").orderBy(F.desc("score"), "v")
    rows = near.filter("q <> v").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).select("q", "at").toArrow()
    of: dict[int, list[bytes]] = {}
    for i, at in zip(rows.column("q").to_pylist(), rows.column("at").to_pylist(), strict=True):
        of.setdefault(i, []).append(at)
    index.calibrate(ids, q, k, [np.frombuffer(b"".join(of.get(i, [])), "<i4").reshape(-1, CURVES) for i in ids.tolist()])


def build(same: DataFrame, kind: str, n: int, k: int = K) -> Index:
    """Ranges of the distinct vectors (vid, vector, asked), with means over all of them, and the level of the windows."""
    index = _bounds(same, kind, n)
    sums = mapped(same.select("vid", "vector"), _sums(kind, index), _ddl(_SUMS))
    rows = mapped(sums.repartition("curve", "range"), _summed, _ddl(_SUMS)).toArrow().to_pylist()
    ranges = index.ranges
    dim = len(rows[0]["total"]) // 8
    count, mean, spread = np.zeros(CURVES * ranges), np.zeros((CURVES * ranges, dim)), np.zeros(CURVES * ranges)
    for r in rows:
        at = r["curve"] * ranges + r["range"]
        count[at], mean[at] = r["n"], np.frombuffer(r["total"]) / r["n"]
        spread[at] = max(r["squares"] / r["n"] - (mean[at] ** 2).sum(), 0.0) / dim
    index.count, index.mean, index.spread = count, mean, np.sqrt(spread)
    t = _first(same.select("vid", "vector"), n, max(1, min(SAMPLE, MEASURED // dim)), 57).toArrow()
    index.measure(t.column("vid").to_numpy(), _read(t.column("vector"), kind).reshape(-1, dim))
    _calibrated(same, kind, index, n, k)
    return index


def _of_length(raw: DataFrame, kind: str, k: int, every: int) -> DataFrame | None:
    """Search among vectors (id, v) of one length."""
    clean = cut(mapped(raw, _clean, "id long, vector binary").withColumn("digest", F.unhex(F.md5("vector"))))
    # Only copies are brought together; other vectors, mostly all, stay where they are.
    copied = _small(cut(clean.groupBy("digest").count().filter("count > 1").select("digest")))
    alone = clean.join(copied, "digest", "left_anti").select(F.col("id").alias("vid"), "vector", (F.col("id") % every == 0).alias("asked"))
    copies = clean.join(copied, "digest", "left_semi")
    groups = cut(copies.groupBy("digest").agg(F.min("id").alias("vid"), F.min("vector").alias("vector"), F.bool_or(F.col("id") % every == 0).alias("asked")))
    ids = copies.select("digest", "id").withColumn("nth", F.dense_rank().over(W.partitionBy("digest").orderBy("id"))).filter(F.col("nth") <= k + 1)
    ids = _small(cut(ids.groupBy("digest").agg(F.sort_array(F.collect_set("id")).alias("ids")).join(_small(groups).select("digest", "vid"), "digest").select("vid", "ids")))
    same = alone.unionByName(groups.select("vid", "vector", "asked"))
    n = same.count()
    if not n:
        return None
    index = build(same, kind, n, k)
    placed = mapped(same, _placed(kind, index, n, k), _ddl(_PLACED))
    found = mapped(placed.repartition("curve", "block").sortWithinPartitions("curve", "block", "query", "range"), _searched(kind, k + 1), _ddl(_FOUND))
    # A vector stands for its smallest id, so more than k + 1 vectors can't hold the k nearest ids.
    best = found.groupBy("q", "v").agg(F.max("score").alias("score"))
    best = best.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))).filter(F.col("nth") <= k + 1)
    near = best.join(ids.withColumnRenamed("vid", "v"), "v", "left").select("q", "score", F.explode(F.coalesce("ids", F.array("v"))).alias("vec_id"))
    asks = copies.filter(F.col("id") % every == 0).select("digest", F.col("id").alias("query_id")).distinct().join(_small(groups).select("digest", F.col("vid").alias("q")), "digest").select("q", "query_id")
    asked = alone.filter("asked").select(F.col("vid").alias("q"), F.col("vid").alias("query_id")).unionByName(asks)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.join(near, "q").filter("vec_id <> query_id").dropDuplicates(["query_id", "vec_id"])
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found to every row of (vec_id, embedding) whose id ``every`` divides."""
    spark: SparkSession = vectors.sparkSession
    ready(spark)
    element = vectors.schema["embedding"].dataType.elementType
    single = isinstance(element, T.FloatType)
    raw = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v")).filter("id is not null and size(v) > 0")
    lengths = [r[0] for r in raw.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    found = [r for n in lengths if (r := _of_length(raw.filter(F.size("v") == n), "<f4" if single else "<f8", k, every)) is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
