"""Vectors as array columns: length, normalising, inner products and exact nearest rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, tasks
from .relational import few


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; null for zero vectors."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


#: Rows of a block of vectors at least, a sixteenth of all rows up to GROUP for larger tables, queries and products that a task
#: has at once, columns of them whose largest is taken first, and queries of a block in one task.
BLOCK, GROUP, STEP, AT_ONCE, WIDE, ASKED = 4096, 32_768, 512, 1 << 21, 64, 20_000
#: Queries whose cells are chosen at once, and rows that are given to cells at once.
CHOOSING = 512
#: Cells at most, rows that pivots are fitted to, and rounds of fitting.
CELLS, SAMPLE, FITTED = 1024, 8192, 4
#: Cells that a query visits in each round, best first; the last round visits all that are left.
VISITS = (1, 8, None)


class Cells:
    """Cells of vectors by their nearest pivot: what the cells hold bounds every inner product with one of their rows."""

    def __init__(self, pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, longest: np.ndarray):
        self.pivots, self.rows, self.radius, self.longest = pivots, rows, radius, longest
        #: Neighbouring cells of about a block of rows in all are a group, to which a query goes once; a large cell is one of its own.
        most = min(GROUP, max(BLOCK, int(np.sum(rows)) // 16))
        along = np.zeros(len(pivots))
        if len(pivots) > 1:
            apart = pivots - pivots.mean(axis=0)
            along = apart @ np.linalg.svd(apart, full_matrices=False)[2][0]
        self.group = np.zeros(len(pivots), np.int64)
        group, held = 0, 0
        for c in np.argsort(along, kind="stable"):
            if held and held + rows[c] > most:
                group, held = group + 1, 0
            self.group[c] = group
            held += rows[c]
        #: Parts of about a block of rows that each group is searched in.
        self.parts = np.maximum(1, -(-np.bincount(self.group, rows, group + 1).astype(np.int64) // most))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that an inner product with a row of each cell can be: of the pivot and the radius, or the longest row.

        Empty cells have none. A little is added for rounding.
        """
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        most = np.minimum(q @ self.pivots.T + length * self.radius, length * self.longest)
        return np.where(self.rows > 0, most + 1e-9 * length * (self.longest + 1e-300), -np.inf)


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, distance) of every row."""
    length = (pivots * pivots).sum(axis=1)
    cell = np.concatenate([np.zeros(0, np.int64), *((length - 2 * x[lo : lo + CHOOSING] @ pivots.T).argmin(axis=1) for lo in range(0, len(x), CHOOSING))])
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def fit_pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of groups of a sample: the first ones are spread over it evenly, then moved a few times."""
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.arange(min(cells, len(pivots))) * len(pivots) // max(min(cells, len(pivots)), 1)].copy()
    for _ in range(FITTED):
        cell, _ = nearest_pivot(sample, pivots)
        for c in np.unique(cell):
            pivots[c] = sample[cell == c].mean(axis=0)
    return pivots


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _read(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts)).reshape(len(parts), -1)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def best_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int, asks: np.ndarray, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of each query that reach its least score, ties to smaller ids, among the runs
    of rows that it asks for.

    Scores are summed product by product, so that equal vectors have equal ones wherever they are. The k-th largest of the
    largest of ``WIDE`` products each is no more than the k-th largest of all, so only those that reach it are looked at.
    """
    tile = max(WIDE, AT_ONCE // max(len(q), 1) // WIDE * WIDE)
    rough = np.empty((len(q), tile))
    parts = rough.reshape(len(q), -1, WIDE)
    slack = 1e-9 * (1e-300 + np.abs(q) @ np.abs(x).max(axis=0))
    every = [bool(column.all()) for column in asks.T]
    bound, found = least - slack, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, len(x), tile):
        hi = min(lo + tile, len(x))
        if hi - lo < tile or not all(every):
            rough.fill(-np.inf)
        for column, whole, (begin, end) in zip(asks.T, every, runs, strict=True):
            begin, end = max(begin, lo), min(end, hi)
            if begin < end and whole:
                np.matmul(q, x[begin:end].T, out=rough[:, begin - lo : end - lo])
            elif begin < end and len(some := np.flatnonzero(column)):
                rough[some, begin - lo : end - lo] = q[some] @ x[begin:end].T
        peaks = parts.max(axis=2)
        of = peaks if peaks.shape[1] >= k else rough
        if of.shape[1] >= k:
            bound = np.maximum(bound, np.partition(of, of.shape[1] - k, axis=1)[:, of.shape[1] - k] - slack)
        who, part = np.nonzero((peaks >= bound[:, None]) & (peaks > -np.inf))
        some = parts[who, part]
        each, column = np.nonzero((some >= bound[who][:, None]) & (some > -np.inf))
        found.append((who[each], lo + part[each] * WIDE + column))
    who, at = (np.concatenate(each) for each in zip(*found, strict=True))
    score = np.concatenate([np.zeros(0), *((q[who[lo : lo + 65_536]] * x[at[lo : lo + 65_536]]).sum(axis=1) for lo in range(0, len(who), 65_536))])
    order = np.lexsort((ids[at], -score, who))
    who, at, score = who[order], at[order], score[order]
    first = np.searchsorted(who, who)
    keep = np.arange(len(who)) - first < k
    return who[keep], at[keep], score[keep]


def _searched(k: int, cells: int, products):
    """Rows arrive by (group, part, slice), vectors by cell before queries: each query's best of the cells that it asks for."""

    def held(block: list) -> tuple:
        cell, ids = np.array([r[0] for r in block]), np.array([r[1] for r in block])
        here, begin = np.unique(cell, return_index=True)
        return _read([r[2] for r in block]), ids, here, list(zip(begin.tolist(), [*begin[1:].tolist(), len(cell)], strict=True))

    def close(rows: tuple, queries: list) -> pa.RecordBatch:
        x, ids, here, runs = rows
        q = _read([r[2] for r in queries])
        asks = np.unpackbits(np.stack([np.frombuffer(r[4], np.uint8) for r in queries]), axis=1, count=cells)[:, here].astype(bool)
        who, at, score = best_rows(q, x, ids, np.array([r[3] for r in queries]), k, asks, runs)
        if products is not None:
            products.add(int((asks * np.array([b - a for a, b in runs])).sum()))
        return pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in queries])[who]), pa.array(ids[at]), pa.array(score)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block, rows, queries = None, [], None, []
        for batch in batches:
            for group, part, slice_, asks, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "slice", "asks", "cell", "id", "v", "best", "cells")), strict=True):
                if (group, part, slice_) != place:
                    if queries:
                        yield close(rows, queries)
                    place, block, rows, queries = (group, part, slice_), [], None, []
                if not asks:
                    block.append(row)
                elif block or rows:
                    if rows is None:
                        rows, block = held(block), []
                    queries.append(row)
                    if len(queries) == STEP:
                        yield close(rows, queries)
                        queries = []
        if queries:
            yield close(rows, queries)

    return run


def _cells(rows: DataFrame, n: int) -> tuple[DataFrame, Cells]:
    """The rows with their cell and part of it, cut, and the cells: as many as the square root of rows, at most ``CELLS``."""
    cells = min(CELLS, int(n**0.5)) if n > BLOCK else 1
    share = 1 << 20
    part = rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(share)) < int(SAMPLE / n * share) + 1)
    pivots = fit_pivots(_matrix(part.select("v").toArrow().column("v").combine_chunks()), cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                cell, far = nearest_pivot(x, pivots)
                length = np.sqrt((x * x).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x]), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(length)], names=["id", "v", "cell", "far", "length"])

    of = cut(rows.mapInArrow(placed, "id long, v binary, cell int, far double, length double"))
    sums = of.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("length").alias("longest")).toArrow().to_pylist()
    count, radius, longest = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in sums:
        count[r["cell"]], radius[r["cell"]], longest[r["cell"]] = r["n"], r["radius"], r["longest"]
    return of.select("id", "v", "cell"), Cells(pivots, count, radius, longest)


def _visits(cells: Cells, many: int | None):
    """Each query once for every part of the groups that have cells that it visits now, best first, and that can hold a row as
    good as its best so far."""
    member = np.zeros((len(cells.rows), len(cells.parts)), np.float32)
    member[np.arange(len(cells.rows)), cells.group] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, CHOOSING) for b in batches for lo in range(0, b.num_rows, CHOOSING)):
            q = _read(batch.column("v").to_pylist())
            most = cells.bounds(q)
            best = batch.column("best").to_numpy(zero_copy_only=False)
            seen = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in batch.column("seen").to_pylist()]), axis=1, count=len(cells.rows)).astype(bool)
            able = (most >= best[:, None]) & ~seen & (cells.rows > 0)
            if many is not None:
                rank = np.argsort(np.argsort(np.where(able, -most, np.inf), axis=1, kind="stable"), axis=1)
                able &= rank < many
            bits, after = ([r.tobytes() for r in np.packbits(x, axis=1)] for x in (able, seen | able))
            who, group = np.nonzero(able.astype(np.float32) @ member)
            times = cells.parts[group]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = pa.array(np.repeat(who, times))
            taken = lambda x: pa.array(x, pa.binary()).take(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("id", "v", "best")), taken(after), taken(bits), pa.array(np.repeat(group, times).astype(np.int32)), pa.array(part.astype(np.int32))], names=["id", "v", "best", "seen", "cells", "group", "part"]
            )

    return run


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int = 1, products=None) -> DataFrame:
    """(query_id, vec_id, score): the exact k nearest by inner product of (query_id, v) among (vec_id, v), ties to smaller ids.

    Rows lie in cells around pivots, fitted to a bounded sample. A cell's pivot and radius, or its longest row, bound the
    inner products with its rows; a query visits the most promising cell first, then the next few, then all others, each
    time only those whose bound reaches its k-th score so far. So few products are made where vectors cluster or differ in
    length, and all of them where neither holds, as no exact method avoids. Groups of neighbouring cells meet queries by
    key, in blocks of ``BLOCK`` to ``GROUP`` rows and slices of ``ASKED`` queries, so no task holds a cell or all that ask for it,
    and a query goes to a block once for all of its cells. Tables of a block or less are one cell. ``products``: an accumulator that counts inner products of vectors.

    Vectors that are null take no part; embeddings of both sides come from one model and have one length. A query of rows
    fewer than k gets all of them; repeated vec_ids are rows of their own. A query_id is unique.
    """
    ship(rows.sparkSession)
    side = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter("v is not null")
    have = side(rows, "vec_id")
    n = have.count()
    nothing = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    if not n:
        return nothing
    placed, cells = _cells(have, n)
    numbers = lambda x, at: F.element_at(F.array(*[F.lit(int(v)) for v in x]), at + 1)
    blocks = placed.withColumn("group", numbers(cells.group, F.col("cell"))).withColumn("part", F.pmod(F.xxhash64("id"), numbers(cells.parts, F.col("group"))).cast("int"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.packbits(np.zeros(len(cells.rows), bool)).tobytes()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in _matrix(batch.column("v"))]), pa.array(np.full(batch.num_rows, -np.inf)), pa.array([none] * batch.num_rows, pa.binary())], names=["id", "v", "best", "seen"])

    asked = side(queries, "query_id").mapInArrow(encoded, "id long, v binary, best double, seen binary")
    rounds = VISITS if len(cells.rows) > 1 else VISITS[-1:]
    if len(rounds) > 1:
        asked = cut(asked)
    found = None
    for many in rounds:
        goes = asked.mapInArrow(_visits(cells, many), "id long, v binary, best double, seen binary, cells binary, group int, part int")
        if len(rounds) > 1:
            goes = cut(goes)
        slices = few(goes.filter("part = 0").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("slices")))
        every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
        held = blocks.join(slices, "group").select("group", "part", every, F.lit(False).alias("asks"), "cell", "id", "v", F.lit(0.0).alias("best"), F.lit(None).cast("binary").alias("cells"))
        mine = goes.join(slices, "group").select("group", "part", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(True).alias("asks"), F.lit(-1).alias("cell"), "id", "v", "best", "cells")
        dealt = held.unionByName(mine).repartition(tasks(rows.sparkSession), "group", "part", "slice").sortWithinPartitions("group", "part", "slice", "asks", "cell")
        now = dealt.mapInArrow(_searched(k, len(cells.rows), products), "query_id long, vec_id long, score double")
        found = top(now if found is None else found.unionByName(now))
        if many is not None and len(rounds) > 1:
            found = cut(found)
            kth = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            seen = goes.groupBy("id").agg(F.max("seen").alias("now"))
            asked = cut(asked.join(seen, "id", "left").join(kth, "id", "left").select("id", "v", F.coalesce("kth", "best").alias("best"), F.coalesce("now", "seen").alias("seen")))
    return found
