"""Exact n-gram Jaccard join with count vectors in R-trees.

A document is its set of distinct hashed word shingles; two link at a Jaccard similarity of ``THRESHOLD`` or more.
1. Equal sets form classes; only one document of a class goes on.
2. Linked sets share one of their first shingles in any common order (a fifth of a set, plus one). Rare ones come first:
   of shingles whose hash is below ``EDGE`` it is counted, by 32 bits of the hash, how many documents have them, and those that
   one document has aren't listed at all, as they meet nothing. Popular ones, told by a number that needn't be exact, come last.
   The order changes the cost, never the result.
3. In each block of a shingle, a document is checked against one partner, with whom it shares most first shingles; this joins groups
   of copies by about one comparison a document. Blocks of popular shingles are split in ``PARTS`` by a hash of the id for
   this, so that no task sorts one alone.
4. Where blocks of one least id still hold more than one component, their documents' count vectors (shingles hashed into a power of two
   of groups, counted) go into an R-tree: a node's largest counts bound the overlap of everything below it, by summed
   coordinate minima. Pairs of different components that survive the bound are compared there on their whole sets, and a link
   joins their components, so pairs that it settles are neither looked at nor passed on. Large blocks are searched
   in cells: pieces of ``CELL`` documents of the block's largest component against pieces of the others, and those pairwise.

Texts that are null, or have no word, link with nothing. Fewer words than a shingle make one shingle of the whole.
Null ids keep their size; they take no part in links. Repeated rows repeat their row; of different texts of one id each
keeps its size, and one of them speaks for the id when sets are compared, the same in every run. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, cut, mapped, mix64, out_batch, ready, word_hashes
from .components import components

WORDS = 5
#: Similarity of a link as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 4, 5
#: A shingle is popular where more documents than this have it; more, where over POPULAR_MOST would be (32 MB).
POPULAR, POPULAR_MOST = 128, 1 << 23
#: Shingles that a task counts at once, and from how many on those that are there once aren't passed on as popular.
COUNTED, ONCE = 1 << 22, 1 << 16
#: Hashes below this, about a third of a set, are counted whole, as the first fifth comes from them; numbers of documents that
#: part them, and bits for each label that more documents have.
EDGE, RARE, LABEL_BITS = int(0.35 * 2**64), (1, 4, 16), 16
#: Children of an R-tree node; blocks of up to two nodes are compared without one.
NODE = 16
#: Parts of the blocks of popular shingles while partners are chosen.
PARTS = 64
#: Documents of either side of a cell of a large block: bounds what a task holds.
CELL = 384
#: Pairs that a task remembers before it starts anew.
SEEN_PAIRS = 500_000
#: Ids of copies that are broadcast at most: 4 MB.
BROADCAST_IDS = 500_000
#: Groups of equal sets, and classes with their component, that are broadcast at most: 6 MB.
BROADCAST_GROUPS = 150_000
#: Copies up to which a group's rows meet at its key; larger groups, at most HOT_GROUPS of them, are broadcast.
HOT, HOT_GROUPS = 256, 100_000
#: Blocks of several components whose sizes are broadcast at most: 4 MB.
BROADCAST_BLOCKS = 100_000
#: Bits, for each id in pairs, of the filter that keeps texts without candidates out of the second shuffle, and most of all: 32 MB.
ID_BITS, FILTER_BITS = 128, 1 << 28


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; rows with fewer words have one, of the whole sequence."""
    h, _, _, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    out = []
    if len(h) >= words:
        rolled = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            rolled += h[k : len(h) - words + 1 + k] * _ODD[k]
        rolled = mix64(rolled)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix64(np.array([(h[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64) ^ np.uint64(0x5DEECE66D)))
        else:
            out.append(h[:0])
    return out


_ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def need(a, b):
    """The least intersection of linked sets of sizes a and b: overlap * 9 >= 4 * (a + b)."""
    return -((-NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def groups_of(n: int) -> int:
    """Groups of a count vector: a power of two of which a set has 2 to 4 shingles a group, from 16 to 16384.

    Of unrelated sets it bounds the overlap by about 7 in 10, where a link needs 8 in 9; more groups would bound little
    better, and vectors, which go to every block that is searched, would be longer.
    """
    return 1 << min(14, max(4, n.bit_length() - 2))


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group; 255 stands for any larger count."""
    size = groups_of(len(s))
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size), 255).astype(np.uint8)


def folded(v: np.ndarray, size: int) -> np.ndarray:
    """A count vector over fewer groups; sums keep every bound valid, and a count that is only known as large bounds nothing."""
    v = np.where(v == 255, 1 << 24, v).astype(np.int64)
    return v.reshape(-1, size).sum(axis=0) if len(v) > size else v


class RTree:
    """A packed R-tree over count vectors of about one size: points sorted by size and main coordinates, NODE to a node."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        spread = np.argsort(-points.var(axis=0))[:3]
        self.order = np.lexsort((*(points[:, k] for k in spread[::-1]), sizes))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = [(self.sizes, self.points)]
        while len(self.levels[-1][0]) > 1:
            low, top = self.levels[-1]
            at = np.arange(0, len(low), NODE)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(top, at, axis=0)))

    def search(self, size: int, point: np.ndarray) -> np.ndarray:
        """Places, in the given order, of points whose overlap bound with this one allows a link."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            low, top = self.levels[level]
            keep = np.minimum(top[nodes], point).sum(axis=1) >= need(size, low[nodes])
            nodes = nodes[keep]
            if level and len(nodes):
                nodes = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
            if not len(nodes):
                break
        return self.order[nodes]


def linked(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets link; both are sorted and neither is empty."""
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
    return both * DENOMINATOR >= (len(s) + len(t) - both) * NUMERATOR


def block_pairs(ids: list[int], comps: list[int], sizes: list[int], raw: list[bytes], sides: list[int], seen: set[tuple[int, int]], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of a block that are in different components and survive the bound; large blocks have a tree for each size band.

    sides: documents of one side, unless it is -1, are compared in another cell. seen: pairs settled in earlier blocks,
    which are not looked at again. sets: given these, only pairs that link, each of which joins its components; so
    there are fewer of them than documents, and raw isn't needed.
    """
    into: dict[int, int] = {}

    def component(i: int) -> int:
        c = comps[i]
        while c in into:
            c = into[c]
        return c

    order = sorted(range(len(ids)), key=lambda i: sizes[i])
    vectors: dict[int, np.ndarray] = {}
    out = []

    def vector(i: int) -> np.ndarray:
        if i not in vectors:
            vectors[i] = np.frombuffer(raw[i], np.uint8) if sets is None else count_vector(sets[i])
        return vectors[i]

    def offer(i: int, j: int, known: bool) -> None:
        one, other = component(i), component(j)
        if one == other or sides[i] == sides[j] >= 0:
            return
        pair = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
        if pair in seen:
            return
        seen.add(pair)
        if sets is not None:
            if not linked(sets[i], sets[j]):
                return
            into[one] = other
        elif not known:
            v, w = vector(i), vector(j)
            size = min(len(v), len(w))
            if np.minimum(folded(v, size), folded(w, size)).sum() < need(sizes[i], sizes[j]):
                return
        out.append(pair)

    if len(order) <= 2 * NODE:
        for k, i in enumerate(order):
            for j in order[k + 1 :]:
                if sizes[i] * DENOMINATOR < sizes[j] * NUMERATOR:
                    break
                offer(i, j, False)
        return out
    size = np.array(sizes)
    band = (np.log(np.maximum(size, 1)) / np.log(1.25)).astype(np.int64)
    for k in np.unique(band):
        mine, near = np.flatnonzero(band == k), np.flatnonzero((band == k) | (band == k - 1))
        if len({comps[i] for i in near}) < 2:
            continue
        width = min(len(vector(i)) for i in near)
        tree = RTree(size[mine], np.stack([folded(vector(i), width) for i in mine]))
        for i in near:
            for j in mine[tree.search(sizes[i], folded(vector(i), width))]:
                if i != j and min(sizes[i], sizes[j]) * DENOMINATOR >= max(sizes[i], sizes[j]) * NUMERATOR:
                    offer(i, int(j), True)
    return out


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _label(s: np.ndarray) -> np.ndarray:
    """32 bits of a shingle hash that popularity is counted by; shingles that share them are popular together."""
    return (s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n) of the shingles, ``COUNTED`` at once, and a row of null label with the number of all.

    Where they are many, a label that is there once is left out, so counts are short by at most one for each time.
    """
    for all_ in _gathered(batches, lambda s: s):
        label, n = np.unique(all_, return_counts=True)
        keep = n > (1 if len(all_) > ONCE else 0)
        yield out_batch(_COUNT, {"label": pa.array([*label[keep].tolist(), None], pa.int32()), "n": np.append(n[keep], len(all_))})


def _gathered(batches: Iterator[pa.RecordBatch], part) -> Iterator[np.ndarray]:
    """Labels of a part of each set, of about ``COUNTED`` at once."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            for s in shingle_sets(data, offsets):
                if len(s):
                    held.append(_label(part(s)))
                    size += len(held[-1])
            if size > COUNTED:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _popular(text: DataFrame) -> np.ndarray:
    """Labels of the popular shingles, sorted: at most ``POPULAR_MOST``, as each stands for so many of all shingles."""
    counts = cut(mapped(text.select("text"), _counted, "label int, n long").groupBy("label").agg(F.sum("n").alias("n")).filter((F.col("n") > POPULAR) | F.col("label").isNull()))
    total = counts.filter("label is null").agg(F.sum("n")).first()[0] or 0
    found = counts.filter((F.col("n") > max(POPULAR, total // POPULAR_MOST)) & F.col("label").isNotNull()).select("label")
    return np.sort(np.asarray(found.toArrow().column("label"), np.int32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labels of hashes below ``EDGE``, by their upper half, with the lower halves of all in two bytes each."""
    for labels in _gathered(batches, lambda s: s[: np.searchsorted(s, np.uint64(EDGE))]):
        labels = np.sort(labels.view(np.uint32))
        upper = (labels >> 16).astype(np.int32)
        at = np.flatnonzero(np.concatenate([[True], upper[1:] != upper[:-1]])) if len(upper) else np.zeros(0, np.int64)
        offsets = np.append(at, len(labels)).astype(np.int32) * 2
        low = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer((labels & 0xFFFF).astype("<u2").tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(upper[at]), low], names=["upper", "low"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n) of the labels that are there more than once, from rows that arrive by upper half."""
    last, held = None, []

    def close() -> pa.RecordBatch:
        low, n = np.unique(np.frombuffer(b"".join(held), "<u2"), return_counts=True)
        label = (low[n > 1].astype(np.uint32) | np.uint32(last << 16)).view(np.int32)
        return out_batch(_COUNT, {"label": label, "n": n[n > 1]})

    for batch in batches:
        out = []
        for upper, low in zip(batch.column("upper").to_pylist(), batch.column("low").to_pylist(), strict=True):
            if upper != last and held:
                out.append(close())
                held = []
            last = upper
            held.append(low)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=None)[0] if sum(len(b) for b in out) else out[0]
    if held:
        yield close()


def _bits(places: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits, of the places that are there."""
    maps = places.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % (1 << 15)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in maps.collect():
        bits[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _frequent(text: DataFrame) -> list[np.ndarray]:
    """For each number in ``RARE``, a bitmap of the counted labels that more documents have, by their lowest bits.

    Labels travel in little more than two bytes each. A bitmap holds some too many, but never too few.
    """
    dealt = mapped(text.select("text"), _packed, "upper int, low binary").repartition("upper").sortWithinPartitions("upper")
    counts = cut(mapped(dealt, _repeated, "label int, n long"))
    out = []
    for least in RARE:
        some = counts.filter(F.col("n") > least)
        size = min(FILTER_BITS, 1 << max(16, (LABEL_BITS * some.count()).bit_length()))
        out.append(_bits(some.select(F.col("label").bitwiseAND(size - 1).cast("long").alias("bit")), size))
    return out


def _tiers(s: np.ndarray, popular: np.ndarray, frequent: list[np.ndarray]) -> np.ndarray:
    """0 for shingles that no other document has, 1 for those of few; 2 where that isn't known; 3 and 4 for more, 5 for popular ones."""
    mine = _label(s)
    tier = np.full(len(s), 2, np.uint8)
    n = np.searchsorted(s, np.uint64(EDGE))
    some, more, many = (_set(bits, mine[:n].view(np.uint32).astype(np.int64) & (len(bits) * 8 - 1)) for bits in frequent)
    tier[:n] = np.where(some & more, np.where(many, 4, 3), some)
    if len(popular):
        tier[popular[np.minimum(np.searchsorted(popular, mine), len(popular) - 1)] == mine] = 5
    return tier


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, and two words of the set's hash."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            sets = shingle_sets(data, offsets)
            s1 = _signed(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64))
            s2 = _signed(np.array([mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) for s in sets], np.uint64))
            yield out_batch(_DOC, {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n": [len(s) for s in sets], "s1": s1, "s2": s2})


def _listed(popular: np.ndarray, frequent: list[np.ndarray]):
    """id, n, those of the first shingles that another document may have, and how many of them aren't popular."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                first, plain = [], []
                for s in sets:
                    tier = _tiers(s, popular, frequent)
                    order = np.argsort(tier, kind="stable")[: prefix_length(len(s)) if len(s) else 0]
                    order = order[tier[order] > 0]
                    first.append(_signed(s[order]))
                    plain.append(int((tier[order] < 5).sum()))
                yield out_batch(_FIRST, {"id": batch.column("doc_id").slice(lo, hi - lo), "n": [len(s) for s in sets], "first": _list(first, pa.int64()), "plain": plain})

    return run


_COUNT = pa.schema([("label", pa.int32()), ("n", pa.int64())])
_DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
_FIRST = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("first", pa.list_(pa.int64())), ("plain", pa.int32())])
_SET = pa.schema([("id", pa.int64()), ("hashes", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _where(bits: np.ndarray):
    """The rows whose place is in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_set(bits, batch.column("bit").to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                yield batch.select(["doc_id", "text"])

    return run


def _sets_where(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _where(bits)(batches):
            for lo, hi, data, offsets in chunks(batch.column("text")):
                yield out_batch(_SET, {"id": batch.column("doc_id").slice(lo, hi - lo), "hashes": [s.tobytes() for s in shingle_sets(data, offsets)]})

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells arrive one after another; only the open cell, and a bounded set of settled pairs, is held."""
    last, held = None, []
    seen: set[tuple[int, int]] = set()

    def close() -> pa.RecordBatch:
        if len(seen) > SEEN_PAIRS:
            seen.clear()
        ids, comps, hashes, sides = (list(x) for x in zip(*held, strict=True))
        sets = [np.frombuffer(x, np.uint64) for x in hashes]
        found = block_pairs(ids, comps, [len(s) for s in sets], [], sides, seen, sets)
        return out_batch(_PAIR, {"a": [p[0] for p in found], "b": [p[1] for p in found]})

    for batch in batches:
        for *cell, a, b, c, d in zip(*(batch.column(c).to_pylist() for c in (*_CELL, "id", "component", "hashes", "side")), strict=True):
            if cell != last and held:
                yield close()
                held = []
            last = cell
            held.append((a, b, c, d))
    if held:
        yield close()


_CELL = ("least", "kind", "i", "j")


def _cells(open_blocks: DataFrame) -> DataFrame:
    """The rows of each block, once for every cell that they are compared in.

    The largest component's documents meet the others only: piece i of it meets piece j of the others in cell (0, i, j),
    and cells (0, 0, j) also compare the others' piece j within itself. Pieces i < j of the others meet in (1, i, j).
    """
    whole = lambda n: F.greatest(F.lit(1), F.ceil(n / CELL)).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    rows = open_blocks.withColumns({"mains": whole(F.col("most")), "others": whole(F.col("rest")), "main": F.col("component") == F.col("largest")})
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(11)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    mine = F.transform(up_to(F.col("others")), lambda j: cell(0, F.col("piece"), j, F.lit(0)))
    theirs = F.concat(
        F.transform(up_to(F.col("mains")), lambda i: cell(0, i, F.col("piece"), F.when(i == 0, -1).otherwise(1))),
        F.transform(F.filter(up_to(F.col("others")), lambda j: j != F.col("piece")), lambda j: cell(1, F.least(j, "piece"), F.greatest(j, "piece"), F.col("piece") > j)),
    )
    carried = [c for c in open_blocks.columns if c not in ("least", "id", "component", "largest", "most", "rest")]
    return rows.withColumn("cell", F.explode(F.when(F.col("main"), mine).otherwise(theirs))).select("least", "cell.*", "id", "component", *carried)


def _place(size: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(size))


def _ids(ids: DataFrame) -> np.ndarray:
    """A bounded bitmap of doc_ids by ``_place``; it passes some too many, more so where they are many millions, but never too few."""
    size = min(FILTER_BITS, 1 << max(16, (ID_BITS * ids.count()).bit_length()))
    return _bits(ids.select(_place(size).alias("bit")), size)


def _sets(active: DataFrame, text: DataFrame) -> DataFrame:
    """(id, hashes): the whole set of each of the distinct ids in ``active``.

    Sets are made again from the texts, rather than kept for all documents; a filter keeps most other texts out of the
    shuffle. Of several texts of one id the one of least set that isn't empty counts, so that reruns agree.
    """
    bits = _ids(active.withColumnRenamed("id", "doc_id"))
    sets = mapped(text.filter("doc_id is not null").select("doc_id", "text", _place(len(bits) * 8).alias("bit")), _sets_where(bits), "id long, hashes binary")
    return cut(sets.filter(F.length("hashes") > 0).join(active, "id", "left_semi").groupBy("id").agg(F.min("hashes").alias("hashes")))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets link."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    return mapped(one.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y"), _linked, "a long, b long")


def _members(doc: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep, hot of every document; the reps of hot groups): the least id of those with the same set.

    Sets that only one document has, and documents without words or id, need no join. A group's rows meet at its key
    unless it is hot, so no task gets a large group, nor all the documents without words.
    """
    of_set = ["n", "s1", "s2"]
    most = max(HOT, rows // HOT_GROUPS)
    groups = cut(doc.filter("n > 0 and doc_id is not null").groupBy(*of_set).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    hot = groups.filter(F.col("size") > most)
    usable = F.coalesce((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    own = F.col("doc_id").alias("rep")
    plain = doc.filter(~usable).select("doc_id", "n", own, F.lit(False).alias("hot"))
    found = doc.filter(usable).select("doc_id", *of_set)
    if groups.count() <= BROADCAST_GROUPS:
        joined = found.join(F.broadcast(groups), of_set, "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce(F.col("size") > most, F.lit(False)).alias("hot"))
    else:
        marked = found.join(F.broadcast(hot.select(*of_set, F.col("rep").alias("hot_rep"))), of_set, "left")
        rest = marked.filter("hot_rep is null").drop("hot_rep").join(groups.filter(F.col("size") <= most).drop("size"), of_set, "left")
        joined = marked.filter("hot_rep is not null").select("doc_id", "n", F.col("hot_rep").alias("rep"), F.lit(True).alias("hot")).unionByName(rest.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.lit(False).alias("hot")))
    return cut(joined.unionByName(plain)), hot.select("rep")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, hot): doc_id, n, rep and hot of every document, the links between representatives (a < b), and the
    representatives of hot groups, at most ``HOT_GROUPS``.

    Links join everything that is linked; between documents already joined, not every link is listed.
    """
    spark = docs.sparkSession
    ready(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.count()
    doc = cut(mapped(text, _digests, "doc_id long, n long, s1 long, s2 long"))
    members, hot = _members(doc, rows)
    # Copies are taken out by their ids, which are broadcast while they are few; else by a bitmap of the ids that stay, so that
    # texts aren't shuffled for it, and those that pass it wrongly by a join of what is listed.
    copies = members.filter("rep <> doc_id").select("doc_id").distinct()
    own, few = text.filter("doc_id is not null"), copies.count() <= BROADCAST_IDS
    if few:
        own = own.join(F.broadcast(copies), "doc_id", "left_anti").select("doc_id", "text")
    else:
        stay = _ids(members.filter("rep = doc_id").select("doc_id").distinct())
        own = mapped(own.select("doc_id", "text", _place(len(stay) * 8).alias("bit")), _where(stay), "doc_id long, text string")
    late = _popular(own)
    nodes = mapped(own, _listed(late, _frequent(own)), "id long, n long, first array<long>, plain int").filter(F.size("first") > 0)
    nodes = nodes if few else nodes.join(copies.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    block = W.partitionBy("h", "part").orderBy("id")
    listed = (
        nodes.select("id", "n", "plain", F.posexplode("first").alias("at", "h"))
        .select("id", "n", "h", F.when(F.col("at") >= F.col("plain"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(PARTS))).otherwise(-1).cast("int").alias("part"))
        .withColumns({"before": F.lag("id").over(block), "before_n": F.lag("n").over(block), "after": F.lead("id").over(block), "least": F.first("id").over(block), "least_n": F.first("n").over(block)})
        .filter("before is not null or after is not null or part >= 0")
    )
    # Only popular shingles are told apart from here on.
    listed = cut(listed.select(F.when(F.col("part") >= 0, F.col("h")).alias("h"), "id", "n", "before", "before_n", "least", "least_n"))
    if len(late):
        # The least id of all parts; blocks of one document are left out.
        split = listed.filter("h is not null")
        top = cut(split.groupBy("h").agg(F.min(F.struct("least", "least_n")).alias("top"), F.max("id").alias("last")).filter("top.least < last").select("h", "top.*"))
        top = F.broadcast(top) if top.count() <= BROADCAST_IDS else top
        listed = listed.filter("h is null").unionByName(split.drop("least", "least_n").join(top, "h"))
    close = lambda m: F.least(m, "n") * DENOMINATOR >= F.greatest(m, "n") * NUMERATOR
    # A partner for each document: one of least id is preferred, so that groups of copies become stars.
    star = listed.filter("least < id").filter(close("least_n")).select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(2).alias("w"))
    chain = listed.filter("before > least and before <> id").filter(close("before_n")).select(F.col("before").alias("a"), F.col("id").alias("b"), F.lit(1).alias("w"))
    partner = star.unionByName(chain).groupBy("a", "b").agg(F.sum("w").alias("w")).groupBy("b").agg(F.max(F.struct("w", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    sets = _sets(cut(listed.select("id").distinct()), text)
    first = cut(_verified(partner, sets))
    joined = components(first).select(F.col("node").alias("id"), "component")
    # Blocks of one least id are searched together, so that a set is sent once for all of them.
    placed = cut(listed.select("least", "id").distinct().join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    several = cut(
        placed.groupBy("least", "component")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy("least")
        .agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("least", F.col("top.component").alias("largest"), F.col("top.size").alias("most"), (F.col("all") - F.col("top.size")).alias("rest"))
    )
    several = F.broadcast(several) if several.count() <= BROADCAST_BLOCKS else several
    open_blocks = placed.join(several, "least").join(sets, "id")
    found = mapped(_cells(open_blocks).repartition(*_CELL).sortWithinPartitions(*_CELL, "id"), _searched, "a long, b long").distinct()
    return members, first.unionByName(cut(found)), hot


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links, the links listed for the document's class, for every row of docs."""
    members, pairs, hot = links(docs)
    pairs = cut(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    info = cut(components(pairs).select(F.col("node").alias("rep"), "component").join(degree, "rep", "left"))
    if info.count() <= BROADCAST_GROUPS:
        out = members.join(F.broadcast(info), "rep", "left")
    else:
        out = members.filter("not hot").join(info, "rep", "left").unionByName(members.filter("hot").join(F.broadcast(info.join(F.broadcast(hot), "rep", "left_semi")), "rep", "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
