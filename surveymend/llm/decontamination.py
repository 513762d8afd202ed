"""Benchmark passages in training texts, found in a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings of some documents, for every word its positions in
ascending order, and is a row of a stored table, so nothing is shuffled however frequent a word is. A query is a window of
consecutive words of an item. In a shard, the lists of its words are intersected from the rarest: the rarest word's
positions less its place in the window are candidate beginnings, and every other word must have a posting at its own place
from there. In a proximity match every word is up to ``SLACK`` places off its own. Documents are kept ``PAD`` positions
apart, so no match spans two.

Words are runs of letters and digits, A to Z in lower case, and of any characters beyond ASCII. Null and empty texts have
none. An item of fewer words than a window is one window, an item without words none. Words are told apart by 64-bit
hashes. Repeated rows, and rows of one id or none, are documents of their own; items of one id are one item; items without
an id are searched, and hit words, but aren't counted. Very long texts are a shard of their own. An empty table gives no
rows, an empty benchmark no hits; other columns are ignored.

Windows go to the shards in blocks of ``BLOCK`` (window, item) pairs, by broadcast; more pairs are more blocks, whose hits
are united for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mapped, mix64, out_batch, ready, word_hashes

#: Words of a window, and places that a word may be off in a proximity match.
WINDOW, SLACK = 10, 2
#: Words of a shard (a document of more is a shard of its own), and positions between documents.
SHARD_WORDS, PAD = 1 << 18, 64
#: (window, item) pairs of a block: 40 MB of terms and items; candidates that are checked at once.
BLOCK, CANDIDATES = 250_000, 1 << 20
#: Shards of an Arrow batch, which are about 2 MB each.
SHARDS_AT_ONCE = 16
#: Bytes that aren't in words (fixed values): ASCII but digits and letters.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_INDEX = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.binary()), ("terms", pa.binary()), ("starts", pa.binary()), ("positions", pa.binary())])
_INDEX_DDL = "shard long, ids array<long>, words binary, terms binary, starts binary, positions binary"


def places(words: np.ndarray) -> np.ndarray:
    """The position of every document's first word, and the end."""
    return np.concatenate([[0], np.cumsum(words + PAD)])


def _shard(number: int, ids: list, words: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    n, h = np.concatenate(words), np.concatenate(hashes)
    position = np.arange(len(h)) + np.repeat(np.arange(len(n)) * PAD, n)
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(h) else np.zeros(0, np.int64)
    return out_batch(
        _INDEX,
        {"shard": [number], "ids": pa.array([ids], pa.list_(pa.int64())), "words": [n.astype("<i8").tobytes()], "terms": [sorted_[first].astype("<u8").tobytes()], "starts": [np.append(first, len(h)).astype("<i8").tobytes()], "positions": [position[order].astype("<u4" if len(h) + PAD * len(n) < 1 << 32 else "<u8").tobytes()]},
    )


def build(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of all texts of (doc_id, text), a row for each shard; store it before searching it."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, words, hashes, held = [], [], [], 0
        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                h, _, _, row = word_hashes(data, offsets, GAP)
                if held and (held + len(h) > shard_words or len(ids) + hi - lo > shard_words):
                    yield _shard(number, ids, words, hashes)
                    number, ids, words, hashes, held = number + 1, [], [], [], 0
                ids += own[lo:hi]
                words.append(np.bincount(row, minlength=hi - lo))
                hashes.append(h)
                held += len(h)
        if ids:
            yield _shard(number, ids, words, hashes)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _INDEX_DDL)


class Shard:
    """The postings of one row of the index. ``keys`` holds (number of the list, position) in one number, in ascending order."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.number, self.ids = row["shard"], row["ids"]
        self.words, self.terms, self.starts = read("words", "<i8"), read("terms", "<u8"), read("starts", "<i8")
        width = len(row["positions"]) // max(int(self.starts[-1]), 1)
        self.positions = read("positions", "<u8" if width == 8 else "<u4").astype(np.int64)
        self.first = places(self.words)
        #: Bits of a position; lists are fewer than 2**27 wherever positions need more than 36.
        self.bits = max(int(self.first[-1] + 2 * PAD).bit_length(), 1)
        self.keys = np.repeat(np.arange(len(self.terms)) << self.bits, np.diff(self.starts)) | self.positions

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the list, its length) of every term; length 0 where it doesn't occur."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.starts[at + 1] - self.starts[at], 0)

    def has(self, number: np.ndarray, position: np.ndarray, slack: int) -> np.ndarray:
        """Whether a list has a posting within ``slack`` of a position."""
        want = (number << self.bits) + position
        at = np.searchsorted(self.keys, want - slack)
        found = at < len(self.keys)
        found[found] &= self.keys[at[found]] <= want[found] + slack
        return found & (position + slack >= 0)


class Block:
    """Distinct windows: the places of their words in the vocabulary, their numbers of words, and the items that have them."""

    def __init__(self, windows: list[int], terms: list[bytes], items: list[str | None]):
        first = {w: k for k, w in enumerate(dict.fromkeys(windows))}
        own = np.array([first[w] for w in windows], np.int64)
        rows = dict(zip(own.tolist(), terms, strict=True))
        each = [np.frombuffer(rows[k], "<u8") for k in range(len(first))]
        self.size = np.array([len(t) for t in each], np.int64)
        flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.vocabulary, at = np.unique(flat, return_inverse=True)
        self.width = int(self.size.max(initial=1))
        self.terms = np.full((len(each), self.width), -1, np.int32)
        self.terms[np.arange(self.width) < self.size[:, None]] = at
        order = np.argsort(own, kind="stable")
        self.items = [items[k] for k in order.tolist()]
        self.first_item = np.searchsorted(own[order], np.arange(len(each) + 1))

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {i for w in windows.tolist() for i in self.items[self.first_item[w] : self.first_item[w + 1]] if i is not None}


def find(shard: Shard, block: Block, slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, beginnings, whether every word is in its place) of all matches with words up to ``slack`` places off."""
    number, length = shard.lists(block.vocabulary)
    never = np.iinfo(np.int64).max
    # Terms beyond a window's end are the last column of both.
    number, length = np.append(number, 0), np.append(length, never)
    alive = np.flatnonzero((length[block.terms] > 0).all(axis=1))
    if not len(alive):
        return
    terms = block.terms[alive]
    each = length[terms]
    order = np.argsort(each, axis=1, kind="stable")
    shift = np.arange(-slack, slack + 1)
    many = each[np.arange(len(alive)), order[:, 0]] * len(shift)
    # A run of windows of about so many candidates; the candidates of one window are of one shard.
    part = np.cumsum(many) // CANDIDATES
    for k in np.unique(part):
        mine = np.flatnonzero(part == k)
        which = np.repeat(mine, many[mine])
        lists = number[terms[mine, order[mine, 0]]]
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many[mine]) - many[mine], many[mine])
        begin = shard.positions[np.repeat(shard.starts[lists], many[mine]) + nth // len(shift)] - order[which, 0] + shift[nth % len(shift)]
        for j in range(1, block.width):
            place = order[which, j]
            term = terms[which, place]
            keep = term < 0
            some = np.flatnonzero(~keep)
            keep[some] = shard.has(number[term[some]], begin[some] + place[some], slack)
            which, begin = which[keep], begin[keep]
            if not len(which):
                break
        exact = np.ones(len(which), bool)
        if slack:
            for j in range(block.width):
                term = terms[which, j]
                some = np.flatnonzero(exact & (term >= 0))
                exact[some] = shard.has(number[term[some]], begin[some] + j, 0)
        if len(which):
            yield alive[which], begin, exact


_HITS = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("ranges", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
_HITS_DDL = "shard long, row int, doc_id long, n_words long, ranges binary, items array<string>, near array<string>"


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of ranges as (m, 2) beginnings and ends in ascending order."""
    if not len(begin):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return np.stack([begin[new], end[np.append(new[1:], len(begin)) - 1]], axis=1)


def hits(shard: Shard, block: Block, slack: int, every: bool) -> pa.RecordBatch:
    """A row for each document of a shard that has a match, or for every document: the ranges of its words in exact matches,
    the items of those, and those of proximity matches."""
    found = list(find(shard, block, slack))
    window, begin, exact = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    # A match may begin before its first word, but no more than the slack.
    doc = np.searchsorted(shard.first, begin + slack, "right") - 1
    order = np.argsort(doc, kind="stable")
    window, begin, exact, doc = window[order], begin[order], exact[order], doc[order]
    begin = begin - shard.first[doc]
    rows = np.arange(len(shard.ids)) if every else np.unique(doc)
    low, high = np.searchsorted(doc, rows), np.searchsorted(doc, rows, "right")
    out: dict[str, list] = {"ranges": [], "items": [], "near": []}
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        if a == b:
            out["ranges"].append(b"")
            out["items"].append([])
            out["near"].append([])
            continue
        sure = exact[a:b]
        w, s = window[a:b][sure], begin[a:b][sure]
        out["ranges"].append(ranges(s, s + block.size[w]).astype("<i8").tobytes())
        out["items"].append(sorted(block.items_of(np.unique(w))))
        out["near"].append(sorted(block.items_of(np.unique(window[a:b]))))
    return out_batch(_HITS, {"shard": np.full(len(rows), shard.number), "row": rows, "doc_id": pa.array([shard.ids[k] for k in rows.tolist()], pa.int64()), "n_words": shard.words[rows], **{k: pa.array(v, _HITS.field(k).type) for k, v in out.items()}})


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct (window, item, terms) of (item_id, text): a window is told by a hash of its words."""
    ready(items.sparkSession)
    schema = pa.schema([("window", pa.int64()), ("item", pa.string()), ("terms", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("item").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                h, _, _, row = word_hashes(data, offsets, GAP)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    t = h[first[k] : first[k + 1]].astype("<u8")
                    if not len(t):
                        continue
                    cuts = np.lib.stride_tricks.sliding_window_view(t, min(size, len(t)))
                    key = np.full(len(cuts), len(cuts[0]), np.uint64)
                    for j in range(cuts.shape[1]):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ cuts[:, j])
                    yield out_batch(schema, {"window": key.view(np.int64), "item": pa.array([own[lo + k]] * len(cuts), pa.string()), "terms": [c.tobytes() for c in cuts]})

    found = mapped(items.select(F.col("item_id").cast("string").alias("item"), "text"), run, "window long, item string, terms binary")
    return found.dropDuplicates(["window", "item"])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near_items", pa.int64())])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of hits in the order of (shard, row); those of several blocks are united."""
    at, doc, words, parts, items, near = None, None, 0, [], set(), set()
    out: dict[str, list] = {f.name: [] for f in _OUT}

    def close() -> None:
        r = np.concatenate(parts)
        r = ranges(r[:, 0], r[:, 1])
        hit = int((r[:, 1] - r[:, 0]).sum())
        for name, v in zip(out, (doc, words, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0, len(near)), strict=True):
            out[name].append(v)

    for batch in batches:
        for shard, row, d, n, r, own, close_by in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, row) != at:
                if at is not None:
                    close()
                at, doc, words, parts, items, near = (shard, row), d, n, [], set(), set()
            parts.append(np.frombuffer(r, "<i8").reshape(-1, 2))
            items.update(own)
            near.update(close_by)
        if out["doc_id"]:
            yield out_batch(_OUT, out)
            out = {f.name: [] for f in _OUT}
    if at is not None:
        close()
        yield out_batch(_OUT, out)


def search(index: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK, block: int = BLOCK) -> DataFrame:
    """Every document of an index: doc_id, n_words, n_hit (words within exact occurrences of windows of ``items``), n_items and
    a digest of the items that have such windows, contaminated, and n_near_items, those that also count proximity matches."""
    if not 0 <= slack < PAD // 2:
        raise ValueError(f"slack must be below {PAD // 2}")
    spark = index.sparkSession
    ready(spark)
    asked = cut(windows(items, size))
    blocks = max(1, -(-asked.count() // block))
    number = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    parts = []
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SHARDS_AT_ONCE))
    try:
        for b in range(blocks):
            t = asked.filter(number == b).select("window", "item", "terms").toArrow().to_pydict()
            held = spark.sparkContext.broadcast(Block(t["window"], t["terms"], t["item"]))
            # The number of rows in a batch is read when a plan runs, so it runs here.
            parts.append(cut(mapped(index, _searched(held, slack, b == 0), _HITS_DDL)))
            held.unpersist()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if blocks > 1:
        found = found.repartition("shard", "row").sortWithinPartitions("shard", "row")
    return mapped(found, _finished, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")


def _searched(held, slack: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield hits(Shard(batch.slice(k, 1).to_pylist()[0]), held.value, slack, every)

    return run


def scan(docs: DataFrame, items: DataFrame, slack: int = SLACK) -> DataFrame:
    """``search`` over the stored index of all documents."""
    return search(cut(build(docs)), items, slack=slack)
