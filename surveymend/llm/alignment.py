"""Alignment of two tokenizers of the same texts by byte-owner arrays, and counts of the token pairs that end together.

A is a byte-level BPE vocabulary over a space and the text, B a SentencePiece vocabulary over the text, which puts that
space before it. ``np.repeat`` gives every byte of a run of texts its token of A and of B. Where either owner changes, a
new pair of overlapping tokens begins; where both change at once is a cut, and the two tokens that end there are linked.
No token is without bytes, so every group between cuts has one link, that of its last tokens.

Null and empty texts, and texts whose tokens' bytes aren't a space and the text (those with U+2581, which B reads as a
space), have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Very long texts are aligned
whole, on their own. Repeated rows, and rows of one id or none, count as often as they occur and give a row each. Among
pairs of one B id, all of the highest count are best. An empty table gives no rows; other columns are ignored.

A text's links are kept as distinct pairs with their numbers, so texts are encoded once. Pairs are counted in each task
before they are shuffled. Counts return to the texts by broadcast for the most frequent pairs, ``HELD`` at most; rarer
ones, if there are more, by a join, in which no pair has more rows than its count, which is below those held.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, out_batch, ready

#: Pairs that a task counts before it passes counts on, and pairs whose counts are broadcast at most: 24 MB.
COUNTED, HELD = 1 << 20, 1 << 20
#: A run of letters or of spaces from this length on is encoded by a library whose time doesn't grow with its square.
LONG_RUN = 1000
#: Characters of texts that are aligned at once; a longer text is on its own.
GROUP_CHARS = 1 << 19


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def stable() -> frozenset[str]:
    """Characters of the basic plane whose class every Unicode version since 3.2 agrees on, so that all libraries part texts
    alike; of spaces and controls, only the plain ones."""
    then, now = unicodedata.ucd_3_2_0, unicodedata
    return frozenset("\t\n\r ") | {c for c in map(chr, range(33, 0x10000)) if then.category(c)[0] == now.category(c)[0] and now.category(c)[0] in "LNPSM"}


class ByteTokens:
    """Ids of texts in a byte-level vocabulary.

    Where the vocabulary is also there as ranks, texts of stable characters without long runs are encoded by the faster
    library, which gives them the same ids; others, and all where ``ranks`` is None, by the slower one.
    """

    run = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        of = byte_alphabet()
        size = self.library.get_vocab_size()
        self.bytes = [bytes(of[c] for c in t) if (t := self.library.id_to_token(i)) and all(c in of for c in t) else (t or "").encode() for i in range(size)]
        self.fast, self.plain = None, frozenset()
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                of_bytes = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of_bytes, special_tokens={})
            self.plain = stable()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; none of an empty one."""
        slow = [k for k, t in enumerate(texts) if self.fast is None or not self.plain.issuperset(t) or len(t) >= LONG_RUN and self.run.search(t)]
        rest = dict(zip(slow, self.library.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False), strict=True))
        return [np.array(rest[k].ids, np.int64) if k in rest else self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int64) for k, t in enumerate(texts)]


class Vocabulary:
    """The bytes of every id, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens, whose owners are given."""
        start = np.concatenate([[0], np.cumsum(self.width[ids])])[:-1]
        return self.flat[(self.first[ids] - start)[owner] + np.arange(len(owner))]


def owners(widths: np.ndarray) -> np.ndarray:
    """For every byte, the place of the token that it belongs to."""
    return np.repeat(np.arange(len(widths), dtype=np.int32), widths)


def changes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last bytes of overlaps (either owner changes behind them, or the bytes end) and of groups (both change)."""
    x, y = np.ones(len(a), bool), np.ones(len(b), bool)
    x[:-1] = a[1:] != a[:-1]
    y[:-1] = b[1:] != b[:-1]
    return np.flatnonzero(x | y), np.flatnonzero(x & y)


class Aligned:
    """Tokens of a run of texts, one text after the other: ids, owners of bytes, and the last byte of every group."""

    def __init__(self, texts: list[str], a: list[np.ndarray], b: list[np.ndarray], of_a: Vocabulary, of_b: Vocabulary):
        want = [(" " + t).encode() if t else b"" for t in texts]
        good = [of_a.width[x].sum() == of_b.width[y].sum() == len(w) for x, y, w in zip(a, b, want, strict=True)]
        while True:
            keep = lambda x: [v if g else v[:0] for v, g in zip(x, good, strict=True)]
            a, b, want = keep(a), keep(b), keep(want)
            self.a, self.b = np.concatenate(a), np.concatenate(b)
            own_a, own_b = owners(of_a.width[self.a]), owners(of_b.width[self.b])
            byte = np.frombuffer(b"".join(want), np.uint8)
            wrong = np.flatnonzero((of_a.spelled(self.a, own_a) != byte) | (of_b.spelled(self.b, own_b) != byte))
            if not len(wrong):
                break
            # Texts that either spells otherwise have no tokens.
            for k in np.unique(np.searchsorted(np.cumsum([len(w) for w in want]), wrong, "right")):
                good[k] = False
        self.overlap, self.cut = changes(own_a, own_b)
        #: The tokens that end with each group, which are linked.
        self.last_a, self.last_b = own_a[self.cut].astype(np.int64), own_b[self.cut].astype(np.int64)
        self.n_a, self.n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        #: Where each text's groups and overlaps begin; a text's end is a cut, since its bytes are the same on both sides.
        self.group = np.searchsorted(self.last_a, self.first_a)
        self.overlaps = np.diff(np.searchsorted(self.overlap, np.concatenate([[0], np.cumsum([len(w) for w in want])])))

    def pieces(self, names: list[str], size_a: int, size_b: int) -> list[str]:
        """Decimal ids with the mark behind each, in the order of the groups: A's ids, a bar, B's ids, a semicolon."""
        na, nb = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        group = np.arange(len(na))
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.last_a] = ends_b[self.last_b] = 1
        code = np.empty(len(self.a) + len(self.b), np.int64)
        before = np.concatenate([[0], np.cumsum(nb)])[:-1]
        code[np.arange(len(self.a)) + before[np.repeat(group, na)]] = self.a + ends_a * size_a
        code[np.arange(len(self.b)) + np.cumsum(na)[np.repeat(group, nb)]] = 2 * size_a + self.b + ends_b * size_b
        return list(map(names.__getitem__, code.tolist()))


def _names(size_a: int, size_b: int) -> list[str]:
    return [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for mark in marks for i in range(size)]


_OUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_overlaps", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary())])
_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs binary"
_open: dict[tuple, tuple] = {}
SPACE = "▁"


def _tokenizers(a: str, ranks: str | None, b: str) -> tuple:
    if (a, ranks, b) not in _open:
        from sentencepiece import SentencePieceProcessor

        first, lib = ByteTokens(a, ranks), SentencePieceProcessor(model_file=b)
        of_b = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i in range(len(lib)) for p in [lib.id_to_piece(i)]]
        _open[a, ranks, b] = first, lib, Vocabulary(first.bytes), Vocabulary(of_b), _names(len(first.bytes), len(of_b))
    return _open[a, ranks, b]


def _pack(pairs: np.ndarray) -> bytes:
    """Distinct pairs in ascending order, with their numbers, compressed behind their length."""
    key, n = np.unique(pairs, return_counts=True)
    data = np.diff(key, prepend=np.uint64(0)).astype("<u8").tobytes() + n.astype("<u4").tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = size // 12
    return np.cumsum(np.frombuffer(raw, "<u8", n), dtype=np.uint64), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def _align(doc_ids: list, texts: list[str], first_row: int, files: tuple) -> pa.RecordBatch:
    one, two, of_a, of_b, names = _tokenizers(*files)
    b = [np.array(i, np.int64) for i in two.encode(texts, num_threads=1)]
    x = Aligned(texts, one.ids([" " + t if t else "" for t in texts]), b, of_a, of_b)
    said = x.pieces(names, of_a.size, of_b.size)
    links = x.a[x.last_a].astype(np.uint64) << np.uint64(32) | x.b[x.last_b].astype(np.uint64)
    n = np.diff(x.group)
    digests, pairs = [], []
    for k in range(len(texts)):
        if not n[k]:
            digests.append("")
            pairs.append(b"")
            continue
        text = "".join(said[x.first_a[k] + x.first_b[k] : x.first_a[k + 1] + x.first_b[k + 1]])[:-1]
        digests.append(hashlib.sha256(text.encode()).hexdigest())
        pairs.append(_pack(links[x.group[k] : x.group[k + 1]]))
    return out_batch(_OUT, {"row": np.arange(first_row, first_row + len(texts)), "doc_id": pa.array(doc_ids, pa.int64()), "n_a": x.n_a, "n_b": x.n_b, "n_groups": n, "n_links": n, "n_overlaps": x.overlaps, "groups_sha256": digests, "pairs": pairs})


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """A row for every text of (doc_id, text): numbers of tokens, groups, links and overlaps, a digest of the groups, and the
    distinct linked pairs with their numbers, packed. ``a``, ``b``: vocabulary files that workers can open."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files = a or model_path("byte_bpe_50k.json"), None if a else model_path("byte_bpe_50k.tiktoken"), b or model_path("piece_bpe_32k.model")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, held, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = t.as_py() or ""
                if held and size + len(t) > GROUP_CHARS:
                    yield _align(ids, held, row, files)
                    row += len(held)
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(t)
                size += len(t)
            if held:
                yield _align(ids, held, row, files)
                row += len(held)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _DDL)


_COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair, A's id in the upper half of ``pair`` and B's in the lower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for data in batch.column("pairs"):
                k, n = _unpack(data.as_py())
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > COUNTED:
                    k, n = _merge(keys, counts)
                    if len(k) > COUNTED // 2:
                        yield out_batch(_COUNTS, {"pair": k.astype(np.int64), "n": n})
                        keys, counts, held = [], [], 0
                    else:
                        keys, counts, held = [k], [n], len(k)
        if held:
            k, n = _merge(keys, counts)
            yield out_batch(_COUNTS, {"pair": k.astype(np.int64), "n": n})

    return mapped(aligned.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


#: The half of a pair that is B's id.
_LOW = 0xFFFFFFFF
_SCORED = pa.schema([f for f in _OUT if f.name != "pairs"] + [pa.field("n_best", pa.int64()), pa.field("count_sum", pa.int64())])
_SCORED_DDL = _DDL.replace("pairs binary", "n_best long, count_sum long")
_REST = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("m", pa.int64())])


def _held(pairs: DataFrame, most: int) -> tuple[int, DataFrame]:
    """The least count of pairs that are broadcast, a power of two, and those pairs: ``most`` at most."""
    levels = {r[0]: r[1] for r in pairs.groupBy(F.floor(F.log2("n") + 1e-9).alias("level")).count().collect()}
    level, some = max(levels, default=0) + 1, 0
    while level > 0 and some + levels.get(level - 1, 0) <= most:
        level -= 1
        some += levels.get(level, 0)
    return 1 << level, pairs.filter(F.col("n") >= 1 << level)


def link_counts(aligned: DataFrame, pairs: DataFrame, held: int = HELD) -> DataFrame:
    """Aligned rows with n_best and count_sum instead of the pairs; both tables have been cut from their lineage."""
    sc = aligned.sparkSession.sparkContext
    # One number for every id of B's vocabulary.
    best = pairs.groupBy(F.col("pair").bitwiseAND(_LOW).alias("b")).agg(F.max("n").alias("most"))
    top = best.toArrow()
    most = np.zeros(max([0, *top.column("b").to_pylist()]) + 1, np.int64)
    most[top.column("b").to_numpy()] = top.column("most").to_numpy()
    least, few = _held(pairs, held)
    table = few.toArrow().sort_by("pair")
    known = sc.broadcast((table.column("pair").to_numpy(), table.column("n").to_numpy(), most))

    def links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the batch, pairs, numbers and corpus counts (0: not held) of a batch."""
        pair, n, _ = known.value
        got = [_unpack(x.as_py()) for x in batch.column("pairs")]
        key, m = np.concatenate([k for k, _ in got]).astype(np.int64), np.concatenate([c for _, c in got])
        at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
        count = np.where(pair[at] == key, n[at], 0) if len(pair) else np.zeros(len(key), np.int64)
        return np.repeat(np.arange(len(got)), [len(k) for k, _ in got]), key, m, count

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, key, m, count = links(batch)
                best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(best, at, np.where((count > 0) & (count == known.value[2][key & _LOW]), m, 0))
                np.add.at(total, at, m * count)
                yield out_batch(_SCORED, {f.name: batch.column(f.name) for f in _OUT if f.name != "pairs"} | {"n_best": best, "count_sum": total})

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, key, m, count = links(batch)
                some = count == 0
                yield out_batch(_REST, {"row": batch.column("row").to_numpy()[at[some]], "pair": key[some], "m": m[some]})

    out = mapped(aligned, scored, _SCORED_DDL)
    if least == 1:
        return out
    rare = mapped(aligned.select("row", "pairs"), others, "row long, pair long, m long").join(pairs.filter(F.col("n") < least), "pair")
    rare = rare.join(best.withColumnRenamed("b", "of"), F.col("pair").bitwiseAND(_LOW) == F.col("of"))
    part = rare.groupBy(F.col("row").alias("of_row")).agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
    more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    joined = out.join(part, F.col("row") == F.col("of_row"), "left")
    return joined.select(*[c for c in out.columns if c not in ("n_best", "count_sum")], more("n_best", F.col("more_best")), more("count_sum", F.col("more_sum")))


def counted(docs: DataFrame, a: str | None = None, b: str | None = None, held: int = HELD) -> DataFrame:
    """Every text's row of ``align``, without the pairs, with the links whose pair is its B id's most frequent in the corpus
    (n_best), and the sum of its links' corpus counts (count_sum)."""
    aligned = cut(align(docs, a, b))
    out = link_counts(aligned, cut(pair_counts(aligned)), held)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
