"""Homomorphic multiset hashes of documents: wide vectors hashed from paragraphs are summed modulo powers of two.

Paragraphs are the lines of a text, empty ones too, byte for byte. A paragraph's vector has ``WIDE`` words of 32 bits from
a 512-bit digest of its bytes, and ``LANES`` signed counters of 32 bits in which each of its word trigrams, whatever its
case, adds or subtracts one. A document's fingerprint is the sum over its paragraphs, modulo 2**32 in every place, so their
order doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector. Fingerprints that are
equal have likeness 1; otherwise it is the cosine of their counters, at least 0 and below 1, so 0 for wordless texts.
Null and empty texts are one empty paragraph. Very long texts are read whole, in pieces of a row; repeated rows give
repeated results, empty tables none, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mapped, mix64, out_batch, ready, word_hashes

WIDE, LANES = 16, 128
_ODD = mix64(np.arange(71, 75, dtype=np.uint64)) | np.uint64(1)


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Identity words and counters, both modulo 2**32, of every row of a text column."""
    wide = np.zeros((len(column), WIDE), np.uint32)
    lanes = np.zeros((len(column), LANES), np.int64)
    for lo, hi, data, offsets in chunks(column):
        raw = data.tobytes()
        lines = [raw[a:b].split(b"\n") for a, b in zip(offsets, offsets[1:], strict=False)]
        digests = np.frombuffer(b"".join([hashlib.blake2b(x).digest() for of in lines for x in of]), "<u4").reshape(-1, WIDE)
        wide[lo:hi] = np.add.reduceat(digests, np.cumsum([0, *[len(of) for of in lines[:-1]]]), axis=0, dtype=np.uint32)
        h, start, _, row = word_hashes(data, offsets)
        # Trigrams don't leave their paragraph: a line's words share the number of line ends before them.
        line = np.cumsum(np.concatenate(([0], (data == 10).astype(np.int64))))[start] if len(start) else start
        first, second = h.copy(), h.copy()
        same = np.zeros(len(h), bool)
        if len(h) > 1:
            same[1:] = (row[1:] == row[:-1]) & (line[1:] == line[:-1])
            first[1:] = np.where(same[1:], h[:-1], 0)
        if len(h) > 2:
            second[2:] = np.where(same[2:] & same[1:-1], h[:-2], 0)
        f = mix64(h * _ODD[0] + np.where(same, first, 0) * _ODD[1] + np.where(same & np.roll(same, 1), second, 0) * _ODD[2])
        at = (f >> np.uint64(8)).astype(np.int64) % LANES
        sign = np.where((f & np.uint64(1)).astype(bool), 1.0, -1.0)
        lanes[lo:hi] += np.bincount(row * LANES + at, weights=sign, minlength=(hi - lo) * LANES).astype(np.int64).reshape(hi - lo, LANES)
    return wide, lanes.astype(np.int32)


def text_of(wide: np.ndarray, lanes: np.ndarray) -> list[str]:
    both = np.concatenate((np.ascontiguousarray(wide).view(np.uint8), np.ascontiguousarray(lanes).view(np.uint8)), axis=1)
    return [r.tobytes().hex() for r in both]


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 4 * WIDE], np.uint32), np.frombuffer(raw[4 * WIDE :], np.int32)


def combined(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint after inserting (1) or deleting (-1) the paragraphs of b."""
    (w, x), (v, y) = parsed(a), parsed(b)
    return text_of((w + v if sign > 0 else w - v)[None], (x + y if sign > 0 else x - y)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.clip((x * y).sum(axis=1) / np.where(size > 0, size, 1), 0, 0.999999)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, cosine)


_PRINT = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out_batch(_PRINT, {"doc_id": batch.column("doc_id"), "fingerprint": text_of(*vectors(batch.column("text")))})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: Texts compared at once in a worker, and rows of one id, or none, that a task gets.
STEP, HOT_ROWS = 256, 4096


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order within a bucket, each with its next; the row that only ends a bucket gives no row."""
    held: list[tuple] = []

    def close(rows: list[tuple]) -> pa.RecordBatch | None:
        texts = [r[2] or "" for r in rows]
        pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][3]]
        if not pairs:
            return None
        edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in pairs]
        own, new = vectors(pa.array(texts, pa.large_string())), vectors(pa.array(edited, pa.large_string()))
        mine, after = tuple(v[pairs] for v in own), tuple(v[[k + 1 for k in pairs]] for v in own)
        return out_batch(
            _OUT,
            {
                "doc_id": [rows[k][1] for k in pairs],
                "n_chars": [len(texts[k]) for k in pairs],
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": text_of(*mine),
                "edited_fingerprint": text_of(*new),
                "near_edited": likeness(mine, new),
                "near_next": likeness(mine, after),
            },
        )

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "closes")), strict=True):
            held.append(row)
            size += len(row[2] or "")
            if len(held) > STEP or size > 4 << 20 and len(held) > 1:
                if (out := close(held)) is not None:
                    yield out
                held, size = held[-1:], len(held[-1][2] or "")
    if len(held) > 1 and (out := close(held)) is not None:
        yield out


def compare(docs: DataFrame, buckets: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fingerprints of texts and of their edited texts, whose last half is replaced from the next document's start.

    Documents are dealt to ranges of doc_id, whose bounds (at most ``buckets`` numbers) come from the ids alone; the first
    of each range is dealt to the range before it too, as its last document's next. Null ids come first; rows of one id, or
    none, are ordered by a hash of the text and then by the text. An id that more than ``hot_rows`` rows share, and no id,
    is a range of its own that is cut by the hash, so no task gets all its rows. A lone document is its own next.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], 10 * n).alias("cuts"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")).first()
    # As many slices at most as there are buckets.
    hot_rows = max(hot_rows, known["rows"] // n)
    cuts = known["cuts"] or []
    # An id of many rows is several of the quantiles.
    often = sorted({c for c in cuts if cuts.count(c) > 1})
    hot = {r["doc_id"]: r["n"] for r in rows.filter(F.col("doc_id").isin(often)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).collect()} if often else {}
    starts = {*cuts, *hot} | ({known["least"]} if known["least"] is not None else set())
    if hot:
        # A range ends with its hot id, so the next id begins another.
        order = F.array(*[F.lit(c).cast("long") for c in sorted(hot)])
        starts |= {r["next"] for r in rows.filter(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(list(hot))).groupBy(F.size(F.filter(order, lambda c: c < F.col("doc_id")))).agg(F.min("doc_id").alias("next")).collect()}
    # Ranges in order: that of no id, if there is one, and those that begin with an id; how many slices of the hash each has.
    ids = sorted(starts)
    counts = ([known["nulls"]] if known["nulls"] else []) + [hot.get(i, 0) for i in ids]
    slices = [max(1, -(-c // hot_rows)) for c in counts]
    first_of = [sum(slices[:k]) for k in range(len(slices))]
    numbers = lambda x: F.array(*[F.lit(v).cast("long") for v in x]) if x else F.array().cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(numbers(ids), lambda c: c <= F.col("doc_id"))) - (0 if known["nulls"] else 1))
    many, first = F.get(numbers(slices), F.col("range")), F.get(numbers(first_of), F.col("range"))
    part = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * many), many - 1)
    dealt = rows.withColumn("range", own).withColumn("bucket", (first + part).cast("int")).withColumn("closes", F.lit(False)).drop("range")
    # The first row of each bucket: of ranges in one slice by their first id, of slices by their least hash.
    whole = [i for i, k in zip(([None] if known["nulls"] else []) + ids, slices, strict=True) if k == 1]
    is_first = F.col("doc_id").isin([i for i in whole if i is not None]) | (F.col("doc_id").isNull() if None in whole else F.lit(False))
    least = F.min(F.struct("h", F.coalesce("text", F.lit("")).alias("text"))).alias("least")
    heads = dealt.filter(is_first).groupBy("bucket", "doc_id").agg(least)
    sliced = [k for f, m in zip(first_of, slices, strict=True) if m > 1 for k in range(f, f + m)]
    if sliced:
        in_slice = dealt.filter((F.col("bucket") >= sliced[0]) & (F.col("bucket") <= sliced[-1]) & F.array_contains(numbers(sliced), F.col("bucket").cast("long")))
        lowest = cut(in_slice.groupBy("bucket").agg(F.min("h").alias("lowest")))
        at_lowest = in_slice.join(F.broadcast(lowest), "bucket").filter(F.col("h") == F.col("lowest"))
        heads = heads.unionByName(at_lowest.groupBy("bucket", "doc_id").agg(least))
    heads = cut(heads)
    # A bucket's last row is followed by the first of the next bucket that has rows; the last bucket's, by the first of all.
    full = sorted(r["bucket"] for r in heads.select("bucket").collect())
    before = {b: full[k - 1] for k, b in enumerate(full)}
    if full:
        place = F.element_at(F.array(*[F.lit(before.get(b, 0)) for b in range(full[-1] + 1)]), F.col("bucket") + 1)
        dealt = dealt.unionByName(heads.select("doc_id", "least.text", "least.h", place.alias("bucket"), F.lit(True).alias("closes")))
    placed = dealt.repartition("bucket").sortWithinPartitions("bucket", "closes", "doc_id", "h", "text")
    return mapped(
        placed.select("bucket", "doc_id", "text", "closes"), _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
