"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in the words that it holds and in their first bytes (stems, where words are
inflected); the document's is the noisy-or of its sentences.
Weights are trained from document labels alone, on at most ``FIT_DOCS`` labelled documents that aren't held out, and then
locate offending sentences. Words are runs of ASCII letters, either case, and non-ASCII bytes, hashed into ``BUCKETS``;
sentences end at ``.``, ``!``, ``?`` and line ends, and those of few words are joined to the next. Null and wordless texts have the score of no sentence, 0.
Labels of null, or of documents that aren't there, take no part; with nothing to learn from, all scores are 0, and with
toxic labels only, 1. Long texts are read whole, in pieces of a row; repeated rows give repeated results, an empty table
none, other columns are ignored, and scores that tie stay tied. What the driver gets of a document is its weighted words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, head_hashes, held_out, mapped, out_batch, ready, word_hashes

FIT_DOCS = 12_000
BUCKETS = 1 << 18
MIN_WORDS = 8
#: Bytes of the stems of longer words.
HEADS = (4, 5, 6)
#: A sentence is offending from this probability on.
OFFENDING = 0.5
#: Penalty of squared weights, and the log-likelihood ratio that a bucket needs to get one.
RIDGE, EVIDENCE = 0.005, 16.0
_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word or stem, by sentence: bucket and sentence; of each sentence with words: row, and bytes where its words begin and end."""
    h, start, end, row = word_hashes(data, offsets, _GAP)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    stops = np.cumsum(_STOP[data])[start]
    new = np.concatenate(([True], (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])))
    # Of the ends within one run of MIN_WORDS words, only the first counts, so very short sentences are joined.
    edge = np.flatnonzero(new)
    own = np.concatenate(([True], row[1:] != row[:-1]))[edge]
    run = (edge - np.searchsorted(row, row[edge])) // MIN_WORDS
    new[edge[1:][(run[1:] == run[:-1]) & ~own[1:]]] = False
    at = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    stems = [head_hashes(data, start, end, size) for size in HEADS]
    word = np.concatenate([h, *[x for _, x in stems]])
    sent = np.concatenate([of, *[of[which] for which, _ in stems]])
    return (word >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), sent, row[at], start[at], end[np.append(at[1:] - 1, len(h) - 1)]


def noisy_or(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(row, weights=np.log1p(-np.clip(p, 0, 1 - 1e-9)), minlength=n))


def useful(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that toxic documents hold more often than others, on evidence, and their log odds; counts are of documents."""
    odds = np.log((pos + 0.3) / (n_pos + 0.6)) - np.log((neg + 0.3) / (n_neg + 0.6))
    # The log-likelihood ratio of a bucket's count among toxic documents against their share of all.
    rate, both = n_pos / (n_pos + n_neg), np.maximum(pos + neg, 1)
    ratio = 2 * (pos * np.log(np.maximum(pos, 1e-9) / (both * rate)) + neg * np.log(np.maximum(neg, 1e-9) / (both * (1 - rate))))
    keep = np.flatnonzero((odds > 0.7) & (ratio >= EVIDENCE))
    return keep, odds[keep]


def train(word: np.ndarray, sentence: np.ndarray, doc: np.ndarray, toxic: np.ndarray, start: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the documents' likelihood under noisy-or, with a ridge penalty.

    word (a place in ``start``) and sentence: of each distinct pair; doc: of each sentence; toxic: of each document.
    """
    n, w, bias = len(toxic), np.minimum(start, 6.0) * 0.7, -7.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights=w[word], minlength=len(doc))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        none = np.bincount(doc, weights=np.log1p(-p), minlength=n)
        any_toxic = np.clip(1 - np.exp(none), 1e-9, 1)
        # d log-likelihood / d log(1 - p): -1 for clean documents, (1 - P) / P for toxic ones.
        g = np.where(toxic, (1 - any_toxic) / any_toxic, -1.0)[doc] * p
        grad = np.append(np.bincount(word, weights=g[sentence], minlength=len(w)) - RIDGE * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = w + move[:-1], min(bias + move[-1], -2.0)
    return w, bias


_DF = pa.schema([("bucket", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])
_BAG = pa.schema([("toxic", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("sentences", pa.binary())])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label by bucket; BUCKETS stands for all of them."""
    pos, neg = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        pos[BUCKETS] += toxic.sum()
        neg[BUCKETS] += (~toxic).sum()
        for lo, hi, data, offsets in chunks(batch.column("text")):
            word, sent, row, _, _ = sentences(data, offsets)
            if len(word):
                once = np.unique(row[sent] * BUCKETS + word)
                hit = toxic[lo:hi][once // BUCKETS]
                pos += np.bincount(once[hit] % BUCKETS, minlength=BUCKETS + 1)
                neg += np.bincount(once[~hit] % BUCKETS, minlength=BUCKETS + 1)
    some = np.flatnonzero(pos + neg)
    yield out_batch(_DF, {"bucket": some.astype(np.int32), "pos": pos[some], "neg": neg[some]})


def _bags(vocabulary: np.ndarray):
    """Of each document: label, number of sentences, and its distinct (vocabulary place, sentence) pairs."""
    place = np.full(BUCKETS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for lo, hi, data, offsets in chunks(batch.column("text")):
                word, sent, row, _, _ = sentences(data, offsets)
                known = place[word] >= 0
                once = np.unique(sent[known] * len(vocabulary) + place[word[known]]) if len(vocabulary) else sent[:0]
                s, v = once // max(len(vocabulary), 1), once % max(len(vocabulary), 1)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                at = np.searchsorted(s, first)
                yield out_batch(
                    _BAG,
                    {
                        "toxic": toxic[lo:hi],
                        "n": np.diff(first).astype(np.int32),
                        "words": [v[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(hi - lo)],
                        "sentences": [(s[at[i] : at[i + 1]] - first[i]).astype(np.int32).tobytes() for i in range(hi - lo)],
                    },
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> np.ndarray:
    """Weights of buckets, then the bias, from (doc_id, text) and (doc_id, toxic).

    Repeated labels of a document count once, the larger. Word counts are made by the executors; the driver gets one row
    for each bucket, and the weighted words of at most ``limit`` documents.
    """
    ready(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    weights = np.zeros(BUCKETS + 1)
    counts = mapped(sample, _frequencies, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    bucket = counts.column("bucket").to_numpy()
    pos[bucket], neg[bucket] = counts.column("pos").to_numpy(), counts.column("neg").to_numpy()
    if not pos[-1] or not neg[-1]:
        weights[-1] = 50.0 if pos[-1] else -50.0
        return weights
    vocabulary, odds = useful(pos[:-1], neg[:-1], int(pos[-1]), int(neg[-1]))
    rows = mapped(sample, _bags(vocabulary), "toxic int, n int, words binary, sentences binary").toArrow()
    n = rows.column("n").to_numpy().astype(np.int64)
    base = np.cumsum(n) - n
    part = [(np.frombuffer(w, np.int32), np.frombuffer(s, np.int32) + b) for w, s, b in zip(rows.column("words").to_pylist(), rows.column("sentences").to_pylist(), base, strict=True)]
    z = np.zeros(0, np.int64)
    w, bias = train(np.concatenate([z, *[x for x, _ in part]]), np.concatenate([z, *[x for _, x in part]]), np.repeat(np.arange(len(n)), n), rows.column("toxic").to_numpy() > 0, odds)
    weights[vocabulary], weights[-1] = w, bias
    return weights


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.string())])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted, and the byte ranges start:end of offending sentences, comma-joined."""
    ready(docs.sparkSession)
    slim = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                word, sent, row, start, end = sentences(data, offsets)
                value = slim[word]
                # A word counts once in a sentence; only weighted words need telling apart.
                some = np.flatnonzero(value)
                _, first = np.unique(sent[some] * BUCKETS + word[some], return_index=True)
                some = some[first]
                z = slim[-1] + np.bincount(sent[some], weights=value[some], minlength=len(row))
                p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                total = noisy_or(p, row, hi - lo)
                where: list[list[str]] = [[] for _ in range(hi - lo)]
                for s in np.flatnonzero(p >= OFFENDING):
                    where[row[s]].append(f"{start[s] - offsets[row[s]]}:{end[s] - offsets[row[s]]}")
                yield out_batch(
                    _OUT,
                    {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "held_out": batch.column("held_out").slice(lo, hi - lo), "score": np.clip(total, 0, 1), "predicted": (total >= 0.5).astype(np.int32), "offending": [",".join(w) for w in where]},
                )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")), run, "doc_id long, held_out boolean, score double, predicted int, offending string")
