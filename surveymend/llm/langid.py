"""Language identification by interpolated Kneser-Ney character trigram models, stored in sorted hash arrays.

Symbols are lower-cased letters of any script, and one for everything else, runs of which count once. A document goes to
the language of lowest cross-entropy per symbol. It is rejected where that entropy exceeds the language's mean, in
standard errors of its length, by more than the language's limit. Limits are calibrated on documents that the models
scoring them had not seen: half way from the largest excess of the language's own documents to the usual excess, under
its model, of the language nearest to it.
Texts that are null, empty or hold no letter are ``und``, score 0, and rejected. Models are fitted on at most ``FIT_DOCS``
documents of each language, the first by a hash of doc_id; rows of null language, null id or held out take no part. With
nothing to learn from, every text is ``und``, but none is taken out. Ties between languages go to the name that sorts
first. Repeated rows give repeated results, an empty table none; other columns are ignored, or kept by ``keep``. Long texts are
read whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, held_out, mapped, mix64, out_batch, ready

FIT_DOCS = 1500
#: Bits of the bins that a language's ids are counted by.
RANK_BITS = 12
#: Bits of a symbol: a code point.
BITS = 21
DISCOUNT = 0.75
UNKNOWN = "und"
#: One document in so many is left out of the models that limits are calibrated with.
FOLDS = 5
#: Symbols that a standard error counts at most, and how far above the largest own excess a limit is at least.
LONG, SLACK = 400, 1.2
_MASK = (1 << BITS) - 1


def _lowered(point: int) -> int:
    ch = chr(point)
    return ord(ch.lower()[0]) if ch.isalpha() else 0


_table: list[np.ndarray] = []


def symbols(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, trigram codes, row of each code), chunk by chunk, over the whole texts."""
    if not _table:
        # Surrogates are no characters, so they are no letters either.
        _table.append(np.array([_lowered(c) for c in range(1 << 16)], np.int64))
    for lo, hi, data, offsets in chunks(column):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.cumsum(np.concatenate(([0], (data & 0xC0) != 0x80)))[offsets]
        sym = _table[0][np.minimum(points, 0xFFFF)]
        beyond = points > 0xFFFF
        if beyond.any():
            found, at = np.unique(points[beyond], return_inverse=True)
            sym[beyond] = np.array([_lowered(c) for c in found.tolist()])[at]
        row = np.repeat(np.arange(hi - lo), np.diff(starts))
        first = np.zeros(len(sym), bool)
        first[starts[:-1][starts[:-1] < len(sym)]] = True
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | first[1:]
        keep[first] = sym[first] > 0
        sym, row = sym[keep], row[keep]
        if not len(sym):
            continue
        new = np.concatenate(([True], row[1:] != row[:-1]))
        back1 = np.concatenate(([0], sym[:-1]))
        back1[new] = 0
        back2 = np.concatenate(([0], back1[:-1]))
        back2[new] = 0
        yield lo, hi, (back2 << 2 * BITS) | (back1 << BITS) | sym, row


class Hashed:
    """Rows by n-gram: sorted 64-bit hashes, with where those of each leading bit pattern begin."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        h = _hash(codes)
        order = np.argsort(h)
        self.keys, self.rows = np.append(h[order], np.uint64(2**64 - 1)), rows[order]
        bits = max(1, len(codes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted((self.keys[:-1] >> self.shift).astype(np.int64), np.arange(1 << bits))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each code is there, its row)."""
        h = _hash(codes)
        at = self.starts[(h >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < h[behind]]
        return (self.keys[at] == h) & (at < len(self.rows)), np.minimum(at, len(self.rows) - 1)


def _hash(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def _counted_by(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, their sums of n, and how many there are of each."""
    u, at = np.unique(codes, return_inverse=True)
    return u, np.bincount(at, n, len(u)), np.bincount(at, minlength=len(u))


@dataclass
class KneserNey:
    """One language: sorted n-grams with what is left of their counts, and each context's weight of the next lower order."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    symbols: int

    def _of(self, sorted_codes: np.ndarray, values: np.ndarray, codes: np.ndarray, default: float) -> np.ndarray:
        if not len(sorted_codes):
            return np.full(len(codes), default)
        at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
        return np.where(sorted_codes[at] == codes, values[at], default)

    def weight(self, order: int, context: np.ndarray) -> np.ndarray:
        """What a context adds of the lower order's probability; all of it where it was never seen."""
        return self._of(*self.contexts[order - 1], context, 1.0)

    def probability(self, order: int, codes: np.ndarray) -> np.ndarray:
        """Of the last symbol after the order - 1 symbols before it."""
        if order == 0:
            return np.full(len(codes), 1.0 / self.symbols)
        codes = codes & ((1 << BITS * order) - 1)
        return self._of(*self.grams[order - 1], codes, 0.0) + self.weight(order, codes >> BITS) * self.probability(order - 1, codes)


def kneser_ney(codes: np.ndarray, n: np.ndarray, symbols: int) -> KneserNey:
    """Interpolated Kneser-Ney from trigram counts; symbols: how many there are, those never seen included."""
    grams, contexts = [], []
    for order in (3, 2, 1):
        context, total, kinds = _counted_by(codes >> BITS, n)
        of = np.searchsorted(context, codes >> BITS)
        grams.append((codes, np.maximum(n - DISCOUNT, 0) / total[of]))
        contexts.append((context, DISCOUNT * kinds / total))
        # The lower order counts the different symbols that come before.
        codes, _, n = _counted_by(codes & ((1 << BITS * (order - 1)) - 1), n)
    return KneserNey(grams[::-1], contexts[::-1], symbols)


@dataclass
class Model:
    """Languages and their models side by side, by order: n-grams seen in any language with a row of log probabilities for
    every language, and contexts with what they add to the next lower order. Excesses of entropy: mean and limit."""

    languages: list[str]
    grams: list[Hashed]
    contexts: list[Hashed]
    never: np.ndarray
    centre: np.ndarray
    limit: np.ndarray

    def logs(self, codes: np.ndarray, order: int = 3) -> np.ndarray:
        """(codes, languages): log probabilities, of seen n-grams from their row, of others by backing off."""
        if order == 0:
            return np.broadcast_to(self.never, (len(codes), len(self.languages)))
        codes = codes & ((1 << BITS * order) - 1)
        seen, at = self.grams[order - 1].find(codes)
        out = self.grams[order - 1].rows[at]
        rest = np.flatnonzero(~seen)
        if len(rest):
            known, c = self.contexts[order - 1].find(codes[rest] >> BITS)
            out[rest] = np.where(known[:, None], self.contexts[order - 1].rows[c], 0) + self.logs(codes[rest], order - 1)
        return out


def model_of(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models of languages from their trigrams (sorted codes, counts), without limits."""
    languages = sorted(counts, key=str.encode)
    every = np.unique(np.concatenate([counts[x][0] for x in languages]))
    # Symbols seen in any language, and one for all others.
    symbols = len(np.unique(every & _MASK)) + 1
    own = [kneser_ney(*counts[x], symbols) for x in languages]
    grams, contexts = [], []
    for order in (1, 2, 3):
        codes = np.unique(every & ((1 << BITS * order) - 1))
        grams.append(Hashed(codes, np.log(np.stack([m.probability(order, codes) for m in own], 1)).astype(np.float32)))
        before = np.unique(codes >> BITS)
        contexts.append(Hashed(before, np.log(np.stack([m.weight(order, before) for m in own], 1)).astype(np.float32)))
    return Model(languages, grams, contexts, np.full(len(languages), -np.log(symbols), np.float32), np.zeros(len(languages)), np.full(len(languages), np.inf))


_COUNT = pa.schema([("lang", pa.string()), ("fold", pa.bool_()), ("code", pa.int64()), ("n", pa.int64())])
_BITS = pa.schema([("lang", pa.string()), ("model", pa.string()), ("h", pa.float64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), strict=True))
        number = {k: i for i, k in enumerate(dict.fromkeys(kinds))}
        kind = np.array([number[k] for k in kinds], np.int64)
        for lo, hi, code, row in symbols(batch.column("text")):
            of = kind[lo:hi][row]
            for (lang, fold), i in number.items():
                u, n = np.unique(code[of == i], return_counts=True)
                if len(u):
                    yield out_batch(_COUNT, {"lang": [lang] * len(u), "fold": [fold] * len(u), "code": u, "n": n})


def first_ids(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id of the first ``limit`` rows of each language by a hash of doc_id.

    Rows are counted by bins of their hash, so that only the bins which the bound reaches are ranked.
    """
    key = F.xxhash64("doc_id", F.lit(8))
    ids = docs.select("doc_id", "lang", key.alias("k"), F.shiftright(key, 64 - RANK_BITS).alias("bin"))
    before = F.sum("count").over(W.partitionBy("lang").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    last = ids.groupBy("lang", "bin").count().withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit).groupBy("lang").agg(F.max("bin").alias("last"))
    # One row for each language, as the model has.
    ids = ids.join(F.broadcast(last), "lang").filter("bin <= last")
    return ids.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("k", "doc_id"))).filter(F.col("rank") <= limit).select("doc_id").distinct()


def fit(docs: DataFrame, limit: int = FIT_DOCS) -> Model | None:
    """Learn from rows (doc_id, text, lang) that aren't held out; at most ``limit`` documents of each language.

    The driver gets the trigram counts of that sample, and the entropies of each document left out of the first models.
    """
    ready(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.join(F.broadcast(first_ids(usable, limit)), "doc_id", "left_semi").select("text", "lang", (F.pmod(F.xxhash64("doc_id", F.lit(88)), F.lit(FOLDS)) == 0).alias("fold"))
    rows = mapped(sample, _counted, "lang string, fold boolean, code long, n long").groupBy("lang", "fold", "code").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None

    def counts(some) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {x: (of.index.to_numpy(), of.to_numpy().astype(float)) for x in sorted(set(some["lang"])) for of in [some[some["lang"] == x].groupby("code")["n"].sum()]}

    model, first = model_of(counts(rows)), counts(rows[~rows["fold"]])
    said = mapped(sample.filter("fold").filter(F.col("lang").isin(list(first))), _entropies(model_of(first)), "lang string, model string, h double, n long").toPandas() if first else None
    if said is None or not len(said):
        return model
    said["root"] = np.sqrt(np.minimum(said["n"], LONG))
    for i, x in enumerate(model.languages):
        under = said[said["model"] == x]
        own = under[under["lang"] == x]
        if not len(own):
            continue
        model.centre[i] = own["h"].mean()
        most = float(((own["h"] - model.centre[i]) * own["root"]).max())
        others = [float((g["h"] - model.centre[i]).median()) * LONG**0.5 for y, g in under.groupby("lang") if y != x]
        model.limit[i] = max((most + min(others)) / 2 if others else 0.0, SLACK * most, 1.0)
    return model


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-entropies per symbol of each row by language, symbols, and letters."""
    total, n, letters = np.zeros((len(column), len(model.languages))), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for lo, _, code, row in symbols(column):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rows = lo + row[at]
        total[rows] = np.add.reduceat(model.logs(code), at, axis=0, dtype=np.float64)
        n[rows] = np.diff(np.append(at, len(row)))
        letters[rows] = np.add.reduceat(((code & _MASK) > 0).astype(np.int64), at)
    return -total / np.maximum(n, 1)[:, None], n, letters


def _entropies(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, letters = scores(model, batch.column("text"))
            lang = batch.column("lang").to_pylist()
            some = np.flatnonzero(letters)
            for k, x in enumerate(model.languages):
                yield out_batch(_BITS, {"lang": [lang[i] for i in some], "model": [x] * len(some), "h": h[some, k], "n": n[some]})

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def judge(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    h, n, letters = scores(model, column)
    best = h.argmin(axis=1)
    # Evidence grows with length, up to the length at which it is certain anyway.
    odds = np.exp(-(h - h.min(axis=1, keepdims=True)) * np.minimum(n, 60)[:, None])
    score = np.where(letters > 0, 1 / odds.sum(axis=1), 0.0)
    excess = (h[np.arange(len(h)), best] - model.centre[best]) * np.sqrt(np.minimum(n, LONG))
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, letters, strict=True)], score, (letters == 0) | (excess > model.limit[best])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and rejected of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = judge(model, batch.column("text"))
            yield out_batch(_OUT, {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score, "rejected": rejected})

    return mapped(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that aren't rejected, with all their columns; all rows where there was nothing to learn from."""
    if model is None:
        return docs
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~judge(model, batch.column("text"))[2]))

    return mapped(docs, run, docs.schema)
