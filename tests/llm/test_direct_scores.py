"""Toxicity scores against a noisy-or in plain Python; added spans of personal data against comparing all."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from surveymend.llm import pii, toxicity
from surveymend.llm.common import bytes_of, head_hashes, word_hashes


def buckets(word):
    """Of a word and its stems."""
    data, offsets = bytes_of(pa.array([word]))
    h, s, e, _ = word_hashes(data, offsets, toxicity._GAP)
    every = [h[0], *[x[0] for size in toxicity.HEADS for _, x in [head_hashes(data, s, e, size)] if len(x)]]
    return {int(x >> np.uint64(40)) & (toxicity.BUCKETS - 1) for x in every}


def parts(text):
    """Sentences as lists of words: of the ends within one run of MIN_WORDS words, only the first counts."""
    words, ends = [], []
    for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[.!?\n]", text.encode()):
        if m[0] in b".!?\n":
            ends.append(len(words))
        else:
            words.append(m[0].decode(errors="surrogateescape"))
    edges = [0, *sorted({e for e in ends if 0 < e < len(words)})]
    kept = [e for k, e in enumerate(edges) if k == 0 or e // toxicity.MIN_WORDS != edges[k - 1] // toxicity.MIN_WORDS]
    return [words[a:b] for a, b in zip(kept, [*kept[1:], len(words)], strict=True)] if words else []


def direct(text, weights):
    clean = 1.0
    for words in parts(text):
        z = weights[-1] + sum(weights[b] for b in {b for w in words for b in buckets(w)})
        clean *= 1 - 1 / (1 + math.exp(-min(max(z, -60), 60)))
    return 1 - clean


def test_scores_are_the_noisy_or_of_sentences(spark):
    rng = random.Random(3)
    words = "vile nasty awful terrible lovely house garden water über grün table about something".split()
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", "!", " \n", "? -"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, "...", "vile", "LOVELY Vile."]
    weights = np.zeros(toxicity.BUCKETS + 1)
    for w in words:
        for b in buckets(w):
            weights[b] = np.float32(rng.uniform(-1, 1.5))
    weights[-1] = np.float32(-2.5)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()}
    for i, t in enumerate(texts):
        want = direct(t or "", weights)
        assert got[i]["score"] == pytest.approx(want, abs=1e-5) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_added_spans_equal_comparing_all():
    rng = random.Random(5)
    for _ in range(500):
        spans = lambda n, lo, hi: sorted({(rng.randint(lo, hi), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 80) for _ in range(n))})
        base, more = spans(rng.randint(0, 8), 0, 3), spans(rng.randint(0, 12), 4, 6)
        kept = list(base)
        for x in more:
            if not any(b[1] < x[2] and x[1] < b[2] for b in kept):
                kept.append(x)
        assert pii._apart(base, more) == kept[len(base) :]


def test_time_of_many_added_spans_grows_with_their_number():
    t = time.perf_counter()
    _, spans = pii.find("account no 12345678 " * 40_000, pii.automaton())
    assert len(spans) == 40_000 and time.perf_counter() - t < 5


def test_personal_data_on_odd_tables(spark):
    rows = [(None, "a@b.cd"), (None, None), (1, ""), (1, ""), (2, "x " * 60_000 + "a@b.cd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.scan(docs).collect()) == [("1", 0, ""), ("1", 0, ""), ("2", 1, "email:120000:120006"), ("None", 0, ""), ("None", 1, "email:0:6")]
    assert pii.scan(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []
