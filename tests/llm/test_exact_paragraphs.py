"""Fingerprints against direct sums over paragraphs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surveymend.llm import fingerprints


def prints(texts):
    return fingerprints.text_of(*fingerprints.vectors(pa.array(texts, pa.large_string())))


def direct(text):
    """Identity words summed paragraph by paragraph."""
    total = [0] * 16
    for line in text.split("\n"):
        d = hashlib.blake2b(line.encode()).digest()
        total = [(t + int.from_bytes(d[4 * k : 4 * k + 4], "little")) % 2**32 for k, t in enumerate(total)]
    return total


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "😀", "delta", "x" * 40, "\t", "\r", " "]
    return ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for _ in range(n)] + ["", "\n", "\n\n", "a\n", "\na", "a"]


def test_identity_is_the_sum_over_paragraphs(monkeypatch):
    texts = texts_of(1)
    want = [direct(t) for t in texts]
    for limit in (1 << 19, 50):
        monkeypatch.setattr(fingerprints.chunks, "__defaults__", (limit,))
        assert [fingerprints.parsed(p)[0].tolist() for p in prints(texts)] == want


def test_equal_only_for_equal_paragraphs():
    texts = texts_of(2) + ["Hello there", "hello there", "hello there\n", "hello  there", "a\nb", "a\n\nb", "b\na", "a b"]
    of = {}
    for t, p in zip(texts, prints(texts), strict=True):
        of.setdefault(p, set()).add(tuple(sorted(t.split("\n"))))
    assert all(len(x) == 1 for x in of.values()) and len(of) == len({tuple(sorted(t.split("\n"))) for t in texts})


def test_insertion_and_deletion():
    texts = texts_of(3)
    for t, u in zip(texts, texts[1:], strict=False):
        joined, a, b = prints([t + "\n" + u, t, u])
        assert fingerprints.combined(a, b) == joined and fingerprints.combined(joined, b, -1) == a


def test_likeness_follows_shared_trigrams():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    base = rng.choices(words, k=400)

    def exact(a, b):
        x, y = (Counter(zip(["", "", *t], ["", *t], t, strict=False)) for t in (a, b))
        dot = sum(n * y[g] for g, n in x.items())
        return dot / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5

    for kept in (0, 100, 200, 300, 390):
        other = base[:kept] + rng.choices(words, k=400 - kept)
        own = fingerprints.vectors(pa.array([" ".join(base), " ".join(other)], pa.large_string()))
        got = fingerprints.likeness(tuple(v[:1] for v in own), tuple(v[1:] for v in own))[0]
        assert got == pytest.approx(exact(base, other), abs=0.25)
    same = fingerprints.vectors(pa.array(["a b c", "A b c"], pa.large_string()))
    assert 0.99 < fingerprints.likeness(tuple(v[:1] for v in same), tuple(v[1:] for v in same))[0] < 1


def test_null_text_is_an_empty_one(spark):
    got = [r["fingerprint"] for r in fingerprints.fingerprint(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")).collect()]
    assert got == prints(["", ""]) and np.any(fingerprints.parsed(got[0])[0])
