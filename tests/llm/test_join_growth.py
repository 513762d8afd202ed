"""What the join sends to disk: count vectors shorter than sets, and popular shingles told by a number that doesn't grow with the table."""

import numpy as np
import pyarrow as pa

from surveymend.llm import ngram_join
from surveymend.llm.common import bytes_of


def test_vectors_are_short_and_tell_unrelated_sets_apart():
    rng = np.random.default_rng(5)
    for n in (100, 460, 3000, 20_000):
        s, t = (np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for _ in range(2))
        v, w = ngram_join.count_vector(s), ngram_join.count_vector(t)
        assert len(v) <= n / 2
        assert np.minimum(v.astype(int), w).sum() < ngram_join.need(len(s), len(t))


def test_popular_shingles_are_bounded_by_their_number(spark, monkeypatch):
    """A shingle of 200 of 5,000 documents is popular, as one of 200 among 300 is; more wait until they are too many."""
    words = lambda k: " ".join(f"p{k}x{j}" for j in range(4))
    rows = [(i, words("same") if i < 200 else words(i)) for i in range(5000)]
    for some in (rows[:300], rows):
        text = spark.createDataFrame(some, "doc_id long, text string")
        assert len(ngram_join._popular(text)) == 1
    monkeypatch.setattr(ngram_join, "POPULAR_MOST", 10)
    assert len(ngram_join._popular(text)) == 0


def test_counts_are_short_by_one_a_block(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 40)
    monkeypatch.setattr(ngram_join, "ONCE", 0)
    texts = ["a b c d"] * 30 + [f"w{k} b c d" for k in range(90)]
    texts = [t for k in range(30) for t in (texts[k], *texts[30 + 3 * k : 33 + 3 * k])]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 20])], names=["text"]) for k in range(0, 120, 20)]
    found = [b.to_pylist() for b in ngram_join._counted(iter(batches))]
    label = ngram_join._label(ngram_join.shingle_sets(*bytes_of(pa.array(["a b c d"])))[0])[0]
    assert sum(r["n"] for b in found for r in b if r["label"] is None) == 120
    counted = sum(r["n"] for b in found for r in b if r["label"] == label)
    assert 30 - len(found) <= counted <= 30 and all(r["n"] > 1 for b in found for r in b if r["label"] is not None)
