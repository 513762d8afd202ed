"""What the join lists and passes on: no shingle of one document, and fewer pairs than documents of a group of near copies."""

import itertools

import numpy as np

from surveymend.llm import ngram_join


def near_copies(groups: int, copies: int, changed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 1 << 62, 130).astype(np.uint64)) for _ in range(groups)]
    return [np.unique(np.concatenate((np.delete(b, rng.choice(len(b), changed, replace=False)), rng.integers(0, 1 << 62, changed).astype(np.uint64)))) for b in base for _ in range(copies)]


def test_a_block_passes_on_fewer_pairs_than_documents():
    """Also where the bound lets pairs through that don't link: those are settled where they meet."""
    for changed in (3, 8, 30):
        sets = near_copies(2, 60, changed)
        ids = list(range(len(sets)))
        pairs = ngram_join.block_pairs(ids, ids, [len(s) for s in sets], [], [-1] * len(ids), set(), sets)
        links = [(i, j) for i, j in itertools.combinations(ids, 2) if ngram_join.linked(sets[i], sets[j])]
        top = list(ids)
        for i, j in links:
            top = [min(top[i], top[j]) if t in (top[i], top[j]) else t for t in top]
        assert set(pairs) <= set(links) and len(pairs) == len(ids) - len(set(top))


def test_shingles_of_one_document_are_not_listed(spark):
    words = lambda k, n: " ".join(f"d{k}x{j}" for j in range(n))
    rows = [(k, words(k, 400)) for k in range(40)] + [(100 + k, words(1000, 400) + f" end{k}") for k in range(3)]
    text = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = ngram_join._frequent(text)
    got = {r["id"]: len(r["first"]) for r in ngram_join.mapped(text, ngram_join._listed(ngram_join._popular(text), frequent), "id long, n long, first array<long>, plain int").collect()}
    # A bitmap of 65,536 bits passes few by chance.
    assert sum(got[k] for k in range(40)) <= 40 and all(got[100 + k] >= 60 for k in range(3))
