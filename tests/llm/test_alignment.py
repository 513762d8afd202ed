"""Alignment of two tokenizers against a direct computation over byte ends."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveymend.llm import alignment
from surveymend.llm.common import cut

LONG = "Lang und länger, " * 4_000 + "x" * 3_000
TEXTS = [
    "One two three.", None, "", "  spaced\n\n out\t text ", "▁ piece mark", "<|endoftext|> and </s><s>", "it's DON'T we’ve I'LL", "漢字 かな 😀 é ﬁ é", "a\x1cb \x85c \x00d", "1234 5,678.9%", "One two three.", LONG,
    "déjà vu: naïve façade", "﻿mark", " ", "\n", "a", "ab" * 40, "the the the the",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.model_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.model_path("piece_bpe_32k.model"))


def direct(text, libraries):
    """(A ids, B ids, groups, overlapping pairs, linked pairs) of one text, token by token."""
    a, b = libraries
    if not text:
        return [], [], [], 0, []
    of = alignment.byte_alphabet()
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], 0, []
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    links = [(p, q) for p, e in zip(x, ends_a, strict=True) for q in [dict(zip(ends_b, y, strict=True)).get(e)] if q is not None] if len(x) < 3000 else None
    both = sorted(set(ends_a) & set(ends_b))
    groups, i, j = [], 0, 0
    for e in both:
        k, m = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
        groups.append((x[i:k], y[j:m]))
        i, j = k, m
    if links is None:
        links = [(p[-1], q[-1]) for p, q in groups]
    return x, y, groups, len(set(ends_a) | set(ends_b)), links


def expected(texts, libraries):
    each = [direct(t, libraries) for t in texts]
    count = Counter(p for e in each for p in e[4])
    most = {}
    for (_, q), n in count.items():
        most[q] = max(most.get(q, 0), n)
    out = []
    for x, y, groups, overlaps, links in each:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if x else ""
        out.append((len(x), len(y), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest, overlaps))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


@pytest.mark.parametrize("held", [alignment.HELD, 40, 1])
def test_equals_direct_computation(spark, libraries, held):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.counted(docs, held=held).collect()}
    assert [got[k] for k in range(len(TEXTS))] == expected(TEXTS, libraries)


def test_whole_texts_of_the_tables(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.counted(docs).collect()}
    assert [got[r["doc_id"]] for r in rows] == expected([r["text"] for r in rows], libraries)


def test_repeated_rows_null_ids_and_empty_tables(spark, libraries):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (2, "")], "doc_id long, text string")
    rows = alignment.counted(docs).collect()
    assert len(rows) == 5 and len({r["count_sum"] for r in rows if r["n_a"]}) == 1
    want = expected(["same text"] * 3, libraries)[0]
    assert [tuple(r[c] for c in COLUMNS) for r in rows if r["n_a"]] == [want] * 3
    assert all(r["groups_sha256"] == "" and r["count_sum"] == 0 for r in rows if not r["n_a"])
    assert alignment.counted(docs.limit(0)).collect() == []


def test_both_libraries_of_a_give_its_ids(libraries):
    t = alignment.ByteTokens(alignment.model_path("byte_bpe_50k.json"), alignment.model_path("byte_bpe_50k.tiktoken"))
    texts = [" " + x for x in TEXTS if x] + ["", " " + "x" * 5_000, " a" + " " * 5_000 + "b", " \u180e\u200b\x1f", " \u0560 \ua7c0 \U0001fae0", " ۱۲۳ ½ ² Ⅻ", " ｆｕｌｌ　width"]
    for ids, text in zip(t.ids(texts), texts, strict=True):
        assert ids.tolist() == libraries[0].encode(text, add_special_tokens=False).ids
    # Every stable character is parted alike by both.
    plain = sorted(alignment.stable())
    line = [" ".join(f"a{c}1{c}{c} {c}b.{c}" for c in plain[k : k + 200]) for k in range(0, len(plain), 200)]
    for text, ids in zip(line, t.ids(line), strict=True):
        assert ids.tolist() == libraries[0].encode(text, add_special_tokens=False).ids


def test_counts_that_tie_are_all_best(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string")
    rows = alignment.counted(docs).collect()
    assert all(r["n_best"] == r["n_links"] for r in rows)


def test_pairs_are_packed_and_back():
    pairs = np.array([7, 3, 3, 1 << 40, 7, 7], np.uint64)
    key, n = alignment._unpack(alignment._pack(pairs))
    assert key.tolist() == [3, 7, 1 << 40] and n.tolist() == [2, 3, 1] and alignment._unpack(b"")[0].tolist() == []


def test_pair_counts_are_complete_when_a_task_passes_them_on_early(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} and word{k % 7}") for k in range(60)], "doc_id long, text string").repartition(2)
    aligned = cut(alignment.align(docs))
    want = {r["pair"]: r["n"] for r in alignment.pair_counts(aligned).collect()}
    assert sum(want.values()) == aligned.agg(F.sum("n_links")).first()[0]
    # The threshold is read in the workers, so the function is run here as they would.
    monkeypatch.setattr(alignment, "COUNTED", 8)
    keys, counts = zip(*[alignment._unpack(r["pairs"]) for r in aligned.collect()], strict=True)
    key, n = alignment._merge(list(keys), list(counts))
    assert dict(zip(key.astype(np.int64).tolist(), n.tolist(), strict=True)) == want
