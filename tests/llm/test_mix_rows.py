"""Rows of the mix itself."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from surveymend.llm import mixing

COLUMNS = "doc_id long, text string, source string"


def test_rows_are_taken_as_often_as_they_were_rounded(spark):
    rows = [(i % 70, f"word {'x ' * (i % 9)}", "a") for i in range(210)] + [(100 + i, "b c", "b") for i in range(60)] + [(None, "b null", "b"), (None, "c c c", None), (500, "c", None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    mixed = mixing.mix(docs).collect()
    want = Counter()
    for r in mixed:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixing.repeat(docs).collect())
    assert got == +want
    assert any(k[0] is None for k in got)
    copies = {}
    for r in mixed:
        copies.setdefault(r["doc_id"], set()).add(r["copies"])
    assert any(len(c) > 1 for c in copies.values())


def test_odd_rows_are_taken_as_often_as_they_were_rounded(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "null id text", "en"), (None, "other", "en"), (4, "w " * 500, "b"), (5, "x", "b")]
    docs = spark.createDataFrame(rows, COLUMNS)
    want, got = Counter(), Counter(r["doc_id"] for r in mixing.repeat(docs).collect())
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert got == +want and got[None] > 0
    assert mixing.repeat(docs.limit(0)).collect() == []


def test_words_of_the_mix_equal_its_digest(spark):
    """Rows in and words out, by source, on a table of null ids, repeated ids, repeated rows and clashing columns."""
    texts = ["x " * (i % 13) for i in range(400)]
    rows = [(None if i % 3 == 0 else i % 120, t, [None, "a", "b", "c"][i % 7 % 4], i, "k", 1) for i, t in enumerate(texts)] + [(None, "same row", "a", 0, "k", 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __copies long, __key string, size int")
    digest = mixing.digest(docs).collect()
    assert len(digest) == len(rows)
    got = mixing.repeat(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r["source"]] += len(r["text"].split())
        assert r["__key"] == "k" and r["size"] == 1
    mixed = mixing.mix(docs).collect()
    taken, target, size, largest = Counter(), {}, Counter(), Counter()
    for r in mixed:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        size[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert words == taken and sum(taken.values()) == sum(r["taken"] for r in digest)
    # Rows without an id take part in the rounding, so no source falls short by their fractions.
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert all(target[s] <= 3 * size[s] for s in target)
    again = Counter(tuple(r) for r in mixing.repeat(docs.repartition(7)).collect())
    assert again == Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("level", ["first", "above"])
def test_rounding_keeps_every_expectation(spark, level):
    """Over many independent groups of the same documents, each is taken as often as its rate says, and no group's words change."""
    rng, reps = random.Random(3), 1500
    units = [(rng.choice([1, 5, 20, 80, 300, 2000]) + rng.randint(0, 9), 0.4 if level == "first" else rng.choice([0.5, 0.2, 0.85, 0.05, 1 / 3])) for _ in range(24)]
    rows = [(rep, [(-w, rep * 1000 + k, False, p, w) for k, (w, p) in sorted(enumerate(units), key=lambda x: (-x[1][0], x[0]))]) for rep in range(reps)]
    df = spark.createDataFrame(rows, "rep int, units array<struct<o:long,key:long,anon:boolean,p:double,size:long>>")
    taken, words = [0.0] * len(units), []
    rounded = (mixing._round if level == "first" else mixing._paired)(F.col("units"), 20)
    for r in df.select(rounded.alias("r")).collect():
        left = r["r"]["rest"]
        assert len(r["r"]["done"]) + (left["key"] is not None) == len(units) and all(d["extra"] in (0, 1) for d in r["r"]["done"])
        for d in r["r"]["done"]:
            taken[d["key"] % 1000] += d["extra"]
        if left["key"] is not None:
            taken[left["key"] % 1000] += left["p"]
        words.append(sum(d["size"] * d["extra"] for d in r["r"]["done"]) + left["size"] * left["p"])
    for (_, p), t in zip(units, taken, strict=True):
        assert abs(t / reps - p) <= 3.5 * (p * (1 - p) / reps) ** 0.5
    assert max(abs(w - sum(w * p for w, p in units)) for w in words) < 1e-6 * sum(w for w, _ in units)


def test_the_tree_keeps_expectations_over_seeds(spark, monkeypatch):
    """Documents of a whole mix, through several levels of small groups: copies average to the rate over seeds."""
    monkeypatch.setattr(mixing, "FAN", 4)
    docs = spark.createDataFrame([(k, " ".join(["w"] * (1 + k * 7 % 23)), "ab"[k % 2]) for k in range(40)], COLUMNS).cache()
    total, seeds = Counter(), 12
    for seed in range(seeds):
        rows = mixing.mix(docs, seed).collect()
        for r in rows:
            total[r["doc_id"]] += r["copies"]
    z = []
    for r in rows:
        rate = r["target"] / r["source_size"]
        part = rate - int(rate)
        z.append((total[r["doc_id"]] / seeds - rate) / max((part * (1 - part) / seeds) ** 0.5, 1e-9) if part > 1e-9 else 0.0)
    assert max(map(abs, z)) <= 4 and abs(sum(z)) / len(z) ** 0.5 <= 4
