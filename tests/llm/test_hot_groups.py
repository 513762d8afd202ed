"""Large groups of copies in the join, and many rows of one id or none among fingerprints."""

import hashlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from surveymend.llm import fingerprints, ngram_join


@pytest.mark.parametrize(("groups", "hot"), [(0, 3), (0, 1000), (150_000, 3)])
def test_large_groups_of_copies(spark, monkeypatch, groups, hot):
    monkeypatch.setattr(ngram_join, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    words = [f"w{k}" for k in range(60)]
    near = " ".join(words[:-1] + ["other"])
    rows = [(100 + i, " ".join(words)) for i in range(90)] + [(50 + i, near) for i in range(5)] + [(300 + i, "") for i in range(40)] + [(400 + i, None) for i in range(40)] + [(None, " ".join(words))] * 9 + [(900, "alone in here"), (901, " ".join(words[:-1] + ["third"])), (901, " ".join(words[:-1] + ["third"]))]
    got = [tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    for doc, n, component, n_links in got:
        if doc is None:
            assert component is None and n == 56
        elif doc < 200 or doc == 901:
            assert (n, component) == (56, 50) and n_links > 0
        else:
            assert component == doc and n == (1 if doc == 900 else 0) and n_links == 0


def test_copies_dont_meet_in_one_task(spark, monkeypatch):
    """Rows of a hot group, and documents without words, stay in the partitions that they are in."""
    monkeypatch.setattr(ngram_join, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(ngram_join, "HOT", 50)
    doc = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 7L, if(id % 3 = 1, 0L, id)) as n", "if(id % 3 = 0, 1L, if(id % 3 = 1, 0L, id)) as s1", "0L as s2").repartition(8).cache()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        members, hot = ngram_join._members(doc, 4000)
        sizes = members.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r[0] for r in hot.collect()] == [0] and members.filter("hot and rep = 0").count() == 1334
    assert sum(sizes) == 4000 and max(sizes) <= 600


@pytest.mark.parametrize("ids", ["null", "one", "several", "mixed"])
def test_missing_and_repeated_ids_are_dealt_out(spark, ids):
    """Edited texts and likeness follow the order of (id, hash of text, text), and no task gets all rows of an id or none."""
    of = {"null": lambda k: None if k % 4 else k, "one": lambda k: 77, "several": lambda k: (5, 9, None, 1000 + k)[k % 4], "mixed": lambda k: (None, k, 300, k // 2)[k % 4]}[ids]
    rows = [(of(k), f"text {k % 190} of some words\nline {k}" if k % 11 else (None, "")[k % 2]) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))
    want = Counter()
    for k, r in enumerate(order):
        t, after = r["text"], order[(k + 1) % len(order)]["text"]
        want[r["doc_id"], len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    out = fingerprints.compare(docs, 12, 40)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        sizes = [r["n"] for r in fingerprints.compare(docs, 12, 40).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 800 and max(sizes) < 400
