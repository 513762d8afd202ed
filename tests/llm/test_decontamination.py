"""The positional index against scanning every place of every text."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from surveymend.llm import decontamination, queries
from surveymend.llm.common import cut

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UPPER))


def near_at(w, window, slack):
    """Whether from some place on every word of a window is within the slack of its own place."""
    at = {}
    for k, x in enumerate(w):
        at.setdefault(x, set()).add(k)
    return any(all(any(s + j + d in at.get(x, ()) for d in range(-slack, slack + 1)) for j, x in enumerate(window)) for s in range(-slack, len(w) + slack))


def direct(docs, items, size=10, slack=2):
    asked = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            asked.setdefault(tuple(w[k : k + size]), set()).add(None if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found, near = words(t), set(), set(), set()
        for win, of in asked.items():
            at = [k for k in range(len(w) - len(win) + 1) if tuple(w[k : k + len(win)]) == win]
            hit.update(p for k in at for p in range(k, k + len(win)))
            found |= of if at else set()
            near |= of if near_at(w, win, slack) else set()
        found.discard(None)
        near.discard(None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


P = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, P), (2, "One Two three"), (3, None), (4, " .,; "), (5, "ALPHA-beta;gamma delta/epsilon zeta eta theta iota kappa"), (None, "no id words of the tenth and last item here now"), (1, "the the the the the the the the the the"), (10, "solo"), (11, "日本 語 テキスト")]
DOCS = [
    (1, f"x {P.upper()} y {P}"), (2, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (3, None), (4, ""), (5, "one, two. THREE one two"), (6, "the " * 25), (7, "alpha beta gamma"), (8, "delta epsilon zeta eta theta iota kappa lambda mu nu"),
    (None, P), (1, f"x {P.upper()} y {P}"), (9, "no id words of the tenth and last item here now"), (10, "solo solo é"), (11, "日本,語,テキスト x"), (12, "alpha beta extra gamma delta epsilon zeta eta theta iota kappa more"), (13, "beta alpha gamma delta epsilon zeta eta iota theta kappa"),
    (14, " \n"), (15, "alphabeta gamma"), (16, "two three one"), (17, "Kİ K one two three"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, n_hit string").repartition(3), spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, window int")


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("shard,block,slack", [(1 << 18, 250_000, 2), (3, 4, 1), (40, 1, 3), (5, 7, 0)])
def test_equals_scanning(spark, tables, shard, block, slack):
    docs, items = tables
    got = rows(decontamination.search(cut(decontamination.build(docs, shard)), items, slack=slack, block=block))
    assert got == direct(DOCS, ITEMS, slack=slack)


def test_short_windows(spark, tables):
    docs, items = tables
    assert rows(decontamination.search(cut(decontamination.build(docs)), items, size=3)) == direct(DOCS, ITEMS, size=3)


def test_empty_tables(spark, tables):
    docs, items = tables
    assert decontamination.scan(docs.limit(0), items).collect() == []
    got = decontamination.scan(docs, items.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r["contaminated"] or r["n_hit"] or r["n_near_items"] for r in got)


def test_random_texts_of_few_words(spark):
    rng = np.random.default_rng(4)
    docs = [(k, " ".join(rng.choice(list("abcd"), rng.integers(0, 60)))) for k in range(60)]
    items = [(f"i{k}", " ".join(rng.choice(list("abcde"), rng.integers(0, 14)))) for k in range(25)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string")
    assert rows(decontamination.search(cut(decontamination.build(d, 100)), i, size=4, slack=1, block=9)) == direct(docs, items, 4, 1)


def test_a_long_text_and_frequent_words(spark, monkeypatch):
    text = "the of and " * 30_000 + P + " the of and" * 30_000
    docs, items = [(1, text), (2, "the of and")], [(1, P), (2, "the of and the of and the of and the of"), (3, "of")]
    monkeypatch.setattr(decontamination, "CANDIDATES", 1000)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.scan(d, i, slack=0).collect()}
    w = words(text)
    # No window ends with "and", so the last words before the passage and at the end aren't hit.
    assert got[1]["n_words"] == len(w) and got[1]["n_hit"] == len(w) - 2 and got[1]["n_items"] == 3 and got[2]["n_hit"] == 1


def test_ranges_are_united():
    b, e = np.array([5, 0, 3, 9, 20]), np.array([8, 2, 6, 10, 30])
    assert decontamination.ranges(b, e).tolist() == [[0, 2], [3, 8], [9, 10], [20, 30]]


def test_query_and_sql_agree(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op13_decontamination", "op12_centroids"):
        df = queries.queries()[name](spark, sf)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        assert got == sorted(map(repr, con.sql(queries.oracle_sql()[name]).select(*columns).fetchall()))
    exact = {r["doc_id"]: r["n_items"] for r in queries.queries()["op13_decontamination"](spark, sf).collect()}
    near = queries.queries()["near_passages"](spark, sf).collect()
    assert {r["doc_id"]: r["n_items"] for r in near} == exact and all(r["n_near_items"] >= r["n_items"] for r in near)
