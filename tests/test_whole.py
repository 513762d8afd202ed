"""Queries over whole tables and texts, against DuckDB or brute force on the smallest tables."""

import os

import duckdb
import pytest

from surveymend.operators import match
from surveymend.plans import catalog
from surveymend.plans.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", ["fold_text", "neighbourhood_hint", "taxonomy", "structure_type", "taxonomy_align", "inverted_index", "sort_multi", "street_lookup", "vec_top1", "rag_augment"])
def test_sql_leaves_no_rows_or_characters_out(name):
    sql = catalog.ORACLES[name]
    assert "substr(text" not in sql and "LIMIT" not in sql and "% 10 = 0" not in sql and "% 50 = 0" not in sql


def test_whole_texts_are_parsed(spark, duck):
    asked = duck.sql("select doc_id, concat(regexp_replace(text, '[^A-Za-zæøåÆØÅ ]', '', 'g'), 'vej ', doc_id % 90 + 1, ', ', doc_id % 9000 + 1000, ' Odense') from documents").fetchall()
    got = catalog.QUERIES["parse_address"](spark, SF)
    assert rows(got, ["doc_id", "street", "house", "postnr"]) == sorted(repr((i, *match.parse(t))) for i, t in asked)


def test_all_vectors_are_candidates(spark, duck):
    import numpy as np

    ids, x = zip(*duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall(), strict=True)
    x = np.array(x, float)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    got = {r["query_id"]: r for r in catalog.QUERIES["vec_top1"](spark, SF).collect()}
    assert sorted(got) == list(ids)
    for k, i in enumerate(ids):
        near = ids.index(got[i]["vec_id"])
        assert near != k and abs(s[k].max() - s[k, near]) < 1e-9 and abs(got[i]["score"] - s[k].max()) < 1e-6
    assert any(r["vec_id"] % 10 == 0 for r in got.values())
    for r in catalog.QUERIES["rag_augment"](spark, SF).collect():
        assert (r["start_match"], r["start_score"]) == (got[r["turid"] % 20 * 10]["vec_id"], got[r["turid"] % 20 * 10]["score"])


def test_all_addresses_are_asked(spark):
    v = catalog.Views(spark, SF)
    names = v.registry.select("postnr", catalog.tx.fold(catalog.c("vejnavn")).alias("s")).distinct().collect()
    asked = catalog._parsed(v).select("text", "q_norm", "postnr").collect()
    assert len(asked) == v.registry.count()
    order = lambda block: sorted({r["s"] for r in names if block in (None, r["postnr"])})

    def found(q, block, top):
        scored = [(-match.weighted_ratio(q, n), n) for n in order(block)]
        return [(s, k, n) for k, (s, n) in enumerate(sorted(x for x in scored if -x[0] >= match.CUTOFF)[:top], 1)]

    want = {(q, b, n, -s, k) for q, b in {(r["q_norm"], r["postnr"]) for r in asked} for s, k, n in found(q, b, match.TOP_STREETS) or found(q, None, match.TOP_STREETS)}
    assert {tuple(r) for r in catalog.QUERIES["blocked_fuzzy"](spark, SF).collect()} == want
    want = {(q, n, -s, k) for q in {r["q_norm"] for r in asked} for s, k, n in found(q, None, match.TOP_STREETS)}
    assert {tuple(r) for r in catalog.QUERIES["fuzzy_topk"](spark, SF).collect()} == want
    assert {r["text"] for r in catalog.QUERIES["retrieve"](spark, SF).select("text").distinct().collect()} == {r["text"] for r in asked}
