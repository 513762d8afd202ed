import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveymend.functions import bins, geo
from surveymend.functions import text as tx
from surveymend.operators import match


def values(spark, schema, rows, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_bounds_and_missing_coordinates(spark):
    rows = [(54.5, 8.0), (57.8, 15.2), (54.49, 8.0), (None, 9.0)]
    assert values(spark, "a double, b double", rows, geo.in_bounds(F.col("a"), F.col("b"))) == [(True,), (True,), (False,), (False,)]


def test_speed_flags(spark):
    rows = [(4.0, 15, 1), (3.75, 15, 1), (10.0, 0, 1), (61.0, 60, 2), (181.0, 60, 3), (500.0, 60, 26), (None, 5, 1), (9.0, None, 1)]
    got = values(spark, "km double, m int, k int", rows, geo.speed_bad(F.col("km"), F.col("m"), F.col("k")))
    assert [g[0] for g in got] == [True, False, False, True, True, False, False, False]


def test_guarded_speed_and_plausibility(spark):
    s = geo.guarded_speed(F.col("km"), F.col("m"))
    got = values(spark, "km double, m int, k int", [(1.0, 0, 1), (1.0, None, 1), (1.0, 6, 1)], s, geo.realistic(s, F.col("k")), geo.impossible(s, F.col("k")))
    assert got == [(9999.0, False, True), (None, False, False), (10.0, True, False)]


def test_haversine_is_symmetric_and_right(spark):
    a, b = (F.col(x) for x in ("a", "b"))
    got = values(spark, "a double, b double, c double, d double", [(55.0, 9.0, 56.0, 10.0), (55.0, 9.0, 55.0, 9.0)], geo.haversine(a, b, F.col("c"), F.col("d")), geo.haversine(F.col("c"), F.col("d"), a, b))
    p, q = math.radians(55), math.radians(56)
    want = 2 * 6371 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(0.5)) ** 2))
    assert got[0][0] == pytest.approx(want) and got[0][0] == pytest.approx(got[0][1]) and got[1][0] == 0


def test_utm_round_trip(spark):
    places = [(54.6 + i * 0.3, 8.1 + j * 0.7) for i in range(10) for j in range(10)]
    rows = [(*geo.latlon_to_utm(*p), *p) for p in places]
    lat, lon = geo.utm_to_latlon(F.col("e"), F.col("n"))
    for a, b, x, y in values(spark, "e double, n double, x double, y double", rows, lat, lon, "x", "y"):
        assert abs(a - x) < 1e-7 and abs(b - y) < 1e-7
    assert values(spark, "e double, n double", [(None, 1.0)], *geo.utm_to_latlon(F.col("e"), F.col("n"))) == [(None, None)]


def test_right_closed_cuts(spark):
    rows = [(0.0,), (2.0,), (2.1,), (10.0,), (9999.0,), (10000.0,), (None,)]
    got = values(spark, "x double", rows, bins.cut_right(F.col("x"), bins.LENGTH_EDGES, bins.LENGTH_LABELS), bins.unified_length(F.col("x")))
    assert [g[0] for g in got] == [None, "Short", "Medium", "Medium", "Long", None, None]
    assert [g[1] for g in got] == ["Short", "Medium", "Medium", "Medium", "Long", "Long", "Unknown"]


def test_unified_bias_at_zero(spark):
    got = values(spark, "u double, s double", [(1.0, 0.0), (0.0, 0.0), (1.2, 1.0), (0.7, 1.0), (None, 1.0)], bins.unified_bias(F.col("u"), F.col("s")))
    assert [g[0] for g in got][:2] == ["Overestimated", "Accurate"] and got[3][0] == "Underestimated" and got[4][0] == "Accurate"


def test_fold_keeps_danish_letters(spark):
    assert values(spark, "t string", [("  Ærø-Å é! ",), (None,)], tx.fold(F.col("t"))) == [("ærøa e",), (None,)]


def test_notes_and_scores(spark):
    n = F.col("n")
    got = values(spark, "n string", [("start_fix(80);end_fix(91)",), ("osrm_recalc",), (None,)], tx.note_score(n), tx.note_score(n, "mean", None), tx.note_score(n, "first"))
    assert got == [(91.0, 85.5, 80.0), (0.0, None, 0.0), (0.0, None, 0.0)]


def test_classes(spark):
    t = F.col("t")
    got = values(spark, "t string", [("ab",), ("Ved ikke",), ("min skole",), (None,), ("en to tre fire fem",), ("Ringvej 5",), ("Ringvej",)], tx.failure_class(t), tx.structure_class(t))
    assert [g[0] for g in got][:4] == [tx.FAILURES[0], tx.FAILURES[1], tx.FAILURES[2], tx.FAILURES[3]]
    assert [g[1] for g in got][4:] == [tx.STRUCTURES[0], tx.STRUCTURES[1], tx.STRUCTURES[2]]


def test_neighbourhood_order_and_verdict(spark):
    got = values(spark, "t string", [("Kbh S",), ("nørrebro",), ("Valby amager",), ("x",)], tx.hint(F.col("t")), tx.verdict(F.col("t")))
    assert got == [("2300", "VALID"), ("2200", "VALID"), ("2300", "VALID"), (None, "VALID")]
    assert values(spark, "t string", [("Verdict: invalid",), (None,)], tx.verdict(F.col("t"))) == [("INVALID",), ("VALID",)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Nørregade 12B, 1165 København", ("Nørregade", "12b", "1165")),
        ("hjemme på Ringvej 5", ("hjemme på Ringvej", "5", None)),
        ("Vesterbro station", ("Vesterbro station", "", "1620")),
        ("", ("", "", None)),
        (None, ("", "", None)),
    ],
)
def test_parse_addresses(raw, want):
    assert match.parse(raw) == want


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcø ", max_size=30), st.text("abcø ", max_size=30))
def test_similarity_bounds(a, b):
    assert match._common(a, b) == brute_common(a, b)
    assert match.indel_ratio(a, b) == match.indel_ratio(b, a)
    assert 0 <= match.weighted_ratio(a, b) <= 100
    if a.strip():
        assert match.weighted_ratio(a, a) == 100


def test_weighted_ratio_known():
    assert match.weighted_ratio("", "x") == 0
    assert match.weighted_ratio("ringvej", "ringvejen") == pytest.approx(87.5)
    assert match.weighted_ratio("vej ring", "ring vej") == pytest.approx(95)


def test_classes_of_odd_texts(spark):
    """Words are parts at white space, as split gives them; words of classes may stand anywhere."""
    texts = ["a b c d e", "a b c d", "\na b c d", "a\tb c\n\nd ", "a b c d\n", " a b c d ", "", None, "x", "vej 1", "Strandvej", "PRIVAT", "xhjemx", "ved  ikke", "a  b   c    d", "\u00a0a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = tx.F.trim(tx.F.lower(tx.F.coalesce("t", tx.F.lit("nan"))))
    for r in df.select("t", tx.structure_class(df["t"]).alias("s"), tx.failure_class(df["t"]).alias("f"), tx.F.size(tx.F.split(old, r"\s+")).alias("n"), old.alias("o")).collect():
        said = any(m in r["o"] for m in tx.MARKERS)
        assert r["s"] == tx.STRUCTURES[0 if r["n"] >= 5 else 1 if said and any(c.isdigit() for c in r["o"]) else 2 if said else 3]
        assert r["f"] == tx.FAILURES[0 if len(r["o"]) < 3 else 1 if any(w in r["o"] for w in tx.PRIVATE) else 2 if any(w in r["o"] for w in tx.SEMANTIC) else 3]
