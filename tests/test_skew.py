"""Plans on hot and missing keys, and exact results of the operators that avoid them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveymend.operators import match, relational, repair, stats


@pytest.fixture
def plain(spark):
    """Sixteen shuffle partitions, without adaptive execution and automatic broadcasts."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "16"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks(df):
    return sorted(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_rows_without_a_route_are_spread(spark, plain):
    trips = spark.range(40_000).selectExpr("id as turid", "if(id % 6 = 1, 'INVALID', 'VALID') as llm_verdict", "id % 27 as transportmiddel", "55 + (id % 400) / 200 as rag_start_lat", "9 + (id % 300) / 100 as rag_start_lon", "55.5D as rag_end_lat", "if(id % 9 = 0, null, 10.0D) as rag_end_lon")
    out = repair.rag_repair(trips)
    sizes = tasks(out)
    assert sum(sizes) == 40_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert out.filter("llm_verdict = 'corrected'").count() == trips.filter("llm_verdict = 'INVALID' and rag_end_lon is not null and transportmiddel between 1 and 25").count()


def test_hot_texts_are_spread(spark, plain):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "home").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
    right = spark.range(500).select(F.concat(F.lit("t"), F.col("id")).alias("text"), F.col("id").alias("n")).unionByName(spark.createDataFrame([("home", -1)], "text string, n long"))
    out = relational.lookup_join(left, right, ["text"], relational.SPREAD)
    sizes = tasks(out)
    assert out.columns == ["id", "text", "n"] and sum(sizes) == 20_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, left.join(right, "text", "left").select("id", "text", "n").collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 298, 5000])
def test_quantiles_are_exact(spark, monkeypatch, n):
    monkeypatch.setattr(stats, "ACCURACY", 100)
    rng = random.Random(n)
    rows = [(g, None if rng.random() < 0.1 else round(rng.gauss(0, 5), rng.choice([0, 1, 6]))) for g in ("a", "b", None) for _ in range(n)]
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g and v is not None]
        if values:
            assert got[g]["n"] == len(values)
            assert [got[g][f"q{k}"] for k in range(len(shares))] == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-9)
    everything = [v for _, v in rows if v is not None]
    if everything:
        one = stats.quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", [0.25, 0.9]).first()
        assert [one["q0"], one["q1"]] == pytest.approx(np.quantile(everything, [0.25, 0.9]).tolist(), abs=1e-9)


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert stats.describe(none, "v").first().asDict() == dict.fromkeys(["mean", "std", "least", "q25", "q50", "q75", "most"]) | {"n": 0}
    assert stats.box(none, "g", "v").collect() == [] and stats.value_counts(none, "g").collect() == []


def test_balanced_sample_equals_a_full_ranking(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 10 == 0, "x").when(F.col("id") % 10 < 4, None).otherwise("z").alias("label"))
    order = F.row_number().over(relational.Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("-42"))), "id"))
    want = sorted(r[0] for r in df.withColumn("k", order).filter("k <= 600").select("id").collect())
    assert sorted(r[0] for r in relational.balanced_sample(df, "label", "id").select("id").collect()) == want and len(want) == 1800


def test_bound_loses_no_street():
    rng = random.Random(8)
    words = ["vester", "ny", "gade", "gaden", "allé", "skov", "vej", "sønder", "a", "park", "strandvejen"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", "vej", "gade"]) for _ in range(400)})
    part = match.Names(names)
    for _ in range(60):
        q = rng.choice(names)[rng.randint(0, 3) :] + rng.choice(["", "x", " nord"])
        if q.strip():
            kept = {names[i] for i in part.possible(q, match.CUTOFF)}
            assert {n for n in names if match.weighted_ratio(q, n) >= match.CUTOFF} <= kept


def test_retrieval_equals_scoring_every_row(spark, monkeypatch):
    monkeypatch.setattr(match, "STREET_ROWS", 7)
    monkeypatch.setattr(match, "PART", 5)
    rng = random.Random(1)
    streets = ["Nørregade", "Nørre gade", "Nygade", "Vestergade", "Sky", "Åvej", "Skovvejen", "Skovvej"]
    registry = [(k, rng.choice(streets), rng.choice([str(rng.randint(1, 40)), f"{rng.randint(1, 40)}B", None]), rng.choice(["1200", "2300", "8000", "5000", None]), "By") for k in range(300)]
    reg = spark.createDataFrame(registry, "row_id long, vejnavn string, husnr string, postnr string, postnrnavn string")
    asked = [f"{rng.choice(streets)} {rng.randint(1, 40)}{rng.choice(['', ', 1200', ', 8000 By', ', 9999'])}" for _ in range(40)] + ["Nørregade", "qqq", ""]
    texts = spark.createDataFrame([(t,) for t in asked], "text string")
    got = match.retrieve(texts, reg, top=3)
    # All rows of all hit streets, scored by the same expressions.
    q = match.parse_addresses(texts.distinct(), "text").withColumn("q_norm", match.tx.fold(F.col("street"))).filter("q_norm <> ''").withColumn("block", F.col("postnr"))
    hits = match.blocked_streets(q, reg).withColumnsRenamed({"block": "b", "q_norm": "qn"})
    every = q.join(hits, (q["q_norm"] == hits["qn"]) & q["block"].eqNullSafe(hits["b"])).join(reg.withColumn("street_norm", match.tx.fold(F.col("vejnavn"))).withColumnRenamed("postnr", "r"), "street_norm")
    same = F.col("postnr") == F.col("r")
    every = every.withColumn("score", match.total_score(F.col("street_score"), F.col("vejnavn"), F.col("q_norm"), F.col("house"), F.col("husnr"), same)).withColumn("o", F.col("score") + F.when(same, 100).otherwise(0))
    best: dict = {}
    for r in every.select("text", "r", "row_id", "score", "o", "street_rank").collect():
        best.setdefault(r["text"], {}).setdefault(r["r"], []).append((-r["score"], r["street_rank"], r["row_id"], -r["o"]))
    want = set()
    for t, posts in best.items():
        ranked = sorted((o, s, k, i) for s, k, i, o in (min(rows) for rows in posts.values()))[:3]
        want |= {(t, n, i, -s) for n, (o, s, k, i) in enumerate(ranked, 1)}
    assert {(r["text"], r["rank"], r["row_id"], r["score"]) for r in got.collect()} == want and want
