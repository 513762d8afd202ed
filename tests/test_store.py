"""Stored vectors and stored house index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveymend.operators import store, vectors


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)


def rows(df):
    return sorted((r["vec_id"], tuple(r["v"])) for r in df.collect())


@pytest.fixture
def data():
    return np.random.default_rng(3).normal(size=(300, 6))


def test_built_twice_appended_and_read_in_a_new_session(spark, tmp_path, data):
    s = store.VectorStore(spark, str(tmp_path / "x"))
    s.build(frame(spark, data[:200]))
    s.build(frame(spark, data[:200]))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "x").rglob("*.parquet")}
    s.append(frame(spark, data[200:], 200))
    # Nothing that was there has been written again.
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    one = store.VectorStore(spark, str(tmp_path / "one"))
    one.build(frame(spark, data))
    again = store.VectorStore(spark.newSession(), str(tmp_path / "x"))
    assert rows(again.read()) == rows(one.read()) == [(i, tuple(v)) for i, v in enumerate(data.tolist())]
    asked = spark.createDataFrame([(5,), (250,), (5,), (9999,), (None,)], "vec_id long")
    assert rows(again.reconstruct(asked)) == [(5, tuple(data[5].tolist())), (250, tuple(data[250].tolist()))]
    q = frame(spark, data[:40]).withColumnRenamed("vec_id", "query_id")
    answers = lambda df: sorted(map(tuple, df.collect()))
    assert answers(again.search(q.select("query_id", "v"), 3)) == answers(vectors.nearest_rows(q, frame(spark, data), 3))
    assert again.manifest().count() == 3 and again.generation() == 2
    assert again.vacuum() == 1 and rows(again.read()) == rows(one.read())


def test_a_write_that_broke_off_is_not_read(spark, tmp_path, data):
    s = store.VectorStore(spark, str(tmp_path / "x"))
    assert s.manifest().count() == 0 and s.generation() == 0
    with pytest.raises(ValueError):
        s.read()
    s.append(frame(spark, data[:10]))
    frame(spark, data[10:20], 10).write.parquet(str(tmp_path / "x" / "parts" / "broken"))
    bad = frame(spark, data[:4]).withColumn("v", F.when(F.col("vec_id") == 2, F.array(F.lit(1.0))).otherwise(F.col("v")))
    with pytest.raises(ValueError):
        s.append(bad)
    with pytest.raises(ValueError):
        s.append(frame(spark, data[:4]).withColumn("v", F.col("v").cast("array<float>")))
    with pytest.raises(ValueError):
        s.append(frame(spark, data[:4, :3]))
    assert len(rows(s.read())) == 10 and s.vacuum() == 3 and len(rows(s.read())) == 10


def test_nulls_repeats_and_empty_appends(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "x"))
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [3.0, 4.0])], "vec_id long, v array<double>")
    s.build(df)
    s.append(df.limit(0))
    assert s.read().count() == 3 and s.reconstruct(spark.createDataFrame([(1,)], "vec_id long")).count() == 2


def test_an_id_reads_few_row_groups(spark, tmp_path, data):
    s = store.VectorStore(spark, str(tmp_path / "x"))
    s.build(frame(spark, data))
    plan = s.read().filter("vec_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vec_id,7)" in plan


REGISTRY = [(1, "Nørregade", "12"), (2, "NØRREGADE", "12"), (3, "Nørregade", "12B"), (4, None, "1"), (5, "Ågade", None), (6, "Sky-vej", "3")]


def test_lookups_equal_a_join_and_leave_the_registry_in_place(spark):
    reg = spark.createDataFrame(REGISTRY, "row_id long, vejnavn string, husnr string")
    index = store.HouseIndex.build(reg, "houses_test", 4)
    try:
        asked = spark.createDataFrame([(1, "nørregade", "12"), (2, "Nørregade", "12b"), (3, None, "1"), (4, "Ågade", None), (5, "x", "1"), (6, "nørregade", "12"), (7, "Skyvej", "3")], "k long, street string, house string")
        got = sorted((r["k"], r["row_id"]) for r in index.lookup(asked).collect())
        assert got == [(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (6, 1), (6, 2), (7, 6)]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = index.rows().join(asked.select(F.col("street").alias("street_norm"), "house").distinct().hint("merge"), ["street_norm", "house"])._jdf.queryExecution().executedPlan().toString()
        registry_side = plan[: plan.index("FileScan parquet")]
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 2
        # From the join down to the scan of the table there is no exchange.
        branch = plan[plan.index("SortMergeJoin") :].split("FileScan parquet")[0]
        assert "Exchange" not in branch and registry_side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.drop()


def test_a_second_build_replaces_the_table(spark):
    reg = spark.createDataFrame(REGISTRY, "row_id long, vejnavn string, husnr string")
    store.HouseIndex.build(reg, "houses_test2", 2)
    index = store.HouseIndex.build(reg.filter("row_id = 6"), "houses_test2", 2)
    assert index.rows().count() == 1
    asked = spark.createDataFrame([("Skyvej", "3", "mine")], "street string, house string, row_id string")
    assert [(r["row_id"], r["r_row_id"]) for r in index.lookup(asked).collect()] == [("mine", 6)]
    index.drop()
