import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from surveymend.operators import match, prompts, relational, repair, stats, vectors
from surveymend.sources import files, rest
from surveymend.streaming import validation


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def pair(spark):
    return spark.createDataFrame([(1, 1, 1, "a", "a"), (2, 1, 2, None, "b"), (3, 1, None, "a", None), (4, None, 5, "a", "c")], "k long, x_raw long, x_mod long, y_raw string, y_mod string")


def test_diff_modes(pair):
    got = {r["k"]: (r["changed_cols"], r["n_changed"], r["row_flag"]) for r in relational.diff(pair).collect()}
    assert got == {1: ([], 0, "OK"), 2: (["x"], 1, "WRONG"), 3: ([], 0, "OK"), 4: (["y"], 1, "WRONG")}
    got = {r["k"]: r["changed_cols"] for r in relational.diff(pair, nulls_count=True).collect()}
    assert got == {1: [], 2: ["x", "y"], 3: [], 4: ["x", "y"]}
    assert rows(relational.diff_long(pair, ["k"])) == [(2, "x", "1", "2"), (4, "y", "a", "c")]


def test_overlay_and_update_never_lose_values(spark, pair):
    assert rows(relational.overlay(pair, ["x", "y"])) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "a"), (4, 5, "c")]
    new = spark.createDataFrame([(1, None, "n1"), (2, 9, None)], "k long, x_raw long, note string")
    got = {r["k"]: (r["x_raw"], r["note"]) for r in relational.update_join(pair, new, ["k"]).collect()}
    assert got == {1: (1, "n1"), 2: (9, None), 3: (1, None), 4: (None, None)}


def test_stage_join_fans_out(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "turid long, delturnr long, km long")
    assert relational.join_suffixed(a, a, ["turid"]).count() == 4
    both = relational.join_suffixed(a, a, ["turid", "delturnr"])
    assert both.count() == 2 and set(both.columns) == {"turid", "delturnr", "km_raw", "km_mod"}


def test_venn_adds_up(spark):
    a, b = spark.range(0, 10).toDF("k"), spark.range(5, 20).toDF("k")
    assert rows(relational.venn(a.unionByName(a), b, "k")) == [(5, 10, 5)]


def test_start_propagation_falls_back(spark):
    df = spark.createDataFrame([(1, 1, "a", "s"), (1, 2, None, "t"), (1, 3, "c", "u"), (2, 1, "d", "v")], "s long, k long, to string, start string")
    out = relational.previous_or_own(df, {"start": "to"}, ["s"], ["k"])
    assert [r["start"] for r in out.orderBy("s", "k").collect()] == ["s", "a", "u", "v"]


def test_balanced_sample_and_resume(spark):
    df = spark.range(30).withColumn("c", F.when(F.col("id") < 7, "x").otherwise("y"))
    s = relational.balanced_sample(df, "c", "id")
    assert rows(s.groupBy("c").count()) == [("x", 7), ("y", 7)] and rows(s) == rows(relational.balanced_sample(df, "c", "id"))
    assert relational.remaining(df, s, ["id"]).count() == 16


def test_crosstab_rows_sum_to_100(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q"), ("b", "q")], "r string, c string")
    assert rows(stats.crosstab_pct(df, "r", "c", ["p", "q", "z"])) == [("a", pytest.approx(100 / 3), pytest.approx(200 / 3), 0.0), ("b", 0.0, 100.0, 0.0)]


def test_empty_bins_stay(spark):
    df = spark.createDataFrame([(0, True), (0, False), (2, True)], "b int, f boolean")
    assert rows(stats.rate_by_bin(df, F.col("f"), F.col("b"), 4)) == [(0, 2, 0.5), (1, 0, None), (2, 1, 1.0), (3, 0, None)]


TRIP = "turid long, start_lat double, start_lon double, til_lat double, til_lon double, home_lat double, home_lon double, stagelength_raw double, stagedurationmin_raw double, transportmiddel int, startTripText_raw string, tiladrtext_raw string"


@pytest.fixture
def trips(spark):
    at = (55.0, 9.0, 55.1, 9.1, 55.0, 9.0)
    return spark.createDataFrame(
        [
            (1, *at, 14.0, 30.0, 11, "Aby", "Bby"),
            (2, None, 9.0, 55.1, 9.1, 55.0, 9.0, 14.0, 30.0, 11, "Aby", "nowhere"),
            (3, *at, 14.0, 5.0, 1, "Aby", "Bby"),
            (4, 55.0, 9.0, 55.0, 9.0, 55.0, 9.0, 200.0, 30.0, 11, "Aby", "Bby"),
            (5, None, 9.0, 55.1, 9.1, 55.0, 9.0, 1.0, 30.0, 11, "nowhere", None),
            (6, *at, 14.0, 5.0, 26, "Aby", "Bby"),
            (7, None, 9.0, 55.1, 9.1, 55.0, 9.0, 14.0, 1.0, 99, "Aby", None),
        ],
        TRIP,
    )


def test_repair_states(spark, trips):
    checked = repair.fast_validation(trips)
    status = {r["turid"]: r["validation_status"] for r in checked.collect()}
    assert status == {1: "trusted", 2: "hard_wrong", 3: "hard_wrong", 4: "hard_wrong", 5: "hard_wrong", 6: "trusted", 7: "hard_wrong"}
    lookup = spark.createDataFrame([("Aby", 55.5, 9.5, 90.0)], "text string, lat double, lon double, precision double")
    got = {r["turid"]: r for r in repair.det_repair(checked, lookup).collect()}
    assert len(got) == 7
    assert (got[2]["note_correction"], got[2]["validation_status"], got[2]["corrected_start_lat"]) == ("start_fix(90);osrm_recalc", "corrected", 55.5)
    assert (got[3]["note_correction"], got[3]["validation_status"]) == ("osrm_recalc", "corrected")
    assert (got[4]["note_correction"], got[4]["validation_status"]) == ("skipped_zero_dist", "hard_wrong")
    assert (got[5]["note_correction"], got[5]["validation_status"]) == (None, "hard_wrong")
    assert (got[7]["note_correction"], got[7]["validation_status"]) == ("start_fix(90);osrm_api_fail", "hard_wrong")
    assert got[1]["note_correction"] is None and got[1]["corrected_dist_km"] is None


def test_routes_run_once_a_key(spark, trips):
    seen = []

    def provider(keys):
        seen.append(keys.count())
        return repair.haversine_routes(keys)

    out = repair.with_routes(trips.unionByName(trips), ("start_lat", "start_lon", "til_lat", "til_lon"), "transportmiddel", provider)
    assert out.count() == 14 and seen == [4]


def test_prompts(trips):
    checked = repair.fast_validation(trips)
    got = {r["turid"]: r for r in prompts.prompt(prompts.training_entry(checked)).collect()}
    assert got[1]["output"].startswith("Verdict: VALID")
    assert got[3]["output"] == "Verdict: INVALID\nAnalysis: Speed is unrealistic. 168 km/h is too fast for mode 'Walk'."
    assert "Zero distance error." in got[4]["output"] and "To: nan" in got[5]["input"] and "To: Unknown Dest" in got[5]["prompt_text"]
    assert got[1]["prompt_text"].endswith("### Response:\n")


REGISTRY = [(1, "Nørregade", "12", "1165", "København"), (2, "Nørregade", "14", "1165", "København"), (3, "Nørregade", "12", "5000", "Odense"), (4, "Søndergade", "12", "5000", "Odense"), (5, "Vestergade", "1", "8000", "Aarhus")]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([(*r, 55.0 + r[0], 9.0) for r in REGISTRY], "row_id long, vejnavn string, husnr string, postnr string, postnrnavn string, lat double, lon double")


def test_retrieve_ranks_the_asked_postcode_first(spark, registry):
    texts = spark.createDataFrame([("Nørregade 12, 1165 København",), ("Nørregade 12, 1165 København",), ("Vestregade 1, 9999 X",), (None,), ("",)], "text string")
    got = match.retrieve(texts, registry).orderBy("text", "rank").collect()
    first = [r for r in got if r["text"].startswith("Nør")]
    # The asked postcode has a street above the cutoff, so other postcodes come only by streets of the same name.
    assert (first[0]["row_id"], first[0]["precision"]) == (1, 100.0) and [r["row_id"] for r in first] == [1, 3]
    assert first[1]["precision"] == 80.0
    wide = [r for r in got if r["text"].startswith("Vest")]
    assert wide[0]["row_id"] == 5 and 30 <= wide[0]["precision"] <= 65
    found = match.resolve(texts, registry).collect()
    assert {r["text"]: r["lat"] for r in found}["Nørregade 12, 1165 København"] == 56.0


def test_nearest_rows_match_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = vectors.nearest_rows(df.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id"), df.filter("vec_id >= 20"), 3)
    best = {}
    for r in got.collect():
        best.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(20):
        assert best[q] == {int(i) + 20 for i in np.argsort(-(x[20:] @ x[q]))[:3]}


def test_csv_text_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "æøå\n\"q\"", ""), (2, None, "x,y")], "k int, a string, b string")
    files.write_csv(df, str(tmp_path / "u"))
    assert rows(files.read_csv(spark, str(tmp_path / "u"), "k int, a string, b string"))[0][:2] == (1, 'æøå\n"q"')
    files.write_csv(df, str(tmp_path / "c"), by=["k"])
    assert files.read_csv(spark, str(tmp_path / "c"), "a string, b string, k int").count() == 2
    (tmp_path / "t.csv").write_text("a,b\n,1\nx,\n")
    assert rows(files.read_text_csv(spark, str(tmp_path / "t.csv"), ["a", "b"])) == [("", "1"), ("x", "")]
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "k int, a string, b string").count() == 2
    files.write_batch(df, str(tmp_path / "b"), "1")
    files.write_batch(df, str(tmp_path / "b"), "1")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_rest_source(spark):
    calls = {"n": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            calls["n"] += 1
            if calls["n"] == 1:
                self.send_response(503)
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            body = [{"kode": "101"}, {"kode": "0147"}] if self.path == "/list" else None
            self.wfile.write(json.dumps(body).encode() if body else b'{"vejnavn": "A%s", "husnr": 3}\n\n{"vejnavn": "B"}\n' % self.path[-4:].encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    reader = rest.AddressReader(type("S", (), {"fields": [type("F", (), {"name": n}) for n in ("vejnavn", "husnr")]}), {"url": base + "/a/{code}", "listUrl": base + "/list", "backoff": "0"})
    parts = reader.partitions()
    assert [p.code for p in parts] == ["0101", "0147"] and list(reader.read(parts[0])) == [("A0101", "3"), ("B", None)]
    server.shutdown()
    server.server_close()
    bad = rest.AddressReader(type("S", (), {"fields": []}), {"url": base, "codes": "1", "retries": "2", "backoff": "0"})
    with pytest.raises(OSError):
        list(bad.read(bad.partitions()[0]))
    skip = rest.AddressReader(type("S", (), {"fields": []}), {"url": base, "codes": "1", "retries": "1", "backoff": "0", "onError": "skip"})
    assert list(skip.read(skip.partitions()[0])) == []


def test_stream_counts_equal_batch(spark, trips, tmp_path):
    df = trips.withColumn("ts", F.timestamp_seconds(F.col("turid") * 60))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = validation.status_counts(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("statuses").start()
    q.processAllAvailable()
    q.stop()
    got = {r["validation_status"]: r["n"] for r in spark.table("statuses").collect()}
    assert got == {"trusted": 2, "hard_wrong": 5}


def test_padding_and_truncation(spark):
    df = spark.createDataFrame([(1, "b", [1, 2, 3]), (2, "b", list(range(9)))], "k int, b string, ids array<int>")
    got = {r["k"]: r for r in prompts.padded(df, "ids", "b").collect()}
    assert got[1]["input_ids"] == [1, 2, 3] + [0] * 13 and got[1]["labels"][3:] == [-100] * 13 and sum(got[2]["attention_mask"]) == 9
    p, r = F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (7, 8)))
    assert spark.range(1).select(prompts.truncated(p, r, 4).alias("t")).first()["t"] == [1, 2, 7, 8]
    assert spark.range(1).select(prompts.truncated(p, r, 1).alias("t")).first()["t"] == [7, 8]


def test_providers(spark, trips):
    from surveymend.operators import providers

    df = spark.createDataFrame([(1, "Nørregade"), (2, "Norregade"), (3, "xyz"), (4, None), (5, "xyz")], "k int, t string")
    got = {r["k"]: r for r in providers.embed(df, "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a]["embedding"], got[b]["embedding"], strict=True))
    assert len(got) == 5 and got[4]["embedding"] is None and dot(1, 1) == pytest.approx(1, abs=1e-5)
    assert dot(1, 2) > dot(1, 3) and got[3]["embedding"] == got[5]["embedding"]
    places = providers.geocode(df, "t", providers.fixed_geocoder({"xyz": (55.0, 9.0)}))
    assert {r["k"]: r["place"] and r["place"]["lat"] for r in places.collect()} == {1: None, 2: None, 3: 55.0, 4: None, 5: 55.0}
    told = providers.verdicts(prompts.prompt(repair.fast_validation(trips)))
    assert {r["turid"]: r["llm_verdict"] for r in told.collect()} == {1: "VALID", 2: "VALID", 3: "VALID", 4: "INVALID", 5: "VALID", 6: "VALID", 7: "INVALID"}
    with pytest.raises(ValueError):
        providers.same_embedder(providers.embed(df, "t"), providers.embed(df, "t", name="other"))
