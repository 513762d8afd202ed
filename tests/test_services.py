"""Streams of lines that break off, reports in two phases, and batched service calls, against a local server and files."""

import csv
import datetime
import http.server
import json
import threading
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from surveymend.operators import providers
from surveymend.sources import rest, sinks


@pytest.fixture
def served():
    """base url and a dictionary from the beginning of a path to a function of (path, body) that returns (status, body, bytes sent)."""
    answers: dict = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, sent=b""):
            status, body, n = next(f for p, f in answers.items() if self.path.startswith(p))(self.path, sent)
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body if n is None else body[:n])

        def do_GET(self):
            self.answer()

        def do_POST(self):
            self.answer(self.rfile.read(int(self.headers["Content-Length"])))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", answers
    server.shutdown()
    server.server_close()


def body(code, n):
    return b"".join(json.dumps({"vejnavn": f"{code} gade {k}", "husnr": k}).encode() + b"\n" for k in range(n))


# ---- lines


def test_lines_go_on_where_a_response_broke_off(served):
    base, answers = served
    whole, asked = body("0101", 5_000), []

    def broken(path, _):
        asked.append(path)
        # Each time a little more than the last, always within a line.
        return 200, whole, 40_000 * len(asked) + 7

    answers["/a"] = broken
    waits = []
    got = list(rest.lines(base + "/a", retries=1, sleep=waits.append))
    assert got == whole.splitlines() and len(asked) == len(waits) + 1 == len(whole) // 40_000 + 1 and set(waits) == {2.0}


def test_lines_that_change_are_an_error(served):
    base, answers = served
    calls = []

    def other(path, _):
        calls.append(path)
        return (200, body("x", 2_000), 50_000) if len(calls) == 1 else (200, body("y", 2_000), None)

    answers["/a"] = other
    with pytest.raises(ValueError, match="other lines"):
        list(rest.lines(base + "/a", sleep=lambda _: None))
    calls.clear()
    answers["/a"] = lambda p, _: (200, body("x", 2_000), 50_000) if not calls.append(p) and len(calls) == 1 else (200, body("x", 10), None)
    with pytest.raises(ValueError, match="fewer lines"):
        list(rest.lines(base + "/a", sleep=lambda _: None))


def test_lines_leave_before_the_response_ends(served):
    base, answers = served
    answers["/a"] = lambda p, _: (200, body("x", 200_000), None)
    came = rest.lines(base + "/a")
    assert json.loads(next(came))["husnr"] == 0
    came.close()


def test_no_line_without_progress_is_asked_for_ever(served):
    base, answers = served
    calls = []
    answers["/a"] = lambda p, _: (calls.append(p), (200, body("x", 10), 55))[1]
    with pytest.raises(rest.FAILURES):
        list(rest.lines(base + "/a", retries=3, sleep=lambda _: None))
    assert len(calls) == 4  # one that gave a line, and three more that gave none


# ---- the stream


def test_a_stream_reads_new_codes_and_starts_again_without_repeats(spark, served, tmp_path):
    base, answers = served
    codes = [f"{k:04d}" for k in range(1, 8)]
    asked, failed, known = [], set(), [5]

    def of_code(path, _):
        code = path.rsplit("/", 1)[1]
        asked.append(code)
        whole = body(code, 40)
        if code not in failed:
            failed.add(code)
            return 200, whole, 700
        return 200, whole, None

    answers["/list"] = lambda p, _: (200, json.dumps([{"kode": c} for c in reversed(codes[: known[0]])]).encode(), None)
    answers["/a/"] = of_code
    spark.dataSource.register(rest.AddressSource)

    def run():
        q = spark.readStream.format("addresses").options(url=base + "/a/{code}", listUrl=base + "/list", backoff="0").load()
        w = q.select("vejnavn", "husnr").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        w.processAllAvailable()
        batches = [p["numInputRows"] for p in w.recentProgress if p["numInputRows"]]
        w.stop()
        return batches

    assert sum(run()) == 5 * 40
    rows = sorted((r["vejnavn"], r["husnr"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == sorted((f"{c} gade {k}", str(k)) for c in codes[:5] for k in range(40))
    before, known[0] = list(asked), 7
    assert sum(run()) == 2 * 40
    rows = sorted((r["vejnavn"], r["husnr"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == sorted((f"{c} gade {k}", str(k)) for c in codes for k in range(40))
    # Codes that were committed aren't asked for again.
    assert not set(asked[len(before) :]) & set(codes[:5])


# ---- reports


ROWS = [(3, "b <&> \"q\"", 1.5, True, datetime.date(2020, 1, 2), None), (1, "a,\x0b\nc", float("nan"), False, None, "x"), (2, None, -0.0, None, datetime.date(1999, 12, 31), " s ")]
SCHEMA = "k int, t string, x double, b boolean, d date, s string"


def test_a_csv_report_is_one_sorted_file_that_repeats(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("é,\"x\" "), "id").alias("t")).repartition(7)
    path = tmp_path / "out" / "r.csv"
    path.parent.mkdir()
    sinks.write_report(df, str(path), ["k"])
    with path.open(newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["k", "t"] and [int(r[0]) for r in rows[1:]] == list(range(500)) and rows[8][1] == 'é,"x" 7'
    first = path.read_bytes()
    sinks.write_report(df.repartition(3), str(path), ["k"])
    assert path.read_bytes() == first and [p.name for p in path.parent.iterdir()] == ["r.csv"]


def test_a_workbook_has_every_cell(spark, tmp_path):
    path = tmp_path / "r.xlsx"
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    sinks.write_report(df, str(path), ["k"], sheet='A & "B"')
    first = path.read_bytes()
    sinks.write_report(df.repartition(3), str(path), ["k"], sheet='A & "B"')
    assert path.read_bytes() == first
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        for name in z.namelist():
            ET.fromstring(z.read(name))
        ns = {"m": sinks._SPREAD}
        sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert ET.fromstring(z.read("xl/workbook.xml")).find(".//m:sheet", ns).get("name") == 'A & "B"'
    got = [[("".join(c.itertext()), c.get("t")) for c in row.findall("m:c", ns)] for row in sheet.iterfind(".//m:row", ns)]
    assert [x for x, _ in got[0]] == ["k", "t", "x", "b", "d", "s"]
    assert got[1] == [("1", None), ("a,_x000B_\nc", "inlineStr"), ("nan", "inlineStr"), ("0", "b"), ("", None), ("x", "inlineStr")]
    assert got[2] == [("2", None), ("", None), ("-0.0", None), ("", None), ("1999-12-31", "inlineStr"), (" s ", "inlineStr")]
    assert got[3][:4] == [("3", None), ('b <&> "q"', "inlineStr"), ("1.5", None), ("1", "b")]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = tmp_path / "r.csv"
    bad = spark.range(100).repartition(4).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_report(bad, str(path), ["id"])
    assert list(tmp_path.iterdir()) == []
    path.write_text("old")
    with pytest.raises(Exception, match="broken"):
        sinks.write_report(bad, str(path), ["id"])
    assert [p.name for p in tmp_path.iterdir()] == ["r.csv"] and path.read_text() == "old"
    with pytest.raises(Exception, match="there already"):
        spark.range(3).write.format("report").mode("append").save(str(path))


def test_empty_reports_and_bounds(spark, tmp_path, monkeypatch):
    sinks.write_report(spark.range(0), str(tmp_path / "e.csv"), ["id"])
    assert (tmp_path / "e.csv").read_text() == "id\n"
    w = sinks.ReportWriter(spark.range(1).schema, {"path": str(tmp_path / "b.xlsx")}, True)
    with pytest.raises(ValueError, match="at most"):
        w.commit([sinks.Part(0, "x", sinks.SHEET_ROWS)])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e.csv"]


# ---- services


def test_batches_are_of_a_size_bounded_and_retried_alone():
    sizes, tries, now, most, lock = [], {}, [0], [0], threading.Lock()

    def ask(keys):
        with lock:
            sizes.append(len(keys))
            tries[keys[0]] = tries.get(keys[0], 0) + 1
            now[0] += 1
            most[0] = max(most[0], now[0])
            mine = tries[keys[0]]
        try:
            if keys[0] == "k20" and mine < 3:
                raise OSError("busy")
            return [k.upper() for k in keys]
        finally:
            with lock:
                now[0] -= 1

    keys = [f"k{i}" for i in range(95)]
    out = list(providers.called(ask, providers.batched(keys, 10), 3, 4, 0.0, lambda _: None))
    assert [k for g, _, _ in out for k in g] == keys and [a for _, x, _ in out for a in x] == [k.upper() for k in keys]
    assert max(sizes) == 10 and sizes.count(5) == 1 and most[0] <= 3 and tries["k20"] == 3 and sum(tries.values()) == 12


def post(base):
    def opened():
        import urllib.request

        def ask(keys):
            with urllib.request.urlopen(urllib.request.Request(base + "/m", data=json.dumps(keys).encode()), timeout=20) as r:
                return json.loads(r.read())

        return ask

    return opened


def test_a_service_that_fails_at_random_answers_every_key_once(spark, served, tmp_path):
    import random

    base, answers = served
    rng, answered, lock = random.Random(4), [], threading.Lock()
    down = [True]

    def model(_, sent):
        keys = json.loads(sent)
        with lock:
            if rng.random() < 0.3 or down[0] and "text 77" in keys:
                return 503, b"", None
            answered.extend(keys)
        return 200, json.dumps([k[::-1] for k in keys]).encode(), None

    answers["/m"] = model
    df = spark.createDataFrame([(k, None if k % 50 == 0 else f"text {k % 120}") for k in range(400)], "id int, t string").repartition(3)
    ask = lambda: providers.served(df, "t", "out", "string", post(base), batch=7, calls=2, retries=6, backoff=0.0, store=str(tmp_path / "s"), wave=40)
    with pytest.raises(providers.Unanswered):
        ask()
    done = len(answered)
    assert 0 < done < 120 and len(set(answered)) == done
    down[0] = False
    rows = ask().collect()
    # The second run asks only for what the first left open.
    assert len(answered) == len(set(answered)) == len({f"text {k % 120}" for k in range(400) if k % 50})
    assert {(r["id"], r["out"]) for r in rows} == {(k, None if k % 50 == 0 else f"text {k % 120}"[::-1]) for k in range(400)} and len(rows) == 400
    again = len(answered)
    assert len(ask().collect()) == 400 and len(answered) == again


def test_without_a_store_a_failure_is_raised(spark, served):
    base, answers = served
    answers["/m"] = lambda p, sent: (503, b"", None)
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="Unanswered"):
        providers.served(df, "t", "out", "string", post(base), retries=1, backoff=0.0).collect()
    wrong = lambda: lambda keys: keys[:-1]
    with pytest.raises(Exception, match="0 results for 1 keys"):
        providers.served(df, "t", "out", "string", wrong).collect()
