"""Providers and sources over HTTP, against a local server."""

import http.server
import json
import threading
import time
import urllib.parse

import pytest
from pyspark.errors import PythonException

from surveymend.functions import text as tx
from surveymend.operators import providers, repair
from surveymend.sources import rest


@pytest.fixture
def served():
    """base url and a dictionary from path to a function of the query that returns (status, body, bytes announced)."""
    answers: dict = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlsplit(self.path)
            status, body, announced = next(f for p, f in answers.items() if url.path.startswith(p))(url)
            self.send_response(status)
            self.send_header("Content-Length", str(len(body) if announced is None else announced))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", answers
    server.shutdown()
    server.server_close()


def ok(x):
    return 200, json.dumps(x).encode(), None


def test_routes(spark, served):
    base, answers = served
    asked = []

    def car(url):
        asked.append(url.path)
        lon = float(url.path.split("/")[-1].split(",")[0])
        if lon == 9.25:
            return 500, b"", None
        if lon == 9.5:
            time.sleep(1.2)
        if lon == 9.75:
            return ok({"code": "NoRoute", "routes": []})
        return ok({"code": "Ok", "routes": [{"distance": 12250.0, "duration": 601.0}, {"distance": 1, "duration": 1}]})

    answers["/car/route"] = car
    answers["/foot/route"] = lambda url: ok({"code": "Ok", "routes": [{"distance": 999.0, "duration": 60.0}]})
    rows = [(1, 55.0, 9.0, 56.0, 10.0, 3), (2, 55.0, 9.0, 56.0, 10.0, 3), (3, 55.0, 9.25, 56.0, 10.0, 3), (4, 55.0, 9.5, 56.0, 10.0, 3), (5, 55.0, 9.75, 56.0, 10.0, 3), (6, 55.0, 9.0, 56.0, 10.0, 1), (7, None, 9.0, 56.0, 10.0, 3), (8, 55.0, 9.0, 56.0, 10.0, 2), (9, 55.0, 9.0, 56.0, 10.0, 30)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, mode int")
    provider = providers.http_routes({"car": base + "/car", "foot": base + "/foot"}, timeout=0.6)
    got = {r["id"]: (r["dist_km"], r["time_min"]) for r in repair.with_routes(df, ("a", "b", "c", "d"), "mode", provider).collect()}
    assert got == {1: (12.2, 11), 2: (12.2, 11), 6: (1.0, 1)} | dict.fromkeys([3, 4, 5, 7, 8, 9], (None, None))
    assert len(asked) == 4 and asked.count("/car/route/v1/driving/9.0,55.0;10.0,56.0") == 1


def test_geocoder(spark, served):
    base, answers = served
    answers["/adresser"] = lambda url: ok([{"x": 9.5, "y": 55.25}, {"x": 1, "y": 1}] if urllib.parse.parse_qs(url.query)["q"] == ["Nørregade 1"] else [])
    df = spark.createDataFrame([("Nørregade 1",), ("nowhere",), (None,), ("Nørregade 1",)], "t string")
    got = [(r["t"], r["place"] and (r["place"]["lat"], r["place"]["lon"])) for r in providers.geocode(df, "t", providers.http_geocoder(base + "/adresser", missing="null")).collect()]
    assert sorted(got, key=str) == sorted([("Nørregade 1", (55.25, 9.5)), ("nowhere", None), (None, None), ("Nørregade 1", (55.25, 9.5))], key=str)
    with pytest.raises(PythonException, match="no place found"):
        providers.geocode(df, "t", providers.http_geocoder(base + "/adresser")).collect()


def reader(**options):
    fields = [type("F", (), {"name": n}) for n in ("vejnavn", "husnr")]
    return rest.AddressReader(type("S", (), {"fields": fields}), {"codes": "101", "backoff": "0"} | options)


def test_a_stream_that_breaks_off_is_asked_again(served, capsys):
    base, answers = served
    body = b'{"vejnavn": "A", "husnr": 1}\n{"vejnavn": "B"}\n'
    calls = []

    def broken(url):
        calls.append(url)
        return 200, body[:40] if len(calls) < 3 else body, len(body)

    answers["/a"] = broken
    r = reader(url=base + "/a/{code}")
    assert list(r.read(r.partitions()[0])) == [("A", "1"), ("B", None)] and len(calls) == 3
    answers["/a"] = lambda url: (200, body[:40], len(body))
    r = reader(url=base + "/a/{code}", retries="1")
    with pytest.raises(rest.FAILURES):
        list(r.read(r.partitions()[0]))
    r = reader(url=base + "/a/{code}", retries="0", onError="skip")
    assert list(r.read(r.partitions()[0])) == [] and "0101 are left out" in capsys.readouterr().err


def test_waits_double():
    waits, calls = [], []

    def ask():
        calls.append(1)
        if len(calls) < 5:
            raise OSError
        return "in the end"

    assert rest.retried(ask, 4, 2.0, waits.append) == "in the end" and waits == [2, 4, 8, 16]
    calls.clear()
    with pytest.raises(OSError):
        rest.retried(ask, 3, 0, waits.append)


def test_numbers_are_rendered_as_python_does(spark):
    import random

    rng = random.Random(2)
    values = [0.25, 0.15, 0.35, 0.45, 2.5, 3.5, -0.04, -0.25, 1e-9, 0.0, 99.95, 1.005, 12345.675, 1e6 + 0.05] + [rng.randint(0, 4000) / 40 for _ in range(300)] + [rng.uniform(-500, 500) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", *[tx.fixed(df["x"], p).alias(f"p{p}") for p in (0, 1, 2, 4)]).collect():
        assert [r[f"p{p}"] for p in (0, 1, 2, 4)] == [f"{r['x']:.{p}f}" for p in (0, 1, 2, 4)]


def test_numbers_next_to_a_middle_are_rendered_as_python_does(spark):
    import math
    import random

    rng = random.Random(4)
    middles = [(2 * rng.randrange(10 ** rng.randint(1, 13)) + 1) / (2 * 10**p) for p in (0, 1, 2, 4) for _ in range(300)]
    values = [s * v for m in middles for s in (1, -1) for v in (m, math.nextafter(m, 0), math.nextafter(m, math.inf))] + [2.0**52, 2.0**53 / 10, 5e-324, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for r in df.select("x", *[tx.fixed(df["x"], p).alias(f"p{p}") for p in (0, 1, 2, 4)]).collect():
        exact = [p for p in (0, 1, 2, 4) if r["x"] is None or abs(r["x"]) * 10**p < 2**53 or not math.isfinite(r["x"])]
        assert [r[f"p{p}"] for p in exact] == [None if r["x"] is None else f"{r['x']:.{p}f}" for p in exact]
    # Lambdas, which aren't compiled, are for numbers next to a middle only.
    plan = df.select(tx.fixed(df["x"], 1))._jdf.queryExecution().analyzed().toString()
    assert plan.index("rint(") < plan.index("lambdafunction(")
