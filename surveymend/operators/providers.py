"""External services behind plain functions over batches: over HTTP, and as deterministic offline doubles.

A provider is opened once in each task and called with lists, so that connections and models are loaded once. Distinct
inputs are served once and joined back. Routes have providers of their own: ``http_routes`` here, a double in ``repair``.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import time
import urllib.parse
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import cut, ship
from ..sources.rest import FAILURES, get, retried
from .relational import remaining

#: A function that opens a service and returns one from a list of texts to a list of results.
Provider = Callable[[], Callable[[list[str]], list]]


#: Keys that a service gets in one call, calls at once in a task, times a failed call is made again, seconds before the first
#: of them (twice as many before each next one), and keys after which finished ones are written.
BATCH, CALLS, RETRIES, BACKOFF, WAVE = 256, 4, 4, 2.0, 100_000


def batched(keys: Iterable[str], size: int) -> Iterator[list[str]]:
    keys = iter(keys)
    while group := list(itertools.islice(keys, size)):
        yield group


def called(ask: Callable[[list[str]], list], groups: Iterable[list[str]], calls: int, retries: int, backoff: float, sleep=time.sleep) -> Iterator[tuple[list[str], list | None, str | None]]:
    """(keys, results or None, error or None) of each group, in order, with ``calls`` groups at most on their way.

    A group whose call fails is asked again by itself; one that goes on failing has an error, and the others go on.
    """

    def one(keys: list[str]) -> list:
        out = ask(keys)
        if len(out) != len(keys):
            raise ValueError(f"a service gave {len(out)} results for {len(keys)} keys")
        return out

    with ThreadPoolExecutor(calls) as pool:
        going: deque = deque()
        for keys in itertools.chain(groups, [None]):
            if keys is not None:
                going.append((keys, pool.submit(retried, lambda k=keys: one(k), retries, backoff, sleep)))
            while going and (keys is None or len(going) >= calls):
                asked, answer = going.popleft()
                try:
                    yield asked, answer.result(), None
                except FAILURES as e:
                    yield asked, None, f"{type(e).__name__}: {e}"


class Unanswered(RuntimeError):
    """Keys that a service failed on; answers to the others have been written."""


def served(
    df: DataFrame, column: str, out: str, kind: str, provider: Provider, batch: int = BATCH, calls: int = CALLS, retries: int = RETRIES, backoff: float = BACKOFF, store: str | None = None, wave: int = WAVE
) -> DataFrame:
    """Add a provider's result for a text column; null texts are not asked for and have none.

    Distinct texts go to the service in calls of ``batch``, ``calls`` at once in each task; a failed call is repeated alone.
    With ``store``, a folder that all executors share, answers are written every ``wave`` keys, and a run asks only for what
    no earlier one has finished: so a run that broke off resumes, and every key is answered once. A call that fails for good
    raises: at once without a store, and with one as ``Unanswered`` once all other answers are written.
    """
    spark = df.sparkSession
    ship(spark)
    schema = f"__key string, `{out}` {kind}, __error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for keys, answers, error in called(ask, batched(itertools.chain.from_iterable(pdf["__key"] for pdf in batches), batch), calls, retries, backoff):
            if error and store is None:
                raise Unanswered(f"{len(keys)} keys, the first of them {keys[0]!r}: {error}")
            yield pd.DataFrame({"__key": keys, out: answers or [None] * len(keys), "__error": error})

    asked = df.select(F.col(column).alias("__key")).filter("__key is not null").distinct()
    if store is None:
        answers = asked.mapInPandas(run, schema).drop("__error")
    else:
        answers = _stored(asked, run, schema, store.rstrip("/"), wave)
    return df.join(answers, df[column] == answers["__key"], "left").drop("__key")


def _stored(asked: DataFrame, run, schema: str, store: str, wave: int) -> DataFrame:
    """Answers of this run and earlier ones; a wave's are a folder of their own, which is written whole or not at all."""
    spark = asked.sparkSession
    types = T.StructType(T._parse_datatype_string(schema).fields)

    def finished() -> DataFrame:
        try:
            return spark.read.schema(types).parquet(f"{store}/wave=*").filter("__error is null").drop("__error")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], types).drop("__error")

    todo = cut(remaining(asked, finished(), ["__key"]))
    waves = -(-todo.count() // wave)
    for k in range(waves):
        part = todo.filter(F.pmod(F.xxhash64("__key", F.lit(31)), F.lit(waves)) == k)
        part.mapInPandas(run, schema).write.parquet(f"{store}/wave={uuid.uuid4().hex}")
    left = remaining(todo, finished(), ["__key"]).count()
    if left:
        raise Unanswered(f"{left} of {todo.count()} keys; the others are in {store}")
    return finished().dropDuplicates(["__key"])


def hashed_embedder(dimensions: int = 64, n: int = 3) -> Provider:
    """Offline double of an embedder: unit vectors of hashed character n-grams, so like texts have like vectors."""

    def vector(text: str) -> list[float]:
        v = [0.0] * dimensions
        padded = f" {text.lower()} "
        for i in range(max(1, len(padded) - n + 1)):
            h = int.from_bytes(hashlib.blake2b(padded[i : i + n].encode(), digest_size=8).digest(), "little")
            v[h % dimensions] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / size for x in v]

    return lambda: lambda texts: [vector(t) for t in texts]


def embed(df: DataFrame, column: str, out: str = "embedding", provider: Provider | None = None, name: str = "hashed-3-64") -> DataFrame:
    """Add vectors and ``embedder_id``, by which two sides are checked to share a model before they are compared."""
    return served(df, column, out, "array<float>", provider or hashed_embedder()).withColumn("embedder_id", F.lit(name))


def same_embedder(left: DataFrame, right: DataFrame) -> None:
    """Raise unless all rows of both sides come from one model."""
    names = [r[0] for r in left.select("embedder_id").unionByName(right.select("embedder_id")).distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError(f"vectors of different embedders: {sorted(map(str, names))}")


def rule_model(prompts: list[str]) -> list[str]:
    """Offline double of a language model: invalid where the prompt tells of a speed above 180 km/h."""
    out = []
    for p in prompts:
        told = p.partition("Calculated Speed: ")[2].partition(" km/h")[0]
        fast = told.replace(".", "", 1).isdigit() and float(told) > 180
        out.append("Verdict: INVALID" if fast else "Verdict: VALID")
    return out


def verdicts(df: DataFrame, prompt: str = "prompt_text", provider: Provider | None = None) -> DataFrame:
    """Add the model's answer to a prompt column, chosen by the caller, and llm_verdict."""
    out = served(df, prompt, "llm_answer", "string", provider or (lambda: rule_model))
    return out.withColumn("llm_verdict", tx.verdict(F.col("llm_answer")))


def fixed_geocoder(places: dict[str, tuple[float, float]]) -> Provider:
    """Offline double of a geocoder over known places; others have no coordinates."""
    return lambda: lambda texts: [dict(zip(("lat", "lon"), places[t], strict=True)) if t in places else None for t in texts]


def http_geocoder(url: str, missing: str = "error", timeout: float = 10.0) -> Provider:
    """A geocoder asked over HTTP, by the parameter q: a list of hits with x and y, of which the first counts.

    A text without a hit is an error, or has no coordinates where ``missing`` is null; a failed request is always an error.
    """

    def opened():
        def place(text: str) -> dict | None:
            ask = urllib.parse.urlencode({"q": text, "struktur": "mini"})
            hits = json.loads(get(f"{url}?{ask}", timeout))
            if not hits and missing == "error":
                raise ValueError(f"no place found for {text!r}")
            return {"lat": float(hits[0]["y"]), "lon": float(hits[0]["x"])} if hits else None

        return lambda texts: [place(t) for t in texts]

    return opened


#: Requests to a router that a task has open at once.
AT_ONCE = 8


def http_routes(bases: dict[str, str], timeout: float = 2.0):
    """A route provider over HTTP, with a service for each profile: km to one decimal, minutes rounded up.

    Missing ends, profiles without a service, timeouts, failures and answers without a route give no route.
    """

    def route(key: tuple) -> tuple[float | None, int | None]:
        lat1, lon1, lat2, lon2, profile = key
        if profile not in bases or any(x is None or math.isnan(x) for x in (lat1, lon1, lat2, lon2)):
            return None, None
        try:
            said = json.loads(get(f"{bases[profile]}/route/v1/driving/{lon1},{lat1};{lon2},{lat2}?overview=false", timeout))
            if said["code"] != "Ok" or not said["routes"]:
                return None, None
            first = said["routes"][0]
            return round(first["distance"] / 1000, 1), math.ceil(first["duration"] / 60)
        except (*FAILURES, KeyError, TypeError, ValueError):
            return None, None

    def provide(keys: DataFrame) -> DataFrame:
        ship(keys.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                for batch in batches:
                    asked = zip(*(batch.column(c).to_pylist() for c in ("lat1", "lon1", "lat2", "lon2", "profile")), strict=True)
                    found = list(pool.map(route, asked))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=[*batch.schema.names, "dist_km", "time_min"])

        return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("dist_km", T.DoubleType()), T.StructField("time_min", T.LongType())]))

    return provide


def geocode(df: DataFrame, column: str, provider: Provider, out: str = "place") -> DataFrame:
    """Add a struct of lat and lon; null where the service finds nothing."""
    return served(df, column, out, "struct<lat:double,lon:double>", provider)
