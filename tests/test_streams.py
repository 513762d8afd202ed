"""Start propagation on a stream against the batch operator."""

import datetime

from surveymend.operators import relational
from surveymend.streaming import validation

SCHEMA = "SessionId long, event_id long, ts timestamp, place string, start_place string"


def at(minute):
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(minutes=minute)


def test_starts_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(k % 5, k, at(k * 7 - (k % 3) * 20), None if k % 4 == 0 else f"p{k}", f"own {k}") for k in range(60)]
    closing = [(9, 1000, at(10_000), "x", "own"), (9, 1001, at(20_000), "y", "own")]
    for n, part in enumerate((rows[:20], rows[20:45], rows[45:], closing[:1], closing[1:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = validation.propagated_starts(stream).writeStream.outputMode("append").format("memory").queryName("starts").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["start_place"] for r in spark.table("starts").collect()}
    batch = relational.previous_or_own(spark.createDataFrame(rows, SCHEMA), {"start_place": "place"}, ["SessionId"], ["ts", "event_id"])
    want = {r["event_id"]: r["start_place"] for r in batch.collect()}
    assert {k: v for k, v in got.items() if k < 1000} == want and len(want) == 60
