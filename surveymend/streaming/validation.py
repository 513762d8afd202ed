"""Validation of trips as they arrive, and start propagation in event time; the batch operators, unchanged where they hold no state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.repair import fast_validation
from ..session import ship


def validated(stream: DataFrame) -> DataFrame:
    """Validation flags hold no state, so the batch projection serves streams."""
    return fast_validation(stream)


def status_counts(stream: DataFrame, ts: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of validation_status by event-time window; rows later than the watermark are left out."""
    return validated(stream).withWatermark(ts, late).groupBy(F.window(ts, window), "validation_status").agg(F.count(F.lit(1)).alias("n"))


_HELD = "last string, ids array<long>, times array<long>, places array<string>, starts array<string>"


def _propagate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one session up to the watermark, in event time; later ones wait in the state with the last place."""
    last, *held = state.get if state.exists else (None, [], [], [], [])
    rows = list(zip(held[1], held[0], held[2], held[3], strict=True))
    if not state.hasTimedOut:
        for pdf in batches:
            none = pdf.astype(object).where(pdf.notna(), None)
            rows += list(zip(pdf["__ms"].tolist(), pdf["event_id"].tolist(), none["place"], none["start_place"], strict=True))
    rows.sort(key=lambda r: r[:2])
    mark = state.getCurrentWatermarkMs()
    done = [r for r in rows if r[0] <= mark]
    out = []
    for _, event, place, start in done:
        out.append((event, key[0], start if last is None else last))
        last = place
    rest = rows[len(done) :]
    state.update((last, [r[1] for r in rest], [r[0] for r in rest], [r[2] for r in rest], [r[3] for r in rest]))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0], mark + 1))
    yield pd.DataFrame(out, columns=["event_id", "SessionId", "start_place"])


def propagated_starts(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """event_id, SessionId and start_place of (SessionId, event_id, ts, place, start_place): each start is the place of the
    session's row before, or its own at the beginning and where that place is null.

    Rows leave once the watermark has passed them, in event time, ties by event_id; rows later than it are left out. The
    state of a session is its last place and the rows that wait.
    """
    ship(stream.sparkSession)
    rows = stream.withWatermark(ts, late).select("SessionId", "event_id", "place", "start_place", ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("__ms"))
    return rows.groupBy("SessionId").applyInPandasWithState(_propagate, "event_id long, SessionId long, start_place string", _HELD, "append", GroupStateTimeout.EventTimeTimeout)
