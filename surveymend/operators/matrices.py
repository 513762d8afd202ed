"""Named crosstabs of several frames in one pass: every frame is read once, and all counts meet in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins
from ..functions import text as tx

INF = float("inf")
# Classes of corrected distance and time, and of the bias of what was reported.
DISTANCE_EDGES, DISTANCE_LABELS = [0.0, 2.0, 10.0, 9999.0], ["Short (<2km)", "Medium (2-10km)", "Long (>10km)"]
TIME_EDGES, TIME_LABELS = [0.0, 15.0, 60.0, 9999.0], ["Short (<15m)", "Medium (15-60m)", "Long (>60m)"]
STATUS_EDGES, STATUS_LABELS = [-INF, -0.2, 0.2, INF], ["Underestimated", "Accurate", "Overestimated"]
#: Biases beyond these are left out of the matrix by mode.
EXTREMES = (-0.8, 1.5)


@dataclass
class Matrix:
    """Rows of a frame that ``where`` holds for, counted by the classes of two expressions; rows of no class aren't counted."""

    name: str
    row: Column
    column: Column
    where: Column | None = None


def _bias(reported: str, corrected: str) -> Column:
    return bins.percent_error(F.col(reported), F.col(corrected))


def by_mode() -> Matrix:
    """Bias of distances by the modes that are compared, without extremes."""
    bias = _bias("stagelength_raw", "corrected_dist_km")
    mode = reduce(lambda w, k: w.when(F.col("transportmiddel") == k, bins.MODES[k]), list(bins.MODES)[1:], F.when(F.col("transportmiddel") == next(iter(bins.MODES)), next(iter(bins.MODES.values()))))
    return Matrix("mode", mode, bins.cut_right(bias, bins.BIAS_EDGES, bins.BIAS_LABELS), (bias > EXTREMES[0]) & (bias < EXTREMES[1]))


def by_distance() -> Matrix:
    return Matrix("distance", bins.cut_right(F.col("corrected_dist_km"), DISTANCE_EDGES, DISTANCE_LABELS), bins.cut_right(_bias("stagelength_raw", "corrected_dist_km"), STATUS_EDGES, STATUS_LABELS))


def by_time() -> Matrix:
    return Matrix("time", bins.cut_right(F.col("corrected_time_min"), TIME_EDGES, TIME_LABELS), bins.cut_right(_bias("stagedurationmin_raw", "corrected_time_min"), STATUS_EDGES, STATUS_LABELS))


def safe(df: DataFrame, name: str) -> DataFrame:
    """The rows whose correction is sure: DET by the mean score of its note, RAG by the lower confidence of its ends."""
    if name == "DET":
        return df.filter((F.col("validation_status") == "corrected") & (tx.note_score(F.col("note"), "mean") >= 80))
    return df.filter((F.col("llm_verdict") == "corrected") & (F.least("start_conf", "end_conf") >= 0.9))


def counted(frames: dict[str, DataFrame], matrices: list[Matrix]) -> DataFrame:
    """(frame, matrix, row, column, n, pct): the cells of all matrices of all frames that have rows, and each cell's share of
    its row in percent. A row of a frame becomes one for each matrix that counts it, and is counted before it is shuffled."""

    def cells(name: str, df: DataFrame) -> DataFrame:
        each = [F.when(F.lit(True) if m.where is None else m.where, F.struct(F.lit(m.name).alias("matrix"), m.row.alias("row"), m.column.alias("column"))) for m in matrices]
        return df.select(F.lit(name).alias("frame"), F.inline(F.filter(F.array(*each), lambda c: c.isNotNull() & c["row"].isNotNull() & c["column"].isNotNull())))

    every = reduce(DataFrame.unionByName, [cells(name, df) for name, df in frames.items()])
    n = every.groupBy("frame", "matrix", "row", "column").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("frame", "matrix", "row")))


def matrix(df: DataFrame, of: Matrix, columns: list[str]) -> DataFrame:
    """One matrix as a table: a row for each class that has rows, a percentage for each of the given columns, 0 for none."""
    share = counted({"": df}, [of]).groupBy("row").pivot("column", columns).agg(F.max("pct"))
    return share.na.fill(0.0, columns)


def process_pipeline(df: DataFrame, name: str) -> DataFrame:
    """The matrix of bias by mode of a pipeline's sure corrections."""
    return matrix(safe(df, name), by_mode(), bins.BIAS_LABELS)
