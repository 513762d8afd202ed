"""Binning: right-closed cuts, error classes and fixed grids. Every binner names its edges' side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_right(x: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """The label of (edge, next edge]; null outside. Edges may be infinite."""
    labels = labels or [f"({a}, {b}]" for a, b in zip(edges, edges[1:])]  # noqa: B905
    inside = [(F.lit(a) < x) & (x <= F.lit(b)) for a, b in zip(edges, edges[1:])]  # noqa: B905
    return reduce(lambda w, k: w.when(inside[k], labels[k]), range(1, len(labels)), F.when(inside[0], labels[0]))


def cut_index(x: Column, edges: list[float]) -> Column:
    """The place, from 0, of (edge, next edge]; null outside."""
    inside = [(F.lit(a) < x) & (x <= F.lit(b)) for a, b in zip(edges, edges[1:])]  # noqa: B905
    return reduce(lambda w, k: w.when(inside[k], k), range(1, len(inside)), F.when(inside[0], 0))


def steps(start: float, stop: float, step: float) -> list[float]:
    """Edges by repeated multiplication, with the same noise as a numeric range has."""
    out, k = [], 0
    while start + k * step < stop:
        out.append(start + k * step)
        k += 1
    return out


LENGTH_EDGES, LENGTH_LABELS = [0.0, 2.0, 10.0, 9999.0], ["Short", "Medium", "Long"]
INF = float("inf")
BIAS_EDGES = [-INF, -0.2, -0.05, 0.05, 0.2, 0.5, INF]
BIAS_LABELS = ["Under (-20%+)", "Slight Under", "Accurate (+/-5%)", "Slight Over", "Over (+20-50%)", "Extreme (+50%+)"]
ERROR_EDGES, ERROR_LABELS = [-0.1, 0.5, 2.0, 5.0, INF], ["Exact", "Close", "Off", "Far"]
# Classes of absolute errors in km and minutes, and names of the modes that are compared.
KM_EDGES, KM_LABELS = [-0.1, 0.5, 2.0, 5.0, 9999.0], ["Negligible (<0.5km)", "Small (0.5-2km)", "Moderate (2-5km)", "Large (>5km)"]
MINUTE_EDGES, MINUTE_LABELS = [-0.1, 2.0, 5.0, 10.0, 9999.0], ["Negligible (<2m)", "Small (2-5m)", "Moderate (5-10m)", "Large (>10m)"]
MODES = {1: "Walk", 2: "Bicycle", 11: "Car/Van", 12: "Car/Van"}


def percent_error(reported: Column, system: Column) -> Column:
    """(reported - system) / system; null where system is 0."""
    return F.try_divide(reported - system, system)


def error_type(error: Column, band: float = 0.2) -> Column:
    """Missing errors count as accurate; the band's edges do too."""
    return F.when(error > band, "Overestimated").when(error < -band, "Underestimated").otherwise("Accurate")


def unified_length(km: Column) -> Column:
    """Short below 2, medium up to 10 inclusive, long above; unlike ``cut_right`` at 0 and 2."""
    return F.when(km < 2, "Short").when(km <= 10, "Medium").when(km > 10, "Long").otherwise("Unknown")


def unified_bias(reported: Column, system: Column, band: float = 0.2) -> Column:
    """Error type in which nothing over zero is over, and zero over zero is accurate."""
    return F.when((system == 0) & (reported > 0), "Overestimated").when((system == 0) & (reported < 0), "Underestimated").otherwise(error_type(percent_error(reported, system), band))


def grid(x: Column, low: float, high: float, n: int) -> Column:
    """Place of one of n equal bins of [low, high], whose last edge is included; null outside."""
    width = (high - low) / n
    return F.when((x >= low) & (x <= high), F.least(F.floor((x - low) / F.lit(width)), F.lit(n - 1)).cast("int"))
