"""Counts, shares, crosstabs, histograms and summaries; every one aggregates before it shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import few

#: Ranks that an approximate quantile is off by at most: one in so many.
ACCURACY = 10_000


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """column, n and pct of all rows."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.col("n") * F.lit(100.0) / out.agg(F.sum("n")).scalar())


def crosstab_pct(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Shares of column values within each row class, in percent; the list of values keeps the pivot to one job."""
    n = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return n.select(row, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) * F.lit(100.0) / total).alias(v) for v in values])


def reindexed(df: DataFrame, column: str, order: list[str], fill: int | None = 0) -> DataFrame:
    """One row for each class of ``order``, with its place; other columns of classes without a row are ``fill``, or null."""
    every = F.posexplode(F.array(*[F.lit(x) for x in order]))
    classes = df.sparkSession.range(1).select(every.alias("place", "__class"))
    rest = [c for c in df.columns if c != column]
    out = F.broadcast(classes).join(df, F.col("__class") == F.col(column), "left").select("place", F.col("__class").alias(column), *rest)
    return out if fill is None else out.na.fill(fill, rest)


def rate_by_bin(df: DataFrame, flag: Column, bin: Column, bins: int) -> DataFrame:
    """bin, n and rate for every bin, also the empty ones, whose rate is null."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    seen = df.select(bin.alias("bin"), flag.cast("double").alias("f")).groupBy("bin").agg(F.count("f").alias("n"), F.avg("f").alias("rate"))
    return every.join(F.broadcast(seen), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "rate")


def histogram(df: DataFrame, bin: Column, width: float) -> DataFrame:
    """bin, n and density of the values that fall in a bin."""
    n = df.select(bin.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("density", F.col("n") / (n.agg(F.sum("n")).scalar() * F.lit(width)))


def histogram2d(df: DataFrame, x: Column, y: Column, n: int, edge: float | None = None) -> DataFrame:
    """x, y, n and edge of the cells of an n by n grid over [0, edge] that have rows; without an edge, it is the largest value
    of either.

    Rows with a null, or a value below 0 or beyond the edge, are in no cell; where all are 0, all are in the first.
    """
    have = df.select(x.cast("double").alias("a"), y.cast("double").alias("b")).filter("a >= 0 and b >= 0")
    if edge is not None:
        have = have.filter((F.col("a") <= edge) & (F.col("b") <= edge))
    edge = have.agg((F.lit(float(edge)) if edge is not None else F.greatest(F.max("a"), F.max("b"))).alias("edge"))
    place = lambda v: F.coalesce(F.least(F.floor(F.try_divide(F.col(v), F.col("edge") / n)), F.lit(n - 1)), F.lit(0)).cast("int")
    return have.join(F.broadcast(edge), F.lit(True)).groupBy(place("a").alias("x"), place("b").alias("y"), "edge").agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float]) -> DataFrame:
    """by, n and q0, q1, ...: exact quantiles with linear interpolation, of values that aren't null.

    Approximate quantiles a little to either side bound where each lies; only the values of those bands are counted and
    ordered, so no task holds or sorts a whole group. NaN is above all numbers.
    """
    keys = [f"__by{k}" for k in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(column).cast("double").alias("x")).filter("x is not null")
    near = [min(max(s + d / ACCURACY, 0.0), 1.0) for s in shares for d in (-2, 2)]
    bands = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.percentile_approx("x", near, ACCURACY).alias("near"))
    if not by:
        bands, same = F.broadcast(bands), F.lit(True)  # one row
    else:
        known = bands.withColumnsRenamed({k: f"{k}_of" for k in keys})
        bands = few(known)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys])
    placed = rows.join(bands, same)
    band = lambda k: F.struct(F.lit(k).alias("k"), F.col("near")[2 * k].alias("low"), F.col("near")[2 * k + 1].alias("high"))
    every = placed.select(*keys, "n", "x", F.explode(F.array(*[band(k) for k in range(len(shares))])).alias("b"))
    # Values outside a band are only counted, but for those next to it.
    side = F.when(F.col("x") < F.col("b.low"), 0).when(F.col("x") <= F.col("b.high"), 1).otherwise(2)
    counts = every.select(*keys, "n", "x", "b.k", side.alias("side")).groupBy(*keys, "k", "side", F.when(F.col("side") == 1, F.col("x")).alias("v"))
    counts = counts.agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.max("x").alias("most"), F.min("x").alias("x"))
    value = F.when(F.col("side") == 0, F.col("most")).otherwise(F.col("x")).alias("x")
    upto = F.sum("m").over(Window.partitionBy(*keys, "k").orderBy("side", "x")).alias("upto")
    at = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("k") + 1)
    first, second = (F.min(F.when(F.col("upto") > f(at), F.col("x"))) for f in (F.floor, F.ceil))
    each = counts.select(*keys, "k", "n", value, upto).groupBy(*keys, "k").agg(first.alias("a"), second.alias("b"), F.max(at - F.floor(at)).alias("f"), F.max("n").alias("n"))
    each = each.withColumn("q", F.col("a") + F.col("f") * (F.col("b") - F.col("a")))
    wide = each.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))])
    return wide.withColumnsRenamed(dict(zip(keys, by, strict=True)))


_QUARTILES = [0.25, 0.5, 0.75]


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles and max of one column in one row."""
    x = F.col(column)
    out = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    q = quantiles(df, [], column, _QUARTILES).drop("n")
    return out.join(F.broadcast(q), F.lit(True), "left").select("n", "mean", "std", "least", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "most")


def box(df: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles and the 1.5 interquartile whiskers of each group that has values."""
    out = quantiles(df, [by], column, _QUARTILES).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return out.withColumn("low", F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).withColumn("high", F.col("q75") + 1.5 * (F.col("q75") - F.col("q25")))


def rate(part: Column, whole: Column) -> Column:
    """Percentage of rows with ``whole`` that have ``part``; null where none has."""
    return F.try_divide(F.count_if(part) * F.lit(100.0), F.count_if(whole).cast("double"))
