"""Validation and repair of trips: flags, routes over distinct keys, and the two repair methods as column logic.

Services are providers: ``RouteProvider`` is called in batches over distinct keys; ``haversine_routes`` is the offline double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as tx
from .relational import SPREAD, lookup_join, update_join

#: (lat1, lon1, lat2, lon2, profile) to a DataFrame with dist_km and time_min added.
RouteProvider = Callable[[DataFrame], DataFrame]
KEY = ["k_lat1", "k_lon1", "k_lat2", "k_lon2", "k_mode"]


def fast_validation(trips: DataFrame) -> DataFrame:
    """Add distances, flags and validation_status to trips with ends, home, reported length, minutes and mode, in one projection."""
    c = F.col
    out = trips.withColumns({
        "calc_dist_geo": geo.haversine(c("start_lat"), c("start_lon"), c("til_lat"), c("til_lon")),
        "dist_start_home": geo.haversine(c("start_lat"), c("start_lon"), c("home_lat"), c("home_lon")),
        "dist_end_home": geo.haversine(c("til_lat"), c("til_lon"), c("home_lat"), c("home_lon")),
    })
    out = out.withColumns({
        "flag_coords_bad": ~(geo.in_bounds(c("start_lat"), c("start_lon")) & geo.in_bounds(c("til_lat"), c("til_lon"))),
        "flag_speed_bad": geo.speed_bad(c("stagelength_raw"), c("stagedurationmin_raw"), c("transportmiddel")),
        "flag_zero_dist": geo.zero_distance(c("calc_dist_geo"), c("stagelength_raw")),
    })
    return out.withColumn("validation_status", F.when(c("flag_coords_bad") | c("flag_speed_bad"), "hard_wrong").otherwise("trusted"))


def haversine_routes(keys: DataFrame) -> DataFrame:
    """Offline double of a router: 1.3 times the great circle at a speed by profile. Missing ends give no route."""
    km = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * 1.3
    pace = F.when(F.col("profile") == "foot", 5.0).when(F.col("profile") == "bike", 16.0).when(F.col("profile") == "car", 60.0)
    return keys.withColumn("dist_km", F.when(pace.isNotNull(), F.round(km, 1))).withColumn("time_min", F.when(pace.isNotNull(), F.ceil(F.round(km / pace * 60, 6)).cast("long")))


def with_routes(df: DataFrame, ends: tuple[str, str, str, str], mode: str, provider: RouteProvider = haversine_routes) -> DataFrame:
    """Add dist_km and time_min. Every distinct key, ends to four places and mode, is routed once, from its least ends."""
    keyed = df.withColumns(dict(zip(KEY, [*[F.round(F.col(e), 4) for e in ends], F.col(mode)], strict=True)))
    once = keyed.filter(" and ".join(f"{k} is not null" for k in KEY)).groupBy(*KEY).agg(F.min(F.struct(*[F.col(e).alias(n) for e, n in zip(ends, ("lat1", "lon1", "lat2", "lon2"), strict=True)])).alias("e"))
    routes = provider(once.select(*KEY, "e.*", geo.profile(F.col("k_mode").cast("string")).alias("profile"))).select(*KEY, "dist_km", "time_min")
    return lookup_join(keyed, routes, KEY).drop(*KEY)


def _score(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def det_repair(df: DataFrame, lookup: DataFrame, provider: RouteProvider = haversine_routes, start_text: str = "startTripText_raw", end_text: str = "tiladrtext_raw") -> DataFrame:
    """Repair validated trips from a table (text, lat, lon, precision) of resolved texts; all rows are returned.

    Bad coordinates: ends whose text resolves are replaced. Else a zero distance is only noted. Changed ends, or a bad
    speed, are routed: a route corrects the row. Only hard_wrong rows are touched; corrected coordinates are kept.
    """
    hard = F.col("validation_status") == "hard_wrong"
    bad, zero, fast = F.col("flag_coords_bad"), F.col("flag_zero_dist"), F.col("flag_speed_bad")
    found = lambda t, p: lookup.select(F.col("text").alias(f"__{p}_text"), F.col("lat").alias(f"__{p}_lat"), F.col("lon").alias(f"__{p}_lon"), F.col("precision").alias(f"__{p}_score"))
    out = df.filter(hard)
    for t, p in ((start_text, "s"), (end_text, "e")):
        out = lookup_join(out.withColumn(f"__{p}_text", F.when(bad, F.col(t))), found(t, p), [f"__{p}_text"], SPREAD)
    s, e = F.col("__s_score").isNotNull(), F.col("__e_score").isNotNull()
    skip = ~bad & zero
    recalc = ~skip & (s | e | fast)
    out = out.withColumns({
        "corrected_start_lat": F.col("__s_lat"), "corrected_start_lon": F.col("__s_lon"), "corrected_til_lat": F.col("__e_lat"), "corrected_til_lon": F.col("__e_lon"),
        "__lat1": F.when(recalc, F.coalesce("__s_lat", "start_lat")), "__lon1": F.when(recalc, F.coalesce("__s_lon", "start_lon")),
        "__lat2": F.when(recalc, F.coalesce("__e_lat", "til_lat")), "__lon2": F.when(recalc, F.coalesce("__e_lon", "til_lon")),
    })
    out = with_routes(out, ("__lat1", "__lon1", "__lat2", "__lon2"), "transportmiddel", provider)
    routed = recalc & F.col("dist_km").isNotNull()
    text = tx.note(
        F.when(skip, "skipped_zero_dist"),
        F.when(s, F.concat(F.lit("start_fix("), _score(F.col("__s_score")), F.lit(")"))),
        F.when(e, F.concat(F.lit("end_fix("), _score(F.col("__e_score")), F.lit(")"))),
        F.when(routed, "osrm_recalc").when(recalc, "osrm_api_fail"),
    )
    out = out.withColumns({"note_correction": text, "corrected_dist_km": F.when(routed, F.col("dist_km")), "corrected_time_min": F.when(routed, F.col("time_min")), "validation_status": F.when(routed, "corrected").otherwise(F.col("validation_status"))})
    own = ["corrected_start_lat", "corrected_start_lon", "corrected_til_lat", "corrected_til_lon", "note_correction", "corrected_dist_km", "corrected_time_min"]
    kinds = {c: t for c, t in out.dtypes}
    rest = df.filter(~F.coalesce(hard, F.lit(False))).withColumns({c: F.lit(None).cast(kinds[c]) for c in own})
    return out.select(*df.columns, *own).unionByName(rest.select(*df.columns, *own))


def rag_repair(df: DataFrame, provider: RouteProvider = haversine_routes) -> DataFrame:
    """Route every row of verdict INVALID on its matched coordinates: it becomes corrected, or its note tells of the failure."""
    invalid = F.coalesce(F.col("llm_verdict") == "INVALID", F.lit(False))
    ends = ("rag_start_lat", "rag_start_lon", "rag_end_lat", "rag_end_lon")
    out = df.withColumns({f"__{e}": F.when(invalid, F.col(e)) for e in ends})
    out = with_routes(out, tuple(f"__{e}" for e in ends), "transportmiddel", provider)
    done = invalid & F.col("dist_km").isNotNull()
    return out.withColumns({
        "corrected_dist_km": F.when(done, F.col("dist_km")), "corrected_time_min": F.when(done, F.col("time_min")),
        "note_correction": F.when(done, "osrm_recalc").when(invalid, "osrm_api_fail"), "llm_verdict": F.when(done, "corrected").otherwise(F.col("llm_verdict")),
    }).select(*df.columns, "corrected_dist_km", "corrected_time_min", "note_correction")


__all__ = ["det_repair", "fast_validation", "haversine_routes", "rag_repair", "update_join", "with_routes"]
