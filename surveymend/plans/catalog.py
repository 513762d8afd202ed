"""Every operator as a named query over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins, geo
from ..functions import text as tx
from ..operators import match, matrices, prompts, relational, repair, stats, store, tokens, vectors
from ..session import cut, delete, shared_folder
from ..sources import files
from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    """Register a function of Views under its name, with its SQL over tables and views, if SQL can state it."""

    def keep(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql.strip())
        return f

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, as sums in another order differ in their last digits."""
    return df.select(*[F.round(n, places).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def _h(a: str, b: str, p: str, q: str) -> str:
    return f"(pow(sin((radians({p}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({p})) * pow(sin((radians({q}) - radians({b})) / 2), 2))"


def _km(a: str, b: str, p: str, q: str) -> str:
    h = _h(a, b, p, q)
    return f"(CAST(2 * 6371 AS DOUBLE) * atan2(sqrt({h}), sqrt(1 - {h})))"


_GEO = _km("start_lat", "start_lon", "til_lat", "til_lon")
_BAD = "NOT (coalesce(start_lat BETWEEN 54.5 AND 57.8 AND start_lon BETWEEN 8.0 AND 15.2, false) AND coalesce(til_lat BETWEEN 54.5 AND 57.8 AND til_lon BETWEEN 8.0 AND 15.2, false))"
_LIMIT = "CASE WHEN transportmiddel = 1 THEN 15.0 WHEN transportmiddel = 2 THEN 60.0 WHEN transportmiddel BETWEEN 3 AND 25 THEN 180.0 END"
_FAST = f"coalesce(CAST(stagelength_raw AS DOUBLE) / nullif(CAST(stagedurationmin_raw AS DOUBLE) / 60, 0) > {_LIMIT}, false)"
_ZERO = f"coalesce({_GEO} < 0.005 AND stagelength_raw > 1, false)"
_VALIDATED = f"SELECT *, {_GEO} AS calc_dist_geo, {_BAD} AS flag_coords_bad, {_FAST} AS flag_speed_bad, {_ZERO} AS flag_zero_dist, CASE WHEN {_BAD} OR {_FAST} THEN 'hard_wrong' ELSE 'trusted' END AS validation_status FROM v_geo"

# ---- validation and geography


@query(f"SELECT validation_status, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN flag_coords_bad THEN 1 ELSE 0 END) AS BIGINT) AS n_coords, CAST(sum(CASE WHEN flag_speed_bad THEN 1 ELSE 0 END) AS BIGINT) AS n_speed, CAST(sum(CASE WHEN flag_zero_dist THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, round(avg(calc_dist_geo), 6) AS mean_km FROM ({_VALIDATED}) GROUP BY 1")
def fast_validation(v: Views) -> DataFrame:
    out = repair.fast_validation(v.geo).groupBy("validation_status")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.count_if("flag_coords_bad").alias("n_coords"), F.count_if("flag_speed_bad").alias("n_speed"), F.count_if("flag_zero_dist").alias("n_zero"), F.avg("calc_dist_geo").alias("mean_km")))


@query(f"SELECT turid, delturnr, round({_GEO}, 6) AS km, round({_km('start_lat', 'start_lon', 'home_lat', 'home_lon')}, 6) AS home_km FROM v_geo")
def haversine(v: Views) -> DataFrame:
    return rounded(v.geo.select("turid", "delturnr", geo.haversine(c("start_lat"), c("start_lon"), c("til_lat"), c("til_lon")).alias("km"), geo.haversine(c("start_lat"), c("start_lon"), c("home_lat"), c("home_lon")).alias("home_km")))


@query(f"SELECT turid, delturnr, {_BAD} AS bad FROM v_geo")
def bounds_flag(v: Views) -> DataFrame:
    return v.geo.select("turid", "delturnr", (~(geo.in_bounds(c("start_lat"), c("start_lon")) & geo.in_bounds(c("til_lat"), c("til_lon")))).alias("bad"))


@query(f"SELECT turid, delturnr, {_FAST} AS bad FROM v_stage")
def speed_flag(v: Views) -> DataFrame:
    return v.stage.select("turid", "delturnr", geo.speed_bad(c("stagelength_raw"), c("stagedurationmin_raw"), c("transportmiddel")).alias("bad"))


@query(f"SELECT turid, delturnr, {_ZERO} AS bad FROM v_geo")
def zero_dist_flag(v: Views) -> DataFrame:
    return v.geo.select("turid", "delturnr", geo.zero_distance(geo.haversine(c("start_lat"), c("start_lon"), c("til_lat"), c("til_lon")), c("stagelength_raw")).alias("bad"))


def _utm_sql() -> str:
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    r = 0.9996 * (a / (1 + n) * (1 + n**2 / 4 + n**4 / 64))
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    e = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    terms = lambda k, f1, f2: " - ".join(f"{e(b)} * {f1}({2 * (j + 1)} * xi) * {f2}({2 * (j + 1)} * eta)" for j, b in enumerate(k))
    return f"""WITH a AS (SELECT turid, (CAST(6000000 + turid * 37 % 500000 AS DOUBLE)) / {e(r)} AS xi, (CAST(400000 + turid * 53 % 400000 AS DOUBLE) - 500000) / {e(r)} AS eta FROM v_trip),
 b AS (SELECT turid, xi - {terms(beta, 'sin', 'cosh')} AS x, eta - {terms(beta, 'cos', 'sinh')} AS y FROM a),
 d AS (SELECT turid, x, y, asin(sin(x) / cosh(y)) AS chi FROM b)
 SELECT turid, round(degrees(chi + {' + '.join(f'{e(k)} * sin({2 * (j + 1)} * chi)' for j, k in enumerate(delta))}), 6) AS lat, round(9 + degrees(atan2(sinh(y), cos(x))), 6) AS lon FROM d"""


@query(_utm_sql())
def utm_inverse(v: Views) -> DataFrame:
    lat, lon = geo.utm_to_latlon((400000 + c("turid") * 53 % 400000).cast("double"), (6000000 + c("turid") * 37 % 500000).cast("double"))
    return rounded(v.trip.select("turid", lat.alias("lat"), lon.alias("lon")))


@query("SELECT turid, delturnr, CASE WHEN transportmiddel = 1 THEN 'foot' WHEN transportmiddel = 2 THEN 'bike' WHEN transportmiddel BETWEEN 3 AND 25 THEN 'car' END AS profile FROM v_stage")
def route_profile(v: Views) -> DataFrame:
    return v.stage.select("turid", "delturnr", geo.profile(c("transportmiddel").cast("string")).alias("profile"))


@query("SELECT turid, delturnr, round(CASE WHEN stagedurationmin_raw <= 0 THEN 9999 ELSE CAST(stagelength_raw AS DOUBLE) / stagedurationmin_raw * 60 END, 6) AS kmh FROM v_stage")
def guarded_speed(v: Views) -> DataFrame:
    return rounded(v.stage.select("turid", "delturnr", geo.guarded_speed(c("stagelength_raw"), c("stagedurationmin_raw")).alias("kmh")))


@query("SELECT turid, coalesce(s > 0 AND s <= l, false) AS realistic, NOT coalesce(s > l, false) AS possible FROM (SELECT turid, CASE WHEN corrected_time_min <= 0 THEN 9999 ELSE corrected_dist_km / corrected_time_min * 60 END AS s, CASE WHEN transportmiddel = 1 THEN 15 WHEN transportmiddel = 2 THEN 60 ELSE 180 END AS l FROM v_det)")
def plausibility(v: Views) -> DataFrame:
    s = geo.guarded_speed(c("corrected_dist_km"), c("corrected_time_min"))
    return v.det.select("turid", geo.realistic(s, c("transportmiddel")).alias("realistic"), (~geo.impossible(s, c("transportmiddel"))).alias("possible"))


_SPEED = "coalesce(corrected_dist_km, stagelength_raw) / nullif(CAST(coalesce(corrected_time_min, stagedurationmin_raw) AS DOUBLE) / 60, 0)"


@query(f"SELECT turid, coalesce({_SPEED} BETWEEN 1 AND 130, false) AS valid, coalesce(corrected_dist_km / nullif(CAST(corrected_time_min AS DOUBLE) / 60, 0) > 0 AND corrected_dist_km / nullif(CAST(corrected_time_min AS DOUBLE) / 60, 0) < 130, false) AS valid_corrected FROM v_det")
def validity_expr(v: Views) -> DataFrame:
    s = geo.speed(F.coalesce("corrected_dist_km", "stagelength_raw"), F.coalesce("corrected_time_min", "stagedurationmin_raw"))
    return v.det.select("turid", geo.valid_speed(s).alias("valid"), geo.valid_speed(geo.speed(c("corrected_dist_km"), c("corrected_time_min")), False).alias("valid_corrected"))


# ---- routes and repair

_ROUTE = lambda a, b, p, q, m: f"CASE WHEN {m} BETWEEN 1 AND 25 THEN round({_km(a, b, p, q)} * 1.3, 1) END"
_TIME = lambda a, b, p, q, m: f"CASE WHEN {m} BETWEEN 1 AND 25 THEN CAST(ceil(round({_km(a, b, p, q)} * 1.3 / (CASE WHEN {m} = 1 THEN 5.0 WHEN {m} = 2 THEN 16.0 ELSE 60.0 END) * 60, 6)) AS BIGINT) END"


@query(f"SELECT turid, delturnr, {_ROUTE('start_lat', 'start_lon', 'til_lat', 'til_lon', 'transportmiddel')} AS dist_km, {_TIME('start_lat', 'start_lon', 'til_lat', 'til_lon', 'transportmiddel')} AS time_min FROM v_geo")
def route_synthetic(v: Views) -> DataFrame:
    return repair.with_routes(v.geo, ("start_lat", "start_lon", "til_lat", "til_lon"), "transportmiddel").select("turid", "delturnr", "dist_km", "time_min")


@query("SELECT transportmiddel, CAST(count(*) AS BIGINT) AS keys FROM (SELECT DISTINCT round(start_lat, 4), round(start_lon, 4), round(til_lat, 4), round(til_lon, 4), transportmiddel FROM v_geo WHERE start_lat IS NOT NULL) GROUP BY 1")
def route_dedupe(v: Views) -> DataFrame:
    ends = ["start_lat", "start_lon", "til_lat", "til_lon"]
    return v.geo.filter("start_lat is not null").select(*[F.round(e, 4).alias(e) for e in ends], "transportmiddel").distinct().groupBy("transportmiddel").agg(F.count(F.lit(1)).alias("keys"))


_LOOKUP = "lookup AS (SELECT DISTINCT o_orderpriority AS text, CAST(55 + length(o_orderpriority) AS DOUBLE) / 1 AS lat, CAST(9 AS DOUBLE) AS lon, CAST(90 AS DOUBLE) AS p FROM orders WHERE o_orderpriority LIKE '%O%')"


def _lookup(v: Views) -> DataFrame:
    t = c("o_orderpriority")
    return v.orders.filter(t.contains("O")).select(t.alias("text"), (F.length(t) + 55).cast("double").alias("lat"), F.lit(9.0).alias("lon"), F.lit(90.0).alias("precision")).distinct()


@query(
    f"""WITH g AS ({_VALIDATED}), {_LOOKUP},
 j AS (SELECT g.*, e.lat AS e_lat, e.lon AS e_lon, e.p AS e_p FROM g LEFT JOIN lookup e ON flag_coords_bad AND tiladrtext_raw = e.text),
 k AS (SELECT *, validation_status = 'hard_wrong' AND NOT (NOT flag_coords_bad AND flag_zero_dist) AND (e_p IS NOT NULL OR flag_speed_bad) AS recalc, coalesce(e_lat, til_lat) AS lat2, coalesce(e_lon, til_lon) AS lon2 FROM j),
 r AS (SELECT *, CASE WHEN recalc THEN {_ROUTE('start_lat', 'start_lon', 'lat2', 'lon2', 'transportmiddel')} END AS d, CASE WHEN recalc THEN {_TIME('start_lat', 'start_lon', 'lat2', 'lon2', 'transportmiddel')} END AS t FROM k)
 SELECT turid, delturnr, CASE WHEN d IS NOT NULL THEN 'corrected' ELSE validation_status END AS validation_status, d AS corrected_dist_km, t AS corrected_time_min, CASE WHEN validation_status = 'hard_wrong' THEN e_lat END AS corrected_til_lat,
 CASE WHEN validation_status <> 'hard_wrong' THEN NULL ELSE nullif(concat_ws(';', CASE WHEN NOT flag_coords_bad AND flag_zero_dist THEN 'skipped_zero_dist' END, CASE WHEN e_p IS NOT NULL THEN 'end_fix(90)' END, CASE WHEN d IS NOT NULL THEN 'osrm_recalc' WHEN recalc THEN 'osrm_api_fail' END), '') END AS note_correction FROM r"""
)
def det_repair(v: Views) -> DataFrame:
    return repair.det_repair(repair.fast_validation(v.geo), _lookup(v)).select("turid", "delturnr", "validation_status", "corrected_dist_km", "corrected_time_min", "corrected_til_lat", "note_correction")


_RAG_ENDS = ("rag_start_lat", "rag_start_lon", "rag_end_lat", "rag_end_lon", "transportmiddel")


@query(f"WITH r AS (SELECT turid, llm_verdict, CASE WHEN llm_verdict = 'INVALID' THEN {_ROUTE(*_RAG_ENDS)} END AS d, CASE WHEN llm_verdict = 'INVALID' THEN {_TIME(*_RAG_ENDS)} END AS t FROM v_rag) SELECT turid, CASE WHEN d IS NOT NULL THEN 'corrected' ELSE llm_verdict END AS llm_verdict, d AS corrected_dist_km, t AS corrected_time_min, CASE WHEN d IS NOT NULL THEN 'osrm_recalc' WHEN llm_verdict = 'INVALID' THEN 'osrm_api_fail' END AS note_correction FROM r")
def rag_repair(v: Views) -> DataFrame:
    return repair.rag_repair(v.rag.drop("corrected_dist_km", "corrected_time_min")).select("turid", "llm_verdict", "corrected_dist_km", "corrected_time_min", "note_correction")


# ---- sources and sinks


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def scan_csv_roundtrip(v: Views) -> DataFrame:
    df = v.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return files.through_csv(df, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double", encoding="ISO-8859-1")


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def scan_pruned(v: Views) -> DataFrame:
    return v.lineitem.select("l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part")
def union_all(v: Views) -> DataFrame:
    return files.merged(*[t.select(c(k).alias("id"), F.lit(n).alias("kind")) for t, k, n in ((v.customer, "c_custkey", "customer"), (v.supplier, "s_suppkey", "supplier"), (v.part, "p_partkey", "part"))])


@query("""SELECT c_custkey, concat('{"name":"', c_name, '","nation":', CAST(c_nationkey AS VARCHAR), '}') AS line FROM customer""")
def to_json(v: Views) -> DataFrame:
    return v.customer.select("c_custkey", F.to_json(F.struct(c("c_name").alias("name"), c("c_nationkey").alias("nation"))).alias("line"))


@query("SELECT turid, SessionId FROM v_trip WHERE turid NOT IN (SELECT turid FROM v_trip WHERE turid % 3 = 0)")
def resume_anti(v: Views) -> DataFrame:
    trips = v.trip.select("turid", "SessionId")
    return relational.remaining(trips, trips.filter("turid % 3 = 0"), ["turid"])


@query("SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS code FROM customer")
def lpad_code(v: Views) -> DataFrame:
    return v.customer.select("c_custkey", F.lpad(c("c_nationkey").cast("string"), 4, "0").alias("code"))


# ---- projection


@query("SELECT turid, SessionId, tiladrtext_raw FROM v_trip")
def project(v: Views) -> DataFrame:
    return v.trip.select("turid", "SessionId", "tiladrtext_raw")


@query("SELECT o_orderkey, TRY_CAST(s AS DOUBLE) AS number, CAST(round_even(TRY_CAST(s AS DOUBLE), 0) AS BIGINT) AS whole FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE concat(CAST(o_orderkey AS VARCHAR), '.5') END AS s FROM orders)")
def coerce_numeric(v: Views) -> DataFrame:
    s = F.when(c("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(c("o_orderkey").cast("string"), F.lit(".5")))
    return v.orders.select("o_orderkey", tx.to_number(s).alias("number"), tx.to_whole(s).alias("whole"))


@query("SELECT turid, lower(trim(concat('  ', tiladrtext_raw || ' '))) AS text FROM v_trip WHERE tiladrtext_raw IS NOT NULL")
def text_norm(v: Views) -> DataFrame:
    return v.trip.filter("tiladrtext_raw is not null").select("turid", tx.normalised(F.concat(F.lit("  "), c("tiladrtext_raw"), F.lit(" "))).alias("text"))


@query("SELECT SessionId, CAST(substr(homeID, 1, 3) AS INTEGER) AS municipality FROM v_session")
def substr_int(v: Views) -> DataFrame:
    return v.session.select("SessionId", F.substring("homeID", 1, 3).try_cast("int").alias("municipality"))


@query("SELECT turid, coalesce(a_mod, a_raw) AS a_raw, coalesce(b_mod, b_raw) AS b_raw FROM v_pair")
def overlay_coalesce(v: Views) -> DataFrame:
    return relational.overlay(v.pair, ["a", "b"])


@query("SELECT SessionId, CASE WHEN daystartmuncode = 999 THEN homeText ELSE CAST(daystartmuncode AS VARCHAR) END AS start FROM v_session")
def cond_replace(v: Views) -> DataFrame:
    return v.session.select("SessionId", F.when(c("daystartmuncode") == 999, c("homeText")).otherwise(c("daystartmuncode").cast("string")).alias("start"))


@query("SELECT turid, CASE WHEN CAST(SessionId % 7 - 4 AS VARCHAR) = '-4' THEN startTripText_raw ELSE CAST(SessionId % 7 - 4 AS VARCHAR) END AS text FROM v_trip")
def sentinel_replace(v: Views) -> DataFrame:
    code = (c("SessionId") % 7 - 4).cast("string")
    return v.trip.select("turid", F.when(code == "-4", c("startTripText_raw")).otherwise(code).alias("text"))


@query("SELECT turid, coalesce(b_raw, b_mod) AS b FROM v_pair")
def coalesce_dupes(v: Views) -> DataFrame:
    return relational.coalesce_copies(v.pair.select("turid", "b_raw", "b_mod"), "b", ["b_raw", "b_mod"])


@query("SELECT turid, CASE validation_status WHEN 'hard_wrong' THEN 'invalid' ELSE validation_status END AS status, CASE WHEN validation_status = 'corrected' THEN 'fixed' WHEN validation_status = 'hard_wrong' THEN 'failed' ELSE 'untouched' END AS category FROM v_det")
def recode(v: Views) -> DataFrame:
    s = c("validation_status")
    return v.det.select("turid", F.when(s == "hard_wrong", "invalid").otherwise(s).alias("status"), F.when(s == "corrected", "fixed").when(s == "hard_wrong", "failed").otherwise("untouched").alias("category"))


@query("SELECT r.turid, r.SessionId AS SessionId_DET, g.SessionId AS SessionId_RAG, validation_status, llm_verdict FROM v_det r JOIN v_rag g ON r.turid = g.turid")
def join_suffixed(v: Views) -> DataFrame:
    return relational.join_suffixed(v.det.select("turid", "SessionId", "validation_status"), v.rag.select("turid", "SessionId", "llm_verdict"), ["turid"], ("_DET", "_RAG")).select("turid", "SessionId_DET", "SessionId_RAG", "validation_status", "llm_verdict")


@query("SELECT turid, stagelength_raw - corrected_dist_km AS delta, abs(stagelength_raw - corrected_dist_km) AS abs_delta FROM v_det")
def deltas(v: Views) -> DataFrame:
    d = c("stagelength_raw") - c("corrected_dist_km")
    return v.det.select("turid", d.alias("delta"), F.abs(d).alias("abs_delta"))


@query("SELECT turid, round((stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0), 6) AS pct_error FROM v_det")
def pct_error(v: Views) -> DataFrame:
    return rounded(v.det.select("turid", bins.percent_error(c("stagelength_raw"), c("corrected_dist_km")).alias("pct_error")))


@query("SELECT row_id, concat(vejnavn, ' ', husnr, ', ', postnr, ' ', postnrnavn) AS line FROM v_registry")
def address_line(v: Views) -> DataFrame:
    return v.registry.select("row_id", tx.address_line(c("vejnavn"), c("husnr"), c("postnr"), c("postnrnavn")).alias("line"))


# ---- filters


@query("SELECT turid FROM v_det WHERE validation_status = 'hard_wrong' AND transportmiddel < 26")
def filter_status(v: Views) -> DataFrame:
    return v.det.filter((c("validation_status") == "hard_wrong") & (c("transportmiddel") < 26)).select("turid")


@query("SELECT turid FROM (SELECT turid, (stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0) AS b FROM v_det) WHERE b > -0.8 AND b < 1.5")
def outlier_filter(v: Views) -> DataFrame:
    b = bins.percent_error(c("stagelength_raw"), c("corrected_dist_km"))
    return v.det.filter((b > -0.8) & (b < 1.5)).select("turid")


@query("SELECT turid FROM v_rag WHERE contains(answer, 'URGENT') AND turid % 2 = 0")
def contains_filter(v: Views) -> DataFrame:
    return v.rag.filter(F.coalesce(c("answer").contains("URGENT"), F.lit(False)) & (c("turid") % 2 == 0)).select("turid")


_DET_SCORE = "coalesce(CAST(nullif(regexp_extract(note, '\\((\\d+)\\)', 1), '') AS DOUBLE), 0)"
_SAFE_DET = f"SELECT turid FROM v_det WHERE validation_status = 'corrected' AND {_DET_SCORE} >= 80"
_SAFE_RAG = "SELECT turid FROM v_rag WHERE llm_verdict = 'corrected' AND least(start_conf, end_conf) >= 0.9"


def _safe(v: Views) -> tuple[DataFrame, DataFrame]:
    det = v.det.filter((c("validation_status") == "corrected") & (tx.note_score(c("note")) >= 80)).select("turid")
    return det, v.rag.filter((c("llm_verdict") == "corrected") & (F.least("start_conf", "end_conf") >= 0.9)).select("turid")


@query(f"SELECT turid, 'DET' AS pipeline FROM ({_SAFE_DET}) UNION ALL SELECT turid, 'RAG' FROM ({_SAFE_RAG})")
def safe_gate(v: Views) -> DataFrame:
    det, rag = _safe(v)
    return det.withColumn("pipeline", F.lit("DET")).unionByName(rag.withColumn("pipeline", F.lit("RAG")))


@query("SELECT CAST(sum(CASE WHEN flag_speed_bad THEN 1 ELSE 0 END) AS BIGINT) AS n, round(avg(CASE WHEN flag_speed_bad THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct FROM v_det")
def flag_rate(v: Views) -> DataFrame:
    return rounded(v.det.agg(F.count_if("flag_speed_bad").alias("n"), (F.avg(c("flag_speed_bad").cast("double")) * 100).alias("pct")))


# ---- joins, sets, order


@query("SELECT t.turid, delturnr, SessionId, stagelength_raw FROM v_trip t JOIN v_stage s ON t.turid = s.turid")
def join_inner(v: Views) -> DataFrame:
    return v.trip.join(v.stage, "turid").select("turid", "delturnr", "SessionId", "stagelength_raw")


@query("SELECT s.SessionId, homeText, t.turid, delturnr, stagelength_raw FROM v_session s JOIN v_trip t ON s.SessionId = t.SessionId JOIN v_stage g ON t.turid = g.turid")
def join_chain(v: Views) -> DataFrame:
    return v.session.join(v.trip, "SessionId").join(v.stage, "turid").select("SessionId", "homeText", "turid", "delturnr", "stagelength_raw")


@query("SELECT d.turid, d.corrected_dist_km AS det_km, r.corrected_dist_km AS rag_km FROM v_det d JOIN v_rag r ON d.turid = r.turid WHERE validation_status = 'corrected' OR llm_verdict = 'corrected'")
def det_rag_join(v: Views) -> DataFrame:
    both = v.det.select("turid", "validation_status", c("corrected_dist_km").alias("det_km")).join(v.rag.select("turid", "llm_verdict", c("corrected_dist_km").alias("rag_km")), "turid")
    return both.filter("validation_status = 'corrected' or llm_verdict = 'corrected'").select("turid", "det_km", "rag_km")


@query("SELECT SessionId, homeText FROM v_session WHERE SessionId IN (SELECT SessionId FROM v_det WHERE validation_status = 'corrected')")
def semi_join(v: Views) -> DataFrame:
    return v.session.join(v.det.filter("validation_status = 'corrected'"), "SessionId", "left_semi").select("SessionId", "homeText")


@query("SELECT SessionId, turid, CAST(row_number() OVER (ORDER BY SessionId, turid DESC) AS BIGINT) AS place FROM v_trip")
def sort_multi(v: Views) -> DataFrame:
    """All trips with their place; ranges of SessionId are ordered on their own and counted before, so no task holds all rows."""
    trips = v.trip.select("SessionId", "turid")
    cuts = sorted(set(trips.agg(F.percentile_approx("SessionId", [k / 64 for k in range(1, 64)])).first()[0] or []))
    piece = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda b: b < c("SessionId")))
    pieces = trips.withColumn("piece", piece)
    counts = {r["piece"]: r["count"] for r in pieces.groupBy("piece").count().collect()}
    before = F.array(*[F.lit(sum(n for p, n in counts.items() if p < k)).cast("long") for k in range(len(cuts) + 1)])
    at = F.row_number().over(Window.partitionBy("piece").orderBy("SessionId", F.desc("turid")))
    return pieces.select("SessionId", "turid", (F.element_at(before, c("piece") + 1) + at).alias("place"))


@query("SELECT turid, SessionId FROM v_trip ORDER BY turid DESC LIMIT 100")
def topk(v: Views) -> DataFrame:
    return v.trip.select("turid", "SessionId").orderBy(F.desc("turid")).limit(100)


@query("SELECT d.turid, coalesce(r.corrected_dist_km, d.corrected_dist_km) AS corrected_dist_km, validation_status, llm_verdict FROM v_det d LEFT JOIN (SELECT * FROM v_rag WHERE turid % 2 = 0) r ON d.turid = r.turid")
def update_join(v: Views) -> DataFrame:
    return relational.update_join(v.det.select("turid", "corrected_dist_km", "validation_status"), v.rag.filter("turid % 2 = 0").select("turid", "corrected_dist_km", "llm_verdict"), ["turid"])


@query("SELECT q.s AS street, r.row_id FROM (SELECT DISTINCT lower(concat(p_name, 'vej')) AS s FROM part) q JOIN v_registry r ON lower(r.vejnavn) = q.s")
def street_lookup(v: Views) -> DataFrame:
    asked = v.part.select(tx.fold(F.concat("p_name", F.lit("vej"))).alias("street")).distinct()
    return asked.join(v.registry.withColumn("street", tx.fold(c("vejnavn"))), "street").select("street", "row_id")


@query(f"SELECT CAST(sum(CASE WHEN r.turid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_left, CAST(sum(CASE WHEN d.turid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_right, CAST(sum(CASE WHEN r.turid IS NOT NULL AND d.turid IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS in_both FROM ({_SAFE_DET}) d FULL JOIN ({_SAFE_RAG}) r ON d.turid = r.turid")
def venn_counts(v: Views) -> DataFrame:
    return relational.venn(*_safe(v), "turid")


@query("SELECT turid, corrected_dist_km, 'DET' AS pipeline FROM v_det WHERE validation_status = 'corrected' UNION ALL SELECT turid, corrected_dist_km, 'RAG' FROM v_rag WHERE llm_verdict = 'corrected'")
def union_tagged(v: Views) -> DataFrame:
    det = v.det.filter("validation_status = 'corrected'").select("turid", "corrected_dist_km", F.lit("DET").alias("pipeline"))
    return det.unionByName(v.rag.filter("llm_verdict = 'corrected'").select("turid", "corrected_dist_km", F.lit("RAG").alias("pipeline")))


_CLASS = "CASE WHEN length(t) < 3 THEN 'Noise (<3 chars)' WHEN regexp_matches(t, 'privat|hemmelig|ved ikke|ukendt|unknown|private|don''t know') THEN 'Ambiguity / Privacy' WHEN regexp_matches(t, 'arbejde|job|hjem|skole|gymnasium|universitet|work|home|school|butik|center|station') THEN 'Semantic Concept (Logic)' ELSE 'Complex / Unclassified' END"
_STRUCTURE = "CASE WHEN len(regexp_split_to_array(t, '\\s+')) >= 5 THEN 'Narrative Description (>5 words)' WHEN regexp_matches(t, 'vej|gade|alle|allé|plads|torv|boulevard|stræde') AND regexp_matches(t, '[0-9]') THEN 'Malformed Specific Address (Street + Number)' WHEN regexp_matches(t, 'vej|gade|alle|allé|plads|torv|boulevard|stræde') THEN 'Generic Street Name (No Number)' ELSE 'Vague Stub (1-4 words, No Address markers)' END"


@query(f"WITH a AS (SELECT lang, {_CLASS} AS class FROM (SELECT lang, trim(lower(text)) AS t FROM v_text)), d AS (SELECT class, count(*) AS n FROM a WHERE lang = 'en' GROUP BY 1), r AS (SELECT class, count(*) AS n FROM a WHERE lang = 'de' GROUP BY 1) SELECT coalesce(d.class, r.class) AS class, CAST(coalesce(d.n, 0) AS BIGINT) AS first, CAST(coalesce(r.n, 0) AS BIGINT) AS second FROM d FULL JOIN r ON d.class = r.class")
def taxonomy_align(v: Views) -> DataFrame:
    counts = lambda lang: v.text.filter(c("lang") == lang).groupBy(tx.failure_class(c("text")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return relational.aligned(counts("en"), counts("de"), "class", ("first", "second"))


@query("SELECT postnr, CAST(count(DISTINCT vejnavn) AS BIGINT) AS streets, min(vejnavn) AS first FROM v_registry GROUP BY 1")
def distinct_streets(v: Views) -> DataFrame:
    return v.registry.select("postnr", "vejnavn").distinct().groupBy("postnr").agg(F.count(F.lit(1)).alias("streets"), F.min("vejnavn").alias("first"))


@query("SELECT turid, validation_status FROM (SELECT *, row_number() OVER (PARTITION BY validation_status ORDER BY md5(concat(CAST(turid AS VARCHAR), '-42')), turid) AS k FROM v_det) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM v_det GROUP BY validation_status))")
def balanced_sample(v: Views) -> DataFrame:
    return relational.balanced_sample(v.det.select("turid", "validation_status"), "validation_status", "turid")


# ---- aggregates

_FIXED = lambda col, what: f"CAST(sum(CASE WHEN {col} = '{what}' THEN 1 ELSE 0 END) AS BIGINT)"


@query(f"SELECT SessionId, CAST(count(*) AS BIGINT) AS trips, {_FIXED('validation_status', 'corrected')} AS corrected, {_FIXED('validation_status', 'hard_wrong')} AS wrong FROM v_det GROUP BY 1")
def session_stats(v: Views) -> DataFrame:
    s = c("validation_status")
    return v.det.groupBy("SessionId").agg(F.count(F.lit(1)).alias("trips"), F.count_if(s == "corrected").alias("corrected"), F.count_if(s == "hard_wrong").alias("wrong"))


@query("SELECT SessionId, CAST(count(DISTINCT tiladrtext_raw) AS BIGINT) AS places FROM v_trip GROUP BY 1")
def nunique_per_group(v: Views) -> DataFrame:
    return v.trip.groupBy("SessionId").agg(F.countDistinct("tiladrtext_raw").alias("places"))


@query("SELECT trips, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT SessionId, CAST(count(DISTINCT turid) AS BIGINT) AS trips FROM v_trip GROUP BY 1) GROUP BY 1")
def count_distribution(v: Views) -> DataFrame:
    return v.trip.groupBy("SessionId").agg(F.countDistinct("turid").alias("trips")).groupBy("trips").agg(F.count(F.lit(1)).alias("sessions"))


@query("SELECT transportmiddel, CAST(count(*) AS BIGINT) AS n FROM v_stage GROUP BY 1")
def value_counts(v: Views) -> DataFrame:
    return stats.value_counts(v.stage, "transportmiddel").drop("pct")


@query("SELECT validation_status, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM v_det), 6) AS pct FROM v_det GROUP BY 1")
def value_pct(v: Views) -> DataFrame:
    return rounded(stats.value_counts(v.det, "validation_status"))


@query(f"WITH d AS (SELECT SessionId, {_FIXED('validation_status', 'corrected')} AS a FROM v_det GROUP BY 1), r AS (SELECT SessionId, {_FIXED('llm_verdict', 'corrected')} AS b FROM v_rag GROUP BY 1) SELECT round(corr(a, b), 6) AS r FROM d JOIN r ON d.SessionId = r.SessionId")
def corr_sessions(v: Views) -> DataFrame:
    det = v.det.groupBy("SessionId").agg(F.count_if(c("validation_status") == "corrected").alias("a"))
    rag = v.rag.groupBy("SessionId").agg(F.count_if(c("llm_verdict") == "corrected").alias("b"))
    return rounded(det.join(rag, "SessionId").agg(F.corr("a", "b").alias("r")))


@query("SELECT CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS most FROM (SELECT o_totalprice AS x FROM orders)")
def describe(v: Views) -> DataFrame:
    return rounded(stats.describe(v.orders, "o_totalprice"))


_LENGTH = "CASE WHEN stagelength_raw > 0 AND stagelength_raw <= 2 THEN 'Short' WHEN stagelength_raw > 2 AND stagelength_raw <= 10 THEN 'Medium' WHEN stagelength_raw > 10 AND stagelength_raw <= 9999 THEN 'Long' END"
_ERROR = "CASE WHEN e > 0.2 THEN 'Overestimated' WHEN e < -0.2 THEN 'Underestimated' ELSE 'Accurate' END"
_SHARE = lambda x: f"round(sum(CASE WHEN t = '{x}' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS {x}"


@query(f"SELECT length, {_SHARE('Underestimated')}, {_SHARE('Accurate')}, {_SHARE('Overestimated')} FROM (SELECT length, {_ERROR} AS t FROM (SELECT {_LENGTH} AS length, (stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0) AS e FROM v_det WHERE validation_status = 'corrected')) GROUP BY 1")
def crosstab_pct(v: Views) -> DataFrame:
    rows = v.det.filter("validation_status = 'corrected'").select(bins.cut_right(c("stagelength_raw"), bins.LENGTH_EDGES, bins.LENGTH_LABELS).alias("length"), bins.error_type(bins.percent_error(c("stagelength_raw"), c("corrected_dist_km"))).alias("t"))
    return rounded(stats.crosstab_pct(rows, "length", "t", ["Underestimated", "Accurate", "Overestimated"]))


@query(f"WITH s AS (SELECT {_DET_SCORE} AS x, coalesce({_SPEED} BETWEEN 1 AND 130, false) AS ok FROM v_det), b AS (SELECT CAST(ceil(x / 10) AS INTEGER) - 1 AS bin, ok FROM s WHERE x > 0 AND x <= 100), k AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) SELECT k.bin, CAST(count(ok) AS BIGINT) AS n, round(avg(CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0.0 END), 6) AS rate FROM k LEFT JOIN b ON k.bin = b.bin GROUP BY 1")
def validity_by_bin(v: Views) -> DataFrame:
    s = geo.speed(F.coalesce("corrected_dist_km", "stagelength_raw"), F.coalesce("corrected_time_min", "stagedurationmin_raw"))
    bin = bins.cut_index(tx.note_score(c("note")), [float(x) for x in range(0, 101, 10)])
    return rounded(stats.rate_by_bin(v.det.withColumn("b", bin).withColumn("ok", geo.valid_speed(s)).filter("b is not null"), c("ok"), c("b"), 10))


@query("SELECT bin, CAST(count(*) AS BIGINT) AS n, round(count(*) / (sum(count(*)) OVER () * 1000.0), 9) AS density FROM (SELECT CAST(least(floor((c_acctbal + 1000) / 1000), 10) AS INTEGER) AS bin FROM customer WHERE c_acctbal >= -1000 AND c_acctbal <= 10000) GROUP BY 1")
def histogram(v: Views) -> DataFrame:
    return rounded(stats.histogram(v.customer, bins.grid(c("c_acctbal"), -1000.0, 10000.0, 11), 1000.0), 9)


@query(
    """WITH p AS (SELECT CAST(stagelength_raw AS DOUBLE) AS a, CAST(corrected_dist_km AS DOUBLE) AS b FROM v_det WHERE stagelength_raw >= 0 AND corrected_dist_km >= 0),
 m AS (SELECT greatest(max(a), max(b)) AS edge FROM p)
 SELECT x, y, CAST(count(*) AS BIGINT) AS n, edge FROM (SELECT CAST(least(floor(a / (edge / 60)), 59) AS INTEGER) AS x, CAST(least(floor(b / (edge / 60)), 59) AS INTEGER) AS y, edge FROM p, m) GROUP BY 1, 2, 4"""
)
def hist2d(v: Views) -> DataFrame:
    return stats.histogram2d(v.det, c("stagelength_raw"), c("corrected_dist_km"), 60)


@query("SELECT c_mktsegment, n, q25, q50, q75, round(q25 - 1.5 * (q75 - q25), 6) AS low, round(q75 + 1.5 * (q75 - q25), 6) AS high FROM (SELECT c_mktsegment, CAST(count(c_acctbal) AS BIGINT) AS n, round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS q50, round(quantile_cont(c_acctbal, 0.75), 6) AS q75 FROM customer GROUP BY 1)")
def box_stats(v: Views) -> DataFrame:
    return rounded(stats.box(v.customer, "c_mktsegment", "c_acctbal"))


@query("SELECT postnr, row_id, husnr FROM (SELECT postnr, row_id, husnr, row_number() OVER (PARTITION BY postnr ORDER BY CAST(husnr AS INTEGER) DESC, row_id) AS k FROM v_registry) WHERE k = 1")
def argmax_group(v: Views) -> DataFrame:
    best = v.registry.groupBy("postnr").agg(F.max(F.struct(c("husnr").cast("int").alias("h"), (-c("row_id")).alias("r"), "husnr")).alias("b"))
    return best.select("postnr", (-c("b.r")).alias("row_id"), "b.husnr")


@query(f"SELECT lower(vejnavn) AS street_norm, row_id // {match.SEGMENT} AS segment, array_to_string(list_sort(list(row_id)), ',') AS row_ids FROM v_registry GROUP BY 1, 2")
def inverted_index(v: Views) -> DataFrame:
    return match.inverted_index(v.registry).select("street_norm", "segment", F.array_join(c("row_ids").cast("array<string>"), ",").alias("row_ids"))


@query("SELECT round(sum(CASE WHEN validation_status = 'corrected' THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN validation_status <> 'trusted' THEN 1 ELSE 0 END), 0), 6) AS success, round(sum(CASE WHEN flag_coords_bad AND corrected_dist_km IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / nullif(sum(CASE WHEN flag_coords_bad THEN 1 ELSE 0 END), 0), 6) AS restored, CAST(sum(CASE WHEN corrected_dist_km > stagelength_raw THEN 1 ELSE 0 END) AS BIGINT) AS longer FROM v_det")
def rates_report(v: Views) -> DataFrame:
    s = c("validation_status")
    return rounded(v.det.agg(stats.rate(s == "corrected", s != "trusted").alias("success"), stats.rate(c("flag_coords_bad") & c("corrected_dist_km").isNotNull(), c("flag_coords_bad")).alias("restored"), F.count_if(c("corrected_dist_km") > c("stagelength_raw")).alias("longer")))


# ---- sequences and ranks


@query("SELECT event_id, SessionId, coalesce(lag(place) OVER (PARTITION BY SessionId ORDER BY ts, event_id), start_place) AS start_place FROM v_seq")
def start_propagation(v: Views) -> DataFrame:
    return relational.previous_or_own(v.seq, {"start_place": "place"}, ["SessionId"], ["ts", "event_id"]).select("event_id", "SessionId", "start_place")


@query("WITH s AS (SELECT row_id, postnr, CAST(row_id % 97 AS INTEGER) AS score FROM v_registry), b AS (SELECT *, row_number() OVER (PARTITION BY postnr ORDER BY score DESC, row_id) AS k FROM s) SELECT postnr, row_id, score, CAST(row_number() OVER (ORDER BY score + CASE WHEN postnr = '1200' THEN 100 ELSE 0 END DESC, score DESC, row_id) AS INTEGER) AS place FROM b WHERE k = 1")
def rank_candidates(v: Views) -> DataFrame:
    s = v.registry.select("row_id", "postnr", (c("row_id") % 97).cast("int").alias("score"))
    best = s.groupBy("postnr").agg(F.max(F.struct("score", (-c("row_id")).alias("r"))).alias("b")).select("postnr", (-c("b.r")).alias("row_id"), "b.score")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(c("score") + F.when(c("postnr") == "1200", 100).otherwise(0)), F.desc("score"), "row_id")))


# ---- bins


@query(f"SELECT turid, {_LENGTH} AS length FROM v_det")
def cut_right(v: Views) -> DataFrame:
    return v.det.select("turid", bins.cut_right(c("stagelength_raw"), bins.LENGTH_EDGES, bins.LENGTH_LABELS).alias("length"))


@query("SELECT turid, CASE WHEN e <= -0.2 THEN 'Under (-20%+)' WHEN e <= -0.05 THEN 'Slight Under' WHEN e <= 0.05 THEN 'Accurate (+/-5%)' WHEN e <= 0.2 THEN 'Slight Over' WHEN e <= 0.5 THEN 'Over (+20-50%)' WHEN e > 0.5 THEN 'Extreme (+50%+)' END AS bias, CASE WHEN d <= 0.5 THEN 'Exact' WHEN d <= 2 THEN 'Close' WHEN d <= 5 THEN 'Off' WHEN d > 5 THEN 'Far' END AS error FROM (SELECT turid, (stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0) AS e, abs(stagelength_raw - corrected_dist_km) AS d FROM v_det)")
def bias_bins(v: Views) -> DataFrame:
    e = bins.percent_error(c("stagelength_raw"), c("corrected_dist_km"))
    return v.det.select("turid", bins.cut_right(e, bins.BIAS_EDGES, bins.BIAS_LABELS).alias("bias"), bins.cut_right(F.abs(c("stagelength_raw") - c("corrected_dist_km")), bins.ERROR_EDGES, bins.ERROR_LABELS).alias("error"))


@query(f"SELECT turid, CASE WHEN x > 0 AND x <= 100 THEN CAST(ceil(x / 10) AS INTEGER) * 10 - 5 END AS middle FROM (SELECT turid, {_DET_SCORE} AS x FROM v_det)")
def score_bins(v: Views) -> DataFrame:
    return v.det.select("turid", (bins.cut_index(tx.note_score(c("note")), bins.steps(0.0, 110.0, 10.0)) * 10 + 5).alias("middle"))


@query(f"SELECT turid, {_ERROR} AS error FROM (SELECT turid, (stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0) AS e FROM v_det)")
def error_type(v: Views) -> DataFrame:
    return v.det.select("turid", bins.error_type(bins.percent_error(c("stagelength_raw"), c("corrected_dist_km"))).alias("error"))


@query("SELECT turid, CASE WHEN stagelength_raw < 2 THEN 'Short' WHEN stagelength_raw <= 10 THEN 'Medium' WHEN stagelength_raw > 10 THEN 'Long' ELSE 'Unknown' END AS length, CASE WHEN corrected_dist_km = 0 AND stagelength_raw > 0 THEN 'Overestimated' WHEN (stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0) > 0.2 THEN 'Overestimated' WHEN (stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0) < -0.2 THEN 'Underestimated' ELSE 'Accurate' END AS status FROM v_det")
def unified_bias(v: Views) -> DataFrame:
    return v.det.select("turid", bins.unified_length(c("stagelength_raw")).alias("length"), bins.unified_bias(c("stagelength_raw"), c("corrected_dist_km")).alias("status"))


@query("SELECT turid, delturnr, CASE WHEN transportmiddel = 1 THEN 'Walk' WHEN transportmiddel = 2 THEN 'Bike' WHEN transportmiddel BETWEEN 3 AND 25 THEN 'Car' ELSE 'Other' END AS mode FROM v_stage")
def mode_label(v: Views) -> DataFrame:
    return v.stage.select("turid", "delturnr", tx.mode_label(c("transportmiddel").cast("string")).alias("mode"))


@query("SELECT turid, CASE WHEN SessionId % 101 > 80 THEN 'Syntactic' WHEN SessionId % 101 > 40 THEN 'Hybrid' ELSE 'Semantic' END AS fix FROM v_trip")
def fix_type(v: Views) -> DataFrame:
    return v.trip.select("turid", tx.fix_class(c("SessionId") % 101).alias("fix"))


# ---- texts

@query("SELECT doc_id, trim(lower(regexp_replace(strip_accents(text), '[^\\p{L}\\p{N}\\s]', '', 'g'))) AS folded FROM v_text")
def fold_text(v: Views) -> DataFrame:
    return v.text.select("doc_id", tx.fold(c("text")).alias("folded"))


def _hint_sql() -> str:
    cases = " ".join(f"WHEN contains(t, '{k}') THEN '{p}'" for k, p in tx.NEIGHBOURHOODS.items())
    south = " OR ".join(f"contains(t, '{k}')" for k in tx.SOUTH)
    return f"SELECT doc_id, CASE WHEN {south} THEN '{tx.SOUTH_POSTCODE}' {cases} END AS postcode FROM (SELECT doc_id, lower(concat(text, CASE WHEN doc_id % 5 = 0 THEN ' Valby' WHEN doc_id % 5 = 1 THEN ' kbh S' ELSE '' END)) AS t FROM v_text)"


@query(_hint_sql())
def neighbourhood_hint(v: Views) -> DataFrame:
    text = F.concat(c("text"), F.when(c("doc_id") % 5 == 0, " Valby").when(c("doc_id") % 5 == 1, " kbh S").otherwise(""))
    return v.text.select("doc_id", tx.hint(text).alias("postcode"))


@query("SELECT turid, l_linenumber, CASE WHEN note IS NULL THEN 0 ELSE greatest(l_partkey % 101, l_suppkey % 101) END::DOUBLE AS most, CASE WHEN note IS NOT NULL THEN (l_partkey % 101 + l_suppkey % 101) / 2.0 END::DOUBLE AS mean, CASE WHEN note IS NULL THEN 0 ELSE l_partkey % 101 END::DOUBLE AS first FROM v_note")
def note_score(v: Views) -> DataFrame:
    return v.note.select("turid", "l_linenumber", tx.note_score(c("note")).alias("most"), tx.note_score(c("note"), "mean", None).alias("mean"), tx.note_score(c("note"), "first").alias("first"))


@query("SELECT turid, nullif(concat_ws(';', CASE WHEN flag_coords_bad THEN 'start_fix(90)' END, CASE WHEN flag_speed_bad THEN 'osrm_recalc' END), '') AS note FROM v_det")
def note_build(v: Views) -> DataFrame:
    return v.det.select("turid", tx.note(F.when(c("flag_coords_bad"), "start_fix(90)"), F.when(c("flag_speed_bad"), "osrm_recalc")).alias("note"))


@query("SELECT turid, least(start_conf, end_conf) AS min_conf FROM v_rag")
def min_conf(v: Views) -> DataFrame:
    return v.rag.select("turid", F.least("start_conf", "end_conf").alias("min_conf"))


@query("SELECT turid, CAST(levenshtein(lower(startTripText_raw), lower(tiladrtext_raw)) AS INTEGER) AS distance FROM v_trip")
def lev_distance(v: Views) -> DataFrame:
    return v.trip.select("turid", F.levenshtein(F.lower("startTripText_raw"), F.lower("tiladrtext_raw")).alias("distance"))


@query()
def indel_ratio(v: Views) -> DataFrame:
    distinct = v.trip.select("startTripText_raw", "tiladrtext_raw").distinct()
    scored = match.similarity(distinct.select(F.lower("startTripText_raw").alias("a"), F.lower("tiladrtext_raw").alias("b")), "a", "b", "ratio")
    return scored.withColumn("fix", tx.fix_class(c("ratio")))


@query(f"SELECT doc_id, {_CLASS} AS class FROM (SELECT doc_id, trim(lower(text)) AS t FROM v_text)")
def taxonomy(v: Views) -> DataFrame:
    return v.text.select("doc_id", tx.failure_class(c("text")).alias("class"))


@query(f"SELECT doc_id, {_STRUCTURE} AS class FROM (SELECT doc_id, trim(lower(text)) AS t FROM v_text)")
def structure_type(v: Views) -> DataFrame:
    return v.text.select("doc_id", tx.structure_class(c("text")).alias("class"))


@query("SELECT turid, CASE WHEN contains(upper(answer), 'INVALID') THEN 'INVALID' ELSE 'VALID' END AS verdict FROM v_rag")
def verdict_parse(v: Views) -> DataFrame:
    return v.rag.select("turid", tx.verdict(c("answer")).alias("verdict"))


# ---- raw against corrected

_A3, _B3 = "coalesce(a_mod <> a_raw, false)", "coalesce(b_mod <> b_raw, false)"
_AN, _BN = "(a_mod IS NOT NULL AND a_mod IS DISTINCT FROM a_raw)", "(b_mod IS NOT NULL AND b_mod IS DISTINCT FROM b_raw)"


@query(f"SELECT turid, CASE WHEN {_A3} OR {_B3} THEN 'WRONG' ELSE 'OK' END AS row_flag FROM v_pair")
def diff_3vl(v: Views) -> DataFrame:
    return relational.diff(v.pair).select("turid", "row_flag")


@query(f"SELECT turid, CASE WHEN {_AN} OR {_BN} THEN 'WRONG' ELSE 'OK' END AS row_flag FROM v_pair")
def diff_nullsafe(v: Views) -> DataFrame:
    return relational.diff(v.pair, nulls_count=True).select("turid", "row_flag")


@query(f"SELECT turid, concat_ws(',', CASE WHEN {_A3} THEN 'a' END, CASE WHEN {_B3} THEN 'b' END) AS changed FROM v_pair")
def changed_cols(v: Views) -> DataFrame:
    return relational.diff(v.pair).select("turid", F.array_join("changed_cols", ",").alias("changed"))


@query(f"SELECT turid, CAST({_AN} AS INTEGER) + CAST({_BN} AS INTEGER) AS n_changed FROM v_pair")
def n_changed(v: Views) -> DataFrame:
    return relational.diff(v.pair, nulls_count=True).select("turid", "n_changed")


@query(f"SELECT turid, 'a' AS \"column\", CAST(a_raw AS VARCHAR) AS raw_value, CAST(a_mod AS VARCHAR) AS mod_value FROM v_pair WHERE {_A3} UNION ALL SELECT turid, 'b', b_raw, b_mod FROM v_pair WHERE {_B3}")
def diff_long(v: Views) -> DataFrame:
    return relational.diff_long(v.pair, ["turid"])


def _matrix_sql(frame: str, name: str, rows: str, row: str, column: str) -> str:
    return f"SELECT '{frame}' AS frame, '{name}' AS matrix, r AS row, c AS column, n, round(n * 100.0 / sum(n) OVER (PARTITION BY r), 6) AS pct FROM (SELECT r, c, CAST(count(*) AS BIGINT) AS n FROM (SELECT {row} AS r, {column} AS c FROM {rows}) WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)"


def _cut_sql(x: str, edges: list[float], labels: list[str]) -> str:
    inside = lambda a, b: " AND ".join([*([f"{x} > {a}"] if a > -bins.INF else []), *([f"{x} <= {b}"] if b < bins.INF else [])])
    return "CASE " + " ".join(f"WHEN {inside(a, b)} THEN '{name}'" for a, b, name in zip(edges, edges[1:], labels)) + " END"  # noqa: B905


_KM_BIAS, _MIN_BIAS = "(stagelength_raw - corrected_dist_km) / nullif(corrected_dist_km, 0)", "(stagedurationmin_raw - corrected_time_min) / nullif(CAST(corrected_time_min AS DOUBLE), 0)"
_SURE = {
    "DET": "(SELECT *, (SELECT avg(CAST(x AS DOUBLE)) FROM (SELECT unnest(regexp_extract_all(note, '\\((\\d+)\\)', 1)) AS x)) AS sure FROM v_det WHERE validation_status = 'corrected')",
    "RAG": "(SELECT *, 100 * least(start_conf, end_conf) AS sure FROM (SELECT r.*, d.stagelength_raw, d.stagedurationmin_raw FROM v_rag r JOIN v_det d ON r.turid = d.turid) WHERE llm_verdict = 'corrected')",
}


@query(
    " UNION ALL ".join(
        _matrix_sql(frame, name, f"(SELECT * FROM {_SURE[frame]} WHERE sure >= {80 if frame == 'DET' else 90}){where}", row, column)
        for frame in _SURE
        for name, where, row, column in (
            ("mode", f" WHERE {_KM_BIAS} > -0.8 AND {_KM_BIAS} < 1.5", "CASE transportmiddel WHEN 1 THEN 'Walk' WHEN 2 THEN 'Bicycle' WHEN 11 THEN 'Car/Van' WHEN 12 THEN 'Car/Van' END", _cut_sql(_KM_BIAS, bins.BIAS_EDGES, bins.BIAS_LABELS)),
            ("distance", "", _cut_sql("corrected_dist_km", matrices.DISTANCE_EDGES, matrices.DISTANCE_LABELS), _cut_sql(_KM_BIAS, matrices.STATUS_EDGES, matrices.STATUS_LABELS)),
            ("time", "", _cut_sql("corrected_time_min", matrices.TIME_EDGES, matrices.TIME_LABELS), _cut_sql(_MIN_BIAS, matrices.STATUS_EDGES, matrices.STATUS_LABELS)),
        )
    )
)
def pipeline_matrices(v: Views) -> DataFrame:
    """Three matrices of each pipeline's sure corrections, in one pass over each."""
    rag = v.rag.join(v.det.select("turid", "stagelength_raw", "stagedurationmin_raw"), "turid")
    frames = {"DET": matrices.safe(v.det, "DET"), "RAG": matrices.safe(rag, "RAG")}
    return rounded(matrices.counted(frames, [matrices.by_mode(), matrices.by_distance(), matrices.by_time()]))


# ---- addresses


@query()
def parse_address(v: Views) -> DataFrame:
    texts = v.documents.select("doc_id", F.concat(F.regexp_replace("text", "[^A-Za-zæøåÆØÅ ]", ""), F.lit("vej "), c("doc_id") % 90 + 1, F.lit(", "), c("doc_id") % 9000 + 1000, F.lit(" Odense")).alias("text"))
    return match.parse_addresses(texts, "text").drop("text")


def _asked(v: Views) -> DataFrame:
    return v.registry.select(F.concat(F.substring("vejnavn", 2, 60), F.lit(" "), "husnr", F.lit(", "), "postnr", F.lit(" "), "postnrnavn").alias("text"))


def _parsed(v: Views) -> DataFrame:
    return match.parse_addresses(_asked(v).distinct(), "text").withColumn("q_norm", tx.fold(c("street")))


@query()
def blocked_fuzzy(v: Views) -> DataFrame:
    return match.blocked_streets(_parsed(v), v.registry)


@query()
def fuzzy_topk(v: Views) -> DataFrame:
    best = match.blocked_streets(_parsed(v).withColumn("postnr", F.lit(None).cast("string")), v.registry)
    return best.select("q_norm", "street_norm", "street_score", "street_rank")


@query()
def retrieve(v: Views) -> DataFrame:
    return match.retrieve(_asked(v), v.registry)


@query("SELECT row_id, CAST(row_id % 60 + 40 AS DOUBLE) + CASE WHEN length(s) <= 3 THEN -25 WHEN length(s) <= 5 THEN -10 ELSE 0 END + CASE WHEN substr(lower(s), 1, 4) = 'almo' THEN 5 ELSE 0 END AS score FROM (SELECT row_id, substr(vejnavn, 1, CAST(row_id % 9 + 1 AS INTEGER)) AS s FROM v_registry)")
def score_adjust(v: Views) -> DataFrame:
    s = v.registry.select("row_id", F.substr("vejnavn", F.lit(1), (c("row_id") % 9 + 1).cast("int")).alias("s"))
    return s.select("row_id", match.adjusted(c("s"), (c("row_id") % 60 + 40).cast("double"), F.lit("almond")).alias("score"))


@query("SELECT row_id, b + CASE WHEN b >= 95 THEN 20 + CASE WHEN postnr = '1200' THEN 50 ELSE 0 END ELSE 0 END + CASE WHEN length(vejnavn) <= 3 THEN -25 WHEN length(vejnavn) <= 5 THEN -10 ELSE 0 END + CASE WHEN substr(lower(vejnavn), 1, 4) = 'almo' THEN 5 ELSE 0 END + CASE WHEN husnr = '12' THEN 50 WHEN abs(CAST(husnr AS INTEGER) - 12) <= 5 THEN 10 WHEN abs(CAST(husnr AS INTEGER) - 12) <= 10 THEN 5 ELSE 0 END AS score FROM (SELECT *, CAST(row_id % 60 + 41 AS DOUBLE) AS b FROM v_registry)")
def total_score(v: Views) -> DataFrame:
    score = match.total_score((c("row_id") % 60 + 41).cast("double"), c("vejnavn"), F.lit("almond"), F.lit("12"), c("husnr"), c("postnr") == "1200")
    return v.registry.select("row_id", score.alias("score"))


@query("SELECT row_id, CASE WHEN s AND h AND p THEN 100.0 WHEN s AND p THEN 90.0 WHEN s AND h THEN 80.0 WHEN s THEN 70.0 WHEN p THEN 60.0 ELSE greatest(30.0, least(65.0, CAST(row_id % 100 AS DOUBLE) * CAST(0.8 AS DOUBLE))) END::DOUBLE AS precision FROM (SELECT row_id, row_id % 2 = 0 AS s, row_id % 3 = 0 AS h, row_id % 5 = 0 AS p FROM v_registry)")
def precision_tier(v: Views) -> DataFrame:
    r = c("row_id")
    return v.registry.select("row_id", match.precision(r % 2 == 0, r % 3 == 0, r % 5 == 0, (r % 100).cast("double")).alias("precision"))


@query(
    """SELECT a.row_id AS k, CAST(count(*) AS BIGINT) AS n, min(r.row_id) AS first_row, max(r.row_id) AS last_row FROM v_registry a
 JOIN v_registry r ON lower(a.vejnavn) = lower(r.vejnavn) AND r.husnr = CAST(a.row_id * 7 % 60 + 1 AS VARCHAR) GROUP BY a.row_id"""
)
def house_lookup(v: Views) -> DataFrame:
    """The rows of each asked street and house, from a bucketed table that is built for it and dropped when they are found."""
    index = store.HouseIndex.build(v.registry, shared_folder(v.spark, "houses").rsplit("/", 1)[1].replace("-", "_"))
    asked = v.registry.select(c("row_id").alias("k"), F.upper("vejnavn").alias("street"), (c("row_id") * 7 % 60 + 1).alias("house"))
    out = cut(index.lookup(asked).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row")))
    index.drop()
    return out


# ---- vectors

_DOT = "list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS length, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first FROM v_vec")
def l2_normalize(v: Views) -> DataFrame:
    return rounded(v.vec.select("vec_id", vectors.norm(c("embedding")).alias("length"), vectors.normalised(c("embedding"))[0].alias("first")))


@query(f"SELECT i, j, round({_DOT} / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS cosine FROM (SELECT p.vec_id AS i, q.vec_id AS j, p.embedding AS a, q.embedding AS b FROM v_vec p JOIN v_vec q ON q.vec_id = p.vec_id + 1)")
def cosine_pair(v: Views) -> DataFrame:
    p, q = v.vec.select(c("vec_id").alias("i"), c("embedding").alias("a")), v.vec.select(c("vec_id").alias("j"), c("embedding").alias("b"))
    return rounded(p.join(q, c("j") == c("i") + 1).select("i", "j", vectors.cosine(c("a"), c("b")).alias("cosine")))


@query("SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM v_vec")
def stored_vectors(v: Views) -> DataFrame:
    """Vectors as a store gives them back that was built, and added to, on disk."""
    path = shared_folder(v.spark, "vectors")
    rows = v.vec.select("vec_id", c("embedding").alias("v"))
    held = store.VectorStore(v.spark, path)
    held.build(rows.filter("vec_id % 2 = 0"))
    held.append(rows.filter("vec_id % 2 = 1"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    out = cut(rounded(held.reconstruct(rows.select("vec_id")).select("vec_id", F.size("v").alias("n"), c("v")[0].cast("double").alias("first"), total.alias("total"))))
    delete(v.spark, path)
    return out


_TOP1 = f"SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT p.vec_id AS query_id, q.vec_id, score, row_number() OVER (PARTITION BY p.vec_id ORDER BY score DESC, q.vec_id) AS k FROM (SELECT vec_id, embedding AS a FROM v_vec) p JOIN (SELECT vec_id, embedding AS b FROM v_vec) q ON p.vec_id <> q.vec_id, LATERAL (SELECT {_DOT} AS score)) WHERE k = 1"


def _top1(v: Views, of: DataFrame | None = None) -> DataFrame:
    """Every vector's, or that of each vec_id in ``of``, nearest among all others: of the two nearest at least one isn't the vector itself."""
    rows = v.vec.select("vec_id", c("embedding").alias("v"))
    asked = rows if of is None else rows.join(relational.few(of), "vec_id", "left_semi")
    two = vectors.nearest_rows(asked.select(c("vec_id").alias("query_id"), "v"), rows, 2).filter("vec_id <> query_id")
    best = two.groupBy("query_id").agg(F.max(F.struct("score", (-c("vec_id")).alias("m"))).alias("b"))
    return rounded(best.select("query_id", (-c("b.m")).alias("vec_id"), "b.score"))


@query(_TOP1)
def vec_top1(v: Views) -> DataFrame:
    return _top1(v)


@query(f"WITH t AS ({_TOP1}) SELECT turid, s.vec_id AS start_match, s.score AS start_score, e.vec_id AS end_match, e.score AS end_score FROM (SELECT turid, turid % 20 * 10 AS a, SessionId % 20 * 10 AS b FROM v_trip) JOIN t s ON s.query_id = a JOIN t e ON e.query_id = b")
def rag_augment(v: Views) -> DataFrame:
    """The matches of both ends of each trip; only vectors that are a trip's end are searched for."""
    trips = v.trip.select("turid", (c("turid") % 20 * 10).alias("a"), (c("SessionId") % 20 * 10).alias("b"))
    found = cut(_top1(v, trips.select(F.explode(F.array("a", "b")).alias("vec_id")).distinct()))
    end = lambda p, k: found.select(c("query_id").alias(k), c("vec_id").alias(f"{p}_match"), c("score").alias(f"{p}_score"))
    return trips.join(end("start", "a"), "a").join(end("end", "b"), "b").select("turid", "start_match", "start_score", "end_match", "end_score")


# ---- prompts and tokens


def _q(text: str) -> str:
    """A text as SQL, line ends by number."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_LABEL = "CASE WHEN transportmiddel = 1 THEN 'Walk' WHEN transportmiddel = 2 THEN 'Bike' WHEN transportmiddel BETWEEN 3 AND 25 THEN 'Car' ELSE 'Other' END"
_STATED = f"SELECT *, CAST(stagelength_raw AS DOUBLE) AS km, CAST(stagedurationmin_raw AS DOUBLE) AS minutes, coalesce(calc_dist_geo, 0) AS system, CASE WHEN stagedurationmin_raw > 0 THEN CAST(stagelength_raw AS DOUBLE) / (CAST(stagedurationmin_raw AS DOUBLE) / 60) ELSE 0 END AS kmh, {_LABEL} AS mode FROM ({_VALIDATED})"


def _body(start: str, end: str) -> str:
    return (
        f"concat('Trip Mode: ', mode, ' (Code ', CAST(transportmiddel AS VARCHAR), ')', chr(10), 'From: ', {start}, chr(10), 'To: ', {end}, chr(10), 'User Reported: ', CAST(km AS VARCHAR), ' km in ', CAST(minutes AS VARCHAR), ' min ', "
        "printf('(Calculated Speed: %.1f km/h)', kmh), chr(10), printf('System Calculated Distance: %.1f km', system), chr(10), printf('Discrepancy: %.1f km difference.', abs(km - system)))"
    )


_SAID = f"concat_ws(' ', CASE WHEN flag_speed_bad THEN concat(printf('Speed is unrealistic. %.0f km/h', kmh), ' is too fast for mode ', chr(39), mode, chr(39), '.') END, CASE WHEN flag_coords_bad THEN {_q(prompts.MISPLACED)} END, CASE WHEN flag_zero_dist THEN {_q(prompts.NOWHERE)} END)"
_ANSWER = "\n\n### Response:\n"


@query(
    f"""SELECT turid, delturnr, {_q(prompts.INSTRUCTION)} AS instruction, {_body("coalesce(startTripText_raw, 'nan')", "coalesce(tiladrtext_raw, 'nan')")} AS input,
 CASE WHEN validation_status = 'hard_wrong' OR validation_status <> 'trusted' AND said <> '' THEN concat('Verdict: INVALID', chr(10), 'Analysis: ', CASE WHEN said = '' THEN {_q(prompts.GENERAL)} ELSE said END) ELSE concat('Verdict: VALID', chr(10), 'Analysis: ', {_q(prompts.FINE)}) END AS output FROM (SELECT *, {_SAID} AS said FROM ({_STATED}))"""
)
def training_entry(v: Views) -> DataFrame:
    return prompts.training_entry(repair.fast_validation(v.geo)).select("turid", "delturnr", "instruction", "input", "output")


_FRAMED = prompts.FRAME + "\n\n### Instruction:\n" + prompts.INSTRUCTION + "\n\n### Input:\n"


@query(f"""SELECT turid, delturnr, concat({_q(_FRAMED)}, {_body("coalesce(startTripText_raw, 'Unknown Start')", "coalesce(tiladrtext_raw, 'Unknown Dest')")}, {_q(_ANSWER)}) AS prompt_text FROM ({_STATED})""")
def prompt_render(v: Views) -> DataFrame:
    return prompts.prompt(repair.fast_validation(v.geo)).select("turid", "delturnr", "prompt_text")


def _place(title: str, text: str, lat: str, lon: str) -> str:
    return (
        f"'--- {title} LOCATION ---', chr(10), 'User Input: ', chr(39), coalesce({text}, ''), chr(39), chr(10), 'Verified Database Match: ', chr(39), coalesce(tiladrtext_raw, ''), chr(39), printf(' (Confidence: %.2f)', 0.875::DOUBLE), chr(10), "
        f"printf('Verified Coords: (%.4f, %.4f)', home_lat, home_lon), chr(10), printf('System Used Coords: (%.4f, %.4f)', coalesce({lat}, 0), {lon}), chr(10)"
    )


_RAG_FRAMED = prompts.FRAME + "\n### Instruction:\n" + prompts.RAG_INSTRUCTION + "\n\n### Input:\n"


@query(
    f"""SELECT turid, delturnr, concat({_q(_RAG_FRAMED)}, 'Trip Mode: ', CAST(transportmiddel AS VARCHAR), chr(10), {_place("START", "startTripText_raw", "start_lat", "start_lon")}, {_place("END", "tiladrtext_raw", "til_lat", "til_lon")},
 '--- METRICS ---', chr(10), 'Reported Dist: ', CAST(CAST(stagelength_raw AS DOUBLE) AS VARCHAR), ' km', chr(10), 'System Calc Dist: ', coalesce(CAST(round(calc_dist_geo, 3) AS VARCHAR), '0'), ' km', {_q(_ANSWER)}) AS rag_prompt_text FROM ({_VALIDATED})"""
)
def rag_prompt(v: Views) -> DataFrame:
    """With distances as a file has them, to a metre."""
    checked = repair.fast_validation(v.geo).withColumns({f"rag_{p}_{k}": e for p in ("start", "end") for k, e in (("text", c("tiladrtext_raw")), ("score", F.lit(0.875)), ("lat", c("home_lat")), ("lon", c("home_lon")))})
    stored = checked.withColumns({"calc_dist_geo": F.round("calc_dist_geo", 3), "stagelength_raw": c("stagelength_raw").cast("double")})
    return prompts.rag_prompt(stored).select("turid", "delturnr", "rag_prompt_text")


def _ids(v: Views) -> DataFrame:
    n = (c("turid") % 5 + 1).cast("int")
    return v.trip.select("turid", "SessionId", F.sequence(F.lit(1), n).alias("p"), F.sequence(F.lit(101), n + 102).alias("r"))


_IDS = "SELECT turid, SessionId, range(1, turid % 5 + 2) AS p, range(101, turid % 5 + 104) AS r FROM v_trip"


@query(f"SELECT turid, array_to_string(list_concat(list_transform(p, lambda x: -100), r), ',') AS labels FROM ({_IDS})")
def label_mask(v: Views) -> DataFrame:
    return _ids(v).select("turid", F.array_join(prompts.labels(c("p"), c("r")).cast("array<string>"), ",").alias("labels"))


@query(f"SELECT turid, array_to_string(list_concat(p[1:greatest(8 - len(r), 0)], r), ',') AS ids FROM ({_IDS})")
def truncate_tokens(v: Views) -> DataFrame:
    return _ids(v).select("turid", F.array_join(prompts.truncated(c("p"), c("r"), 8).cast("array<string>"), ",").alias("ids"))


@query(f"SELECT turid, array_to_string(list_concat(r, list_transform(range(0, m - len(r)), lambda x: 0)), ',') AS input_ids, CAST(m AS INTEGER) AS width FROM (SELECT turid, r, CAST(ceil(max(len(r)) OVER (PARTITION BY SessionId) / 8.0) * 8 AS BIGINT) AS m FROM ({_IDS}))")
def pad_batch(v: Views) -> DataFrame:
    out = prompts.padded(_ids(v), "r", "SessionId")
    return out.select("turid", F.array_join(c("input_ids").cast("array<string>"), ",").alias("input_ids"), F.size("labels").alias("width"))


@query(
    """SELECT turid, 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10)
 || startTripText_raw || chr(10) || chr(10) || '### Input:' || chr(10) || coalesce(tiladrtext_raw, 'nan') || chr(10) || chr(10) || '### Response:' || chr(10) || CAST(SessionId AS VARCHAR) || '</s>' AS text FROM v_trip"""
)
def instruction_format(v: Views) -> DataFrame:
    text = prompts.formatted(c("startTripText_raw"), F.coalesce(c("tiladrtext_raw"), F.lit("nan")), c("SessionId").cast("string"))
    return v.trip.select("turid", text.alias("text"))


@query()
def tokenized_examples(v: Views) -> DataFrame:
    """Prompts and answers of all trips as token ids, masked and truncated."""
    import public_tokenizers

    said = prompts.training_entry(repair.fast_validation(v.geo))
    prompt = prompts.formatted(c("instruction"), c("input"), F.lit(""), "")
    out = tokens.examples(said, prompt, c("output"), public_tokenizers.path("byte_bpe_50k.json"), 160, "<|endoftext|>", ["turid", "delturnr"])
    return out.select("turid", "delturnr", "input_ids", "labels")


# ---- smaller steps


@query("SELECT turid, a_raw, b_raw FROM v_pair")
def drop_named(v: Views) -> DataFrame:
    return relational.without(v.pair, lambda name: name.endswith("_mod"))


@query(
    """SELECT d.turid, d.SessionId, validation_status, note, stagelength_raw, stagedurationmin_raw, llm_verdict, answer,
 concat_ws('|', d.turid, d.SessionId, validation_status, note, stagelength_raw, stagedurationmin_raw, llm_verdict, answer) AS line FROM v_det d JOIN v_rag r ON d.turid = r.turid AND d.SessionId = r.SessionId"""
)
def column_order(v: Views) -> DataFrame:
    """The joined rows, common columns first, then extras, one column moved behind another; ``line`` has the values in that order."""
    det, rag = v.det.select("turid", "validation_status", "note", "stagelength_raw", "SessionId", "stagedurationmin_raw"), v.rag.select("turid", "SessionId", "llm_verdict", "answer")
    both = det.join(rag, ["turid", "SessionId"]).select(*relational.common_first(det, rag))
    rows = relational.moved(both, "SessionId", "turid")
    return rows.withColumn("line", F.concat_ws("|", *[c(n).cast("string") for n in rows.columns]))


_MODE = "CASE WHEN transportmiddel = 1 THEN 'Walk' WHEN transportmiddel = 2 THEN 'Bike' WHEN transportmiddel BETWEEN 3 AND 25 THEN 'Car' ELSE 'Other' END"


@query(f"SELECT CAST(place AS INTEGER) AS place, mode, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES (0, 'Car'), (1, 'Ferry'), (2, 'Walk'), (3, 'Bike')) o(place, mode) LEFT JOIN (SELECT {_MODE} AS mode, count(*) AS n FROM v_det GROUP BY 1) USING (mode)")
def reindexed_modes(v: Views) -> DataFrame:
    """Counts of modes in a fixed order, 0 for one that no row has."""
    n = v.det.groupBy(tx.mode_label(c("transportmiddel")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    return stats.reindexed(n, "mode", ["Car", "Ferry", "Walk", "Bike"])


@query("SELECT row_id AS id, vejnavn AS street, husnr AS house, postnr FROM v_registry")
def rename_map(v: Views) -> DataFrame:
    return relational.renamed(v.registry.select("row_id", "vejnavn", "husnr", "postnr"), {"row_id": "id", "vejnavn": "street", "husnr": "house", "absent": "x"})


_COMPARED = ["SessionId", "corrected_dist_km", "corrected_time_min", "transportmiddel"]


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS name, 'number' AS kind, CAST(count(*) FILTER (d.{n} IS NOT NULL AND r.{n} IS NOT NULL) AS BIGINT) AS compared, CAST(count(*) FILTER (d.{n} = r.{n}) AS BIGINT) AS same,
 CAST(count(*) FILTER ((d.{n} IS NULL) <> (r.{n} IS NULL)) AS BIGINT) AS one_side, round(max(abs(CAST(d.{n} AS DOUBLE) - CAST(r.{n} AS DOUBLE))), 6) AS largest FROM v_det d JOIN v_rag r ON d.turid = r.turid"""
        for n in _COMPARED
    )
)
def comparable_columns(v: Views) -> DataFrame:
    """The columns that both sides have, found from their schemas, with how their values compare."""
    return rounded(relational.compared(v.det, v.rag, ["turid"]))


@query(f"SELECT turid, a_raw, a_mod, b_raw, b_mod FROM v_pair WHERE {_A3} OR {_B3}")
def changed_rows(v: Views) -> DataFrame:
    return relational.changed_rows(v.pair).select("turid", "a_raw", "a_mod", "b_raw", "b_mod")


@query("SELECT turid, delturnr, CASE transportmiddel WHEN 1 THEN 'Walk' WHEN 2 THEN 'Bicycle' ELSE 'Car/Van' END AS mode FROM v_stage WHERE transportmiddel IN (1, 2, 11, 12)")
def named_modes(v: Views) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in bins.MODES.items() for x in kv])
    return v.stage.filter(c("transportmiddel").isin(*bins.MODES)).select("turid", "delturnr", names[c("transportmiddel").cast("int")].alias("mode"))


@query("SELECT CAST(count(DISTINCT SessionId) AS BIGINT) AS sessions, CAST(count(DISTINCT tiladrtext_raw) AS BIGINT) AS places FROM v_trip")
def nunique(v: Views) -> DataFrame:
    return v.trip.agg(F.countDistinct("SessionId").alias("sessions"), F.countDistinct("tiladrtext_raw").alias("places"))


@query(f"WITH d AS (SELECT SessionId, {_FIXED('validation_status', 'corrected')} AS a FROM v_det GROUP BY 1), r AS (SELECT SessionId, {_FIXED('llm_verdict', 'corrected')} AS b FROM v_rag GROUP BY 1) SELECT CAST(sum(CASE WHEN b > a THEN 1 ELSE 0 END) AS BIGINT) AS more_rag, CAST(sum(CASE WHEN b < a THEN 1 ELSE 0 END) AS BIGINT) AS more_det, CAST(sum(CASE WHEN b = a THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM d JOIN r ON d.SessionId = r.SessionId")
def comparison_counts(v: Views) -> DataFrame:
    det = v.det.groupBy("SessionId").agg(F.count_if(c("validation_status") == "corrected").alias("a"))
    rag = v.rag.groupBy("SessionId").agg(F.count_if(c("llm_verdict") == "corrected").alias("b"))
    return det.join(rag, "SessionId").agg(F.count_if(c("b") > c("a")).alias("more_rag"), F.count_if(c("b") < c("a")).alias("more_det"), F.count_if(c("b") == c("a")).alias("equal"))


@query("SELECT turid, CASE WHEN d <= 0.5 THEN 'Negligible (<0.5km)' WHEN d <= 2 THEN 'Small (0.5-2km)' WHEN d <= 5 THEN 'Moderate (2-5km)' WHEN d > 5 THEN 'Large (>5km)' END AS km, CASE WHEN m <= 2 THEN 'Negligible (<2m)' WHEN m <= 5 THEN 'Small (2-5m)' WHEN m <= 10 THEN 'Moderate (5-10m)' WHEN m > 10 THEN 'Large (>10m)' END AS minutes FROM (SELECT turid, abs(stagelength_raw - corrected_dist_km) AS d, abs(stagedurationmin_raw - corrected_time_min) AS m FROM v_det)")
def error_classes(v: Views) -> DataFrame:
    km, minutes = F.abs(c("stagelength_raw") - c("corrected_dist_km")), F.abs(c("stagedurationmin_raw") - c("corrected_time_min"))
    return v.det.select("turid", bins.cut_right(km, bins.KM_EDGES, bins.KM_LABELS).alias("km"), bins.cut_right(minutes, bins.MINUTE_EDGES, bins.MINUTE_LABELS).alias("minutes"))


@query("SELECT CAST(count(*) FILTER (bad) AS BIGINT) AS bad, CAST(count(*) FILTER (bad AND good) AS BIGINT) AS restored, round(count(*) FILTER (bad AND good) * 100.0 / nullif(count(*) FILTER (bad), 0), 6) AS pct FROM (SELECT flag_coords_bad AS bad, rag_start_lat IS NOT NULL AND rag_start_lat <> 0 AS good FROM v_det d JOIN v_rag r ON d.turid = r.turid)")
def coords_restored(v: Views) -> DataFrame:
    both = v.det.select("turid", c("flag_coords_bad").alias("bad")).join(v.rag.select("turid", "rag_start_lat"), "turid")
    good = F.coalesce(c("rag_start_lat") != 0, F.lit(False))
    return rounded(both.agg(F.count_if("bad").alias("bad"), F.count_if(c("bad") & good).alias("restored"), stats.rate(c("bad") & good, c("bad")).alias("pct")))


@query("SELECT row_id, lower(vejnavn) AS vejnavn_norm, concat(vejnavn, ' ', husnr, ', ', postnr, ' ', postnrnavn) AS line FROM v_registry WHERE row_id % 7 <> 0 AND row_id % 11 <> 0")
def indexable_rows(v: Views) -> DataFrame:
    """Of rows of which some lack a coordinate, those with a line and both, with the columns derived for chunks."""
    gaps = v.registry.withColumns({"lat": F.when(c("row_id") % 7 != 0, c("lat")), "lon": F.when(c("row_id") % 11 != 0, c("lon"))})
    return files.with_line(gaps).na.drop(subset=["line", "lat", "lon"]).select("row_id", "vejnavn_norm", "line")


@query("SELECT turid, coalesce(a_mod, 0) AS a_mod, coalesce(b_raw, b_mod) AS b FROM v_pair WHERE a_mod IS NOT NULL OR b_raw IS NOT NULL")
def null_filters(v: Views) -> DataFrame:
    some = v.pair.filter(c("a_mod").isNotNull() | c("b_raw").isNotNull())
    return some.na.fill(0, ["a_mod"]).select("turid", "a_mod", F.coalesce("b_raw", "b_mod").alias("b"))


@query("SELECT CAST(sum(stagelength_raw) AS DOUBLE) AS total, round(avg(d), 6) AS mean, round(avg(abs(d)), 6) AS mean_abs FROM (SELECT stagelength_raw, stagelength_raw - corrected_dist_km AS d FROM v_det)")
def sum_and_means(v: Views) -> DataFrame:
    d = c("stagelength_raw") - c("corrected_dist_km")
    return rounded(v.det.agg(F.sum("stagelength_raw").alias("total"), F.avg(d).alias("mean"), F.avg(F.abs(d)).alias("mean_abs")))


@query("SELECT CAST(floor(x / 20) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean FROM (SELECT least(greatest(l_partkey % 101, l_suppkey % 101), 99) AS x FROM v_note) GROUP BY 1")
def wide_bins(v: Views) -> DataFrame:
    x = F.least(F.greatest(c("l_partkey") % 101, c("l_suppkey") % 101), F.lit(99))
    return rounded(v.note.select(x.alias("x")).groupBy(F.floor(c("x") / 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")))


@query("SELECT turid, i - 1 AS place, string_split(startTripText_raw, ' ')[i] AS word FROM (SELECT turid, startTripText_raw, unnest(range(1, len(string_split(startTripText_raw, ' ')) + 1)) AS i FROM v_trip)")
def positions(v: Views) -> DataFrame:
    return v.trip.select("turid", F.posexplode(F.split("startTripText_raw", " ")).alias("place", "word")).select("turid", c("place").cast("long").alias("place"), "word")


@query("SELECT CAST(turid AS VARCHAR) AS turid, CAST(SessionId AS INTEGER) AS SessionId FROM v_trip")
def cast_keys(v: Views) -> DataFrame:
    return v.trip.select(c("turid").cast("string").alias("turid"), c("SessionId").cast("int").alias("SessionId"))
