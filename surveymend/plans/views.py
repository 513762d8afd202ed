"""Survey-shaped views of the test tables, as expressions that Spark SQL and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LAT = "cast(5400 + {a} % 400 as double) / cast(100 as double)"
_LON = "cast(750 + {a} % 800 as double) / cast(100 as double)"

#: name: (source in SQL, expressions)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_session": ("customer", ["c_custkey AS SessionId", "c_mktsegment AS homeText", "CASE WHEN c_custkey % 10 = 0 THEN 999 ELSE 100 + c_nationkey END AS daystartmuncode", "concat(cast(100 + c_nationkey as string), c_name) AS homeID"]),
    "v_trip": ("orders", ["o_orderkey AS turid", "o_custkey AS SessionId", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS tiladrtext_raw", "concat(o_orderstatus, ' ', o_orderpriority) AS startTripText_raw"]),
    "v_stage": ("lineitem", ["l_orderkey AS turid", "l_linenumber AS delturnr", "l_quantity AS stagelength_raw", "(l_suppkey % 8) * 15 AS stagedurationmin_raw", "l_partkey % 32 AS transportmiddel"]),
    "v_geo": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey",
        [
            "l_orderkey AS turid", "l_linenumber AS delturnr", "o_custkey AS SessionId", "l_partkey", "l_suppkey",
            f"CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_LAT.format(a='o_orderkey')} END AS start_lat", f"{_LON.format(a='o_custkey')} AS start_lon",
            f"{_LAT.format(a='l_partkey')} AS til_lat", f"{_LON.format(a='l_suppkey')} AS til_lon", f"{_LAT.format(a='o_custkey')} AS home_lat", f"{_LON.format(a='o_orderkey')} AS home_lon",
            "l_quantity AS stagelength_raw", "(l_suppkey % 8) * 15 AS stagedurationmin_raw", "l_partkey % 32 AS transportmiddel",
            "concat(o_orderstatus, ' ', o_orderpriority) AS startTripText_raw", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS tiladrtext_raw",
        ],
    ),
    "v_pair": (
        "orders",
        [
            "o_orderkey AS turid", "o_custkey AS a_raw", "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS a_mod",
            "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS b_raw", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE o_orderpriority END AS b_mod",
        ],
    ),
    "v_note": ("lineitem", ["l_orderkey AS turid", "l_partkey", "l_suppkey", "l_linenumber", "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('start_fix(', cast(l_partkey % 101 as string), ');end_fix(', cast(l_suppkey % 101 as string), ')') END AS note"]),
    "v_det": (
        "orders",
        [
            "o_orderkey AS turid", "o_custkey AS SessionId", "CASE WHEN o_orderkey % 5 = 0 THEN 'corrected' WHEN o_orderkey % 5 = 1 THEN 'hard_wrong' ELSE 'trusted' END AS validation_status",
            "CASE WHEN o_orderkey % 5 = 0 THEN concat('start_fix(', cast(60 + o_custkey % 41 as string), ');osrm_recalc') ELSE NULL END AS note",
            "cast(o_custkey % 30 as double) / cast(2 as double) AS stagelength_raw", "o_custkey % 9 * 10 AS stagedurationmin_raw", "o_orderkey % 27 AS transportmiddel",
            "CASE WHEN o_orderkey % 5 = 0 THEN cast(o_orderkey % 40 as double) / cast(2 as double) ELSE NULL END AS corrected_dist_km", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 70 ELSE NULL END AS corrected_time_min",
            "o_orderkey % 3 = 0 AS flag_speed_bad", "o_orderkey % 4 = 0 AS flag_coords_bad", "o_orderpriority AS text",
        ],
    ),
    "v_rag": (
        "orders",
        [
            "o_orderkey AS turid", "o_custkey AS SessionId", "CASE WHEN o_orderkey % 6 = 0 THEN 'corrected' WHEN o_orderkey % 6 = 1 THEN 'INVALID' ELSE 'VALID' END AS llm_verdict",
            "cast(o_orderkey % 1000 as double) / cast(1000 as double) AS start_conf", "cast(500 + o_custkey % 500 as double) / cast(1000 as double) AS end_conf",
            "CASE WHEN o_orderkey % 6 = 0 THEN cast(o_orderkey % 50 as double) / cast(2 as double) ELSE NULL END AS corrected_dist_km", "CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 60 ELSE NULL END AS corrected_time_min",
            "concat('Verdict: ', CASE WHEN o_orderkey % 4 = 0 THEN 'invalid' ELSE 'Valid' END, ' ', o_orderpriority) AS answer", "o_orderkey % 27 AS transportmiddel",
            f"CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {_LAT.format(a='o_custkey')} END AS rag_start_lat", f"{_LON.format(a='o_custkey')} AS rag_start_lon", f"{_LAT.format(a='o_orderkey')} AS rag_end_lat", f"{_LON.format(a='o_orderkey')} AS rag_end_lon",
        ],
    ),
    "v_text": ("documents", ["doc_id", "text", "lang"]),
    "v_registry": ("part", ["p_partkey AS row_id", "concat(p_name, 'vej') AS vejnavn", "cast(p_partkey % 60 + 1 as string) AS husnr", "cast(1000 + p_partkey % 50 * 100 as string) AS postnr", "p_brand AS postnrnavn", f"{_LAT.format(a='p_partkey')} AS lat", f"{_LON.format(a='p_partkey')} AS lon"]),
    "v_seq": ("events", ["user_id AS SessionId", "event_id", "ts", "value", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS place", "concat('own ', event_type) AS start_place"]),
    "v_vec": ("embeddings", ["vec_id", "embedding", "label"]),
}


class Views:
    """The views over one folder, made when they are asked for; tables by their own names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        source, expressions = VIEWS[f"v_{name}"]
        if " JOIN " in source:
            left, right, a, b = re.fullmatch(r"(\w+) JOIN (\w+) ON (\w+) = (\w+)", source).groups()
            base = self.table(left).join(self.table(right), F.col(a) == F.col(b))
        else:
            base = self.table(source)
        return base.selectExpr(*expressions)


def with_views(sql: str) -> str:
    """The SQL with those of the views that it names as common table expressions."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    tables = [f"{v} AS (SELECT {', '.join(VIEWS[v][1])} FROM {VIEWS[v][0]})" for v in named]
    if not tables:
        return sql
    return f"WITH {', '.join(tables)}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {', '.join(tables)} {sql}"
