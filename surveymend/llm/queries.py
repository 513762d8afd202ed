"""The operators as queries over whole tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, decontamination, fingerprints, htmltext, langid, mixing, neighbours, ngram_join, pii, secrets, sentencepieces, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"), secrets.train(secrets.training_sample(spark)))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(read(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.counted(read(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact phrase matches; ``near_passages`` has the proximity matches."""
    return decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slack=0).drop("n_near_items")


def near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_items", "n_near_items")


# What SQL can say of results that it can't state whole: the same operators, without the columns that models make.


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).drop("spans")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op2_source_mix(spark, sf_dir)
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii(spark, sf_dir).drop("spans")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Query]:
    dealt = (op1_secret_scan, op2_source_mix, op3_ngram_join, op4_sentencepiece, op5_neighbours, op6_toxicity, op7_pii, op8_language, op9_main_text, op10_fingerprints, op11_alignment, op12_centroids, op13_decontamination)
    return {f.__name__: f for f in (*dealt, secret_base_spans, mix_targets, pii_base_spans, edited_texts, near_passages)}


_JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


def _spans_sql(kinds: dict[str, tuple[str, str, str]], order: str) -> str:
    """Counts and digest of the matches of kinds: (pattern, group or '', condition on the match m and the group g)."""
    places = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)"
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{name}' AS kind, whole[i] AS m, part[i] AS g, {places} AS a FROM (SELECT doc_id, whole, part, gaps, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS whole, regexp_extract_all(text, '{p}', {g or 0}) AS part, string_split_regex(text, '{p}') AS gaps FROM t))"
        for k, (name, (p, g, _)) in enumerate(kinds.items())
    )
    valid = " OR ".join(f"(k = {k} AND {c})" for k, (_, _, c) in enumerate(kinds.values()))
    counts = ", ".join(f"CAST(count(*) FILTER (k = {k}) AS BIGINT) AS n_{name}" for k, name in enumerate(kinds))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
good AS (SELECT doc_id, k, a, concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a + length(m) AS BIGINT)) AS span FROM found WHERE {valid})
SELECT t.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY {order}), '')) AS base_sha256 FROM t LEFT JOIN good USING (doc_id) GROUP BY t.doc_id"""


_SECRETS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "2", "length(g) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "", "length(m) >= 20"),
    "hex": ("[0-9a-f]+", "", "length(m) >= 24"),
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse({_DIGITS})[j] AS INTEGER) ELSE (CAST(reverse({_DIGITS})[j] AS INTEGER) * 2) // 10 + (CAST(reverse({_DIGITS})[j] AS INTEGER) * 2) % 10 END)) % 10 = 0"
_PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "", "len(list_filter(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) <= 255)) = 4"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}
_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, (SELECT sum(size) FROM d) - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(w) OVER (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
 FROM s WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT CAST(rest AS DOUBLE) / weights AS r FROM o WHERE CAST(cap AS DOUBLE) / w >= CAST(rest AS DOUBLE) / weights ORDER BY CAST(cap AS DOUBLE) / w, source LIMIT 1)
SELECT doc_id, size, source_size, round(least(CAST(cap AS DOUBLE), coalesce((SELECT r FROM rate), 1e300) * w), 4) AS target, true AS within FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
"""
_EDITED_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(concat(substring(text, 1, n - n // 2), substring(after, 1, n // 2))) AS edited_sha256 FROM p
"""


def _centroids_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """Rounds as tables of (j, c): means from assignments, and assignments from means."""
    near = lambda c: f"SELECT vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT x.vec_id, x.v, c.j, CAST(list_sum(list_transform(list_zip(x.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM x, {c} c) GROUP BY vec_id, v"
    out = [
        f"x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({centroids.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {centroids.DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS j, v AS c FROM (SELECT sha256(concat('{centroids.SEED}:', vec_id)) AS h, v FROM x ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        out += [
            f"a{r} AS MATERIALIZED ({near(f'c{r}')})",
            f"m{r} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS c FROM (SELECT j, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT j, unnest(range(1, {centroids.DIM + 1})) AS i, unnest(v) AS e FROM a{r}) GROUP BY j, i) GROUP BY j)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.j, list_transform(coalesce(m{r}.c, c{r}.c), lambda e: CAST(e AS BIGINT)) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.j = m{r}.j)",
        ]
    return "WITH " + ",\n".join(out) + f""",
a AS MATERIALIZED ({near(f"c{rounds}")})
SELECT vec_id, a.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.j = a.j"""


_LEAKS_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda p: array_to_string(w[p:p + 9], ' '))) AS win FROM i WHERE len(w) > 0),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS win FROM d, (SELECT DISTINCT n FROM v)),
h AS MATERIALIZED (SELECT doc_id, p, p.n, win FROM p WHERE win IN (SELECT win FROM v)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h JOIN v USING (win)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the join, and of what it can say of others, whose whole results hold learned models, random choices, digests
    of added spans or tokenizer ids."""
    return {
        "op3_ngram_join": _JOIN_SQL.strip(),
        "op12_centroids": _centroids_sql(),
        "op13_decontamination": _LEAKS_SQL.strip(),
        "secret_base_spans": _spans_sql(_SECRETS, "a, k"),
        "mix_targets": _MIX_SQL.strip(),
        "pii_base_spans": _spans_sql(_PERSONAL, "k, a"),
        "edited_texts": _EDITED_SQL.strip(),
    }
