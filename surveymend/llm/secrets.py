"""Secret scan with built-in functions only: base patterns, and character Markov models compared by log-likelihood ratio.

``scan`` adds spans to each text; ``redact`` replaces them. The models of random strings and of ordinary identifiers, and
the threshold between them, are learned from labelled samples. Null and empty texts have no spans. Positions are code
points, ends exclusive. Overlapping base spans of different kinds all stay; a ``markov`` span is dropped where it overlaps
one; spans that start together are in the order of ``KINDS``. Very long texts are scanned whole, each within its row.
Repeated rows and null ids give a row each, an empty table none. Other columns stay, but those of the names that ``scan``
adds are replaced; ``redact`` adds no column.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Kinds in the order that ties at one start follow.
KINDS = ("assign", "access", "hex", "markov")
# Either case is spelled out, as regular-expression libraries fold non-ASCII letters differently.
_WORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = _WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are maximal, so asking for the length inside the pattern equals dropping shorter matches afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What isn't a candidate: digits and marks without a letter, and UUIDs.
PLAIN = r"^[0-9+/_=-]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Characters that candidates are made of, for smoothing.
ALPHABET = 67
#: One labelled string in so many is left out of the models, and serves to set the threshold; the shares of
#: identifiers and of random strings that it may leave on the wrong side.
FOLDS, FALSE, MISSED = 3, 0.001, 0.01
#: Words that ordinary identifiers of the training sample are joined from (fixed values).
WORDS = (
    "get set user name value index count list table column row key data file path size time date order item type class method object string number array map filter select join group window session address street house code latitude longitude distance speed status result error message request response server client config option default buffer stream reader writer parser handler manager service factory builder context checkpoint partition shuffle broadcast schema "
    "account amount balance category company country customer discount document employee holiday image invoice journal language market payment picture product project purchase quantity region report sales season shipment summary supplier travel vehicle warehouse weather "
    "und der die das nicht haus wasser zeit jahr stadt schule arbeit leben welt ende kind les des une pour avec dans plus monde temps jour maison ville femme los las una con para como casa agua vida tiempo ciudad trabajo og det hus vej by tid dag hjem skole rejse"
).split()
#: Rows of the training sample for each label: its bound.
SAMPLE_ROWS = 4096


def training_sample(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, random, left_out): random strings in several alphabets, and identifiers in the ways that words are joined.

    One row in ``FOLDS`` is left out of the models, and has words that no other row has: the threshold is set on new words.
    """
    ids = spark.range(rows)
    left_out = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(FOLDS)) == 0
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    every = list(dict.fromkeys(WORDS))
    words = [F.array(*[F.lit(w) for k, w in enumerate(every) if (k % FOLDS == 0) == out]) for out in (True, False)]
    draw = lambda of, k: F.element_at(of, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(of)) + 1).cast("int"))
    four = [F.when(left_out, draw(words[0], k)).otherwise(draw(words[1], k)) for k in range(4)]
    of = lambda kinds: F.element_at(F.array(*kinds), (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int"))
    random = of([digest, packed, packed, F.translate(packed, "+/=", "aQ7"), F.upper(digest), F.translate(F.upper(F.concat(digest)), "0123456789", "GHKMPRSTVZ")])
    number = F.pmod(F.xxhash64("id", F.lit(21)), F.lit(10**8)).cast("string")
    day = F.concat(F.lit("20"), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit("-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("-1"), (F.col("id") % 10).cast("string"))
    plain = of([
        F.concat_ws("_", *four), F.concat_ws("-", *four), F.concat_ws("/", *four), F.concat(four[0], *[F.initcap(w) for w in four[1:]]), F.concat(*[F.initcap(w) for w in four]), F.concat(*four),
        F.upper(F.concat_ws("_", *four)), F.concat(F.concat_ws("-", *four), F.lit("-"), F.col("id").cast("string")), F.concat_ws("/", *four[:3], day),
        F.repeat(F.element_at(F.array(*[F.lit(c) for c in "=-_/+"]), (F.floor(F.col("id") / 10) % 5 + 1).cast("int")), 30),
        F.concat_ws("/", *four[:2], F.concat(F.lit("v"), F.col("id") % 10), number), F.concat_ws("/", F.lit("/usr/lib"), F.concat(F.lit("x86_64-"), four[0], F.lit("-"), four[1]), four[2]), F.concat_ws("_", four[0], number, four[1], day),
    ])
    return ids.select(random.alias("text"), F.lit(True).alias("random"), left_out.alias("left_out")).unionByName(ids.select(plain.alias("text"), F.lit(False).alias("random"), left_out.alias("left_out")))


@dataclass
class Model:
    """Log-likelihood ratios of character transitions, at 128 * first + second, and the mean ratio from which a string is random."""

    odds: list[float]
    threshold: float


def train(sample: DataFrame) -> Model:
    """Models from (text, random, and left_out or a hash in its place); collects at most 2 * 67**2 counts and two quantiles.

    Among strings left out of the counts, the threshold lies half way between what all but ``FALSE`` of the identifiers
    stay below and what all but ``MISSED`` of the random strings exceed, or at the former where the two overlap.
    """
    if "left_out" not in sample.columns:
        sample = sample.withColumn("left_out", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(FOLDS)) == 0)
    chars = F.transform(F.split("text", ""), F.ascii)
    pairs = (
        sample.filter("not left_out").filter(F.length("text") > 1)
        .select("random", chars.alias("c"))
        .select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * 128 + F.element_at("c", i + 1))).alias("pair"))
        .filter(F.col("pair").between(0, 128 * 128 - 1))
        .groupBy("random", "pair")
        .count()
    )
    count, first = {True: {}, False: {}}, {True: {}, False: {}}
    for row in pairs.collect():
        count[row[0]][row[1]] = row[2]
        first[row[0]][row[1] >> 7] = first[row[0]].get(row[1] >> 7, 0) + row[2]

    odds = lambda r, p: log((count[r].get(p, 0) + 0.5) / (first[r].get(p >> 7, 0) + 0.5 * ALPHABET))
    model = Model([round(odds(True, p) - odds(False, p), 4) for p in range(128 * 128)], 0.0)
    r = ratio(F.col("text"), model)
    ends = sample.filter("left_out").agg(
        F.percentile_approx(F.when(~F.col("random"), r), 1 - FALSE, 10_000).alias("plain"), F.percentile_approx(F.when(F.col("random"), r), MISSED, 10_000).alias("random")
    ).first()
    plain, random = (0.0 if x is None else x for x in ends)
    model.threshold = max(plain, (plain + random) / 2)
    return model


def ratio(token: Column, model: Model) -> Column:
    """Mean log-likelihood ratio of an ASCII token's transitions; 0 for tokens of one character."""
    table = F.split(F.lit(",".join(map(str, model.odds))), ",").cast("array<double>")
    chars = F.transform(F.split(token, ""), F.ascii)
    total = F.aggregate(
        chars,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(c.alias("last"), F.when((s["last"] < 0) | (c > 127), s["sum"]).otherwise(s["sum"] + F.element_at(table, s["last"] * 128 + F.least(c, F.lit(127)) + 1)).alias("sum")),
    )["sum"]
    return F.coalesce(F.try_divide(total, F.length(token) - 1), F.lit(0.0))


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches with places, from the texts between matches; value is the group's text."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
        F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("before"),
    )
    walk = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("out")),
        lambda s, m: F.struct(
            (s["at"] + F.length(m["before"]) + F.length(m["whole"])).alias("at"),
            F.concat(
                F.coalesce(s["out"], F.array().cast(_SPAN)),
                F.array(F.struct((s["at"] + F.length(m["before"])).alias("start"), F.lit(kind).alias("kind"), (s["at"] + F.length(m["before"]) + F.length(m["whole"])).alias("end"), m["part"].alias("value"))),
            ).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(_SPAN))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: Model, text: str = "text", threshold: float | None = None) -> DataFrame:
    """Add ``secret_base`` and ``secret_spans``, sorted by start and kind: arrays of (start, kind, end, value)."""
    return _scanned(docs, model, text, "secret_base", "secret_spans", model.threshold if threshold is None else threshold)


def _scanned(docs: DataFrame, model: Model, text: str, base_as: str, spans_as: str, threshold: float) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_spans(whole, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 6)
    base = F.array_sort(F.concat(assign, _spans(whole, ACCESS, 1), _spans(whole, HEX, 2)))
    out = docs.withColumn(base_as, base)
    over = lambda s: F.exists(base_as, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(_spans(whole, CANDIDATE, 3), lambda s: ~over(s) & ~s["value"].rlike(PLAIN) & (ratio(s["value"], model) > threshold))
    return out.withColumn(spans_as, F.array_sort(F.concat(base_as, more)))


def redact(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span of ``scan`` in the text by a mark; overlapping spans become one. Null texts stay null."""
    base_as, spans_as = fresh(docs, "base"), fresh(docs, "spans")
    out = _scanned(docs, model, text, base_as, spans_as, model.threshold)
    step = F.aggregate(
        spans_as,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("done")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.when(x["start"] < s["at"], s["done"]).otherwise(F.concat(s["done"], F.substr(F.col(text), s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("done"),
            )
        ),
    )
    clean = F.when(F.size(spans_as) == 0, F.col(text)).otherwise(F.concat(step["done"], F.substr(F.col(text), step["at"] + 1)))
    return out.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts and digests of the spans of ``scan``."""
    out = scan(docs.select("doc_id", "text"), model)
    number = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(listed(F.col("secret_base")), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
