"""Mixing sources to target weights by pivotal dependent rounding, with built-in functions only.

Every document of a source has the same expected number of copies, target words over source words: the whole part is
taken outright, and the fractional parts are rounded by pairs that exchange mass until one of them is integral, so a
source's taken words stay near its target. Groups form a reduction tree: each of about ``FAN`` documents leaves at most
one fractional document, and those meet in groups of ``FAN`` on the next level. On the first level all documents of a group
have one rate, and each is paired with the pool of the smaller ones, which leaves a small one over; on the levels above,
where rates differ, a document is paired with a document. Both keep every document's expectation.
Ties are broken by hashes of doc_id, or of source and text where that is null, so reruns agree. Null and empty texts have
size 0 and are never copied. A null source is a source of its own, ordered last. Rows of null or repeated ids are rounded
one by one. An empty table gives no rows. Very long texts are only counted; one that alone exceeds its source's target
is still taken or left whole. Other columns are ignored by ``mix`` and kept by ``repeat``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a group of the tree, and levels above the first: 256**4 documents of one source before groups grow.
FAN, LEVELS = 256, 3
MOST = 3
#: Sources up to which their totals are broadcast: a few MB.
BROADCAST_SOURCES = 20_000
#: Keys up to which those whose rows are taken unequally often are broadcast.
BROADCAST_IDS = 100_000


def _key() -> Column:
    """doc_id, or a hash of the row where that is null, which the column anon tells."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("row"), "source", "text"))


def sizes(docs: DataFrame) -> DataFrame:
    """key, anon, source and size: the number of words of the whole text."""
    return docs.select(_key().alias("key"), F.col("doc_id").isNull().alias("anon"), "source", _size().alias("size"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n and target. Weights 1, 2, 3 repeat over sources by code point, null last.

    A target stops at ``MOST`` times the source's size. Sharing the excess again and again ends where every source
    below its cap has one common rate per weight; caps are reached in the order of cap over weight.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = total.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    ranked = W.orderBy(F.col("cap") / F.col("weight"), "source")
    before, rest, everything = ranked.rowsBetween(W.unboundedPreceding, -1), ranked.rowsBetween(0, W.unboundedFollowing), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shared = weighed.withColumn("rate", (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # Before a source is capped the rate is too low for it; the last uncapped prefix's rate is the common one.
    free = shared.withColumn("capped", F.col("cap") < F.col("rate") * F.col("weight"))
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rate"))).over(everything)["rate"]
    return free.select("source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", common * F.col("weight"))).alias("target"))


_DONE = "array<struct<key:bigint,anon:boolean,size:bigint,extra:int>>"


def _uniform(a: Column, b: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, which keeps nested expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _round(units: Column, seed: int) -> Column:
    """Settle an array of (key, anon, size, p) of one p, largest first: settled units, and the at most one left fractional.

    Each unit is paired with the pool of those after it, which share one probability, kept as a + b * p. Mass moves at
    random between the two, keeping every expectation, until the unit or the whole pool is integral.
    """

    def pivot(s: Column, u: Column) -> Column:
        w = u["size"].cast("double")
        size, mass0 = s["size"] - w, s["mass"] - u["p"] * w
        known = F.struct(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["a"] + s["b"] * u["p"])).alias("p"),
            F.greatest(F.lit(0.0), F.least(size, s["a"] * size + s["b"] * mass0)).alias("mass"),
        )
        return _let(known, lambda k: _let(F.struct(F.least((1 - k["p"]) * w, k["mass"]).alias("up"), F.least(k["p"] * w, size - k["mass"]).alias("down")), lambda m: turned(s, u, w, size, mass0, k, m)))

    def turned(s: Column, u: Column, w: Column, size: Column, mass0: Column, k: Column, m: Column) -> Column:
        p, mass, up, down = k["p"], k["mass"], m["up"], m["down"]
        choice = F.struct((_uniform(u["key"], F.lit(1), seed) * (up + down) < down).alias("rise"), ((p < 1e-9) | (p > 1 - 1e-9)).alias("whole"))
        return _let(choice, lambda c: moved(s, u, w, size, mass0, p, mass, up, down, c["rise"], c["whole"]))

    def moved(s, u, w, size, mass0, p, mass, up, down, rise, whole) -> Column:
        settled = F.when(size < 0.5, whole).otherwise(whole | F.when(rise, (1 - p) * w <= mass).otherwise(p * w <= size - mass))
        kept = F.when(whole, 1.0).otherwise(1 - F.coalesce(F.try_divide(F.when(rise, up).otherwise(down), F.when(rise, mass).otherwise(size - mass)), F.lit(0.0)))
        extra = F.when(whole, (p > 0.5).cast("int")).otherwise(rise.cast("int"))
        return _let(F.struct(settled.alias("settled"), kept.alias("kept")), lambda c: F.struct(
            F.when(c["settled"], F.concat(s["done"], F.array(F.struct(u["key"].alias("key"), u["anon"].alias("anon"), u["size"].alias("size"), extra.alias("extra"))))).otherwise(s["done"]).alias("done"),
            F.when(c["settled"], s["rest"]).otherwise(F.struct(u["key"].alias("key"), u["anon"].alias("anon"), u["size"].alias("size"), F.when(rise, p + up / w).otherwise(p - down / w).alias("p"))).alias("rest"),
            size.alias("size"),
            mass0.alias("mass"),
            F.when(rise | whole, s["a"] * c["kept"]).otherwise(1 - (1 - s["a"]) * c["kept"]).alias("a"),
            (s["b"] * c["kept"]).alias("b"),
        ))

    # A struct that is always there keeps the state's type fixed; its null key says that nothing is left.
    nothing = F.struct(F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("boolean").alias("anon"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("p"))
    total = lambda f: F.aggregate(units, F.lit(0.0), lambda s, u: s + f(u))
    start = F.struct(F.array().cast(_DONE).alias("done"), nothing.alias("rest"), total(lambda u: u["size"].cast("double")).alias("size"), total(lambda u: u["size"] * u["p"]).alias("mass"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    return F.aggregate(units, start, pivot)


def _paired(units: Column, seed: int) -> Column:
    """Settle an array of (key, anon, size, p): settled units, and the at most one left fractional.

    One fractional unit is carried along and paired with the next. Words move at random from one to the other, keeping
    their sum and both expectations, until one of the two is integral; the other is carried on.
    """

    def pivot(s: Column, u: Column) -> Column:
        c = s["rest"]
        w, v, p, q = c["size"].cast("double"), u["size"].cast("double"), c["p"], u["p"]
        moves = F.struct(F.least((1 - p) * w, q * v).alias("up"), F.least(p * w, (1 - q) * v).alias("down"))
        return F.when(c["key"].isNull(), F.struct(s["done"].alias("done"), _unit(u, q).alias("rest"))).otherwise(_let(moves, lambda m: turned(s, c, u, w, v, p, q, m)))

    def turned(s, c, u, w, v, p, q, m) -> Column:
        rise = _uniform(u["key"], c["key"], seed) * (m["up"] + m["down"]) < m["down"]
        return _let(F.struct(rise.alias("rise"), F.when(rise, (1 - p) * w <= q * v).otherwise(p * w <= (1 - q) * v).alias("first")), lambda k: F.struct(
            F.concat(s["done"], F.array(F.when(k["first"], _settled(c, k["rise"])).otherwise(_settled(u, ~k["rise"])))).alias("done"),
            F.when(k["first"], _unit(u, q + F.when(k["rise"], -m["up"]).otherwise(m["down"]) / v)).otherwise(_unit(c, p + F.when(k["rise"], m["up"]).otherwise(-m["down"]) / w)).alias("rest"),
        ))

    nothing = F.struct(F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("boolean").alias("anon"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("p"))
    return F.aggregate(units, F.struct(F.array().cast(_DONE).alias("done"), nothing.alias("rest")), pivot)


def _unit(u: Column, p: Column) -> Column:
    return F.struct(u["key"].alias("key"), u["anon"].alias("anon"), u["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


def _settled(u: Column, taken: Column) -> Column:
    return F.struct(u["key"].alias("key"), u["anon"].alias("anon"), u["size"].alias("size"), taken.cast("int").alias("extra"))


def mix(docs: DataFrame, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target and copies, from 0 to 3: one row per document.

    A source without words has target 0 and is taken 0 times.
    """
    doc_id = F.when(~F.col("anon"), F.col("key")).alias("doc_id")
    return _mixed(docs, seed).select(doc_id, "source", "size", "source_size", "target", "copies")


def _mixed(docs: DataFrame, seed: int) -> DataFrame:
    """The mix by key and anon."""
    sized = cut(sizes(docs))
    share = cut(targets(sized))
    # One row for each source is broadcast where there are few; Spark chooses for more.
    if share.count() <= BROADCAST_SOURCES:
        share = F.broadcast(share)
    rows = sized.withColumn("nil", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).join(
        share.select(F.col("source").isNull().alias("nil"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "n", "target"), ["nil", "name"], "left"
    )
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.least(F.floor(rate + 1e-12), F.lit(MOST)).cast("int")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate - whole))
    part = F.when(part < 1e-9, 0.0).otherwise(part)
    rows = rows.select("key", "anon", "nil", "name", "size", "source_size", "target", "n", whole.alias("whole"), part.alias("p"))
    loose = (F.col("size") > 0) & (F.col("p") > 0)
    fixed = rows.filter(~F.coalesce(loose, F.lit(False)))
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / FAN)).cast("long")
    unit = F.struct((-F.col("size")).alias("o"), "key", "anon", "p", "size")
    level = rows.filter(loose).withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), groups))
    of_source = ["nil", "name", "source_size", "target", "whole"]
    out = fixed.select("key", "anon", *of_source, "size", F.lit(0).alias("extra"))
    for k in range(LEVELS + 1):
        last = k == LEVELS
        level = level.groupBy(*of_source, *([] if last else ["bucket"])).agg(F.array_sort(F.collect_list(unit)).alias("units")).withColumn("r", (_paired if k else _round)(F.col("units"), seed + k)).drop("units")
        # Each level is cut, as otherwise its plan holds those of all levels below.
        level = cut(level)
        out = out.unionByName(level.select(*of_source, F.explode("r.done").alias("d")).select("d.key", "d.anon", *of_source, "d.size", "d.extra"))
        rest = level.filter("r.rest.key is not null").select(*of_source, "r.rest.key", "r.rest.anon", "r.rest.size", "r.rest.p", *([] if last else [F.shiftright("bucket", 8).alias("bucket")]))
        if last:
            out = out.unionByName(rest.select("key", "anon", *of_source, "size", (_uniform(F.col("key"), F.lit(0), seed) < F.col("p")).cast("int").alias("extra")))
        level = rest
    source = F.when(F.col("nil"), F.lit(None).cast(T.StringType())).otherwise(F.col("name"))
    return out.select("key", "anon", source.alias("source"), "size", "source_size", F.col("target").cast("double").alias("target"), F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra"), F.lit(MOST))).otherwise(0).alias("copies"))


def repeat(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The mix itself: each row as often as it was rounded, with its own columns.

    Rows of one doc_id, or equal rows without one, are taken as often together as they were rounded; which of those of
    one source and size takes more goes by their columns.
    """
    key, anon, size, nth, copies, copy = (fresh(docs, n) for n in ("key", "anon", "size", "nth", "copies", "copy"))
    taken = cut(_mixed(docs, seed).select(F.col("key").alias(key), F.col("anon").alias(anon), F.col("source").alias("from"), F.col("size").alias("words"), F.col("copies").alias(copies)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    mine = docs.withColumns({key: _key(), anon: F.col("doc_id").isNull()})
    of_key = taken.groupBy(key, anon).agg(F.min(copies).alias("least"), F.max(copies).alias(copies))
    out = mine.join(of_key.filter((F.col("least") == F.col(copies)) & (F.col(copies) > 0)).drop("least"), [key, anon])
    uneven = cut(of_key.filter(F.col("least") < F.col(copies)).select(key, anon))
    n = uneven.count()
    if n:
        keys = F.broadcast(uneven) if n <= BROADCAST_IDS else uneven
        row = W.partitionBy(key, anon, "source", size).orderBy(F.xxhash64("text"), F.to_json(F.struct(*kept)))
        own = mine.join(keys, [key, anon], "left_semi").withColumn(size, _size()).withColumn(nth, F.row_number().over(row))
        place = W.partitionBy(key, anon, "from", "words").orderBy(F.desc(copies))
        of_key, of_anon, of_source, of_size, of_nth = (fresh(docs, n) for n in ("of_key", "of_anon", "of_source", "of_size", "of_nth"))
        dealt = taken.join(keys, [key, anon], "left_semi").withColumn(nth, F.row_number().over(place)).filter(F.col(copies) > 0)
        dealt = dealt.select(F.col(key).alias(of_key), F.col(anon).alias(of_anon), F.col("from").alias(of_source), F.col("words").alias(of_size), F.col(nth).alias(of_nth), copies)
        same = [F.col(a) == F.col(b) for a, b in ((key, of_key), (anon, of_anon), (size, of_size), (nth, of_nth))] + [F.col("source").eqNullSafe(F.col(of_source))]
        out = out.select(*kept, copies).unionByName(own.join(dealt, same).select(*kept, copies))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*kept)


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
