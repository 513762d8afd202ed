"""Joins, overlays, updates and raw-against-corrected comparison over keyed DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_suffixed(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_raw", "_mod"), how: str = "inner") -> DataFrame:
    """Join whose columns of one name on both sides, other than keys, get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    return left.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), on, how)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under their new names; names that aren't there are passed over, and two columns never get one name."""
    out = [names.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError(f"renaming gives columns of one name: {sorted(x for x in set(out) if out.count(x) > 1)}")
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def overlay(df: DataFrame, bases: list[str], raw: str = "_raw", mod: str = "_mod") -> DataFrame:
    """base_raw becomes the corrected value where there is one; corrected columns go."""
    return df.withColumns({b + raw: F.coalesce(F.col(b + mod), F.col(b + raw)) for b in bases}).drop(*[b + mod for b in bases])


def update_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with right's values where those aren't null; columns that only right has are added. Right's keys are unique."""
    shared = [c for c in right.columns if c not in on and c in left.columns]
    extra = [c for c in right.columns if c not in on and c not in left.columns]
    out = left.join(right.withColumnsRenamed({c: f"__new_{c}" for c in shared}), on, "left")
    return out.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns], *extra)


def coalesce_copies(df: DataFrame, name: str, copies: list[str]) -> DataFrame:
    """One column of the first value that isn't null among copies."""
    return df.withColumn("__one", F.coalesce(*copies)).drop(*copies).withColumnRenamed("__one", name)


def common_first(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of both in the left's order, then those that only the left has, then those that only the right has."""
    return [c for c in left.columns if c in right.columns] + [c for c in left.columns if c not in right.columns] + [c for c in right.columns if c not in left.columns]


def moved(df: DataFrame, column: str, after: str) -> DataFrame:
    """The same columns, with one behind another."""
    rest = [c for c in df.columns if c != column]
    at = rest.index(after) + 1
    return df.select(*rest[:at], column, *rest[at:])


def without(df: DataFrame, unwanted) -> DataFrame:
    """The columns whose names ``unwanted`` doesn't hold for."""
    return df.select(*[c for c in df.columns if not unwanted(c)])


def comparable(left: DataFrame, right: DataFrame, key: list[str]) -> dict[str, str]:
    """Columns that both sides have, other than keys, and whether they compare as number or text."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kind = lambda t: "number" if t in numbers or t.startswith("decimal") else "text"
    theirs = dict(right.dtypes)
    return {c: "number" if kind(t) == kind(theirs[c]) == "number" else "text" for c, t in left.dtypes if c in theirs and c not in key}


def compared(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """name, kind, compared, same, one_side and largest of each comparable column of rows with one key: pairs of values, equal
    ones, those that one side lacks, and the largest difference of numbers. Both sides are read once, for all columns."""
    kinds = comparable(left, right, key)
    a, b = (df.select(*key, *[F.col(c).alias(f"{side}_{c}") for c in kinds]) for df, side in ((left, "l"), (right, "r")))
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    apart = lambda c: F.max(F.abs(l(c).cast("double") - r(c).cast("double"))) if kinds[c] == "number" else F.max(F.lit(None).cast("double"))
    each = [
        F.struct(
            F.lit(c).alias("name"), F.lit(kinds[c]).alias("kind"), F.count_if(l(c).isNotNull() & r(c).isNotNull()).alias("compared"), F.count_if(l(c) == r(c)).alias("same"),
            F.count_if(l(c).isNull() != r(c).isNull()).alias("one_side"), apart(c).alias("largest"),
        )
        for c in kinds
    ]
    return a.join(b, key).agg(F.array(*each).alias("each")).select(F.inline("each"))


def bases_of(df: DataFrame, raw: str = "_raw", mod: str = "_mod") -> list[str]:
    """Names that occur with both suffixes, in column order."""
    have = set(df.columns)
    return [b for c in df.columns if (b := re.sub(re.escape(raw) + "$", "", c)) != c and b + mod in have]


def changed(raw: Column, mod: Column, nulls_count: bool = False) -> Column:
    """Whether a correction differs. A raw null never counts in three-valued comparison, and always where ``nulls_count``."""
    return mod.isNotNull() & ~raw.eqNullSafe(mod) if nulls_count else F.coalesce(mod.isNotNull() & (mod != raw), F.lit(False))


def diff(df: DataFrame, bases: list[str] | None = None, nulls_count: bool = False) -> DataFrame:
    """Add changed_cols, n_changed and row_flag (WRONG or OK) of raw and corrected pairs."""
    bases = bases_of(df) if bases is None else bases
    masks = [changed(F.col(b + "_raw"), F.col(b + "_mod"), nulls_count) for b in bases]
    names = F.array_compact(F.array(*[F.when(m, F.lit(b)) for m, b in zip(masks, bases, strict=True)]))
    n = reduce(lambda a, b: a + b, [m.cast("int") for m in masks])
    return df.withColumn("changed_cols", names).withColumn("n_changed", n).withColumn("row_flag", F.when(n > 0, "WRONG").otherwise("OK"))


def changed_rows(df: DataFrame, bases: list[str] | None = None, nulls_count: bool = False) -> DataFrame:
    """Rows with at least one change, with what ``diff`` adds."""
    return diff(df, bases, nulls_count).filter("n_changed > 0")


def diff_long(df: DataFrame, keys: list[str], bases: list[str] | None = None, nulls_count: bool = False) -> DataFrame:
    """One row (keys, column, raw_value, mod_value) for each changed value."""
    bases = bases_of(df) if bases is None else bases
    each = F.array(*[F.struct(F.lit(b).alias("column"), F.col(b + "_raw").cast("string").alias("raw_value"), F.col(b + "_mod").cast("string").alias("mod_value"), changed(F.col(b + "_raw"), F.col(b + "_mod"), nulls_count).alias("hit")) for b in bases])
    return df.select(*keys, F.explode(F.filter(each, lambda s: s["hit"])).alias("s")).select(*keys, "s.column", "s.raw_value", "s.mod_value")


def venn(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row with only_left, only_right and in_both distinct keys, by one full join."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("in_both"))


def aligned(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Two (key, value) tables side by side, with 0 where one has no row."""
    l, r = (df.select(key, F.col([c for c in df.columns if c != key][0]).alias(n)) for df, n in zip((left, right), names, strict=True))
    return l.join(r, key, "full").na.fill(0, list(names))


def previous_or_own(df: DataFrame, columns: dict[str, str], by: list[str], order: list[str]) -> DataFrame:
    """Each target becomes the previous row's source value; the own value stays at a group's start and where that is null."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({t: F.coalesce(F.lag(s).over(w), F.col(t)) for t, s in columns.items()})


def balanced_sample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the rarest has, the first by a hash of key and seed.

    Rows are counted by bins of the hash; only a class's last bin is ranked, so no task sorts a class.
    """
    rows = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))).withColumn("__bin", F.substring("__h", 1, 4))
    counts = rows.groupBy(label, "__bin").agg(F.count(F.lit(1)).alias("__m"))
    least = counts.groupBy(label).agg(F.sum("__m").alias("n")).agg(F.min("n")).scalar()
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(label).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("__before", before).withColumn("__n", least).filter(F.col("__before") < F.col("__n"))
    last = last.groupBy(label).agg(F.max(F.struct("__bin", F.col("__n") - F.col("__before"))).alias("__last"))
    last = last.select(F.col(label).alias("__label"), F.col("__last.__bin").alias("__end"), F.col("__last.col2").alias("__left"))
    marked = rows.join(few(last), F.col(label).eqNullSafe(F.col("__label"))).filter(F.col("__bin") <= F.col("__end"))
    whole = marked.filter(F.col("__bin") < F.col("__end")).select(*df.columns)
    part = marked.filter(F.col("__bin") == F.col("__end")).withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy("__h", key)))
    return whole.unionByName(part.filter(F.col("__k") <= F.col("__left")).select(*df.columns))


#: Tasks that the rows of one key are spread over, and rows up to which a small table is broadcast.
SPREAD, BROADCAST_ROWS = 8, 100_000


def few(df: DataFrame) -> DataFrame:
    """Marked for broadcast, if it has few rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], spread: int = 1) -> DataFrame:
    """Left join with a table of unique keys, whose keys both sides name alike.

    Rows without a whole key match nothing, and are dealt out by a hash of the row. Rows of one key are spread over
    ``spread`` tasks, for which the looked-up table is repeated; so no task gets all rows of a hot or missing key.
    """
    row = F.xxhash64(*left.columns)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    salted = left.withColumn("__salt", F.when(whole, F.pmod(row, F.lit(spread))).otherwise(row))
    # Not a literal, which would be taken out of the join's keys.
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))) if spread > 1 else F.xxhash64(*on).bitwiseAND(F.lit(0)))
    return salted.join(copies, [*on, "__salt"], "left").select(*left.columns, *[c for c in right.columns if c not in on])


def remaining(todo: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows still to do after an interrupted run, whose finished rows are in ``done``."""
    return todo.join(done.select(*on).distinct(), on, "left_anti")
