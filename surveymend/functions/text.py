"""Folding, taxonomies, notes and verdicts as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters that decompose to one base letter; made from the character database, as ø and æ must stay.
_FOLDS = {chr(c): d[0] for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}

# Fixed values, in the order that decides between them.
#: Neighbourhood names and the postcode that each stands for; the first that occurs counts.
NEIGHBOURHOODS = {
    "nørrebro": "2200", "nørre": "2200", "østerbro": "2100", "øster": "2100",
    "vesterbro": "1620", "vester": "1620", "amager": "2300", "christianshavn": "1400",
    "frederiksberg": "2000", "valby": "2500", "brønshøj": "2700", "vanløse": "2720",
    "hvidovre": "2650", "rødovre": "2610", "glostrup": "2600", "albertslund": "2620",
    "herlev": "2730", "ballerup": "2750", "smørum": "2765", "malmø": "2765",
    "kongens lyngby": "2800", "lyngby": "2800", "gentofte": "2820", "klampenborg": "2930",
    "charlottenlund": "2920", "ordrup": "2920", "hellerup": "2900", "inderhavnen": "2100",
    "holmen": "1437", "christiania": "1437", "refshaleøen": "1432", "tåsinge": "5700",
    "langeland": "5900", "ærø": "5970", "als": "6400", "fyn": "5000",
    "midtjylland": "8000", "østjylland": "8000", "vestjylland": "7500",
    "nordjylland": "9000", "sjælland": "4000", "bornholm": "3700",
    "lolland": "4900", "falster": "4800", "møn": "4780", "hoje taastrup": "2630",
}
#: Forms of one district's name, looked for before the others, and its postcode.
SOUTH, SOUTH_POSTCODE = ("kbh s", "københavn s", "kobenhavn s", "cph s"), "2300"
#: Endings of street names that addresses are parsed by.
SUFFIXES = (
    "vej", "gade", "gaden", "boulevard", "allé", "alle", "plads", "stræde", "torv",
    "kaj", "park", "parken", "sti", "stien", "bakke", "vænge", "have", "engen", "gård", "runddel",
    "boulevarden", "boulev.", "alléen", "vang", "vangen", "vejen", "svinget", "skoven", "ringen", "centret",
)
#: Endings that the structure classes look for, and the words of failure classes.
MARKERS = ("vej", "gade", "alle", "allé", "plads", "torv", "boulevard", "stræde")
PRIVATE = ("privat", "hemmelig", "ved ikke", "ukendt", "unknown", "private", "don't know")
SEMANTIC = ("arbejde", "job", "hjem", "skole", "gymnasium", "universitet", "work", "home", "school", "butik", "center", "station")
#: Names of classes.
FAILURES = ("Noise (<3 chars)", "Ambiguity / Privacy", "Semantic Concept (Logic)", "Complex / Unclassified")
STRUCTURES = ("Narrative Description (>5 words)", "Malformed Specific Address (Street + Number)", "Generic Street Name (No Number)", "Vague Stub (1-4 words, No Address markers)")


def fold(c: Column) -> Column:
    """Lower case without accents, only letters, digits and space, trimmed. ø and æ stay."""
    c = F.translate(c, "".join(_FOLDS), "".join(_FOLDS.values()))
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")))


def normalised(c: Column) -> Column:
    return F.lower(F.trim(c))


def to_number(c: Column) -> Column:
    return c.try_cast("double")


def to_whole(c: Column) -> Column:
    """Rounded half to even; what is no number becomes null."""
    return F.bround(c.try_cast("double"), 0).cast("long")


def hint(c: Column, places: dict[str, str] | None = None) -> Column:
    """The postcode that a text's neighbourhood stands for; null where it names none."""
    places = NEIGHBOURHOODS if places is None else places
    low = F.lower(c)
    start = F.when(reduce(lambda a, b: a | b, [low.contains(s) for s in SOUTH]), SOUTH_POSTCODE)
    return reduce(lambda w, kv: w.when(low.contains(kv[0]), kv[1]), places.items(), start)


def note_scores(note: Column) -> Column:
    """All numbers in brackets of a repair note."""
    return F.transform(F.regexp_extract_all(note, F.lit(r"\((\d+)\)"), F.lit(1)), lambda s: s.cast("double"))


def note_score(note: Column, how: str = "max", default: float | None = 0.0) -> Column:
    """One score of a note: max, mean or first of its numbers; the default where it has none."""
    s = note_scores(note)
    value = {"max": F.array_max(s), "first": F.get(s, F.lit(0)), "mean": F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), F.size(s).cast("double"))}[how]
    return value if default is None else F.coalesce(value, F.lit(default))


def note(*tokens: Column) -> Column:
    """Tokens that aren't null, joined by semicolons; null where there is none."""
    joined = F.concat_ws(";", *tokens)
    return F.when(joined != "", joined)


def _any(c: Column, words) -> Column:
    """Whether any of some plain words occurs; plain search is many times faster than an alternation."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def failure_class(text: Column) -> Column:
    """Why a text couldn't be resolved; a missing text reads as the word for it."""
    noise, private, semantic, other = FAILURES
    named = lambda t: F.when(F.length(t) < 3, noise).when(_any(t, PRIVATE), private).when(_any(t, SEMANTIC), semantic).otherwise(other)
    return _once(F.trim(F.lower(F.coalesce(text, F.lit("nan")))), named)


def structure_class(text: Column) -> Column:
    """By number of words, from five on, then by whether a street ending and a digit occur."""
    narrative, malformed, generic, stub = STRUCTURES
    few = lambda t: F.when(_any(t, MARKERS), F.when(t.rlike("[0-9]"), malformed).otherwise(generic)).otherwise(stub)
    # Four runs of white space, looked for from the beginning, so that a long text isn't split.
    named = lambda t: F.when(t.rlike(r"^\S*+(?:\s++\S++){3}\s"), narrative).otherwise(few(t))
    return _once(F.trim(F.lower(F.coalesce(text, F.lit("nan")))), named)


def verdict(answer: Column) -> Column:
    """INVALID if the answer says so anywhere, in either case; else VALID, as for no answer."""
    return F.when(F.upper(answer).contains("INVALID"), "INVALID").otherwise("VALID")


def fix_class(similarity: Column) -> Column:
    return F.when(similarity > 80, "Syntactic").when(similarity > 40, "Hybrid").otherwise("Semantic")


def address_line(street: Column, number: Column, postcode: Column, town: Column) -> Column:
    """``street number, postcode town``; missing parts are left empty."""
    s, n, p, t = (F.coalesce(c, F.lit("")) for c in (street, number, postcode, town))
    return F.trim(F.concat(s, F.lit(" "), n, F.lit(", "), p, F.lit(" "), t))


def mode_label(mode: Column, other: str | None = "Other", unknown: str | None = "Unknown") -> Column:
    m = mode.try_cast("double").cast("int")
    return F.when(m.isNull(), F.lit(unknown)).when(m == 1, "Walk").when(m == 2, "Bike").when(m.between(3, 25), "Car").otherwise(F.lit(other))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; outside generated code, which stays small enough to be compiled."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, its exact binary value rounded, ties to even, as Python and C render it.

    A product further from a middle than its own error is rounded right, and so is one too large for decimals. Else the nearest two decimals lie around a middle;
    where the number equals the double next to the middle, the exact remainder of that double, by products of its halves,
    tells the side. That is left to lambdas, which aren't compiled and take many times as long.
    """
    scale = 10**places

    def off(middle: Column, odd: Column) -> Column:
        split = middle * F.lit(134217729.0)
        return _once(split - (split - middle), lambda high: (high * F.lit(2.0 * scale) - odd) + (middle - high) * F.lit(2.0 * scale))

    def whole(a: Column, low: Column) -> Column:
        odd = (2 * low + 1).cast("double")
        tie = lambda middle: _once(off(middle, odd), lambda d: F.when(d != 0, d > 0).otherwise(low % 2 == 1))
        up = _once(odd / F.lit(2.0 * scale), lambda middle: F.when(a != middle, a > middle).otherwise(tie(middle)))
        return low + up.cast("long")

    def written(x: Column) -> Column:
        sign = F.when(x < 0, "-").otherwise("")
        n = _once(F.abs(x), lambda a: _once(F.floor(a * F.lit(float(scale))), lambda low: whole(a, low)))
        text = _once(n, lambda n: F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))) if places else n.cast("string")
        return F.when(F.isnan(x), "nan").when(F.abs(x) == F.lit(float("inf")), F.concat(sign, F.lit("inf"))).when(F.abs(x) < 2.0**53 / scale, F.concat(sign, text)).otherwise(F.format_string(f"%.{places}f", x))

    x = x.cast("double")
    product = F.abs(x) * F.lit(float(scale))
    n = F.rint(product)
    clear = (F.abs(x) < 2.0**53 / scale) & ((F.lit(0.5) - F.abs(product - n) > product * F.lit(2.0**-52)) | (product >= F.lit(2.0**52)))
    text = n.cast("long").cast("string")
    if places:
        text = F.concat(F.floor(n / F.lit(float(scale))).cast("string"), F.lit("."), F.lpad((n % F.lit(float(scale))).cast("long").cast("string"), places, "0"))
    return F.when(clear, F.concat(F.when(x < 0, "-").otherwise(""), text)).when(x.isNotNull(), _once(x, written))
