"""Markov models of secrets on labelled strings that they weren't trained on, and secrets on odd tables."""

import base64
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from surveymend.llm import secrets

WORDS = "rhythm pumpkin thunder blanket whisper velvet lantern orchard puzzle jungle cricket pocket mirror candle bucket ribbon saddle turtle pepper walnut falcon glacier harbor meadow canyon violet copper silver marble timber anchor bridge castle desert engine forest garden hammer island jacket kernel ladder magnet needle oyster parrot quartz rocket shadow tunnel umbrella valley wagon yellow zebra mountain river flower dragon knight wizard frosty bright quick jumpy lazy sphinx vow judge".split()


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.training_sample(spark))


def random_strings(rng):
    kinds = [
        lambda n: base64.b64encode(rng.randbytes(n)).decode()[: n + 4],
        lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n)),
        lambda n: "ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=n)),
        lambda n: "sk_live_" + "".join(rng.choices(string.ascii_letters + string.digits, k=n)),
        lambda n: "".join(rng.choices("0123456789ABCDEF", k=n + 8)),
        lambda n: "".join(rng.choices(string.ascii_uppercase + "234567", k=n + 8)),
    ]
    return [k(rng.randint(24, 48)) for _ in range(250) for k in kinds]


def identifiers(rng):
    """Names of kinds of identifiers, and how each is made."""
    pick = lambda n: rng.choices(WORDS, k=n)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    return {
        "snake": lambda: "_".join(pick(4)), "kebab": lambda: "-".join(pick(4)), "path": lambda: "/" + "/".join(pick(4)), "camel": lambda: "".join(w.title() for w in pick(4)), "lower camel": lambda: pick(1)[0] + "".join(w.title() for w in pick(3)),
        "joined": lambda: "".join(pick(4)), "upper": lambda: "_".join(pick(4)).upper(), "path with numbers": lambda: "/".join(pick(2)) + f"/v{rng.randint(1, 9)}/{digits(8)}", "path with date": lambda: "/".join(pick(3)) + "/2023-11-02", "numbered": lambda: "-".join([*pick(3), digits(4)]),
        "zeros": lambda: "0" * rng.randint(20, 23), "digits": lambda: digits(23), "uuid": lambda: "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12)), "upper uuid": lambda: "-".join("".join(rng.choices("0123456789ABCDEF", k=n)) for n in (8, 4, 4, 4, 12)),
        "library": lambda: f"/usr/lib/x86_64-linux-gnu/lib{pick(1)[0]}", "stamp": lambda: f"{pick(1)[0]}_20240517_123045_{pick(1)[0]}", "line": lambda: rng.choice("=-_+") * rng.randint(20, 60),
    }


def test_random_strings_are_found_and_identifiers_of_new_words_left(spark, model):
    assert not set(WORDS) & set(secrets.WORDS)
    rng = random.Random(7)
    base = re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    rows = [("secret", x) for x in random_strings(rng)] + [(kind, make()) for kind, make in identifiers(rng).items() for _ in range(300)]
    rows = [(k, f"The value is {x} here.") for k, x in rows if len(x) >= 20 and not base.search(x)]
    got = secrets.scan(spark.createDataFrame(rows, "kind string, text string"), model)
    share = {r["kind"]: r["found"] for r in got.groupBy("kind").agg(F.avg((F.size("secret_spans") > 0).cast("double")).alias("found")).collect()}
    print("found", share, "threshold", model.threshold)
    assert share.pop("secret") >= 0.95
    assert {k: v for k, v in share.items() if v > 0.01} == {}


def test_added_spans_equal_an_independent_log_likelihood(spark):
    """Transitions are counted, and ratios and spans found, in plain Python."""
    sample = secrets.training_sample(spark, 1024)
    model = secrets.train(sample)
    count: dict = {}
    for r in sample.filter("not left_out").collect():
        for x, y in zip(r["text"], r["text"][1:], strict=False):
            of = count.setdefault(r["random"], {}).setdefault(x, {})
            of[y] = of.get(y, 0) + 1

    def likelihood(kind, x, y):
        of = count[kind].get(x, {})
        return math.log((of.get(y, 0) + 0.5) / (sum(of.values()) + 0.5 * secrets.ALPHABET))

    def ratio(t):
        return sum(likelihood(True, x, y) - likelihood(False, x, y) for x, y in zip(t, t[1:], strict=False)) / (len(t) - 1)

    rng = random.Random(11)
    kinds = identifiers(rng)
    words = [x for x in random_strings(rng)[:200]] + [make() for make in kinds.values() for _ in range(12)]
    rng.shuffle(words)
    docs = [(k, " ".join(words[k : k + 9])) for k in range(0, len(words), 9)]
    got = {r["doc_id"]: r["secret_spans"] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    checked = 0
    for k, text in docs:
        base = [(s["start"], s["end"]) for s in got[k] if s["kind"] < 3]
        for m in re.finditer(secrets.CANDIDATE, text):
            if any(a < m.end() and m.start() < b for a, b in base) or re.search(secrets.PLAIN, m[0]):
                want = False
            elif abs((r := ratio(m[0])) - model.threshold) < 1e-3:  # odds are rounded
                continue
            else:
                want = r > model.threshold
            assert any(s["kind"] == 3 and (s["start"], s["end"]) == m.span() for s in got[k]) == want
            checked += 1
    assert checked > 250


def test_secrets_that_no_base_pattern_covers(spark, model):
    t = "key 9fQ2xLw7Rz1TbV6kYp3NcJ8s and get_user_name_by_customer_id"
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    assert secrets.digest(docs, model).first()["spans"] == "markov:4:28"
    assert secrets.redact(docs, model).first()["text"] == "key [SECRET] and get_user_name_by_customer_id"


def test_odd_tables(spark, model):
    rows = [(None, "token=abcdefgh"), (None, None), (1, ""), (1, ""), (2, "x " * 60_000 + "secret: zzzzzz"), (3, "😀" * 30_000 + " " + "f" * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_assign"], r["n_hex"], r["spans"]) for r in secrets.digest(docs, model).collect())
    assert got == [("1", 0, 0, ""), ("1", 0, 0, ""), ("2", 1, 0, "assign:120000:120014"), ("3", 0, 1, "hex:30001:30025"), ("None", 0, 0, ""), ("None", 1, 0, "assign:0:14")]
    assert secrets.digest(docs.limit(0), model).collect() == [] and secrets.redact(docs.limit(0), model).collect() == []


def test_columns_of_the_same_names_stay(spark, model):
    docs = spark.createDataFrame([(1, "a token=abcdefgh", "mine", 5, "x", "y")], "doc_id long, text string, secret_base string, secret_spans int, __base string, __spans string")
    out = secrets.redact(docs, model)
    assert out.columns == docs.columns and tuple(out.first()) == (1, "a [SECRET]", "mine", 5, "x", "y")
