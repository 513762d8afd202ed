"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate around them.

Anchors are at-signs, plus signs, digits that begin a run, schemes and identifier cues. Around them parsers settle the
base kinds (email, ip, card, phone; leftmost and non-overlapping within a kind, matches that fail validation are dropped
without retries) and the added kinds: credentials inside URLs, IBANs with right check digits, and numbers after an
identifier cue. An added span that overlaps a base span, or an added one of a kind before its own, is dropped. Null texts
count as empty; positions are code points, ends exclusive. Spans of one start and kind can't tie. Very long texts are
searched whole; repeated rows give repeated results, an empty table none, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, out_batch, ready

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([A-Za-z0-9._%+-]+:[^\s/@:]+)@[A-Za-z0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\x20?(?:number|no|nr|id))?[.:#=\x20]{1,4}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
#: Words after which a number is taken for an identifier (fixed values).
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "tax id", "driver licence", "driver license", "patient")
#: Anchors and the parser that each leads to.
_ANCHORS = {"@": "email", "+": "phone", "://": "login", **{c: "account" for c in CUES}, **{d: "digit" for d in "0123456789"}}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _ANCHORS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


_DIGITS = "0123456789"


def find(text: str, anchors: ahocorasick.Automaton) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans of a text as (kind, start, end), sorted."""
    base, more = [], []
    after = {"email": 0, "ip": 0, "card": 0, "phone": 0}
    digit = -2
    low = text.lower()
    if len(low) != len(text):  # some letters become two
        low = "".join([c.lower() if c.isascii() else c for c in text])
    for last, (kind, size) in anchors.iter(low):
        at = last - size + 1
        if kind == "digit":
            begins, digit = digit != at - 1, at
            if not begins:
                continue
            if at >= after["ip"] and (m := _IP.match(text, at)):
                after["ip"] = m.end()
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
                    base.append((1, at, m.end()))
            if at >= after["card"] and (m := _CARD.match(text, at)):
                after["card"] = m.end()
                if m.end() - at >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                    base.append((2, at, m.end()))
            if at >= 2 and text[at - 2].isupper() and text[at - 1].isupper() and (m := _IBAN.match(text, at - 2)) and (at < 3 or not text[at - 3].isalnum()) and iban(m[0]):
                more.append((5, at - 2, m.end()))
        elif kind == "email":
            a = at
            while a > after["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, at + 1)):
                after["email"] = m.end()
                base.append((0, a, m.end()))
        elif kind == "phone":
            if at >= after["phone"] and (m := _PHONE.match(text, at)):
                after["phone"] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    base.append((3, at, m.end()))
        elif kind == "login":
            if m := _LOGIN.match(text, at):
                more.append((4, *m.span(1)))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := _NUMBER.match(text, last + 1)):
            more.append((6, *m.span(1)))
    base.sort()
    return base, sorted(base + _apart(base, sorted(set(more))))


def _apart(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``more`` that overlap neither base spans nor one another; the first come first."""
    begins: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(base, key=lambda s: s[1:]):  # as stretches apart from one another
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    out = []
    for x in more:
        i = bisect_left(begins, x[2])
        if not i or ends[i - 1] <= x[1]:
            begins.insert(i, x[1])
            ends.insert(i, x[2])
            out.append(x)
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace spans by their kind; of overlapping spans the first counts, and the rest of the others goes with it."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
    return "".join([*out, text[at:]])


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string())])


def _mapped(schema: pa.Schema, row):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = [row(t or "", *find(t or "", anchors)) for t in batch.column("text").to_pylist()]
            columns = dict(zip(schema.names[1:], zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in schema.names[1:]}
            yield out_batch(schema, {"doc_id": batch.column("doc_id")} | columns)

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row."""
    ready(docs.sparkSession)
    row = lambda t, base, spans: (*[sum(s[0] == k for s in base) for k in range(4)], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _mapped(_OUT, row), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span replaced by its kind."""
    ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _mapped(schema, lambda t, base, spans: (redacted(t, spans),)), "doc_id long, text string")
