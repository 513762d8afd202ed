"""Encoding and decoding by a merge-type SentencePiece vocabulary: a score-ordered agenda of adjacent symbol pairs.

No piece joins a word to the space after it, nor a letter to certain marks (which ones is read from the vocabulary), so a
text falls apart into units, such as a run of spaces and the letters after it, which are encoded on their own and kept in
a bounded table. Every unit that enters the table is checked against the
sentencepiece library, a batch at a time; should one differ, the library's ids are kept, it is counted, and a worker's log says so. Vocabularies for which units
can't be told apart, or which normalise texts, are encoded by the library alone.
Null texts count as empty, which encodes to the begin and end ids and decodes to an empty text. Of pairs of equal score the
leftmost is merged first, as the library does. Very long texts are encoded whole, part by part; repeated rows give repeated
results, an empty table none. ``encode`` keeps other columns and replaces those named ids and decoded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, out_batch, ready

SPACE = "▁"
#: Units kept by a worker; the table is emptied when it is full.
KEPT_UNITS = 450_000
#: Symbols up to which the agenda is a plain list, searched from the left; longer units use a heap.
SHORT = 48
#: Letters that units are told apart by; others are treated as marks are that can follow them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def merge_short(symbols: list[str], score) -> list[str]:
    """Merge the pair of best score, leftmost among equals, until none is a piece."""
    none = float("-inf")
    agenda = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
    while agenda:
        best = max(agenda)
        if best == none:
            break
        i = agenda.index(best)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        del agenda[i]
        if i:
            agenda[i - 1] = score(symbols[i - 1] + symbols[i], none)
        if i < len(agenda):
            agenda[i] = score(symbols[i] + symbols[i + 1], none)
    return symbols


def merge_long(symbols: list[str], score) -> list[str]:
    """The same agenda as a heap over a linked list, for units of any length."""
    before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    agenda: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(symbols) and (s := score(symbols[i] + symbols[j])) is not None:
            heapq.heappush(agenda, (-s, i, j, symbols[i] + symbols[j]))

    for i in range(len(symbols) - 1):
        offer(i)
    while agenda:
        _, i, j, piece = heapq.heappop(agenda)
        if not symbols[i] or after[i] != j or symbols[i] + symbols[j] != piece:
            continue
        symbols[i], symbols[j] = piece, ""
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s]


class Pieces:
    """A vocabulary with its table of units. ``ids`` gives a text's ids as little-endian 32-bit words, without begin and end."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(lib)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.pieces = [lib.id_to_piece(i) for i in range(len(lib))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(len(lib)) if lib.is_byte(i)}
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        probe = "  Abéﬁ ①\t c  "
        # No piece of several characters has a line end, and none has one of these marks behind a letter, so units end there.
        pairs = {x + y for p in self.id for x, y in zip(p, p[1:])}  # noqa: B905
        after_letter = {y for x, y in pairs if re.match(f"[{_LETTERS}]", x)}
        marks = re.escape("".join([c for c in map(chr, range(33, 127)) if not c.isalpha() and c not in after_letter]))
        alone = "".join({c for x in pairs for c in x} & {"\n"})
        other, rest = f"[^{SPACE}\n{_LETTERS}]", f"[^{SPACE}\n{_LETTERS}{marks}]"
        self.unit = re.compile(f"\n|{SPACE}*{other}*(?:[{_LETTERS}]+{rest}{other}*)*[{_LETTERS}]*")
        self.lead = len(lib.encode("\n"))
        self.own = (
            len(self.bytes) == 256
            and lib.decode(lib.encode(probe)) == probe
            and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
            and not alone
            and not any(lib.is_unused(i) for i in range(len(lib)))
        )
        self.code = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.word: dict[str, bytes] = {}
        #: What units decode to where that isn't their own text.
        self.odd: dict[str, str] = {}
        #: Units whose ids the library gave otherwise, each time they were learned.
        self.differing = 0

    def encode_unit(self, unit: str) -> bytes:
        symbols = merge_short(list(unit), self.score.get) if len(unit) <= SHORT else merge_long(list(unit), self.score.get)
        code = self.code
        try:
            return b"".join([code[s] for s in symbols])
        except KeyError:  # characters without a piece become bytes
            return b"".join([code[s] if s in code else b"".join([self.bytes[x].to_bytes(4, "little") for x in s.encode()]) for s in symbols])

    def learn(self, units: list[str]) -> None:
        """Encode units that aren't in the table, and check them, and what they decode to, against the library."""
        if len(self.word) + len(units) > KEPT_UNITS:
            self.word.clear()
            self.odd.clear()
        # The library puts one space before a text, as most units have; others are checked behind a line end, which
        # joins nothing. Alone, one space stands for an empty text.
        texts = [u[1:].replace(SPACE, " ") if u[0] == SPACE else "\n" + u for u in units]
        theirs = self.library.encode(texts, num_threads=1)
        for u, t, ids, back in zip(units, texts, theirs, self.library.decode(theirs), strict=True):
            mine = self.encode_unit(u)
            if u != SPACE:
                own = u[0] == SPACE
                checked = array("I", ids if own else ids[self.lead :]).tobytes()
                if mine != checked:
                    self.differing += 1
                    print(f"the library encodes {u!r} otherwise: its ids are kept", file=sys.stderr)
                    mine = checked
                if back != t:
                    self.odd[u] = " " + back if own else back[1:]
            self.word[u] = mine

    def units(self, text: str) -> list[str]:
        return [u for u in self.unit.findall(SPACE + text.replace(" ", SPACE)) if u]

    def ids(self, text: str, units: list[str] | None = None) -> tuple[bytes, str]:
        """The ids of a text, and what they decode to."""
        if not text:
            return b"", ""
        if not self.own:
            ids = self.library.encode(text, num_threads=1)
            return array("I", ids).tobytes(), self.library.decode(ids)
        units = self.units(text) if units is None else units
        word = self.word
        try:
            out = b"".join([word[u] for u in units])
        except KeyError:
            # A text may have more units than the table holds. When learning a part's fresh units empties the table, all
            # units of the part are learned again; each part is read before the next can empty the table.
            parts, said = [], []
            for k in range(0, len(units), KEPT_UNITS // 2):
                part = units[k : k + KEPT_UNITS // 2]
                every = set(part)
                fresh = [u for u in every if u not in word]
                self.learn(list(every) if len(word) + len(fresh) > KEPT_UNITS else fresh)
                parts += [word[u] for u in part]
                said += [self.odd.get(u) or u.replace(SPACE, " ") for u in part]
            return b"".join(parts), "".join(said)[1:]
        if self.odd and not self.odd.keys().isdisjoint(units):
            return out, "".join([self.odd.get(u) or u.replace(SPACE, " ") for u in units])[1:]
        return out, text.replace(SPACE, " ")


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


#: Characters of texts whose units are told apart and learned at once; a longer text is on its own.
GROUP_CHARS = 1 << 18


def _texts(batch: pa.RecordBatch, p: Pieces) -> Iterator[tuple[bytes, str]]:
    group: list[str] = []
    size = 0
    for t in batch.column("text"):
        t = t.as_py() or ""
        if group and size + len(t) > GROUP_CHARS:
            yield from _group(group, p)
            group, size = [], 0
        group.append(t)
        size += len(t)
    yield from _group(group, p)


def _group(texts: list[str], p: Pieces) -> Iterator[tuple[bytes, str]]:
    units: list[list[str] | None] = [None] * len(texts)
    if p.own:
        fresh: set[str] = set()
        for k, t in enumerate(texts):
            if t and len(t) < 1 << 20:
                units[k] = p.units(t)
                fresh.update([u for u in units[k] if u not in p.word])
        if 0 < len(fresh) < KEPT_UNITS // 2:
            p.learn(list(fresh))
    for t, u in zip(texts, units, strict=True):
        yield p.ids(t, u)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizers keep a model; workers look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Add ``ids``, with begin and end, and ``decoded`` to every row; other columns stay. ``model``: a file that workers can open."""
    ready(docs.sparkSession)
    docs = docs.drop("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model or model_path())
        begin, end = p.begin.to_bytes(4, "little"), p.end.to_bytes(4, "little")
        for batch in batches:
            ids, said = [], []
            for b, t in _texts(batch, p):
                ids.append(begin + b + end)
                said.append(t)
            at = np.cumsum([0, *[len(b) // 4 for b in ids]])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(said, pa.string())], names=[*batch.schema.names, "ids", "decoded"])

    return mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model or model_path())
        begin, end = p.begin.to_bytes(4, "little"), p.end.to_bytes(4, "little")
        for batch in batches:
            n, ids, said = [], [], []
            for b, t in _texts(batch, p):
                n.append(len(b) // 4 + 2)
                ids.append(hashlib.sha256(begin + b + end).hexdigest())
                said.append(hashlib.sha256(t.encode()).hexdigest())
            yield out_batch(_DIGEST, {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": said})

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
