"""Token ids of prompts and responses by a vocabulary file, in Arrow batches, and training examples made of them.

The vocabulary is a file of the ``tokenizers`` library (JSON), which workers can open; it is loaded once in each worker.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Bytes of text that are worked on at once, lines that are encoded at once, and lines and ids that a worker remembers.
SOME, AT_ONCE, LINES, IDS = 1 << 23, 256, 1 << 16, 1 << 21
#: Columns of examples.
ADDED = ("input_ids", "labels", "attention_mask")
_open: dict[str, object] = {}
_lines: dict[tuple[str, bool], Lines] = {}


def vocabulary(path: str):
    if path not in _open:
        # A worker is one of many on its machine, so the library gets no threads of its own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _open[path] = Tokenizer.from_file(path)
    return _open[path]


def by_lines(library) -> bool:
    """Whether lines can be encoded one by one: byte-level BPE over the usual pattern, which makes a single line end between
    other characters a word of its own, and no step or added token that looks across it."""
    told = json.loads(library.to_str())
    before = told["pre_tokenizer"] or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    plain = all("\n" not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
    return usual and plain and told["normalizer"] is None and told["truncation"] is None and told["padding"] is None and told["model"]["type"] == "BPE" and not told["model"].get("dropout")


class Lines:
    """Ids of texts, put together of those of their lines, so that a line that many texts have is encoded once while it is remembered."""

    def __init__(self, library):
        self.library, self.whole, self.encoded = library, not by_lines(library), 0
        # Lines in UTF-8, and their ids as bytes; those at the end of a text by what is put after them.
        self.known: dict[str | None, dict[bytes, bytes]] = {}
        self.held = self.lines = 0

    def _learn(self, lines: list[bytes], end: str | None) -> list[bytes]:
        known = self.known.setdefault(end, {})
        found = list(map(known.get, lines))
        if None not in found:
            return found
        new = [x for x, ids in zip(lines, found, strict=True) if ids is None]
        for lo in range(0, len(new), AT_ONCE):
            texts = [x.decode() if end is None else x.decode().rstrip() + end for x in new[lo : lo + AT_ONCE]]
            for x, e in zip(new[lo : lo + AT_ONCE], self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                known[x] = np.array(e.ids, np.int32).tobytes()
                self.held += len(e.ids)
        self.lines += len(new)
        self.encoded += len(new)
        return [known[x] for x in lines]

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The lines of all texts, coded, and the number of the first of each text; a null is one empty line. A cut is before
        a single line end between ASCII letters or signs."""
        _, at, data = texts.buffers()
        kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        at = np.frombuffer(at, kind, len(texts) + 1, texts.offset * kind.itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        cuts = np.zeros(0, np.int64)
        if not self.whole and len(data) > 2:
            ends = np.flatnonzero(data[1:-1] == 10) + 1
            shown = lambda k: (data[k] > 32) & (data[k] < 127)
            cuts = ends[shown(ends - 1) & shown(ends + 1)]
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            cuts = cuts[~edge[cuts] & ~edge[cuts + 1]]
        first = np.arange(len(at)) + np.searchsorted(cuts, at)
        begin, own = np.empty(first[-1] + 1, np.int64), np.ones(first[-1] + 1, bool)
        begin[first], own[first] = at, False
        begin[own] = cuts
        return pa.Array.from_buffers(pa.large_binary(), first[-1], [None, pa.py_buffer(begin), pa.py_buffer(data)]).dictionary_encode(), first

    def coded(self, columns: list[tuple[pa.Array, str | None]]) -> list[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """For each column of texts, and what is put after them in place of spaces (None: they stay): the number of each of its
        lines among the different ones, the first line of each text, and the ids of different lines."""
        if self.lines > LINES or self.held > IDS:
            self.known.clear()
            self.held = self.lines = 0
        out = []
        for texts, end in columns:
            lines, first = self._cut(texts)
            code, different = lines.indices.to_numpy(), lines.dictionary.to_numpy(zero_copy_only=False)
            if end is None:
                out.append((code, first, self._learn(different.tolist(), None)))
                continue
            last = np.zeros(len(code), bool)
            last[first[1:] - 1] = True
            ids, number = [], np.zeros(len(code), np.int64)
            for those, after in ((~last, None), (last, end)):
                used = np.zeros(len(different), bool)
                used[code[those]] = True
                number[those] = (np.cumsum(used) - 1 + len(ids))[code[those]]
                ids += self._learn(different[used].tolist(), after)
            out.append((number, first, ids))
        return out

    def ids(self, texts: list[str | None] | pa.Array) -> pa.Array:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ((code, first, ids),) = self.coded([(texts, None)])
        values, at = _joined(ids, code)
        return pa.ListArray.from_arrays(pa.array(at[first], pa.int32()), pa.array(values), mask=texts.is_null())

    def examples(self, prompt: pa.Array, response: pa.Array, most: int, end: str) -> tuple[pa.Array, pa.Array]:
        """input_ids, and how many of them are the prompt's."""
        (code_p, first_p, ids_p), (code_r, first_r, ids_r) = self.coded([(prompt, "\n"), (response, end)])
        # The lines of a row's prompt, then those of its response.
        code = np.empty(len(code_p) + len(code_r), np.int64)
        code[np.arange(len(code_p)) + np.repeat(first_r[:-1], np.diff(first_p))] = code_p
        code[np.arange(len(code_r)) + np.repeat(first_p[1:], np.diff(first_r))] = code_r + len(ids_p)
        values, at = _joined(ids_p + ids_r, code)
        begin, middle = at[first_p + first_r], at[first_p[1:] + first_r[:-1]]
        of_p, of_r = middle - begin[:-1], begin[1:] - middle
        missing = pa.compute.or_(prompt.is_null(), response.is_null())
        whole = ~missing.to_numpy(zero_copy_only=False)
        kept = np.where(whole, np.minimum(of_p, np.maximum(most - of_r, 0)), 0)
        if not whole.all() or (kept < of_p).any():
            parts = np.stack([kept, of_p - kept, of_r], 1)
            values = values[np.repeat(np.stack([whole, np.zeros(len(whole), bool), whole], 1).ravel(), parts.ravel())]
        size = kept + np.where(whole, of_r, 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(values), mask=missing), pa.array(kept, pa.int32())


def _joined(ids: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of lines by number, one after another, and where each line's begin."""
    out = pa.array(ids, pa.large_binary()).take(pa.array(code))
    at = np.frombuffer(out.buffers()[1], np.int64, len(code) + 1) // 4
    return np.frombuffer(out.buffers()[2] or b"", np.int32)[: at[-1]], at


def _remembered(path: str, special: bool) -> Lines:
    """What this worker remembers, also of earlier tasks."""
    library = vocabulary(path)
    library.encode_special_tokens = not special
    if (path, special) not in _lines:
        _lines[path, special] = Lines(library)
    return _lines[path, special]


def _some(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of at most ``SOME`` bytes of these columns, or one row."""
    for batch in batches:
        size = sum((np.asarray(pa.compute.binary_length(batch.column(c)).fill_null(0), np.int64) for c in columns), np.zeros(batch.num_rows, np.int64))
        size, lo = np.cumsum(size), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SOME, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def encode(df: DataFrame, columns: dict[str, str], path: str, special: bool = True) -> DataFrame:
    """Add the ids of text columns, named by ``columns``; null texts have null ids. Where ``special``, the strings of special
    tokens are those tokens, as an end mark is; else they are plain text. Lines that texts share are encoded once (``Lines``)."""
    ship(df.sparkSession)
    fresh = [out for out in columns.values() if out in df.columns]
    if fresh:
        raise ValueError(f"columns of these names are there already: {fresh}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _remembered(path, special)
        for batch in _some(batches, list(columns)):
            more = [lines.ids(batch.column(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *columns.values()])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in columns.values())]))


def examples(df: DataFrame, prompt: Column, response: Column, path: str, most: int, end: str, keep: list[str] | None = None) -> DataFrame:
    """Add input_ids, attention_mask and labels: the prompt and a line end, then the response and the end mark, each without
    spaces at its end; labels ignore the prompt. Beyond ``most`` ids the prompt keeps its beginning and the response all of
    its own. A null prompt or response gives nulls. ``keep`` names the columns that are needed besides (all where it is None):
    what is named travels to Python and back."""
    ship(df.sparkSession)
    text = df.select(*([F.col(f"`{c}`") for c in df.columns if c not in ADDED] if keep is None else keep), prompt.alias("__prompt"), response.alias("__response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _remembered(path, True)
        for batch in _some(batches, ["__prompt", "__response"]):
            *others, p, r = batch.columns
            yield pa.RecordBatch.from_arrays([*others, *lines.examples(p, r, most, end)], names=[*batch.schema.names[:-2], "input_ids", "__kept"])

    out = text.mapInArrow(run, T.StructType([*text.schema.fields[:-2], T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("__kept", T.IntegerType())]))
    size = F.size("input_ids")
    # Made of input_ids where they are asked for; arrays from Python are read value by value.
    labels = F.concat(F.array_repeat(F.lit(-100), F.col("__kept")), F.slice("input_ids", F.col("__kept") + 1, size - F.col("__kept")))
    attention = F.when(F.col("input_ids").isNotNull(), F.array_repeat(F.lit(1), size))
    return out.withColumns({"labels": F.when(F.col("input_ids").isNotNull(), labels), "attention_mask": attention}).drop("__kept")


def collated(df: DataFrame, size: int, pad: int, ignored: int = -100, multiple: int = 8) -> DataFrame:
    """Rows of ``examples`` in batches of ``size`` within each task, padded to their batch's longest row, rounded up to a
    multiple. Adds ``batch``, the same for rows padded together. Rows without ids are left out; nothing is shuffled."""
    ship(df.sparkSession)
    padding = {"input_ids": pad, "attention_mask": 0, "labels": ignored}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            batch = batch.filter(batch.column("input_ids").is_valid())
            while batch.num_rows:
                some = batch.slice(0, size - rows)
                batch = batch.slice(some.num_rows)
                held.append(some)
                rows += some.num_rows
                if rows == size:
                    yield _padded(held, number, padding, multiple)
                    number, held, rows = number + 1, [], 0
        if rows:
            yield _padded(held, number, padding, multiple)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]))


def _padded(held: list[pa.RecordBatch], number: int, padding: dict[str, int], multiple: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    n = t.num_rows
    width = -(-max(len(x) for x in t.column("input_ids")) // multiple) * multiple
    out = {}
    for name, fill in padding.items():
        lists = t.column(name).combine_chunks()
        size = np.asarray(lists.value_lengths())
        full = np.full((n, width), fill, np.int32)
        full[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
        out[name] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(full.ravel()))
    columns = [out.get(c, t.column(c).combine_chunks()) for c in t.column_names]
    return pa.RecordBatch.from_arrays([*columns, pa.array([number] * n, pa.int64())], names=[*t.column_names, "batch"])
