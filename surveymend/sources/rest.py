"""REST list and newline-delimited JSON as a Spark DataSource, in batches and as a stream: one partition for each code.

Lines leave as they arrive, so a task holds one block of a response. A response that breaks off is asked for again, with
backoff, and read on from the line that it had come to.
"""

from __future__ import annotations

import hashlib
import http.client
import json
import sys
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

T = TypeVar("T")


#: What a failed request raises: refused, timed out, a status of failure, broken off, or not what was asked for. Lines that
#: changed between two requests are no such failure.
FAILURES = (urllib.error.URLError, OSError, http.client.HTTPException, json.JSONDecodeError)


def retried(ask: Callable[[], T], retries: int = 4, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``ask`` returns; it is asked again after each failure, at most ``retries`` times, backoff * 2**k seconds later."""
    for k in range(retries + 1):
        try:
            return ask()
        except FAILURES:
            if k == retries:
                raise
            sleep(backoff * 2**k)
    raise ValueError("retries must not be negative")


def get(url: str, timeout: float = 30.0) -> bytes:
    """A whole response; one that breaks off before its end is a failure."""
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


#: Bytes of a response that are read at once.
BLOCK = 1 << 16


def _whole_lines(r: http.client.HTTPResponse) -> Iterator[bytes]:
    """The lines of a response as they arrive; the last one only if the response came to its end."""
    rest = b""
    while block := r.read(BLOCK):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if r.length:
        raise http.client.IncompleteRead(b"", r.length)
    if rest:
        yield rest


def lines(url: str, timeout: float = 30.0, retries: int = 4, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[bytes]:
    """The lines of a response that are JSON, each once, however often it breaks off.

    A broken response is asked for again and its first lines are passed over, as many as have left. They must be those that
    have: a digest tells, and other lines are an error. It is asked ``retries`` times without a new line in between.
    """
    done, digest, failed = 0, hashlib.blake2b(), 0
    while True:
        again, passed = hashlib.blake2b(), 0
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                for line in _whole_lines(r):
                    if passed < done:
                        again.update(line + b"\n")
                        passed += 1
                        if passed == done and again.digest() != digest.digest():
                            raise ValueError(f"{url} gave other lines when it was asked again")
                        continue
                    if line.strip():
                        json.loads(line)
                        yield line
                    digest.update(line + b"\n")
                    done, passed, failed = done + 1, passed + 1, 0
            if passed < done:
                raise ValueError(f"{url} gave fewer lines when it was asked again")
            return
        except FAILURES:
            if failed == retries:
                raise
            sleep(backoff * 2**failed)
            failed += 1


class CodePartition(InputPartition):
    def __init__(self, code: str):
        self.code = code


class AddressReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        # Streams get the names of options in lower case.
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[CodePartition]:
        if "codes" in self.options:
            return [CodePartition(c.strip().zfill(4)) for c in self.options["codes"].split(",") if c.strip()]
        codes = self._asked(self.options["listurl"], json.loads)
        return [CodePartition(str(x[self.options.get("codefield", "kode")]).zfill(4)) for x in codes]

    def _asked(self, url: str, parse: Callable[[bytes], T]) -> T:
        timeout = float(self.options.get("timeout", "180"))
        return retried(lambda: parse(get(url, timeout)), int(self.options.get("retries", "4")), float(self.options.get("backoff", "2")))

    def read(self, partition: CodePartition) -> Iterator[tuple]:
        """Rows of one code as they arrive; a failure ends the task, whose rows Spark then drops. Where onError is skip, rows
        are kept in a file until the response has come to its end; a failure is told on standard error and gives no rows."""
        get_ = self.options.get
        came = lines(self.options["url"].replace("{code}", partition.code), float(get_("timeout", "180")), int(get_("retries", "4")), float(get_("backoff", "2")))
        if get_("onerror", "fail") != "skip":
            yield from map(self._row, came)
            return
        with tempfile.TemporaryFile() as held:
            try:
                for line in came:
                    held.write(line + b"\n")
            except FAILURES as e:
                print(f"addresses of {partition.code} are left out: {e}", file=sys.stderr)
                return
            held.seek(0)
            yield from map(self._row, held)

    def _row(self, line: bytes) -> tuple:
        x = json.loads(line)
        return tuple(None if x.get(n) is None else str(x[n]) for n in self.names)


class AddressStreamReader(DataSourceStreamReader):
    """The codes as a stream: each micro-batch reads the codes that have come since the last one, in their order, one
    partition each, so tasks bound how many are read at once.

    An offset is the number of codes read. The position within a code is its task's, which resumes at the line that a
    response broke off at; a server can't begin at a line. A query that starts again from its checkpoint repeats no code
    that was committed. Codes that the list gains are read once they sort last.
    """

    def __init__(self, schema, options):
        self.reader = AddressReader(schema, options)

    def _codes(self) -> list[CodePartition]:
        return sorted(self.reader.partitions(), key=lambda p: p.code)

    def initialOffset(self) -> dict:
        return {"code": 0}

    def latestOffset(self) -> dict:
        return {"code": len(self._codes())}

    def partitions(self, start: dict, end: dict) -> list[CodePartition]:
        return self._codes()[start["code"] : end["code"]]

    def read(self, partition: CodePartition) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class AddressSource(DataSource):
    """Format ``addresses``; options: url with {code}, listUrl or codes, codeField, retries, backoff, timeout, onError."""

    @classmethod
    def name(cls) -> str:
        return "addresses"

    def schema(self) -> str:
        return "vejnavn string, husnr string, postnr string, postnrnavn string, lat string, lon string"

    def reader(self, schema) -> AddressReader:
        return AddressReader(schema, dict(self.options))

    def streamReader(self, schema) -> AddressStreamReader:
        return AddressStreamReader(schema, dict(self.options))
