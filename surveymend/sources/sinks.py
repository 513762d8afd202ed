"""Reports as one file of a run, written by a Spark DataSourceWriter in two phases.

Every task writes its rows to a file of its own in a folder of the run; the commit joins the files of the tasks that
succeeded, in the order of their partitions, and moves the result into place. An abort deletes the folder. So a run leaves
its whole report or nothing, and rows in a total order give the same file again, byte for byte.
"""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows and columns of a worksheet, which the format bounds (fixed values).
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384
#: Bytes that are copied at once.
BLOCK = 1 << 20
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


@dataclass
class Part(WriterCommitMessage):
    """A task's file and its rows."""

    partition: int
    file: str
    rows: int


def _opened(path: str):
    """(file system, path in it) of a path or URI that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def cell(x) -> str:
    """A value as a cell of a worksheet; what has no type there is text."""
    if x is None:
        return "<c/>"
    if isinstance(x, bool):
        return f'<c t="b"><v>{int(x)}</v></c>'
    if isinstance(x, (int, decimal.Decimal)) or isinstance(x, float) and x - x == 0:
        return f"<c><v>{x!r}</v></c>" if isinstance(x, float) else f"<c><v>{x}</v></c>"
    text = x.isoformat(" ") if isinstance(x, datetime.datetime) else str(x)
    text = _UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet_row(row) -> bytes:
    return f"<row>{''.join(map(cell, row))}</row>".encode()


def _csv_row(row) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if x is None else x for x in row])
    return out.getvalue().encode()


_SPREAD = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
# Parts of a workbook with one sheet (fixed values of the format).
_BOOK = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


class ReportWriter(DataSourceWriter):
    def __init__(self, schema, options, overwrite: bool):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"]
        self.sheet = options.get("sheet", "Sheet1")
        self.book = self.path.lower().endswith(".xlsx")
        if self.book and len(self.names) > SHEET_COLUMNS:
            raise ValueError(f"a worksheet has at most {SHEET_COLUMNS} columns")
        fs, at = _opened(self.path)
        if not overwrite and fs.get_file_info(at).type.name != "NotFound":
            raise ValueError(f"{self.path} is there already")
        # The folder of the run is beside the report, so that the report can be moved into place.
        self.run = posixpath.join(posixpath.dirname(self.path), f"_{posixpath.basename(self.path)}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}"
        fs, at = _opened(self.run)
        fs.create_dir(at)
        line, rows = _sheet_row if self.book else _csv_row, 0
        with fs.open_output_stream(f"{at}/{name}") as out:
            for row in iterator:
                out.write(line(row))
                rows += 1
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        fs, at = _opened(self.run)
        _, to = _opened(self.path)
        fs.create_dir(at)
        try:
            if self.book and sum(m.rows for m in parts) >= SHEET_ROWS:
                raise ValueError(f"a worksheet has at most {SHEET_ROWS - 1} rows below its header")
            with fs.open_output_stream(f"{at}/report") as out:
                self._joined(out, [(fs, f"{at}/{m.file}") for m in parts])
            fs.move(f"{at}/report", to)
        finally:
            fs.delete_dir(at)

    def _joined(self, out, parts: list) -> None:
        def copied(to) -> None:
            for fs, file in parts:
                with fs.open_input_stream(file) as f:
                    while block := f.read(BLOCK):
                        to.write(block)

        if not self.book:
            out.write(_csv_row(self.names))
            copied(out)
            return
        # Entries have no date, so equal rows give equal files.
        with zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_DEFLATED) as z:
            def entry(name: str):
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED
                return z.open(info, "w", force_zip64=True)

            sheets = f'<sheets><sheet name="{escape(self.sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets>'
            for name, text in (_BOOK | {"xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_SPREAD}" xmlns:r="{_OFFICE}">{sheets}</workbook>'}).items():
                with entry(name) as f:
                    f.write(text.encode())
            with entry("xl/worksheets/sheet1.xml") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_SPREAD}"><sheetData>'.encode() + _sheet_row(self.names))
                copied(f)
                f.write(b"</sheetData></worksheet>")

    def abort(self, messages: list) -> None:
        fs, at = _opened(self.run)
        if fs.get_file_info(at).type.name != "NotFound":
            fs.delete_dir(at)


class _Counted(io.RawIOBase):
    """A stream that is only written, as zip archives need one."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)


class ReportSink(DataSource):
    """Format ``report``: one CSV file, or a workbook where the path ends with .xlsx; options: path and sheet."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(schema, dict(self.options), overwrite)


def write_report(df: DataFrame, path: str, order: list[str], sheet: str = "Sheet1") -> None:
    """One sorted file of all rows. Rows are range-partitioned by ``order``, which should leave no ties, and sorted in each task."""
    df.sparkSession.dataSource.register(ReportSink)
    df.orderBy(*order).write.format("report").mode("overwrite").option("sheet", sheet).save(path)
