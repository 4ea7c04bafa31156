"""Rows of spreadsheets (XLSX): zip members of XML, streamed row by row."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the format's parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 2000


def _column(reference: str) -> int:
    """Place of a cell's column, from 0: A, B, ..., Z, AA."""
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = 26 * n + ord(c) - ord("A") + 1
    return n - 1


def _text(element) -> str:
    """The text of a string item: its runs joined, phonetic hints left out."""
    hints = {t for hint in element.iter(f"{MAIN}rPh") for t in hint.iter(f"{MAIN}t")}
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t") if t not in hints)


def _streamed(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of a member, each dropped when the next is asked for."""
    with book.open(name) as stream:
        parents = []
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == f"{MAIN}{tag}":
                yield element
                if parents:
                    parents[-1].remove(element)


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets' names and members, in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): (t.lstrip("/") if (t := targets[s.get(LINK)]).startswith("/") else f"xl/{t}") for s in found}


def _rows(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    number = 0
    for row in _streamed(book, member, "row"):
        number = int(row.get("r") or number + 1)
        values: list[str | None] = []
        for cell in row.iter(f"{MAIN}c"):
            at = _column(cell.get("r")) if cell.get("r") else len(values)
            values += [None] * (at + 1 - len(values))
            kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
            if kind == "inlineStr":
                values[at] = _text(cell)
            elif value is not None and value.text is not None:
                values[at] = shared[int(value.text)] if kind == "s" else {"0": "false", "1": "true"}.get(value.text) if kind == "b" else None if kind == "e" else value.text
        yield number, values


def sheet_rows(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], sheets: Sequence[str] | None = None, first: int = 2, header: Sequence[str] | None = None, distinct: dict[str, int] | None = None
) -> DataFrame:
    """file, sheet, row (its number in the sheet) and the first ``columns``, as strings, of rows from ``first`` on whose first cell is filled.

    Shared and inline strings, numbers, booleans and the stored results of
    formulas are read; cells with an error are null; dates are the numbers
    that the file stores. Errors: a sheet that is not there, a ``header`` (the
    row before ``first``) that differs, sheets whose first column has other
    than the ``distinct`` number of values (blanks at both ends apart). A
    workbook is read by one task, as zip files cannot be split and must lie in
    memory packed; its rows leave in batches.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for file, content in zip(files.column(0).to_pylist(), files.column(1)):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as book:
                    members = _sheets(book)
                    shared = [_text(s) for s in _streamed(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
                    for sheet in sheets or members:
                        if sheet not in members:
                            raise ValueError(f"{file}: no sheet {sheet!r}")
                        rows, seen, head = [], set(), header is None
                        for number, values in _rows(book, members[sheet], shared):
                            values = (values + [None] * len(columns))[: max(len(columns), len(header or ()))]
                            if number == first - 1 and header is not None:
                                head = list(header) == values[: len(header)]
                            if number < first or values[0] is None:
                                continue
                            seen.add(values[0].strip())
                            rows.append((file, sheet, number, *values[: len(columns)]))
                            if len(rows) == ROWS:
                                yield batch(rows)
                                rows = []
                        if not head:
                            raise ValueError(f"{file}: the header of sheet {sheet!r} is not {list(header)}")
                        if distinct and sheet in distinct and len(seen) != distinct[sheet]:
                            raise ValueError(f"{file}: sheet {sheet!r} has {len(seen)} different values in its first column, not {distinct[sheet]}")
                        if rows:
                            yield batch(rows)

    names = ["file", "sheet", "row", *columns]
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * len(columns)]
    schema = "file string, sheet string, row long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInArrow(run, schema)
