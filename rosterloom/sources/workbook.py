"""Exports of unknown kind: the format is told by content, then read into named rows.

``read`` takes files through Spark (``binaryFile``), so any store works, and parses each where it lies;
``parse`` works on bytes. A row is (file, sheet, row number, values by column name).
"""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby, islice
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.sources.base import leaf_of

OOXML, BIFF, HTML, DELIMITED, UNKNOWN = "ooxml", "biff", "html", "delimited", "unknown"
Grid = list[list[str]]
BATCH_ROWS = 5_000


def sniff(content: bytes, content_type: str = "") -> str:
    """The format by its first bytes; what is declared counts for nothing, as exports often declare another."""
    head = content[:2048]
    if head.startswith(b"PK\x03\x04"):
        return OOXML
    if head.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return BIFF
    low = head.lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if low.startswith((b"<!doctype html", b"<html")) or b"<table" in low:
        return HTML
    first = low.splitlines()[0] if low else b""
    if any(d in first for d in (b";", b"\t", b",")):
        return DELIMITED
    return UNKNOWN


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _texts(e: ET.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and paths of the sheets in the workbook's order. Sheets whose part is missing are left out; a book without a
    list of sheets gives its parts in the order of their numbers, named by their paths."""
    names = set(book.namelist())
    found: list[tuple[str, str]] = []
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
            target = targets.get(next((v for k, v in sheet.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None))
            path = target and (target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            if path in names:
                found.append((sheet.get("name", ""), path))
    if not found:
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]*\.xml", n)), key=lambda n: (int("0" + "".join(re.findall(r"\d+", n))), n))
        found = [(n.rsplit("/", 1)[-1].removesuffix(".xml"), n) for n in parts]
    return found


class Shared:
    """The shared strings of a workbook as one run of bytes and where each ends: far less than a string object each."""

    def __init__(self):
        self.bytes, self.ends = bytearray(), array("Q")

    @classmethod
    def of(cls, book: zipfile.ZipFile) -> Shared:
        out = cls()
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for element in _pulled(part, "si"):
                    out.bytes += _texts(element).encode()
                    out.ends.append(len(out.bytes))
        return out

    def get(self, index: str) -> str:
        """The string of an index; an index that is no number or out of range stays as it stands."""
        if not index.isascii() or not index.isdigit() or int(index) >= len(self.ends):
            return index
        k = int(index)
        return self.bytes[self.ends[k - 1] if k else 0 : self.ends[k]].decode()


def _pulled(part: IO[bytes], tag: str) -> Iterator[ET.Element]:
    """The elements of a tag one after the other, each dropped when the next is asked for."""
    root = None
    for event, element in ET.iterparse(part, ("start", "end")):
        if root is None:
            root = element
            parents = [root]
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        if _tag(element) == tag:
            yield element
            element.clear()
            parents[-1].remove(element) if element in parents[-1] else None


def xlsx_rows(content: bytes) -> Iterator[tuple[str, list[str]]]:
    """(sheet, cells) of all rows in the workbook's order, pulled one at a time; shared and inline strings; missing cells are not
    filled in."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = Shared.of(book)
    for name, path in _sheets(book):
        with book.open(path) as part:
            for row in _pulled(part, "row"):
                cells = []
                for cell in (c for c in row if _tag(c) == "c"):
                    value = next((v.text or "" for v in cell if _tag(v) == "v"), "")
                    cells.append(shared.get(value) if cell.get("t") == "s" else _texts(cell) if cell.get("t") == "inlineStr" else value)
                yield name, cells


def xlsx(content: bytes) -> dict[str, Grid]:
    """All sheets of a small workbook; sheets without rows too."""
    out: dict[str, Grid] = {name: [] for name, _ in _sheets(zipfile.ZipFile(io.BytesIO(content)))}
    for name, cells in xlsx_rows(content):
        out[name].append(cells)
    return out


class _Table(HTMLParser):
    def __init__(self):
        super().__init__()
        self.grid: Grid = []
        self.depth, self.over, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if self.over:
            return
        if tag == "table":
            self.depth += 1
        elif tag == "tr" and self.depth:
            self.grid.append([])
        elif tag in ("td", "th") and self.depth and self.grid:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.grid[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.over |= not self.depth

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_table(text: str) -> Grid:
    """The first table of a page."""
    parser = _Table()
    parser.feed(text)
    return parser.grid


def delimited(text: str) -> Grid:
    """Rows cut at whichever of semicolon, tab and comma the first line has most of."""
    first = text.split("\n", 1)[0]
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=max(";\t,", key=first.count)))


def _names(cells: list[str]) -> list[str]:
    names: list[str] = []
    for k, cell in enumerate(cells, 1):
        name = re.sub(r"\s+", "_", cell.strip().lower()) or f"column_{k}"
        while name in names:
            name += f"_{k}"
        names.append(name)
    return names


class Header:
    """Makes rows of cells into named rows, as they come: names are those of the first row with more than one filled cell, lower
    case with ``_`` for white space; blank ones are numbered, repeated ones get their column's number. Rows without any value are left out."""

    def __init__(self):
        self.names: list[str] = []

    def row(self, cells: list[str]) -> dict[str, str] | None:
        if not self.names:
            if sum(bool(c.strip()) for c in cells) > 1:
                self.names = _names(cells)
            return None
        return dict(zip(self.names, [c.strip() for c in cells] + [""] * len(self.names))) if any(c.strip() for c in cells) else None


def named(grid: Grid) -> tuple[list[str], list[dict[str, str]]]:
    """The column names of a grid, and the rows after them that have any value."""
    header = Header()
    rows = [row for row in map(header.row, grid) if row is not None]
    return header.names, rows


def parse(content: bytes, content_type: str = "") -> tuple[str, dict[str, tuple[list[str], list[dict[str, str]]]], str | None]:
    """The format, the sheets, and what was wrong, if anything was: an export never raises."""
    kind = sniff(content, content_type)
    try:
        if kind in (OOXML, HTML, DELIMITED):
            text = "" if kind == OOXML else content.decode("utf-8-sig", "replace")
            grids = xlsx(content) if kind == OOXML else {"": html_table(text) if kind == HTML else delimited(text)}
            sheets = {n: named(g) for n, g in grids.items()}
            return kind, sheets, None if any(rows for _, rows in sheets.values()) else f"{kind} without data rows"
    except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, csv.Error) as error:
        return kind, {}, f"{kind}: {error}"
    return kind, {}, f"{kind} can't be read"


def records(content: bytes) -> Iterator[tuple[str, str | None, int | None, dict[str, str] | None, str | None]]:
    """(format, sheet, row, values, error) of an export, row by row; an export never raises: what stops it, or that it has no
    data, is a last row with an error."""
    kind, found = sniff(content), 0
    try:
        if kind not in (OOXML, HTML, DELIMITED):
            raise ValueError("can't be read")
        text = "" if kind == OOXML else content.decode("utf-8-sig", "replace")
        rows = xlsx_rows(content) if kind == OOXML else (("", cells) for cells in (html_table(text) if kind == HTML else delimited(text)))
        for sheet_name, own in groupby(rows, key=lambda r: r[0]):
            header = Header()
            for k, values in enumerate(v for v in (header.row(cells) for _, cells in own) if v is not None):
                found += 1
                yield kind, sheet_name, k, values, None
        if not found:
            raise ValueError("without data rows")
    except (zipfile.BadZipFile, ET.ParseError, KeyError, IndexError, ValueError, csv.Error) as error:
        yield kind, None, None, None, f"{kind}: {error}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, format, sheet, row, values (map of column name to text) and error for all exports under ``path``. Rows leave the task in
    batches of ``BATCH_ROWS``, so a sheet of any length takes the memory of its file, its shared strings and a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for file, content in zip(frame["path"], frame["content"]):
                rows = ((file, *r) for r in records(content))
                while own := list(islice(rows, BATCH_ROWS)):
                    out = pd.DataFrame(own, columns=["file", "format", "sheet", "row", "values", "error"])
                    yield out.astype({"row": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, format string, sheet string, row bigint, values map<string,string>, error string")


def find_column(headers: dict[str, list[str]], candidates: list[str]) -> list[tuple[str, str]]:
    """(sheet, column) of every sheet that has one of the candidates. Where no sheet has one exactly, columns with the last
    segment of a candidate stand for it; an exact name anywhere rules these out everywhere."""
    exact = [(s, c) for s, own in headers.items() for c in dict.fromkeys(candidates) if c in own]
    return exact or list(dict.fromkeys((s, c) for s, own in headers.items() for c in (leaf_of(own, x) for x in candidates) if c))


def sheet(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One sheet as a table: its name matches without case, else by its first six letters."""
    have = [r["sheet"] for r in rows.select("sheet").distinct().collect() if r["sheet"] is not None]  # a few sheets
    pick = next((s for s in have if s.casefold() == name.casefold()), next((s for s in have if s.casefold()[:6] == name.casefold()[:6]), None))
    own = rows.filter(F.col("sheet").eqNullSafe(pick) & F.col("values").isNotNull())
    return own.select(F.col("row").alias("ord"), *[F.nullif(F.try_element_at("values", F.lit(c)), F.lit("")).alias(c) for c in columns])


def hits(spark: SparkSession, path: str, schema: str, row_tag: str = "Hit") -> DataFrame:
    """Records of a paged XML index under an explicit schema, so a year stays text."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested records as flat columns, the path joined by underscores; arrays stay."""
    from pyspark.sql import types as T

    def leaves(kind: T.StructType, path: str, name: str):
        for f in kind.fields:
            p, n = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}_{f.name.lstrip('_')}".strip("_").lower()
            yield from leaves(f.dataType, p, n) if isinstance(f.dataType, T.StructType) else [F.col(p).alias(n)]

    return df.select(*leaves(df.schema, "", ""))
