"""Workbooks (xlsx) as a data source of Spark: ``spark.read.format("workbook")``, and a plain writer.

A partition is one sheet of one file. Rows are read as a stream of XML events and leave in Arrow batches, so neither a file nor
a sheet is held as a whole; only a workbook's shared strings are. Files are opened with ``pyarrow.fs`` (local, HDFS, S3, GCS)."""

from __future__ import annotations

import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from posixpath import normpath
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 5000
SCHEMA = "_file string, _sheet string, _at long, cells array<string>"
_ARROW = pa.schema([("_file", pa.string()), ("_sheet", pa.string()), ("_at", pa.int64()), ("cells", pa.list_(pa.string()))])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PLACE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELL = re.compile(r"([A-Z]+)\d+")


def _opened(path: str) -> pa.NativeFile:
    place, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return place.open_input_file(inside)


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of the sheets, in the workbook's order."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        listed = [(e.get("name", ""), targets.get(e.get(_PLACE), "")) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        found = [(n, t.removeprefix("/") if t.startswith("/") else normpath(f"xl/{t}")) for n, t in listed]
        if found and all(t in names for _, t in found):
            return found
    return [(n.rsplit("/", 1)[1].removesuffix(".xml"), n) for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))]


def _said(e: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic runs."""
    return "".join(t.text or "" for part in e if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in part.iter(f"{_MAIN}t"))


def _elements(file: Iterable, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end; what was read is forgotten."""
    around: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            around.append(e)
            continue
        around.pop()
        if e.tag == tag:
            yield e
            e.clear()
            # The element around it would keep every empty one.
            around[-1].remove(e)


def rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str]]:
    """Rows of a sheet: shared and inline strings, numbers as they are written; columns that are left out are empty."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as file:
            shared = [_said(e) for e in _elements(file, f"{_MAIN}si")]
    with book.open(part) as file:
        for row in _elements(file, f"{_MAIN}row"):
            out: list[str] = []
            for c in row.iter(f"{_MAIN}c"):
                m = _CELL.match(c.get("r", ""))
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(m[1]))) - 1 if m else len(out)
                value, kind = c.find(f"{_MAIN}v"), c.get("t")
                text = "" if value is None else value.text or ""
                if kind == "s":
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(_said(e) for e in c.iter(f"{_MAIN}is"))
                out += [""] * (at - len(out))
                out.append(text)
            yield out


@dataclass
class Sheet(InputPartition):
    path: str
    #: None: the first one, whatever its name.
    part: str | None
    name: str = ""


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.every = json.loads(options["files"]), options.get("sheets", "first") == "all"

    def partitions(self) -> list[Sheet]:
        if not self.every:
            return [Sheet(f, None) for f in self.files] or [Sheet("", None)]
        found = []
        for f in self.files:
            with _opened(f) as file, zipfile.ZipFile(file) as book:
                found += [Sheet(f, part, name) for name, part in sheets(book)]
        return found or [Sheet("", None)]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _opened(partition.path) as file, zipfile.ZipFile(file) as book:
            name, part = (partition.name, partition.part) if partition.part else sheets(book)[0]
            batch: list[list[str]] = []
            at = 0
            for row in rows(book, part):
                batch.append(row)
                if len(batch) == BATCH:
                    yield self._batch(partition.path, name, at, batch)
                    at, batch = at + len(batch), []
            if batch:
                yield self._batch(partition.path, name, at, batch)

    @staticmethod
    def _batch(path: str, name: str, at: int, cells: list[list[str]]) -> pa.RecordBatch:
        n = len(cells)
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), pa.array(cells, _ARROW.field("cells").type)], schema=_ARROW)


class WorkbookSource(DataSource):
    """Options: files (a JSON list of places), sheets (``first`` or ``all``)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def read_cells(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """_file, _sheet, _at (from 0), cells of the workbooks of a path (a file, a folder or a pattern)."""
    files = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path").collect())
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("files", json.dumps(files)).option("sheets", "all" if every else "first").load()


def _cell(x: object) -> str:
    if x is None:
        return "<c/>"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"<c><v>{x}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'


def write_workbook(file: IO[bytes], tables: Mapping[str, Iterable[Iterable[object]]]) -> None:
    """A workbook: rows by the names of their sheets, written as they come; numbers as numbers, everything else as text."""
    main, office = _MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        n = range(1, len(tables) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, tables, strict=True)) + "</sheets></workbook>")
        for i, table in zip(n, tables.values(), strict=True):
            with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for r in table:
                    part.write(("<row>" + "".join(map(_cell, r)) + "</row>").encode())
                part.write(b"</sheetData></worksheet>")


def workbook_bytes(tables: Mapping[str, Iterable[Iterable[object]]]) -> bytes:
    """A small workbook as bytes."""
    out = io.BytesIO()
    write_workbook(out, tables)
    return out.getvalue()


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


def write_workbooks(df: DataFrame, folder: str, by: str, order: str, sheet: str = "Sheet1") -> None:
    """A workbook ``<value>.xlsx`` in the folder for each value of a column, with the other columns, in order of one of them.

    A workbook is one file and so one task's; Spark sorts its rows, and they are written as they come: the task holds a batch of them."""
    names = [c for c in df.columns if c != by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, inside = fs.FileSystem.from_uri(folder)
        place.create_dir(inside, recursive=True)
        for key, rows in itertools.groupby(_rows(batches, [by, *names]), lambda r: r[0]):
            with place.open_output_stream(f"{inside}/{key}.xlsx") as file:
                counted = itertools.count()
                write_workbook(file, {sheet: itertools.chain([names], (r[1:] for r, _ in zip(rows, counted)))})
            yield pa.RecordBatch.from_arrays([pa.array([next(counted)], pa.int64())], names=["rows"])

    df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


def as_table(cells: DataFrame) -> DataFrame:
    """Rows under the first file's header as strings, with _file and _at (from 1)."""
    first = cells.where("_at = 0").orderBy("_file", "_sheet").first()
    names = [c or f"column {i}" for i, c in enumerate(first.cells)] if first else []
    wide = cells.where("_at > 0").select("_file", "_at", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(len(names))])
    return wide.toDF("_file", "_at", *names)
