"""Readers for loosely kept tables: encodings, header names, missing columns, folders of yearly files."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, split_list, split_numbered, startup_id
from ..operators.profile import number_rows
from . import workbook

# Encodings in the order they are tried, header synonyms and the columns of people.
ENCODINGS = ("utf-8", "gb18030", "gbk", "big5", "iso-8859-1")
SYNONYMS = {"names": "name", "research interest": "research_interests", "research interests": "research_interests", "research_interest": "research_interests"}
# Fixed value: names of yearly files.
FILE_NAME = r"(?P<source>[A-Za-z]+)_(?P<year>\d{4})\.(?:xlsx|csv|parquet|json)$"
PEOPLE = ("name", "department", "title", "research_interests", "url", "leading_project", "funding", "paper")


def header(name: str) -> str:
    return re.sub(r"\s+", " ", name.replace("﻿", "").strip()).lower()


def normalize(df: DataFrame, synonyms: dict[str, str] = SYNONYMS) -> DataFrame:
    """Headers lower-cased with single blanks, synonyms renamed; of equal headers the first stays."""
    names = [synonyms.get(header(c), header(c)) for c in df.columns]
    df = df.toDF(*[f"{i}:{n}" for i, n in enumerate(names)])
    return df.select(*[F.col(f"`{i}:{n}`").alias(n) for i, n in enumerate(names) if n not in names[:i]])


def complete(df: DataFrame, wanted: tuple[str, ...] = PEOPLE, attributes: bool = True, nan_text: bool = False) -> DataFrame:
    """Missing columns as empty strings; other columns as a map of attributes (missing values empty, or ``nan`` as text)."""
    kept = [c for c in df.columns if c in wanted or c.startswith("_") or c in ("is_engineering", "years_since_phd")]
    extra = [c for c in df.columns if c not in kept]
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan" if nan_text else ""))
    out = [*[F.col(f"`{c}`") for c in kept], *[F.lit("").alias(c) for c in wanted if c not in df.columns]]
    if attributes:
        pairs = [x for c in extra for x in (F.lit(c), text(c))]
        out.append((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attributes"))
    return df.select(*out)


def tried_encodings(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> list[tuple[str, str | None]]:
    """Every encoding with the first file (by name) that it cannot read, or None. Files are read in parts; lines break where bytes do in all of these encodings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad: dict[str, str] = {}
        for batch in batches:
            files = batch.column(1).to_pylist()
            for file in set(files):
                lines = b"\n".join(x for x, f in zip(batch.column(0).to_pylist(), files, strict=True) if f == file and x is not None)
                for name in encodings:
                    try:
                        lines.decode(name)
                    except UnicodeDecodeError:
                        bad[name] = min(file, bad.get(name, file))
        yield pa.RecordBatch.from_arrays([pa.array(list(bad)), pa.array(list(bad.values()))] if bad else [pa.array([], pa.string())] * 2, names=["bad", "file"])

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    bad = {r.bad: r.file for r in lines.mapInArrow(run, "bad string, file string").groupBy("bad").agg(F.min("file").alias("file")).collect()}
    return [(name, bad.get(name)) for name in encodings]


def decodable(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that reads all files; an error that names every attempt if none does."""
    tried = tried_encodings(spark, path, encodings)
    for name, file in tried:
        if file is None:
            return name
    raise ValueError(f"no encoding reads {path}: " + "; ".join(f"{name} fails in {file}" for name, file in tried))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that is there; None if none is."""
    return next((p for p in paths if exists(spark, p)), None)


#: Encodings that Spark's own reader knows.
NATIVE = ("utf-8", "iso-8859-1")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, missing: tuple[str, ...] | None = None, replace: bool = False) -> DataFrame:
    """All columns as strings, headers normal, ``_row`` in file order (file name, then line); quotes and line breaks as usual.

    missing: columns of the empty table that stands for a path that is not there (an error where it is not given).
    replace: bytes that the encoding (UTF-8 if none is given) cannot read become replacement characters."""
    if missing is not None and not exists(spark, path):
        return with_rows(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in missing)))
    encoding = encoding or ("utf-8" if replace else decodable(spark, path))
    if encoding.lower() in NATIVE:
        df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
        return _in_file_order(normalize(df.select("*", file.alias("_file"), F.monotonically_increasing_id().alias("_at"))), {re.sub("^file:/+", "file:/", f) for f in df.inputFiles()})
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_csv_rows(encoding, "replace" if replace else "strict"), "_file string, _at long, cells array<string>")
    first = rows.where("_at = 0").orderBy("_file").first()
    names = first.cells if first else []
    wide = rows.where("_at > 0").select("_file", "_at", *[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(f"{i}:{n}") for i, n in enumerate(names)])
    listed = spark.read.format("binaryFile").load(path).select("path").collect()
    return _in_file_order(normalize(wide.toDF("_file", "_at", *names)), {f.path for f in listed})


def _csv_rows(encoding: str, errors: str):
    """Rows of whole files in an encoding that only Python reads; for legacy files, which a task holds one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = csv.reader(io.TextIOWrapper(io.BytesIO(content.as_py()), encoding, errors, newline=""))
                at = 0
                while rows := [r for r in itertools.islice(reader, 10_000) if r]:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["_file", "_at", "cells"])
                    at += len(rows)

    return run


def _in_file_order(df: DataFrame, files: set[str]) -> DataFrame:
    """``_row`` from _file and _at (increasing inside a file): the number of the file by name, then its rows. The listing is on the driver anyway; a file has fewer than 2**33 rows."""
    names = sorted(files)
    table = df.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], "_file string, __n long")
    place = F.shiftleft("__n", 33) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return df.join(F.broadcast(table) if len(names) <= 100_000 else table, "_file").withColumn("_row", place).drop("_file", "_at", "__n")


def row_count(spark: SparkSession, path: str) -> int:
    """Data rows of CSV files; 0 if they cannot be read."""
    try:
        return read_csv(spark, path).count()
    except Exception:  # whatever is wrong with the file, it counts as empty
        return 0


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook as strings under the first file's header; ``_file``, and ``_row`` from 1 in each file."""
    return normalize(workbook.as_table(workbook.read_cells(spark, path))).withColumnRenamed("_at", "_row")


def with_rows(df: DataFrame) -> DataFrame:
    """``_row``: increasing in the order that the files are read; taken at the scan, before any shuffle."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def files(spark: SparkSession, folder: str, pattern: str = FILE_NAME, recursive: bool = False, default: str = FILE_NAME) -> DataFrame:
    """path, source (upper case), year, modified of the files whose name fits; sorted by source, year (-1 without), path.

    A pattern that cannot be compiled is replaced by the default; named groups are written as in Python."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", F.col("modificationTime").alias("modified"))
    return named_files(listing, pattern, default)


def named_files(listing: DataFrame, pattern: str = FILE_NAME, default: str = FILE_NAME) -> DataFrame:
    """The same for a listing (path, modified)."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = default
    java = "(?i)" + pattern.replace("(?P<", "(?<")
    groups = re.compile(pattern).groupindex
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda g: F.nullif(F.regexp_extract(name, java, groups[g]), F.lit("")) if g in groups else F.lit(None).cast("string")
    found = listing.where(name.rlike(java)).select("path", F.upper(part("source")).alias("source"), part("year").cast("int").alias("year"), "modified")
    return found.orderBy(F.col("source"), F.coalesce("year", F.lit(-1)), F.lower("path"))


def latest(listing: DataFrame, by: str = "modified") -> DataFrame:
    """The path changed last, of equal times the largest; or, by ``path``, the largest path."""
    order = F.struct("modified", "path") if by == "modified" else F.struct("path")
    return listing.agg(F.max_by("path", order).alias("path"))


def enabled_sources(sources: DataFrame, fallback: str | None = None) -> DataFrame:
    """sources: path, source_id, enabled (null counts as enabled). Those that are enabled; without any the fallback path alone."""
    kept = sources.where(F.coalesce("enabled", F.lit(True))).select("path", "source_id")
    if fallback is None:
        return kept
    one = sources.sparkSession.createDataFrame([(fallback, None)], "path string, source_id string")
    return kept.unionByName(one.join(kept.select(F.lit(True).alias("any")).limit(1), how="left_anti"))


def union_sources(tables: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """Technology projects of several sources, in the order given (``_row`` goes on from source to source)."""
    out = None
    for k, (source, df) in enumerate(tables.items()):
        mine = deeptech(df, columns, source).withColumn("_row", F.col("_row") + F.lit(k << 50))
        out = mine if out is None else out.unionByName(mine)
    return out


def merge_sources(discovered: DataFrame, configured: DataFrame) -> DataFrame:
    """path, source_id: each path once, discovered ones first; ids upper-cased, else from the file name, else EAS."""
    both = discovered.select("path", "source_id", F.lit(0).alias("o")).unionByName(configured.select("path", "source_id", F.lit(1).alias("o")))
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("o", F.col("source_id").asc_nulls_last()))).where("n = 1")
    named = F.nullif(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(?i)([A-Za-z]+)_\d{4}\.", 1), F.lit(""))
    return first.select("path", F.upper(F.coalesce(F.nullif(F.trim("source_id"), F.lit("")), named, F.lit("EAS"))).alias("source_id"))


def deeptech(df: DataFrame, columns: dict[str, str], source: str = "EAS") -> DataFrame:
    """Technology projects from a table with configured headers: pi, title, ..., applications, industries; rows without a pi go."""
    lookup = {header(c): c for c in df.columns}
    col = lambda key: clean_text(F.col(f"`{lookup[header(columns[key])]}`")) if header(columns.get(key, "")) in lookup else F.lit("")
    some = lambda keys: F.filter(F.array(*[col(k) for k in keys]), lambda x: x != "")
    out = df.select(
        "_row", col("pi").alias("pi"), F.lit(source).alias("source"), col("cluster").alias("cluster"), col("title").alias("technology_title"), col("trl").alias("trl"), col("ip_status").alias("ip_status"),
        col("overview").alias("overview"), col("tech_edges").alias("tech_edges"), some(["app_1", "app_2", "app_3"]).alias("applications"), some(["industry_1", "industry_2"]).alias("industries"),
    )
    return out.where("pi <> ''")


def startups(df: DataFrame, columns: dict[str, str], file: str) -> DataFrame:
    """Startup rows from a table with configured headers; the year is read from the file's name."""
    lookup = {header(c): c for c in df.columns}
    col = lambda key: clean_text(F.col(f"`{lookup[header(columns.get(key, key))]}`")) if header(columns.get(key, key)) in lookup else F.lit("")
    year = re.search(r"(\d{4})", file)
    named = number_rows(df, "raw_row_index") if "raw_row_index" not in df.columns else df
    year_col: Column = F.lit(int(year[1]) if year else None).cast("int")
    return named.select(
        startup_id(col("company_name"), year_col, F.col("raw_row_index")).alias("startup_id"), year_col.alias("source_year"), F.lit(file).alias("source_file"), col("company_name").alias("company_name"),
        split_numbered(col("people")).alias("people"), *[col(c).alias(c) for c in ("ref_code", "ref_code_link", "funding", "background_year", "description", "website")],
        split_list(col("category")).alias("categories"), split_numbered(col("tel")).alias("tels"), split_numbered(col("email")).alias("emails"), "raw_row_index",
    )
