"""Loose tables, folders of files, stored pages and streams."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.sources import ingest, workbook
from lodestar.streaming import updates


def test_csv_in_any_encoding(spark, tmp_path):
    rows = 'Names,Research  Interests,Office,Name\n"Zoë","a ""b""\nc",R1,x\n王,,,y\n'
    for name in ("utf-8-sig", "gb18030"):
        path = tmp_path / f"{name}.csv"
        path.write_text(rows, encoding=name)
        df = ingest.read_csv(spark, f"file://{path}")
        got = ingest.complete(df, ("name", "research_interests", "title")).orderBy("_row").collect()
        assert [(r.name, r.research_interests, r.title, r.attributes) for r in got] == [("Zoë", 'a "b"\nc', "", {"office": "R1"}), ("王", None, "", {"office": ""})]
    (tmp_path / "latin.csv").write_bytes(b"name\nZo\xeb\xff\n")
    latin = f"file://{tmp_path}/latin.csv"
    assert ingest.decodable(spark, latin, ("utf-8", "iso-8859-1")) == "iso-8859-1"
    with pytest.raises(ValueError, match="utf-8 fails in .*latin.csv; gbk fails in .*latin.csv"):
        ingest.decodable(spark, latin, ("utf-8", "gbk"))
    assert ingest.read_csv(spark, latin, encoding="utf-8", replace=True).first().name == "Zo\ufffd\ufffd"
    assert ingest.read_csv(spark, latin, encoding="gbk", replace=True).first().name.startswith("Zo")


def test_rows_follow_file_names_and_lines(spark, tmp_path):
    for name, n in (("a.csv", 2), ("b c.csv", 500), ("z.csv", 5)):
        (tmp_path / name).write_text("name\n" + "".join(f"{name} {i}\n" for i in range(n)))
    want = [f"{name} {i}" for name, n in (("a.csv", 2), ("b c.csv", 500), ("z.csv", 5)) for i in range(n)]
    for encoding in ("utf-8", "gbk"):
        assert [r.name for r in ingest.read_csv(spark, f"file://{tmp_path}", encoding=encoding).orderBy("_row").collect()] == want


def test_missing_extra_values_as_text(spark):
    df = spark.createDataFrame([("a", None)], "name string, lab string")
    assert ingest.complete(df, ("name",), nan_text=True).first().attributes == {"lab": "nan"}


def test_files_and_sources(spark, tmp_path):
    for name in ("EAS_2024.csv", "bmh_2023.csv", "bmh_2022.csv", "notes.txt"):
        (tmp_path / name).write_text("x")
    found = ingest.files(spark, f"file://{tmp_path}", pattern="(unclosed")
    assert [(r.source, r.year) for r in found.collect()] == [("BMH", 2022), ("BMH", 2023), ("EAS", 2024)]
    assert ingest.latest(found).first().path.endswith(".csv")
    discovered = found.select("path", F.col("source").alias("source_id"))
    configured = spark.createDataFrame([("file:/x/mes_2020.csv", None), ("file:/x/other", " ")], "path string, source_id string")
    got = {r.path.rsplit("/", 1)[1]: r.source_id for r in ingest.merge_sources(discovered, configured.unionByName(discovered)).collect()}
    assert got == {"EAS_2024.csv": "EAS", "bmh_2023.csv": "BMH", "bmh_2022.csv": "BMH", "mes_2020.csv": "MES", "other": "EAS"}


def test_projects_and_startups(spark):
    df = ingest.with_rows(spark.createDataFrame([(" Ann ", "T", "x", "", " z "), (None, "U", "", "", "")], ["P I", "Title", "App1", "App2", "App3"]))
    got = ingest.deeptech(df, {"pi": "p  i", "title": "TITLE", "app_1": "app1", "app_2": "app2", "app_3": "app3"}).collect()
    assert [(r.pi, r.technology_title, r.applications, r.industries) for r in got] == [("Ann", "T", ["x", "z"], [])]
    raw = ingest.with_rows(spark.createDataFrame([("Med AI Lab!", "1. Ann 2. Bo", "AI, Health", "")], ["Company_Name", "People", "Category", "Description"]))
    row = ingest.startups(raw, {"company_name": "company_name"}, "startup_2025.xlsx").first()
    assert (row.startup_id, row.people, row.categories, row.source_year) == ("med-ai-lab-2025-1", ["Ann", "Bo"], ["AI", "Health"], 2025)


def test_every_sheet_of_large_and_odd_workbooks(spark, tmp_path, monkeypatch):
    long = [[i, f"text <{i}> & 'more'", None, 1.5 * i] for i in range(12_000)]
    (tmp_path / "a.xlsx").write_bytes(workbook.workbook_bytes({"Second & first": long, "Other": [["x"], [], ["", " y "]]}))
    rich = io.BytesIO()
    with zipfile.ZipFile(rich, "w") as book:
        main = workbook._MAIN[1:-1]
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si/></sst>')
        book.writestr("xl/worksheets/sheet10.xml", f'<worksheet xmlns="{main}"/>')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="B1" t="s"><v>0</v></c><c r="AA1" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(rich.getvalue())
    (tmp_path / "notes.txt").write_text("x")
    got = {}
    for r in workbook.read_cells(spark, f"file://{tmp_path}", every=True).collect():
        got.setdefault((r._file.rsplit("/", 1)[1], r._sheet), {})[r._at] = r.cells
    assert set(got) == {("a.xlsx", "Second & first"), ("a.xlsx", "Other"), ("b.xlsx", "sheet2")}
    assert [got["a.xlsx", "Second & first"][i] for i in range(12_000)] == [[str(a), b, "", str(d)] for a, b, _, d in long]
    assert got["a.xlsx", "Other"] == {0: ["x"], 1: [], 2: ["", " y "]} and got["b.xlsx", "sheet2"] == {0: ["", "rich", *[""] * 25]}
    assert {r._sheet for r in workbook.read_cells(spark, f"file://{tmp_path}").collect()} == {"Second & first", "sheet2"}
    assert workbook.as_table(workbook.read_cells(spark, f"file://{tmp_path}/*.txt")).count() == 0


LINES = ["[1/4] Scraping: Ann", "noise", "[3/4] Scraping: Ann", "[2/4] x", "[9/4] y", "Processing: Cy"]


def test_progress_in_batch_and_stream(spark, tmp_path):
    rows = [(run, i, line, 0.0, 33.3, 10) for run in ("a", "b") for i, line in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "run string, pos long, line string, start_pct double, stage_pct double, expected int")
    batch = sorted((r.run, r.pos, round(r.percent, 4), r.name) for r in updates.progress(lines).collect())
    assert [x[1:] for x in batch if x[0] == "a"] == [(0, 8.325, "Ann"), (2, 24.975, "Ann"), (4, 33.3, None)]
    lines.write.parquet(f"{tmp_path}/lines")
    stream = updates.progress_stream((own := updates.state_session(spark)).readStream.schema(lines.schema).parquet(f"{tmp_path}/lines"))
    query = stream.writeStream.format("memory").queryName("progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.run, r.pos, round(r.percent, 4), r.name) for r in own.table("progress").collect()) == batch


class Held(dict):
    """State of one key, as the processor sees it: a map, a value and timers."""

    def getMapState(self, *_):
        return self

    getValueState = lambda self, *_: Value()
    containsKey = lambda self, key: key in self
    updateValue = dict.__setitem__
    registerTimer = lambda self, at: self.__setitem__(("timer",), at)
    deleteTimer = lambda self, at: self.pop(("timer",))
    getCurrentProcessingTimeInMs = lambda self: 1000


class Value(list):
    exists = lambda self: bool(self)
    get = lambda self: self[0]

    def update(self, value):
        self[:] = [value]


def test_a_silent_run_is_forgotten():
    held, processor = Held(), updates._Progress(50)
    processor.init(held)
    rows = lambda *names: iter([pd.DataFrame([(i, 0.0, 30.0, 2, None, None, n) for i, n in enumerate(names)], columns=["pos", "start_pct", "stage_pct", "expected", "current", "total", "name"])])
    told = lambda *names: next(processor.handleInputRows(("a",), rows(*names), held))["percent"].tolist()
    assert told("Ann", "Ann", "Bo") == [15.0, 30.0] and told("Ann", "Cy") == [] and held[("timer",)] == 1050
    assert len(next(processor.handleExpiredTimer(("a",), held, None))) == 0 and not held
    assert told("Ann") == [15.0]


def test_slow_steps_are_folded_exactly(spark):
    rows = [("a", i, f"[{i}/10000] Scraping: x", 0.0, 33.3, 1) for i in range(1, 40)]
    got = updates.progress(spark.createDataFrame(rows, "run string, pos long, line string, start_pct double, stage_pct double, expected int")).collect()
    last, want = 0.0, []
    for _, i, *_ in rows:
        percent = i / 10000 * 33.3
        if percent > last + 0.01:
            last = percent
            want.append(i)
    assert sorted(r.pos for r in got) == want
