"""Workbooks and pages that are larger than a task should hold at once."""

import io
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from lodestar.sources import markup, workbook


def test_workbooks_are_written_and_read_as_streams():
    peaks = []
    for n in (2000, 20000):
        tracemalloc.start()
        with io.BytesIO() as out:
            workbook.write_workbook(out, {"s": ((i, f"name {i}") for i in range(n))})
            with zipfile.ZipFile(out) as book:
                assert sum(1 for _ in workbook.rows(book, "xl/worksheets/sheet1.xml")) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 500_000  # ten times the rows: the compressed file, and no row


def test_pages_of_a_small_file_are_dealt(spark):
    rows = markup.dealt(spark.range(3000).coalesce(1).withColumn("x", F.lit(1)), "id")
    assert rows.rdd.getNumPartitions() >= 4 and rows.count() == 3000
