"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  It is read from the
session; only where it is unset and Spark runs on one machine (unit tests) a folder of
this process is used, which ends with it.  Elsewhere an unset folder is an error.

Tables of one application stand in a folder of their own: ``release`` deletes those
that loops leave behind, ``clear`` the whole folder, when no result is read any more.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
#: Folders of tables that are still held, by the frame that reads them.
_written: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            if not _local:
                _local.append(tempfile.mkdtemp(prefix="lodestar-"))
                atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
            root = f"file://{_local[0]}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root.rstrip('/')}/lodestar-{spark.sparkContext.applicationId}"


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def cols(columns: list[str]) -> list[Column]:
    """The columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of a file, not a
    recomputation.  The schema is passed on, so an empty table stays readable.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for table in tables:
        path = _written.pop(id(table), None)
        if path:
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, results that were not written elsewhere included."""
    _delete(spark, shared_root(spark))
