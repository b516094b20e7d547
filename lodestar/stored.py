"""Tables that a job writes on its way, in the folder that driver and executors share (``spark.checkpoint.dir``).

Where that is unset and Spark runs on one machine, a temporary folder of this process is used, which ends with it; elsewhere it is an error."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A place for a folder that is not there yet."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestar-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet and read back: what is used several times is worked out once, and a lost executor costs a reread."""
    place = new_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def path_of(spark: SparkSession, place: str):
    """Hadoop's path and file system of a place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, place: str) -> None:
    path, fs = path_of(spark, place)
    fs.delete(path, True)
