"""Tables that change: a log of changes by key in buckets, and snapshots that are published whole; readers keep the version they opened.

A version is a manifest, a small JSON file that names the folders a reader reads. It is written beside its place and renamed into it, so a version
is there or it is not, for every session. Data folders never change once a manifest names them.

``KeyedTable`` keeps the latest change of each key. A commit writes the changes as one folder, dealt by buckets of the key's hash: what is written
grows with the changes, not with the table. Buckets with more than ``deltas`` folders are merged into one in the same commit; no other
bucket is touched. Deletes stay as rows, so that an older change in a later commit does not bring a key back. A batch that is
run again after a crash writes the same folder again, and one that was committed is left out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import stored


class Manifests:
    """The versions of a table under a folder."""

    def __init__(self, spark: SparkSession, target: str) -> None:
        self.spark, self.target = spark, target.rstrip("/")

    def versions(self) -> list[int]:
        path, fs = stored.path_of(self.spark, f"{self.target}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def load(self, version: int | None = None) -> dict | None:
        """What the version says (the newest by default); None before the first."""
        known = self.versions()
        if not known or version is not None and version not in known:
            return None
        place = f"{self.target}/manifests/{known[-1] if version is None else version}.json"
        return json.loads("\n".join(r.value for r in self.spark.read.text(place, wholetext=True).collect()))

    def commit(self, number: int, content: dict) -> None:
        """One rename; an error if another writer has committed this number."""
        draft, fs = stored.path_of(self.spark, f"{self.target}/manifests/.{number}.draft")
        final, _ = stored.path_of(self.spark, f"{self.target}/manifests/{number}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {number} of {self.target} was committed by another writer")

    def folders(self) -> list[str]:
        path, fs = stored.path_of(self.spark, f"{self.target}/data")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def vacuum(self, keep: int, used) -> None:
        """Forgets all but the last ``keep`` versions and deletes folders that none of these use."""
        known = self.versions()
        needed = {f for n in known[-keep:] for f in used(self.load(n))}
        for n in known[:-keep]:
            stored.delete(self.spark, f"{self.target}/manifests/{n}.json")
        for folder in self.folders():
            if folder not in needed:
                stored.delete(self.spark, f"{self.target}/data/{folder}")


def publish(df: DataFrame, target: str, keep: int = 2) -> int:
    """The table as the next version of a snapshot: readers see the old rows or all of the new. Returns its number."""
    m = Manifests(df.sparkSession, target)
    number = max(m.versions(), default=0) + 1
    df.write.mode("overwrite").parquet(f"{m.target}/data/v{number}")
    m.commit(number, {"folder": f"v{number}", "schema": df.schema.jsonValue()})
    m.vacuum(keep, lambda x: [x["folder"]])
    return number


def published(spark: SparkSession, target: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version (the newest by default); None if it is not there."""
    m = Manifests(spark, target)
    said = m.load(version)
    return None if said is None else spark.read.schema(StructType.fromJson(said["schema"])).parquet(f"{m.target}/data/{said['folder']}")


class KeyedTable:
    """A table of the latest change of each key, by ``order``; changes have a column op (``add`` or ``delete``)."""

    def __init__(self, spark: SparkSession, target: str, key: str, order: str, buckets: int = 32, deltas: int = 6) -> None:
        self.spark, self.key, self.order, self.buckets, self.deltas = spark, key, order, buckets, deltas
        self.manifests = Manifests(spark, target)
        self.data = f"{self.manifests.target}/data"

    def _latest(self, rows: DataFrame, *more: str) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.order, *more)).alias("__r")).select(self.key, "__r.*")

    def _write(self, rows: DataFrame, folder: str, version: int | None) -> list[int]:
        """Writes rows by bucket; the buckets that have any."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        told = rows if version is None else rows.withColumn("__version", F.lit(version).cast("long"))
        told.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.data}/{folder}")
        path, fs = stored.path_of(self.spark, f"{self.data}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("__bucket=") and n.split("=")[1].isdigit())

    def _rows(self, said: dict, buckets: list[str]) -> DataFrame:
        """The latest row of each key of some buckets. Only changes, and the rows of keys that changed, are shuffled: the rest of a bucket's first folder is read as it is."""
        schema = StructType.fromJson(said["schema"])
        read = lambda places: self.spark.read.schema(schema).parquet(*places)
        place = lambda b, f: f"{self.data}/{f}/__bucket={b}"
        first = [place(b, said["folders"][b][0]) for b in buckets]
        later = [place(b, f) for b in buckets for f in said["folders"][b][1:]]
        if not later:
            return read(first) if first else self.spark.createDataFrame([], schema)
        changes, base = read(later), read(first)
        keys = changes.select(self.key).distinct()
        same = base[self.key].eqNullSafe(keys[self.key])
        changed = self._latest(base.join(keys, same, "left_semi").unionByName(changes), "__version")
        return base.join(keys, same, "left_anti").unionByName(changed)

    def apply(self, changes: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """Commits changes as the next version and returns its number. A batch of a source that was committed before is left out."""
        said = self.manifests.load() or {"folders": {}, "sources": {}, "number": 0}
        if source is not None and said["sources"].get(source, -1) >= batch:
            return said["number"]
        number = said["number"] + 1
        folders = {b: list(f) for b, f in said["folders"].items()}
        schema = changes.schema
        if "schema" in said:
            # New columns join the table; those that a batch leaves out are null.
            known = StructType.fromJson(said["schema"])
            schema = StructType([f for f in known if f.name != "__version"] + [f for f in schema if f.name not in known.names])
            changes = changes.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        for b in self._write(self._latest(changes), f"v{number}", number):
            folders.setdefault(str(b), []).append(f"v{number}")
        content = {"number": number, "folders": folders, "sources": {**said["sources"], **({source: batch} if source is not None else {})}, "schema": schema.add("__version", "long").jsonValue()}
        full = [b for b, f in folders.items() if len(f) > self.deltas]
        if full:
            self._write(self._rows(content, full), f"c{number}", None)
            content["folders"] = {b: [f"c{number}"] if b in full else f for b, f in folders.items()}
        self.manifests.commit(number, content)
        return number

    def stream(self, changes: DataFrame, checkpoint: str, source: str = "stream"):
        """Streams changes into the table until what is there has been read."""
        return changes.writeStream.foreachBatch(lambda rows, n: self._batch(rows, source, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _batch(self, rows: DataFrame, source: str, number: int) -> None:
        self.apply(rows, source, number)
        self.vacuum()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest by default) that are not deleted; None if it is not there."""
        said = self.manifests.load(version)
        return None if said is None else self._rows(said, list(said["folders"])).where("op = 'add'").drop("op", "__version")

    def vacuum(self, keep: int = 2) -> None:
        self.manifests.vacuum(keep, lambda x: {f for folders in x["folders"].values() for f in folders})
