"""Tables that keep versions: latest changes by key, bytes by batch, crashes, pinned readers, snapshots."""

import random

import pytest

from lodestar import stored
from lodestar.streaming import keyed

SCHEMA = "k long, v string, at long, op string"


def written(spark, target):
    """Data files and their bytes."""
    path, fs = stored.path_of(spark, f"{target}/data")
    files, out = fs.listFiles(path, True), {}
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().endswith(".parquet"):
            out[f.getPath().toString()] = f.getLen()
    return out


def rows(table, version=None):
    found = table.read(version)
    return None if found is None else {(r.k, r.v) for r in found.collect()}


def test_against_a_dictionary(spark, tmp_path):
    rng, latest = random.Random(3), {}
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=4, deltas=3)
    assert table.read() is None
    for n in range(1, 9):
        batch = [(rng.randrange(60), f"{n}.{i}", rng.randrange(1000), rng.choice(["add", "add", "delete"])) for i in range(rng.choice([1, 5, 40]))]
        best = {}
        for k, v, at, op in batch:  # of equal times in a batch any may count: keep them apart
            if k not in best or at > best[k][1]:
                best[k] = (v, at, op)
        assert table.apply(spark.createDataFrame([(k, *x) for k, x in best.items()], SCHEMA)) == n
        for k, x in best.items():
            if k not in latest or x[1] >= latest[k][1]:
                latest[k] = x
        assert rows(table) == {(k, v) for k, (v, _, op) in latest.items() if op == "add"}
    assert max(map(len, table.manifests.load()["folders"].values())) <= 3


def test_what_is_written_grows_with_the_batch(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    table = keyed.KeyedTable(spark, target, "k", "at", buckets=64, deltas=3)
    table.apply(spark.createDataFrame([(i, f"some longer text of row {i} " * 10, 1, "add") for i in range(20_000)], SCHEMA))
    before = written(spark, target)
    for n in range(4):
        table.apply(spark.createDataFrame([(7, f"new {n}", n + 2, "add"), (8, "x", n + 2, "delete")], SCHEMA))
        after = written(spark, target)
        # Two buckets at most are touched, also when they are merged.
        assert sum(size for file, size in after.items() if file not in before) < sum(before.values()) / 10
        assert all(after[f] == size for f, size in before.items())
        before = after
    got = rows(table)
    assert len(got) == 19_999 and (7, "new 3") in got


def test_batches_of_a_stream_once_and_after_a_crash(spark, tmp_path, monkeypatch):
    source, target = f"{tmp_path}/in", f"file://{tmp_path}/out"
    table = keyed.KeyedTable(spark, target, "k", "at", buckets=4)
    run = lambda: table.stream(spark.readStream.schema(SCHEMA).parquet(source), f"{tmp_path}/offsets").awaitTermination()
    spark.createDataFrame([(1, "a", 1, "add"), (2, "b", 2, "add")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    run()  # finds nothing new
    assert rows(table) == {(1, "a"), (2, "b")} and table.manifests.versions() == [1]
    spark.createDataFrame([(1, "c", 3, "add"), (2, "", 4, "delete"), (3, "d", 5, "add"), (3, "e", 6, "add")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    with monkeypatch.context() as m:  # dies after the data, before the manifest
        m.setattr(keyed.Manifests, "commit", lambda *x: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    assert rows(table) == {(1, "a"), (2, "b")}
    run()
    assert rows(table) == {(1, "c"), (3, "e")} and table.manifests.versions() == [1, 2]
    # A batch that was committed, but whose offsets were lost, is left out.
    assert table.apply(spark.createDataFrame([(9, "again", 9, "add")], SCHEMA), "stream", 1) == 2
    assert rows(table) == {(1, "c"), (3, "e")}


def test_readers_keep_their_version_and_old_changes_stay_old(spark, tmp_path):
    target = f"file://{tmp_path}/t"
    table = keyed.KeyedTable(spark, target, "k", "at", buckets=2)
    table.apply(spark.createDataFrame([(1, "a", 5, "add")], SCHEMA))
    other = keyed.KeyedTable(spark.newSession(), target, "k", "at", buckets=2)
    pinned = other.read(1)
    table.apply(spark.createDataFrame([(1, "b", 6, "delete")], SCHEMA))
    table.apply(spark.createDataFrame([(1, "late", 4, "add"), (2, "n", 1, "add")], SCHEMA))
    assert {(r.k, r.v) for r in pinned.collect()} == {(1, "a")} and rows(other) == {(2, "n")} and rows(other, 1) == {(1, "a")} and rows(other, 9) is None
    with pytest.raises(RuntimeError, match="another writer"):
        table.manifests.commit(3, {})
    table.vacuum(keep=1)
    assert rows(other) == {(2, "n")} and rows(other, 1) is None


def test_columns_that_come_later(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=2)
    table.apply(spark.createDataFrame([(1, "a", 1, "add"), (2, "b", 1, "add")], SCHEMA))
    table.apply(spark.createDataFrame([(2, 2, "add", 7)], "k long, at long, op string, extra int"))
    assert {(r.k, r.v, r.extra) for r in table.read().collect()} == {(1, "a", None), (2, None, 7)}


def test_snapshots(spark, tmp_path):
    target = f"file://{tmp_path}/s"
    assert keyed.published(spark, target) is None
    assert keyed.publish(spark.range(3), target) == 1
    first = keyed.published(spark.newSession(), target)
    assert keyed.publish(spark.range(5), target) == 2
    assert first.count() == 3 and keyed.published(spark, target).count() == 5 and keyed.published(spark, target, 1).count() == 3
    assert keyed.publish(keyed.published(spark, target).limit(1), target) == 3
    assert keyed.published(spark, target).count() == 1 and keyed.published(spark, target, 1) is None
