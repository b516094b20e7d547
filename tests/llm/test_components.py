"""Components against union-find, with hot nodes; tables of loops are deleted."""

import random

import pytest

from lodestar.llm import components, storage


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("hot", [500, 3])
def test_against_union_find(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_ROWS", hot)
    rng = random.Random(hot)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    edges += [(900, 900 + k) for k in range(60)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3), (2000, None)] + [(-7, -9)] * 3
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == plain(edges)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_released_tables_are_gone(spark):
    df = storage.materialize(spark.range(3), "x")
    path = df.inputFiles()[0]
    assert df.count() == 3
    storage.release(df, spark.range(1))
    assert path not in [f for p in [path] for f in _files(spark, p)]


def _files(spark, path):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [path] if fs.exists(place) else []
