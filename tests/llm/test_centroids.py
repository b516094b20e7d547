"""Operator 12: against exhaustive search in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, dim, k, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    cs = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            mine = [v for o, (_, v) in zip(own, kept, strict=True) if o == n]
            if mine:
                cs[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [near(v) for _, v in kept]
    inertia = [sum(d for d, n in found if n == m) for m in range(len(cs))]
    return sorted(repr((i, n, d, inertia[n], sum(inertia), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest())) for (i, _), (d, n) in zip(kept, found, strict=True))


def run(spark, rows, **kw):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("own")).withColumn("v", F.lit(1))
    return sorted(repr(tuple(r)) for r in c.cluster(frame, **kw).collect())


def test_against_plain_version(spark):
    rng = random.Random(4)
    middles = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in rng.choice(middles)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [float("nan")] + [0.0] * 63), (304, [float("inf")] * 64), (305, [None] + [1.0] * 63), (None, [0.25] * 64), (None, [0.5] * 64)]
    rows += [(7, rows[7][1]), (7, rows[8][1])] + [(400 + i, [-1.5] * 64) for i in range(100)]
    assert run(spark, rows) == plain(rows, 64, 40, 5)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4 - 2), float(i % 3)]) for i in range(60)]
    assert run(spark, rows, dim=2, k=7, rounds=3) == plain(rows, 2, 7, 3)


def test_few_vectors_and_none(spark):
    assert run(spark, [(1, [1.0] * 64), (2, [2.0] * 64)]) == plain([(1, [1.0] * 64), (2, [2.0] * 64)], 64, 40, 5)
    assert run(spark, []) == [] and run(spark, [(None, None)]) == []
    assert len(run(spark, [(None, [1.0] * 64)])) == 1


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [3e38] * 64)])


@pytest.mark.parametrize("scale", [1, 1000, 1 << 26])
def test_search_is_exact_and_skips(scale):
    rng = np.random.default_rng(scale)
    cs = rng.integers(-scale, scale + 1, (40, 64))
    v = np.concatenate([rng.integers(-scale, scale + 1, (500, 64)), cs, cs[:5] + 1, np.zeros((2, 64), np.int64)])
    number, best, worked = c.Search(cs).nearest(v)
    distances = ((v[:, None, :] - cs[None]) ** 2).sum(axis=2)
    assert (number == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()
    means = np.arange(40)[:, None] * 100 + rng.integers(0, 5, (40, 64))
    near = means[rng.integers(0, 40, 1000)] + rng.integers(0, 3, (1000, 64))
    number, best, worked = c.Search(means).nearest(near)
    assert (number == ((near[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)).all() and worked < 3 * len(near)
