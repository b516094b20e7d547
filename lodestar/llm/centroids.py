"""Operator 12: Lloyd's rounds with an equal-average equal-variance search, in whole numbers.

A vector's nearest centroid is found without most distances.  With the sums s, t of
the components of a vector and a centroid, and u, v the lengths of what is left of
them after their mean is taken away, every squared distance over ``dim`` components is
at least ``((s - t)**2 + dim * (u - v)**2) / dim``.  Centroids are sorted by their mean
and visited outward from the vector's mean.  A vector is done as soon as the first
part alone is above its best distance (all further centroids are worse still); a
centroid is skipped if both parts together are.  Both tests compare roots and give
way by more than their rounding, so they never reject a centroid that could win or tie;
what is left is a squared distance in 64-bit integers.

Vectors are turned into integers once and written; a round is one Arrow pass in
which a task adds up its vectors per centroid, one aggregation of those sums, and a floor
division of ``k * dim`` numbers on the driver, which is all that reaches it.

Defined results: vectors with another number of components, a null, NaN or infinite one
are left out; components beyond ``LIMIT`` in either direction are an error, as their
distances leave 64 bits; rows that repeat are vectors of their own, and those with a
null id start a centroid only if too few others are there; with fewer vectors than
``k`` there are fewer centroids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest component after scaling: 64 squared differences of twice that are below 2**62.
LIMIT = 1 << 26
#: Vectors of one step.
BATCH = 8192


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and the components as integers of the vectors that count."""
    sound: Column = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dim) & sound)
    near = F.forall("embedding", lambda x: F.abs(x * float(scale)) <= float(LIMIT))
    checked = kept.withColumn("embedding", F.when(near, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT / scale}"))))
    return checked.select("vec_id", F.transform("embedding", lambda x: F.floor(x * float(scale)).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose id has the smallest sha256, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


class Search:
    """The nearest of some centroids, smaller numbers first on ties."""

    def __init__(self, centroids: np.ndarray):
        self.dim = centroids.shape[1]
        self.numbers = np.argsort(centroids.sum(axis=1), kind="stable")
        self.sorted = centroids[self.numbers]
        self.sums, self.spread = self._moments(self.sorted)

    def _moments(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums, and the root of dim times the squares around the mean."""
        sums = v.sum(axis=1)
        return sums, np.sqrt(((v - (sums / self.dim)[:, None]) ** 2).sum(axis=1) * self.dim)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and the squared distance of every vector; and how many distances were worked out."""
        n, k = len(v), len(self.sorted)
        sums, spread = self._moments(v)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        right = np.searchsorted(self.sums, sums)
        left, rows, worked = right - 1, np.arange(n), 0
        far = np.iinfo(np.int64).max
        for _ in range(k):
            # The nearer of the next centroids on either side, by the difference of the sums.
            low = np.where(left[rows] >= 0, sums[rows] - self.sums[left[rows]], far)
            high = np.where(right[rows] < k, self.sums[np.minimum(right[rows], k - 1)] - sums[rows], far)
            down = low <= high
            at, gap = np.where(down, left[rows], right[rows]), np.minimum(low, high)
            left[rows[down]] -= 1
            right[rows[~down]] += 1
            # With gap**2 / dim above best all further centroids are worse.
            reach = np.sqrt(best[rows].astype(np.float64) * self.dim) * (1 + 1e-12) + 1
            going = (gap < far) & (gap <= reach)
            rows, at, gap = rows[going], at[going], gap[going]
            if not len(rows):
                break
            apart = gap.astype(np.float64) ** 2 + (spread[rows] - self.spread[at]) ** 2
            maybe = apart * (1 - 1e-6) - 1 <= best[rows].astype(np.float64) * self.dim
            look, to = rows[maybe], at[maybe]
            worked += len(look)
            distance = ((v[look] - self.sorted[to]) ** 2).sum(axis=1)
            better = (distance < best[look]) | ((distance == best[look]) & (self.numbers[to] < number[look]))
            best[look[better]], number[look[better]] = distance[better], self.numbers[to[better]]
        return number, best, worked


def _sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centroid has, and their sum."""
    k, dim = centroids.shape
    model = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = Search(model.value), np.zeros((k, dim + 1), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                v = _matrix(whole.column(0).slice(i, BATCH), dim)
                number, _, _ = search.nearest(v)
                order = np.argsort(number, kind="stable")
                present, start = np.unique(number[order], return_index=True)
                total[present, :dim] += np.add.reduceat(v[order], start)
                total[:, dim] += np.bincount(number, minlength=k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "value"])

    rows = vectors.select("v").mapInArrow(run, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    model.unpersist()
    total = np.zeros(k * (dim + 1), np.int64)
    total[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    total = total.reshape(k, dim + 1)
    return total[:, dim], total[:, :dim]


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after some rounds over vectors (vec_id, v), one a row."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        count, total = _sums(vectors, centroids)
        there = count > 0
        centroids[there] = total[there] // count[there, None]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector (vec_id, v)."""
    model, dim = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(model.value)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                part = whole.slice(i, BATCH)
                number, distance, _ = search.nearest(_matrix(part.column(1), dim))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(table: DataFrame, dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = table.sparkSession
    vectors = materialize(whole_vectors(table, dim, scale), "whole-vectors")
    centroids = fit(vectors, k, rounds, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    assigned = materialize(assign(vectors, centroids), "assigned-vectors")
    # One row a centroid: k at most.
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Every round as steps of their own; in SQL a quotient is cut towards 0, so a negative sum is moved first."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIM}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS key, v FROM v ORDER BY key NULLS LAST, v LIMIT {K})
)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT v.r, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c
  ) GROUP BY r
)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS MATERIALIZED (
  SELECT a.best.c AS c, p, sum(v.v[p])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN v USING (r) CROSS JOIN generate_series(1, {DIM}) AS g(p) GROUP BY a.best.c, p
), m{i} AS (
  SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY p) AS v FROM s{i} GROUP BY c
), c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c)
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.best.c::INTEGER AS "cluster", a.best.d AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
       (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON c.c = a.best.c
"""


SQL = _sql()
