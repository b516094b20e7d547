"""Connected components of an edge table, by min-label stars.

Each round applies a large star and a small star (Kiveris et al., 2014): every
node's larger neighbours, then its smaller ones, are attached to the smallest
node it knows.  Both are a ``min`` per node, which is combined before the shuffle, and
one equi-join of the edges with these minima.  A node with very many neighbours would
be one task of that join, so the minima of such hot nodes are broadcast instead and
their edges stay where they are (``join_by_key``).  The result of each round is
written, which cuts the lineage, and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release

MAX_ROUNDS = 60
#: A key is hot from this many rows on, or from a HOT_SHARE-th of all rows if that is more: at most HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 500, 20_000


def join_by_key(side: DataFrame, told: DataFrame, key: str, total: int) -> DataFrame:
    """side joined with told (key, n, further columns): one row a key, n rows of side at most have it, of total rows.

    Rows of hot keys meet a broadcast table, which has total / hot, that is HOT_SHARE, rows at most; the others are shuffled."""
    hot = max(HOT_ROWS, -(-total // HOT_SHARE))
    more = [c for c in told.columns if c not in (key, "n")]
    tagged = side.join(F.broadcast(told.where(F.col("n") >= hot).drop("n").withColumn("__hot", F.lit(True))), key, "left")
    cold = tagged.where("__hot IS NULL").drop("__hot", *more).join(told.where(F.col("n") < hot).drop("n"), key)
    return tagged.where("__hot").drop("__hot").unionByName(cold)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (a, b), a > b. Both directions are looked at; a self-pair never leaves."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if large else edges
    least = side.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    joined = join_by_key(side, least, "a", 2 * total)
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any direction, repeats and loops allowed; rows with a null end are left out.

    Returns (node, component) for nodes with an edge; component is the smallest node."""
    current = materialize(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    signature, total = None, current.count()
    for _ in range(MAX_ROUNDS):
        before = current
        middle = materialize(_star(before, True, total), "edges")
        current = materialize(_star(middle, False, total), "edges")
        release(before, middle)
        # Stars only ever lower the ends of edges: equal sums mean that nothing moved.
        seen = current.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        total = seen[0]
        if tuple(seen) == signature:
            break
        signature = tuple(seen)
    else:
        raise RuntimeError("connected components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
