"""Operator 4: mix sources to target weights by capped water-filling.

Every source has a weight and a cap (``max_epochs`` times its size).  A source
whose proportional share exceeds its cap is clamped there and the excess goes to
the others by weight, until no target is above its cap.  The fixed point of that
loop is ``target = least(cap, weight * level)`` for one water level, found with
two running sums over the sources ordered by ``cap / weight``: one row a source,
whatever the number of documents.

Sampling: with ``rate = target / size`` of its source, every document is taken
``floor(rate)`` times, and the remaining words are filled with one more copy of
documents in a seeded shuffle (order of an md5 of seed and id) until the
remainder is met, to within half a document.  No source is sorted as a whole:
the shuffle is cut into ranges of the hash, as many as leave about ``RANGE_ROWS``
documents in each, sums per range find the range that the boundary falls in, and
only that range is ordered.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; a row with a null id is shuffled by its text; rows that repeat are separate
documents, each with copies of its own; an empty table gives an empty result; other
columns are ignored by ``mix`` and kept by ``mixture`` and ``repeat_rows``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cols, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Source tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000
#: Documents of a range of the shuffle key, more or less; a range is named by so many hex digits of the key, between FINE.
RANGE_ROWS = 50_000
FINE = (3, 6)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the counted rows stay under the limit."""
    return F.broadcast(df) if rows <= limit else df


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``sizes`` has one row a source: source, source_size.  Adds ``target``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("source_size").cast("double") * float(max_epochs)
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", cap)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything) * float(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), ignorenulls=True).over(everything))
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies."""
    return _mixed(docs, [], weights, share, max_epochs, seed)


def _mixed(docs: DataFrame, carried: list[str], weights: Sequence[float], share: float, max_epochs: float, seed: int) -> DataFrame:
    """carried: further columns of docs that go along, with names of their own."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *carried), "mix-sizes")
    fine = min(FINE[1], max(FINE[0], math.ceil(math.log(max(1, sized.count() / RANGE_ROWS), 16))))
    ranges = materialize(sized.groupBy("source", F.substring("key", 1, fine).alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    targets = water_fill(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    # The range of each source in which its remaining words end, and the words before it.
    along = Window.partitionBy("source").orderBy("range")
    running = ranges.withColumn("end", F.sum("words").over(along)).withColumn("start", F.col("end") - F.col("words"))
    edge = (
        running.join(targets.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s")))
        .where(F.col("end") > F.col("need"))
        .groupBy("source")
        .agg(F.min(F.struct("range", "start")).alias("edge"))
    )
    plan = targets.join(edge.select(F.col("source").alias("s"), "edge"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "need", "edge")
    plan = materialize(plan, "mix-plan")
    placed = sized.join(bounded_broadcast(plan, plan.count()), F.col("source").eqNullSafe(F.col("s"))).withColumn("range", F.substring("key", 1, fine))
    in_edge = F.col("edge").isNotNull() & (F.col("range") == F.col("edge.range"))
    sure = placed.where(~in_edge).withColumn("extra", F.when(F.col("edge").isNull() | (F.col("range") < F.col("edge.range")), 1).otherwise(0))
    up_to = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("edge.start") + F.sum("size").over(up_to) - F.col("size") / 2
    close = placed.where(in_edge).withColumn("extra", F.when(middle <= F.col("need"), 1).otherwise(0))
    # Without words left over (need 0) no range is taken: the edge is then the first range with words.
    copies = F.col("whole") + F.col("extra")
    out = sure.unionByName(close).withColumn("copies", F.least(F.when(F.col("need") > 0, copies).otherwise(F.col("whole")), F.lit(int(max_epochs)).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *carried)


def mixture(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The documents in the mixture, all columns, with size, source_size, target, taken and copies (1 or more).

    Columns of docs with one of these names, in any case, are replaced."""
    made = ("size", "source_size", "target", "taken", "copies")
    kept = [c for c in docs.columns if c.lower() not in made]
    own = {f"__{i}": c for i, c in enumerate(kept) if c.lower() not in ("doc_id", "source")}
    named = docs.select("doc_id", "source", "text", *[x.alias(n) for n, x in zip(own, cols(list(own.values())), strict=True)])
    told = _mixed(named, list(own), weights, share, max_epochs, seed).where("copies > 0")
    back = {c: n for n, c in own.items()}
    return told.select(*[F.col(back.get(c, c)).alias(c) for c in kept], *made)


def repeat_rows(docs: DataFrame, **kw) -> DataFrame:
    """The mixture itself: a row of docs for each of its copies, with ``copy`` counted from 1."""
    kept = [c for c in docs.columns if c.lower() not in ("copy", "size", "source_size", "target", "taken", "copies")]
    told = mixture(docs.select(*cols(kept)), **kw).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return told.select(*cols(kept), "copy")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, '')))) AS key
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM per
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), water AS (
  SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level <= cap / weight
), targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM water)), cap) AS target FROM weighed
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size ROWS UNBOUNDED PRECEDING) - s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(whole + CASE WHEN need > 0 AND middle <= need THEN 1 ELSE 0 END, 2) * size AS BIGINT) AS taken
FROM run
"""
