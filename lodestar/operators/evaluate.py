"""Ranking metrics over a table: query_id, rank of the relevant item (null if it is not in the list)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevant_rank(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """ranked: query_id, id, rank. truth: query_id, id. The rank of each query's relevant item."""
    return truth.join(ranked, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))


def rank_among(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """The same from unranked pairs (query_id, id, score): one more than the pairs that come before the relevant one. Nothing is sorted."""
    wanted = truth.join(scored, ["query_id", "id"], "left").groupBy("query_id").agg(F.max_by(F.struct(F.col("score").alias("s"), F.col("id").alias("i")), F.struct("score", -F.col("id"))).alias("w"))
    ahead = (F.col("score") > F.col("w.s")) | (F.col("score") == F.col("w.s")) & (F.col("id") < F.col("w.i"))
    counted = wanted.join(scored, "query_id", "left").groupBy("query_id").agg(F.count_if(ahead).alias("n"), F.first("w.s").alias("s"))
    return counted.select("query_id", F.when(F.col("s").isNotNull(), F.col("n") + 1).alias("rank"))


def metrics(ranks: DataFrame, k: int) -> DataFrame:
    """top_k accuracy, mean reciprocal rank and NDCG at k with one relevant item; 0 for no queries."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return ranks.agg(
        mean(hit.cast("double")).alias("top_k_accuracy"),
        mean(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        mean(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("ndcg"),
    )
