"""Ranks over report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_per(df: DataFrame, key: str, newest_first: list[Column]) -> DataFrame:
    """Newest row per key. The ``= 1`` filter limits each map task to one row per key."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*newest_first)))
    return ranked.filter("_rank = 1").drop("_rank")


def rank_desc_then_asc(df: DataFrame, name: str, lead: str, then: str) -> DataFrame:
    """RANK() OVER (ORDER BY lead DESC, then ASC) without one task seeing every row.

    ``lead`` is a rounded percentage, so it has at most 10 001 values: the number of
    rows ahead of each value is a small table, and ties are ranked within it.
    """
    sizes = df.groupBy(F.col(lead).alias("_lead")).agg(F.count("*").alias("_size"))
    ahead = W.orderBy(F.desc_nulls_last("_lead")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_lead", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    within = F.rank().over(W.partitionBy(lead).orderBy(F.asc(then)))
    return (df.withColumn("_within", within)
            .join(offsets, F.col(lead).eqNullSafe(F.col("_lead")))
            .withColumn(name, F.col("_ahead") + F.col("_within"))
            .drop("_within", "_lead", "_ahead"))
