"""Connected components of an edge table, as Spark jobs.

Edges are rewritten in turns until nothing changes (large-star and small-star): every
vertex points its larger, then its smaller neighbours to the least neighbour it knows. A
vertex of very many neighbours is one group of a minimum, which is combined before the
shuffle, and one key of a join, which Spark splits when it is skewed. Every round is
written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import written

MOST_ROUNDS = 100


def _to_least(pairs: DataFrame, own: bool) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    if own:
        least = least.withColumn("least", F.least("u", "least"))
    return pairs.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_least(both, own=True).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _to_least(down, own=False)
    onto = small.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return onto.unionByName(small.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str, label: str = "components") -> DataFrame:
    """``vertex`` and ``component`` (its least vertex) for every vertex that has an edge to another one."""
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    pairs, before = written(pairs, label), None
    for _ in range(MOST_ROUNDS):
        rows, mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if rows == 0 or (rows, mark) == before:
            break
        before = (rows, mark)
        pairs = written(_round(pairs), label)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    own = pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(own)
