"""Global row numbers without sending every row through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W



def global_rank(df: DataFrame, name: str, score: Column, block: str, within: str) -> DataFrame:
    """Add ``name`` = 1..n in the order (``score``, ``block``, ``within``), all ascending.

    Rows are numbered inside a (score, block) group, where a block is a piece of the
    input of bounded size, and shifted by the rows that come before: those with a
    smaller score, and those of earlier blocks with the same score.  Both shifts come
    from counts, so the only global order is over the distinct scores.
    """
    keyed = df.withColumn("_k", score)
    cells = keyed.groupBy("_k", F.col(block).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    per_score = cells.groupBy("_k").agg(F.sum("_n").alias("_m"))
    below = per_score.select("_k", F.coalesce(F.sum("_m").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1)),
                                              F.lit(0)).alias("_below"))
    inside = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = cells.join(below, "_k").select(
        "_k", "_b", (F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_shift"))
    rank = F.row_number().over(W.partitionBy("_k", "_b").orderBy(within))
    numbered = keyed.withColumn("_b", F.col(block)).join(shift, ["_k", "_b"])
    return numbered.withColumn(name, rank + F.col("_shift")).drop("_k", "_b", "_shift")
