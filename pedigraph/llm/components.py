"""Connected components of an edge table, as alternating star steps over Spark joins.

Every step sends each node's neighbours to a smaller neighbour; the edge set shrinks to
stars whose centre is the smallest node of the component.  A node's neighbours are never
gathered into one row: the minimum is a partial aggregate and the join back is one Spark
can split at a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pedigraph.llm.common import landed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that is not its component's smallest node.

    Self links, repeated and mirrored links are allowed; links with a null end are left
    out.  A node without a row is its own root; an empty edge table gives an empty result.
    The number of rounds is logarithmic in practice, and each round is written out.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u.alias("u"), v.alias("v"))
    now = landed(pairs.where("u <> v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = landed(_small_star(_large_star(now)), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
