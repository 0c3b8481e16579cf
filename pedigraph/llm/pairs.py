"""Near-duplicate vectors: PCA-ordered tiles with suffix-norm bounds.

Exact copies are counted first and compared once.  Unit vectors are turned to their
principal axes; two vectors within the threshold cannot differ by more than
sqrt(2 - 2 t) on the first axis, so vectors are laid in cells of that width and only tiles
of the same or the next cell are compared.  In a pair of tiles the products of the leading
axes come first; the rest is bounded by the product of the suffix norms, and only pairs
that can still reach the threshold get their cosine in double precision from the original
vectors.  A pair of tiles reports link counts and star links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from pedigraph.llm.common import landed, pick
from pedigraph.llm.components import components
from pedigraph.llm.simhash import forest
from pedigraph.llm.vectors import matrix, principal_axes, unit, usable

THRESHOLD = 0.98
LEADING = 16
TILE = 512
_SLACK = 1e-9


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, leading: int = LEADING) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of rows of a and b whose cosine reaches the threshold."""
    ua, ub = unit(a), unit(b)
    ya, yb = ua @ axes, ub @ axes
    live_i, live_j, sums, done = None, None, None, 0
    for upto in (*range(min(leading, ya.shape[1]), ya.shape[1], leading), ya.shape[1]):
        rest_a, rest_b = (np.sqrt((y[:, upto:] ** 2).sum(axis=1)) for y in (ya, yb))
        if live_i is None:
            sums = ya[:, :upto] @ yb[:, :upto].T
            live_i, live_j = np.nonzero(sums + rest_a[:, None] * rest_b[None, :] >= threshold - _SLACK)
            sums = sums[live_i, live_j]
        else:
            sums = sums + np.einsum("ij,ij->i", ya[live_i, done:upto], yb[live_j, done:upto])
            on = sums + rest_a[live_i] * rest_b[live_j] >= threshold - _SLACK
            live_i, live_j, sums = live_i[on], live_j[on], sums[on]
        done = upto
        if not len(live_i):
            break
    hit = np.einsum("ij,ij->i", ua[live_i], ub[live_j]) >= threshold
    return live_i[hit], live_j[hit]


def _tile_pair(axes: dict[int, np.ndarray], threshold: float, leading: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        left = np.flatnonzero(part["is_left"].to_numpy())
        same = bool(part["one_tile"].iloc[0])
        right = left if same else np.flatnonzero(~part["is_left"].to_numpy())
        x, ids, n = matrix(part["vector"]), part["rep"].to_numpy(), part["n"].to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": ids[:0], "links": n[:0], "root": ids[:0]})
        i, j = linked_pairs(x[left], x[right], axes[x.shape[1]], threshold, leading)
        i, j = left[i], right[j]
        off = i != j
        i, j = i[off], j[off]
        links = np.bincount(i, weights=n[j], minlength=len(ids))
        if not same:
            links += np.bincount(j, weights=n[i], minlength=len(ids))
        order = np.argsort(ids, kind="stable")  # the smallest id is the centre of its star
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][forest(len(ids), place[i], place[j])[place]]
        met = links > 0
        return pd.DataFrame({"rep": ids[met], "links": links[met].astype(np.int64), "root": root[met]})

    return run


def _first_axis(axes: dict[int, np.ndarray]):
    @F.pandas_udf(DoubleType())
    def run(vectors: pd.Series) -> pd.Series:
        sizes = vectors.map(len).to_numpy()
        out = np.zeros(len(vectors))
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            out[at] = unit(matrix(vectors.iloc[at])) @ axes[int(dim)][:, 0]
        return pd.Series(out)

    return run


def _tile_pairs(groups: DataFrame, width: float, tile: int) -> DataFrame:
    """Send every vector to the pairs of its own tile with the tiles of its cell and the next ones."""
    laid = landed(groups.withColumn("cell", F.floor(F.col("y") / width).cast("int")), "cells")
    counts = laid.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("subs"))
    near = counts.select("label", "dim", F.explode(F.expr("array(struct(cell - 1 as cell, cell as other), struct(cell, cell as other), struct(cell + 1 as cell, cell as other))")).alias("k"), "subs")
    around = near.groupBy("label", "dim", F.col("k.cell").alias("cell")).agg(  # at most three entries
        F.map_from_entries(F.collect_list(F.struct("k.other", "subs"))).alias("around"))
    own = F.struct("cell", "sub")
    others = F.expr("flatten(transform(map_keys(around), c -> transform(sequence(0, around[c] - 1), s -> struct(c as cell, s as sub))))")
    return (laid.join(around, ["label", "dim", "cell"]).withColumn("sub", F.expr("cast(pmod(xxhash64(rep), around[cell]) as int)"))
            .select("label", "dim", "rep", "n", "vector", own.alias("own"), F.explode(others).alias("other"))
            .select("label", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                    (F.col("own") <= F.col("other")).alias("is_left"), (F.col("own") == F.col("other")).alias("one_tile"), "rep", "n", "vector"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
                 leading: int = LEADING, tile: int = TILE) -> DataFrame:
    """(id, n_links, component): links to other vectors of the same label, and the smallest id reachable.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null label or id, link with nothing: no links, and their own id as component.  Vectors of
    different lengths never link.  Repeated rows are vectors of their own; a repeated id with
    different vectors counts as one vector in links and components.
    """
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    taken = pick(rows, id_col, vector_col, label_col).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.when(usable(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.col(vector_col)).alias("vector"))
    keys = landed(taken.select("id", "label", "vector", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")).alias("k1"),
                               F.hash("vector", "label").alias("k2")), "vectors")
    groups = keys.where("vector is not null").groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    groups = landed(groups.withColumn("dim", F.size("vector")), "groups")
    axes = principal_axes(groups)
    ordered = groups.select("label", "dim", "rep", "n", "vector", _first_axis(axes)(F.col("vector")).alias("y"))
    dealt = _tile_pairs(ordered, width, tile)
    found = dealt.groupBy("label", "dim", "low", "high").applyInPandas(_tile_pair(axes, threshold, leading), "rep {0}, links long, root {0}".format(groups.schema["rep"].dataType.simpleString()))
    found = landed(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, "rep", "root")
    named = groups.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    return keys.select("id", "k1", "k2").join(named, ["k1", "k2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").cast("long").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
