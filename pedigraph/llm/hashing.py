"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Unit vectors are centred, turned to their principal axes and by a learned rotation that
brings them close to a corner of the cube; the signs are the code.  The code is split into
substrings, each with its own index.  Two codes within a Hamming radius r agree within
r / m in at least one of m substrings, so probing every value that near in each index
retrieves every code within the radius.  What is retrieved is ranked by the exact cosine.

Rows are dealt to blocks, each with its indexes; the stated queries go to every block in
chunks, and only each block's best few come back.  The rotation and the radius are learned
from a bounded sample; every row is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pedigraph.llm.common import landed, pick
from pedigraph.llm.vectors import matrix, unit, usable

TOP = 5
SAMPLE = 8192
SAMPLE_QUERIES = 512
CAUGHT = 0.985  # share of the sample's true neighbours within the radius
BLOCK = 4096
CHUNK = 4096
_STEP = 256
_ROUNDS = 40
_POP = np.bitwise_count(np.arange(256, dtype=np.uint8))


@dataclass(frozen=True)
class Codes:
    """Centre and rotation for vectors of one length, and the radius to search."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, units: np.ndarray) -> np.ndarray:
        """Packed codes, one row of bytes per vector; the bytes are the substrings."""
        return np.packbits((units - self.centre) @ self.rotation > 0, axis=1)


def learn(units: np.ndarray, top: int = TOP, caught: float = CAUGHT, seed: int = 11) -> Codes:
    """Codes from a sample of unit vectors: principal axes, then alternating signs and rotation."""
    centre = units.mean(axis=0)
    x = units - centre
    axes = np.linalg.svd(x.T @ x)[0]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=axes.shape))[0]
    for _ in range(_ROUNDS):
        b = np.where(v @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ b)
        r = left @ right
    codes = Codes(centre, axes @ r, 0)
    packed, few = codes.of(units), min(SAMPLE_QUERIES, len(units))
    cosine = units[:few] @ units.T
    cosine[np.arange(few), np.arange(few)] = -2
    near = np.argsort(-cosine, axis=1)[:, :min(top, len(units) - 1)]
    far = np.bitwise_count(packed[:few, None, :] ^ packed[near]).sum(axis=2, dtype=np.int64)
    return Codes(centre, codes.rotation, int(np.quantile(far, caught, method="higher")) if far.size else units.shape[1])


def retrieve(queries: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of every pair of codes within the radius, by probing one index per substring."""
    parts, per = queries.shape[1], radius // queries.shape[1]
    met = np.zeros((len(queries), len(block)), dtype=bool)
    for j in range(parts):
        order = np.argsort(block[:, j], kind="stable")
        starts = np.searchsorted(block[order, j], np.arange(257))
        for value in np.unique(queries[:, j]):
            probes = np.flatnonzero(_POP[np.arange(256, dtype=np.uint8) ^ value] <= per)
            rows = np.concatenate([order[starts[p]:starts[p + 1]] for p in probes]) if len(probes) else order[:0]
            met[np.ix_(np.flatnonzero(queries[:, j] == value), rows)] = True
    q, r = np.nonzero(met)
    near = np.bitwise_count(queries[q] ^ block[r]).sum(axis=1, dtype=np.int64) <= radius
    return q[near], r[near]


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: Codes, radius: int, top: int) -> pd.DataFrame:
    """The best rows of one block for each query: exact cosine, ties to the smaller id."""
    found = []
    block, q_codes = codes.of(unit(x)), codes.of(unit(q))
    norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    for at in range(0, len(q), _STEP):
        i, r = retrieve(q_codes[at:at + _STEP], block, radius)
        i = i + at
        other = query_ids[i] != ids[r]
        i, r = i[other], r[other]
        score = np.concatenate([np.einsum("ij,ij->i", q[i[k:k + 65536]], x[r[k:k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
        score = score / (q_norms[i] * norms[r])
        order = np.lexsort((ids[r], -score, i))
        i, r, score = i[order], r[order], score[order]
        fresh = np.ones(len(i), dtype=bool)  # parallel vectors of one id have one score and take one place
        fresh[1:] = (i[1:] != i[:-1]) | (ids[r[1:]] != ids[r[:-1]]) | (score[1:] != score[:-1])
        i, r, score = i[fresh], r[fresh], score[fresh]
        first = np.searchsorted(i, i, side="left")
        keep = np.arange(len(i)) - first < top
        found.append(pd.DataFrame({"query_id": query_ids[i[keep]], "vec_id": ids[r[keep]], "score": score[keep]}))
    return pd.concat(found, ignore_index=True)


def _search(rows: DataFrame, queries: DataFrame, codes: dict[int, Codes], top: int, every: bool) -> DataFrame:
    """The best ``top`` of every block for each query."""
    count, asked = rows.count(), queries.count()
    blocks, chunks = max(1, -(-count // BLOCK)), max(1, -(-asked // CHUNK))
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select("id", "vector", "dim", F.expr(f"cast(pmod(xxhash64(id, vector, 1), {blocks}) as int)").alias("block"), many(chunks).alias("chunk"), F.lit(False).alias("asks"))
    asks = queries.select("id", "vector", "dim", many(blocks).alias("block"), F.expr(f"cast(pmod(xxhash64(id, vector, 2), {chunks}) as int)").alias("chunk"), F.lit(True).alias("asks"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": part["id"].iloc[:0], "vec_id": part["id"].iloc[:0], "score": np.empty(0)})
        q, x = part[part["asks"]], part[~part["asks"]]
        if not len(q) or not len(x):
            return empty
        own = codes[int(part["dim"].iloc[0])]
        radius = 8 * ((own.rotation.shape[1] + 7) // 8) if every else own.radius
        return best(q["id"].to_numpy(), matrix(q["vector"]), x["id"].to_numpy(), matrix(x["vector"]), own, radius, top)

    return held.union(asks).groupBy("dim", "block", "chunk").applyInPandas(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)


def nearest(rows: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the best found neighbours of the rows that satisfy ``is_query``.

    ``is_query`` is a condition on ``id``.  Vectors that are null, empty, zero or hold null or
    non-finite components, and null ids, take no part; vectors of different lengths are never
    compared; rows with the query's id are its own and repeated
    rows of one id and vector count once.  A query with fewer than ``top`` rows
    within the radius is searched again without a radius, so it gets all candidates if they
    are fewer.  An empty table gives an empty result.
    """
    taken = pick(rows, id_col, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    once = taken.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    held = landed(once.withColumn("dim", F.size("vector")), "indexed")
    sizes = dict(held.groupBy("dim").agg(F.count(F.lit(1))).collect())  # one row per vector length
    draw = F.shiftrightunsigned(F.xxhash64("id", "vector", F.lit("codes")), 11) / F.lit(float(1 << 53))
    rate = F.lit(0.0)
    for dim, n in sorted(sizes.items()):
        rate = F.when(F.col("dim") == dim, F.lit(sample / n)).otherwise(rate)
    drawn = held.where(draw < rate).select("id", "dim", "vector").toPandas().sort_values("id")
    codes = {int(dim): learn(unit(matrix(part["vector"])), top) for dim, part in drawn.groupby("dim")}
    for dim, n in sizes.items():
        if dim not in codes:  # the draw took none of a short list
            codes[dim] = Codes(np.zeros(dim), np.eye(dim), 8 * ((dim + 7) // 8))
    queries = held.where(is_query)
    found = landed(_ranked(_search(held, queries, codes, top, False), top), "nearest")
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    short = queries.join(got, F.col("id") == F.col("query_id"), "left").where(F.coalesce("got", F.lit(0)) < top).select("id", "vector", "dim")
    short = landed(short, "short")
    if short.count():
        again = _ranked(_search(held, short, codes, top, True), top)
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of every embedding whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")
