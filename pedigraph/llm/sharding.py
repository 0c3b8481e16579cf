"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

The key orders rows by a hash of the text and then by a hash of the id, so equal texts
stand together and even one text with a third of all rows can be cut.  Boundaries come
from a bounded, size-weighted sample of keys; ranges that turn out overfull are subdivided
from a sample of their own.  Sizes and counts per range are then exact, and each row's
place in the order of bytes decides its shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from pedigraph.llm.common import landed, pick

SHARDS = 40
ROW_BYTES = 16
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 48
_ROUNDS = 4


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, key): UTF-8 bytes plus 16, unsigned CRC-32 and the 63-bit order key."""
    rows = pick(docs, id_col, text_col)
    text = F.col(text_col)
    high = F.shiftrightunsigned(F.xxhash64(text), 24)
    return rows.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.shiftleft(high, 23).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 41)).alias("key"))


def _sample(rows: DataFrame, weight: str, rate: float) -> np.ndarray:
    """Sorted keys, each row drawn with a chance of rate x weight (a hash decides: repeatable)."""
    draw = F.shiftrightunsigned(F.xxhash64("key", "id", F.lit("draw")), 11) / F.lit(float(1 << 53))
    # a row of more than one expected draw counts as often as its weight asks
    times = F.floor(F.lit(rate) * F.col(weight) + draw)
    drawn = rows.select("key", times.cast("int").alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times"))
    got = drawn.toPandas().sort_values("key")
    return np.repeat(got["key"].to_numpy(), np.minimum(got["times"].to_numpy(), SAMPLES_PER_RANGE).astype(int))


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.unique(keys[(np.arange(1, parts) * len(keys)) // parts]) if len(keys) else np.empty(0, np.int64)


def range_column(bounds: np.ndarray):
    """The range number of a key: how many boundaries are at or below it."""

    @F.pandas_udf(IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    return run(F.col("key"))


def splitters(rows: DataFrame, count: int, total: int, shards: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Boundaries of near equal bytes and the exact size and count of each range.

    The sample is bounded by the number of ranges, not by the corpus.  A range of over
    twice its share is cut again from a denser sample of its own keys.
    """
    ranges = max(shards * RANGES_PER_SHARD, -(-count // ROWS_PER_RANGE))
    bounds = _quantiles(_sample(rows, "bytes", SAMPLES_PER_RANGE * ranges / max(1, total)), ranges)
    for left in range(_ROUNDS, -1, -1):
        found = rows.select(range_column(bounds).alias("part"), "bytes", "copies").groupBy("part").agg(
            F.sum("bytes").alias("bytes"), F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("kinds")).toPandas().sort_values("part", ignore_index=True)
        full = found[(found["bytes"] > 2 * total / ranges) & (found["kinds"] > 1)]
        if not len(full) or not left:
            return bounds, found
        part = range_column(bounds)
        inside = rows.select("key", "id", "bytes", part.alias("part")).where(F.col("part").isin([int(p) for p in full["part"]]))
        extra = _sample(inside, "bytes", 4 * SAMPLES_PER_RANGE * ranges / max(1, total))
        piece = np.searchsorted(bounds, extra, side="right")
        more = [_quantiles(extra[piece == p], max(2, int(2 * b * ranges / total))) for p, b in zip(full["part"], full["bytes"])]
        grown = np.unique(np.concatenate([bounds, *more]))
        if len(grown) == len(bounds):
            return bounds, found
        bounds = grown


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot) for every row; the law is near equal bytes.

    Every shard's bytes are within one row's size of the mean.  Equal texts stand together
    in the order, so they share a shard unless the shard's border falls among them.  Slots
    count from 0 without a gap in each shard.  Null texts have size 16 (and a null CRC),
    null ids sort first among equal keys, repeated rows take places of their own, and an
    empty table gives an empty result.
    """
    alike = keyed(docs, id_col, text_col).groupBy("id", "size", "crc", "key").agg(F.count(F.lit(1)).alias("copies"))
    rows = landed(alike.withColumn("bytes", F.col("size") * F.col("copies")), "keys")  # repeats are one row until they are placed
    count, total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bounds, found = splitters(rows, count, total, shards)
    before = dict(zip(found["part"].tolist(), zip((found["bytes"].cumsum() - found["bytes"]).tolist(), (found["rows"].cumsum() - found["rows"]).tolist())))
    schema = "part int, bytes_before long, rows_before long"
    offsets = rows.sparkSession.createDataFrame([(int(p), int(b), int(r)) for p, (b, r) in before.items()], schema)
    inside = Window.partitionBy("part").orderBy("key", "id", "size", "crc")
    placed = (rows.withColumn("part", range_column(bounds))
              .withColumn("upto", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .withColumn("nth", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .join(F.broadcast(offsets), "part")  # one row per range: bounded by the number of ranges
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
              .select("id", "size", "crc", (F.col("bytes_before") + F.col("upto") - F.col("bytes") + F.col("copy") * F.col("size")).alias("start"),
                      (F.col("rows_before") + F.col("nth") - F.col("copies") + F.col("copy")).alias("place")))
    middle = F.expr("2 * start + size")  # twice the middle byte of the row
    placed = landed(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2.0 * max(1, total)))).cast("int")), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # at most one row per shard
        "id", "size", "crc", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
