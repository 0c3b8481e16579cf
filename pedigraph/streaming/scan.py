"""Incremental candidate scan: the batch operators on a stream of call-file lines.

The scan looks at one record at a time and keeps no state, so it needs no
watermark; every arriving record yields its candidates once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.operators.candidates import find_candidates, trio_column
from pedigraph.sources.tables import Trio
from pedigraph.sources.vcf import VcfHeader, parse_records


def stream_candidates(spark: SparkSession, folder: str, header: VcfHeader, trios: list[Trio], cfg: dict,
                      mean_depth: dict[str, float] | None = None) -> DataFrame:
    """Candidates of text call files as they appear in ``folder`` (one header for all of them)."""
    lines = spark.readStream.text(folder).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.lit(0).cast("bigint").alias("seq"))
    return find_candidates(parse_records(lines), trio_column(trios, header.samples, mean_depth), cfg)
