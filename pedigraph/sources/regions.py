"""Region scans of block-gzip call files: a block index, and a data source that reads only the blocks a filter can meet."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual,
)

from pedigraph.sources.text import SPLIT_BYTES, BlockGzipLines, _BlockGzipReader, _file_size, _open, _Range
from pedigraph.sources.vcf import parse_records


def write_block_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Write ``path.blocks``: for each byte range of the file and contig in it the least and the largest position.

    One pass of tasks over the file; the index has a line per range and contig, in any order of the records.
    """
    spark.dataSource.register(BlockGzipLines)
    lines = spark.read.format("bgzip_lines").option("path", path).option("split_bytes", split_bytes).load()
    cells = F.split("value", "\t", 3)
    places = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("block", F.get(cells, F.lit(0)).alias("chrom"),
                                                                                            F.get(cells, F.lit(1)).cast("bigint").alias("pos"))
    found = places.groupBy("block", "chrom").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).orderBy("block", "chrom")
    target = path + ".blocks"
    store, inner = _open(target)
    with store.open_output_stream(inner) as out:
        out.write((json.dumps({"split_bytes": split_bytes, "size": _file_size(path)}) + "\n").encode())
        for row in found.toLocalIterator():  # a line per byte range and contig
            out.write((json.dumps([row.block, row.chrom, row.low, row.high]) + "\n").encode())
    return target


def read_block_index(path: str) -> tuple[int, list[tuple[int, str, int, int]]]:
    """(bytes a range, entries); an index of another state of the file is refused."""
    store, inner = _open(path + ".blocks")
    with store.open_input_stream(inner) as fh:
        head, *rows = fh.read().decode().splitlines()
    head = json.loads(head)
    if head["size"] != _file_size(path):
        raise ValueError(f"{path}.blocks does not belong to this file; write it again")
    return head["split_bytes"], [tuple(json.loads(r)) for r in rows]


class Wanted:
    """What the filters leave of the contigs (None: all) and positions."""

    def __init__(self) -> None:
        self.contigs: set[str] | None = None
        self.low, self.high = -(1 << 62), 1 << 62

    def take(self, f: Filter) -> bool:
        """Use a filter on chrom or pos; False for any other."""
        name = getattr(f, "attribute", (None,))
        if name == ("chrom",) and isinstance(f, (EqualTo, In)):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.contigs = named if self.contigs is None else self.contigs & named
        elif name == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def meets(self, chrom: str, low: int, high: int) -> bool:
        return (self.contigs is None or chrom in self.contigs) and low <= self.high and high >= self.low


class BlockGzipCalls(DataSource):
    """``vcf_blocks``: call lines with chrom and pos; the options contig, first and last choose the byte ranges by the block index."""

    @classmethod
    def name(cls):
        return "vcf_blocks"

    def schema(self):
        return "chrom string, pos bigint, value string, block bigint, seq bigint"

    def reader(self, schema):
        return _CallReader(self.options)


class FilteredCalls(BlockGzipCalls):
    """``vcf_filtered``: the same, where the session hands filters on chrom and pos to Python sources."""

    @classmethod
    def name(cls):
        return "vcf_filtered"

    def reader(self, schema):
        return _FilteredReader(self.options)


class _CallReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.wanted = options["path"], Wanted()
        self.split, self.index = read_block_index(self.path)
        self.lines = _BlockGzipReader({"path": self.path, "split_bytes": str(self.split)})
        if options.get("contig") is not None:
            self.wanted.take(EqualTo(("chrom",), options["contig"]))
        for name, kind in (("first", GreaterThanOrEqual), ("last", LessThanOrEqual)):
            if options.get(name) is not None:
                self.wanted.take(kind(("pos",), int(options[name])))

    def partitions(self):
        size = _file_size(self.path)
        blocks = sorted({block for block, chrom, low, high in self.index if self.wanted.meets(chrom, low, high)})
        return [_Range(b, min(size, b + self.split)) for b in blocks] or [_Range(size, size)]

    def read(self, partition) -> Iterator[tuple]:
        if partition.start == partition.end:
            return
        for value, block, seq in self.lines.read(partition):
            if value and not value.startswith("#"):
                chrom, pos, _ = value.split("\t", 2)
                yield chrom, int(pos), value, block, seq


class _FilteredReader(_CallReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f  # a byte range holds other places too, so Spark still filters its rows


def read_calls(spark: SparkSession, path: str, contig: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Records of an indexed block-gzip call file, of one contig and of positions first..last if these are given.

    Where the session hands filters to Python sources, ``spark.read.format("vcf_filtered")`` needs no such bounds.
    """
    spark.dataSource.register(BlockGzipCalls)
    spark.dataSource.register(FilteredCalls)
    given = {k: str(v) for k, v in (("contig", contig), ("first", first), ("last", last)) if v is not None}
    lines = spark.read.format("vcf_blocks").options(path=path, **given).load()
    for name, value in given.items():
        lines = lines.where(F.col("chrom") == value if name == "contig" else F.col("pos") >= int(value) if name == "first" else F.col("pos") <= int(value))
    return parse_records(lines.select("value", F.lit(path).alias("file"), "block", "seq"))
