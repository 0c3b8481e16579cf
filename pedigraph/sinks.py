"""Text outputs: tasks write the parts of a file, plain or block-gzip, and put them together by a manifest."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pedigraph.functions.numeric import py_bool

BLOCK = 0xFF00  # bytes of text in a block-gzip member


def text_row(df: DataFrame, columns: list[str], sep: str = "\t"):
    """One line per row: booleans as True/False, NULL as the empty string."""
    kinds = dict(df.dtypes)
    cells = []
    for c in columns:
        col = F.col(f"`{c}`")
        text = py_bool(col) if kinds[c] == "boolean" else col.cast("string")
        cells.append(F.coalesce(F.when(col.isNotNull(), text), F.lit("")))
    return F.concat_ws(sep, *cells)


def gzip_block(data: bytes) -> bytes:
    """One block-gzip member of at most ``BLOCK`` bytes; without bytes it is the mark that ends a file."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Out:
    """Text to a stream, as it is or as block-gzip members; counts the bytes that go out."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed, self.held, self.size = stream, packed, bytearray(), 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def write(self, data: bytes) -> None:
        if not self.packed:
            self._put(data)
            return
        self.held += data
        while len(self.held) >= BLOCK:
            self._put(gzip_block(bytes(self.held[:BLOCK])))
            del self.held[:BLOCK]

    def end(self) -> None:
        if self.held:
            self._put(gzip_block(bytes(self.held)))
            self.held.clear()


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write_part(uri: str, packed: bool):
    """Every task writes its rows as a file of its own, named after the attempt, and tells its number, name and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(uri)
        number, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        with store.open_output_stream(f"{folder}/{name}") as stream:
            out = _Out(stream, packed)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    out.write("".join(f"{line}\n" for line in batch.column(0).slice(at, 4096).to_pylist()).encode("utf-8", "surrogatepass"))
            out.end()
        yield pa.RecordBatch.from_pylist([{"number": number, "name": name, "size": out.size}],
                                         pa.schema([("number", pa.int32()), ("name", pa.string()), ("size", pa.int64())]))

    return run


def _copy_parts(uri: str, parts: str):
    """Put each listed part into the one file at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(parts)
        target = _store(uri)[1]
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{folder}/{row['name']}") as src, open(target, "r+b") as out:
                    out.seek(row["offset"])
                    while chunk := src.read(4 << 20):
                        out.write(chunk)
            yield batch.select(["name"])

    return run


def _join_parts(uri: str, parts: str):
    """Stream all listed parts to one object, for stores that cannot write in the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, target), (_, folder) = _store(uri), _store(parts)
        names = [row for batch in batches for row in batch.to_pylist()]
        with store.open_output_stream(target) as out:
            for row in sorted(names, key=lambda r: r["offset"]):
                with store.open_input_stream(f"{folder}/{row['name']}") as src:
                    while chunk := src.read(4 << 20):
                        out.write(chunk)
        yield pa.RecordBatch.from_pylist([{"name": target}])

    return run


def write_lines(lines: DataFrame, path: str, header: list[str]) -> list[dict]:
    """Write the column ``value`` in the frame's order as one file with a header; block-gzip when the name ends in .gz or .bgz.

    Tasks write parts.  What the successful attempts tell (part number, name, size) is the manifest,
    so what a lost or repeated attempt left is not used; it gives every part its offset, at which
    tasks put the parts into the file.  The driver writes the header and the end only.  Returns
    the manifest.
    """
    # a path without a scheme is a file of this machine, for tasks as for the reader below
    uri = path if "://" in path else Path(path).absolute().as_uri()
    packed = path.endswith((".gz", ".bgz"))
    spark, (store, target), parts = lines.sparkSession, _store(uri), f"{uri}.parts"
    folder = _store(parts)[1]
    store.create_dir(folder)
    made = lines.select("value").mapInArrow(_write_part(parts, packed), "number int, name string, size bigint").collect()  # a row per task
    listed = [{"number": -1, "name": "head"}, *sorted((r.asDict() for r in made), key=lambda r: r["number"]), {"number": len(made), "name": "tail"}]
    for entry, text in ((listed[0], "".join(f"{line}\n" for line in header)), (listed[-1], "")):
        with store.open_output_stream(f"{folder}/{entry['name']}") as stream:
            out = _Out(stream, packed)
            out.write(text.encode())
            out.end()
            if packed and entry is listed[-1]:
                out._put(gzip_block(b""))
        entry["size"] = out.size
    offset = 0
    for entry in listed:
        entry["offset"], offset = offset, offset + entry["size"]
    plan = spark.createDataFrame([(e["name"], e["offset"]) for e in listed], "name string, offset bigint")
    if isinstance(store, pafs.LocalFileSystem):
        with open(target, "wb") as fh:
            fh.truncate(offset)
        plan.repartition(len(listed)).mapInArrow(_copy_parts(uri, parts), "name string").write.format("noop").mode("overwrite").save()
    else:
        plan.coalesce(1).mapInArrow(_join_parts(uri, parts), "name string").write.format("noop").mode("overwrite").save()
    store.delete_dir(folder)
    return listed


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    write_lines(df.select(text_row(df, columns).alias("value")), path, ["\t".join(columns)])


def write_json(value, path: str) -> None:
    with open(path, "w") as fh:
        json.dump(value, fh, indent=2, default=str)
