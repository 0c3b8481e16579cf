"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its five-word shingles.  Candidates share all minima of a band of
permutations; a pair at the similarity 0.8 misses every band with a probability of
(1 - 0.8 ** 5) ** 48, under one in a hundred million, and nearer pairs more rarely.  A sketch
keeps two bits of every minimum; pairs whose sketches differ in more places than similar sets
do (six standard deviations) are dropped, and every pair left is verified on the whole sets
before it links.  Each bucket is first compared with its smallest member and in a few turns in
small parts.  The buckets that these links left in different groups are then compared in
tiles, inside a task: sketch against sketch, then set against set.  A tile gives only links that
join two groups, so texts that share much without being similar make no rows.

Texts whose SimHash fingerprints lie within the radius of ``simhash`` link too, by its comparison:
long texts with small edits all over keep their fingerprint when their sets fall below 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from pedigraph.llm.common import enter, landed, text_slices, trimmed
from pedigraph.llm.components import components
from pedigraph.llm.simhash import fingerprint, linked

WORDS = 5
PARTS = 5  # similar: the intersection is at least (PARTS - 1) / PARTS of the union, 0.8
BANDS = 48
ROWS = 5
FEW = 4  # members a part of a bucket, in the turns before all its pairs
TURNS = 1
TILE = 1024  # members of a bucket compared at once
TILE_BYTES = 8 << 20  # of whole sets, unless one set is larger
_TILE_KEYS = ["bucket", "low", "high"]
_STEP = 1024
_CHUNK = 65536
_PLACES = BANDS * ROWS
#: Places in which the sketches of sets at a similarity of 0.8 differ, at most: 0.15 of them and six standard deviations.
APART = int(0.15 * _PLACES + 6 * (0.15 * 0.85 * _PLACES) ** 0.5)
_TURNS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words_per_shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; words as in simhash.fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    hashed = [np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())], dtype="<u8")
              for at in range(0, len(starts), _CHUNK)]
    return np.unique(np.concatenate(hashed))


def set_key(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(own.tobytes())


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of every permutation over a set that is not empty."""
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), _STEP):
        np.minimum(least, (own[None, at:at + _STEP] * _TURNS[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One signed number per band."""
    cut = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(cut[i].tobytes(), i) for i in range(BANDS)], dtype=np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    """Two bits of every minimum, mixed first, in whole words of eight bytes."""
    bits = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
    padded = np.zeros(-(-_PLACES // 32) * 32, np.uint8)
    padded[:_PLACES] = bits
    return np.packbits(np.unpackbits(padded[:, None], axis=1, bitorder="little")[:, :2].ravel(), bitorder="little").tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places sketches (rows of words) differ."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return PARTS * shared >= (PARTS - 1) * (len(a) + len(b) - shared)


@F.arrow_udf(BinaryType())
def key_column(texts: pa.Array) -> pa.Array:
    return pa.array([set_key(shingle_set(t)) for part in text_slices(texts) for t in part], pa.binary())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("shingles")
    names = ["id", "key", "size", "bands", "sketch", "fp"]
    for batch in batches:
        lo = 0
        for part in text_slices(batch.column("text")):
            keys, sizes, cells, marks, cut, fps = [], [], [], [], [0], []
            for text in part:
                own = shingle_set(text)
                keys.append(set_key(own))
                sizes.append(len(own))
                least = minima(own) if len(own) else None
                if least is not None:
                    cells.append(bands(least))
                marks.append(None if least is None else sketch(least))
                cut.append(cut[-1] + BANDS * (least is not None))
                fps.append(fingerprint(text))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(cells) if cells else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(part)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists,
                                              pa.array(marks, pa.binary()), pa.array(fps, pa.int64())], names=names)
            lo += len(part)
    trimmed()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("shingles")
    for batch in batches:
        for part in text_slices(batch.column("text")):
            sets = [shingle_set(t) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["key", "own"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("x"), batch.column("y")
        keep = [similar(np.frombuffer(x[i].as_buffer(), "<u8"), np.frombuffer(y[i].as_buffer(), "<u8")) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar."""
    x, y = sets.select(F.col("key").alias("a"), F.col("own").alias("x")), sets.select(F.col("key").alias("b"), F.col("own").alias("y"))
    return landed(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_checked, "a binary, b binary"), "similar")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = apart(_words(batch.column("x")), _words(batch.column("y"))) <= APART
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketched(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sketches are near enough."""
    x, y = (marks.select(F.col("key").alias(k), F.col("sketch").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return landed(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_likely, "a binary, b binary"), "likely")


def _fetched(rows: DataFrame, keys: DataFrame, distinct: DataFrame) -> DataFrame:
    """The whole sets of some keys, from the texts of their smallest ids."""
    wanted = landed(distinct.join(keys, "key", "left_semi").select("least"), "wanted")
    texts = rows.join(wanted.where("least is not null").distinct(), F.col("id") == F.col("least"), "left_semi").select("text")
    if wanted.where("least is null").limit(1).count():
        texts = texts.union(rows.where("id is null").select("text"))
    return texts.mapInArrow(_whole, "key binary, own binary").join(keys, "key", "left_semi").groupBy("key").agg(F.first("own").alias("own"))


def _near_sizes(a: str, b: str):
    """Sets of other sizes cannot be similar."""
    return F.least(a, b) * PARTS >= F.greatest(a, b) * (PARTS - 1)


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets with more than one root."""
    placed = members.join(roots, F.col("key") == F.col("node"), "left").select("bucket", "n", "key", "size", F.coalesce("root", "key").alias("root"))
    placed = landed(placed, "placed")
    mixed = placed.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("bucket")
    return landed(placed.join(mixed, "bucket"), "unsettled")


def _printed(prints: DataFrame) -> DataFrame:
    """Links (a, b) of keys whose fingerprints are in one group, each with the smallest key of the group."""
    held = landed(prints.select("key", "fp").distinct(), "fingerprints")
    roots = components(linked(landed(held.select("fp").distinct(), "distinct")), "a", "b")
    placed = held.join(roots, F.col("fp") == F.col("node"), "left").select("key", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    return landed(placed.join(least, "root").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")), "printed")


def _met(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links within pairs of tiles: sketches first, then whole sets, where the roots still differ.

    A pair of sets that shares several buckets is looked at in that of its first common band.
    """
    own = np.stack([part[n].to_numpy() for n in _TILE_KEYS])
    cut = np.concatenate(([0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1, [part.num_rows]))
    words, size, left = _words(part["sketch"]), part["size"].to_numpy(), part["is_left"].to_numpy()
    band = part["bands"].combine_chunks().flatten().to_numpy().reshape(len(size), BANDS)
    whole = [np.frombuffer(x, "<u8") for x in part["own"].to_pylist()]
    _, root = np.unique(np.array(part["root"].to_pylist(), dtype=object), return_inverse=True)
    joined = np.arange(len(root))  # over the roots of this part

    def find(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    links: list[tuple[int, int]] = []
    for s, e in zip(cut[:-1], cut[1:]):
        one = own[1, s] == own[2, s]
        first = np.arange(s, e) if one else s + np.flatnonzero(left[s:e])
        second = first if one else s + np.flatnonzero(~left[s:e])
        for k in range(0, len(first), 32):  # a few rows against all
            rows = first[k:k + 32]
            other = root[rows][:, None] != root[second][None, :]
            if one:
                other &= rows[:, None] < second[None, :]
            small, large = np.minimum(size[rows][:, None], size[second][None, :]), np.maximum(size[rows][:, None], size[second][None, :])
            x, y = np.nonzero(other & (small * PARTS >= large * (PARTS - 1)))
            x, y = rows[x], second[y]
            near = apart(words[x], words[y]) <= APART
            x, y = x[near], y[near]
            shared = band[x] == band[y]
            here = band[x, shared.argmax(axis=1)] == own[0, s]
            for i, j in zip(x[here].tolist(), y[here].tolist()):
                p, q = find(root[i]), find(root[j])
                if p != q and similar(whole[i], whole[j]):
                    joined[max(p, q)] = min(p, q)
                    links.append((i, j))
    if links:
        i, j = (pa.array(v) for v in zip(*links))
        yield from pa.Table.from_arrays([part["key"].take(i), part["key"].take(j)], names=["a", "b"]).combine_chunks().to_batches()


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and pair of tiles to links; a pair of tiles may go on in the next batch."""
    enter("shingles")
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in _TILE_KEYS])
        change = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0))
        if held and any(held[-1].column(n)[-1].as_py() != batch.column(n)[0].as_py() for n in _TILE_KEYS):
            yield from _met(pa.Table.from_batches(held))
            held = []
        if len(change):
            edge = int(change[-1]) + 1
            yield from _met(pa.Table.from_batches([*held, batch.slice(0, edge)]))
            held, batch = [], batch.slice(edge)
        held.append(batch)
    if held:
        yield from _met(pa.Table.from_batches(held))
    trimmed()


def _tiled(left: DataFrame, marks: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """Links between the roots that the buckets of ``left`` hold; a large or heavy bucket is cut into tiles by hash."""
    weight = left.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum(F.col("size").cast("long")) * 8 / TILE_BYTES)).cast("int").alias("subs"))
    dealt = left.join(weight, "bucket").join(marks, "key").join(sets, "key").withColumn("tile", F.expr("cast(pmod(xxhash64(key), subs) as int)")).select(
        "bucket", "key", "size", "root", "sketch", "bands", "own", "tile", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("other"))
    laid = dealt.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") <= F.col("other")).alias("is_left"),
                        "key", "size", "root", "sketch", "bands", "own")
    return landed(laid.repartition(*_TILE_KEYS).sortWithinPartitions(*_TILE_KEYS).mapInArrow(_tile_links, "a binary, b binary"), "tiled")


def grouped(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, text) rows as (id, key, root): equal keys are equal sets, equal roots linked groups."""
    kind = rows.schema["id"].dataType.simpleString()
    prints = landed(rows.select("id", "text").mapInArrow(_signed, f"id {kind}, key binary, size int, bands array<bigint>, sketch binary, fp bigint"), "signatures")
    distinct = landed(prints.groupBy("key").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"),
                                                F.first("sketch").alias("sketch")), "sets")
    marks = distinct.where("sketch is not null").select("key", "sketch", "bands")
    cells = distinct.select("key", "size", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.min(F.struct("key", "size")).alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = landed(cells.join(shared, "bucket"), "members")

    sets = landed(_fetched(rows, members.select("key").distinct(), distinct), "shingles")  # the texts are read once for it

    first = members.where((F.col("key") != F.col("centre.key")) & _near_sizes("size", "centre.size"))
    pairs = first.select(F.col("key").alias("a"), F.col("centre.key").alias("b")).distinct()
    links = _printed(prints).union(_verified(_sketched(pairs, marks), sets))
    for turn in range(TURNS):  # few pairs a member, which join most of a large group
        left = _unsettled(members, components(links, "a", "b"))
        left = left.withColumn("part", F.expr(f"pmod(xxhash64(key, {turn}), ceil(n / {FEW}))")).where(F.col("n") > FEW)
        other = left.select("bucket", "part", *[F.col(c).alias(f"{c}_2") for c in ("key", "size", "root")])
        rest = left.join(other, ["bucket", "part"]).where((F.col("root") < F.col("root_2")) & _near_sizes("size", "size_2"))
        pairs = rest.select(F.col("key").alias("a"), F.col("key_2").alias("b")).distinct()
        links = links.union(_verified(_sketched(pairs, marks), sets))
    left = _unsettled(members, components(links, "a", "b"))
    links = links.union(_tiled(left, marks, sets, tile))
    roots = components(links, "a", "b")
    return prints.select("id", "key").join(roots, F.col("key") == F.col("node"), "left").select("id", "key", F.coalesce("root", "key").alias("root"))
