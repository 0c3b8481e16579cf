"""SimHash fingerprints and their exact comparison within a Hamming radius.

Fingerprints are made row by row in Arrow batches.  Only distinct fingerprints are
compared.  The comparison is tiled: a fingerprint is dealt to one tile set for each
choice of bit blocks on which a pair within the radius must agree (radius r over m
blocks: some m - r of them are equal), and inside a set tiles are cut by population
count; a pair of tiles is compared by exclusive-or and bit counts only when their
population counts differ by no more than the radius.  No pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from pedigraph.llm.common import landed, pick, text_slices
from pedigraph.llm.components import components

RADIUS = 4
SHINGLE = 4
TILE = 2048
_CHUNK = 65536


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed number.

    A-Z are lowered, words are runs of bytes other than ASCII white space, shingles keep
    repeats and are joined by one space; fewer words make one shingle, no word gives 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1:]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        hashed = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())],
                          dtype="<u8")
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(packed.view("<i8")[0])


@F.arrow_udf(LongType())
def fingerprint_column(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for part in text_slices(texts) for t in part], pa.int64())


def blocks_for(distinct: int, radius: int, tile: int = TILE) -> int:
    """The fewest bit blocks whose tile sets hold at most ``tile`` of the fingerprints on average."""
    for m in range(radius + 1, 64):
        if distinct / 2.0 ** (64 * (m - radius) // m) <= tile or comb(m + 1, m + 1 - radius) > 500:
            return m
    return 64


def _cells(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp -> one row per choice of agreeing blocks: (choice, bits, pc, fp)."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return prints.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.explode(F.array(*keys)).alias("k")).select(
        "k.choice", "k.bits", "pc", "fp")


def _tiles(cells: DataFrame, radius: int, tile: int) -> DataFrame:
    """Deal the members of each set to tile pairs; a set of at most ``tile`` members is one tile.

    Larger sets are cut by population count and then by hash; a member goes to the pairs of
    its own tile with every tile whose population count is within the radius.
    """
    counts = cells.groupBy("choice", "bits", "pc").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("choice", "bits").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("n") / tile).cast("int").alias("subs")))).alias("subs"),
    ).where(F.col("total") > tile).select("choice", "bits", "subs")
    own = F.struct(F.col("pc").alias("pc"), F.col("sub").alias("sub"))
    pairs = F.expr(f"""flatten(transform(filter(map_keys(subs), p -> abs(p - pc) <= {radius}), p ->
        transform(sequence(0, subs[p] - 1), s -> struct(p as pc, s as sub))))""")
    hot = (cells.join(large, ["choice", "bits"])
           .withColumn("sub", F.expr("cast(pmod(xxhash64(fp), subs[pc]) as int)"))
           .select("choice", "bits", "pc", "fp", own.alias("own"), F.explode(pairs).alias("other"))
           .select("choice", "bits", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                   (F.col("own") <= F.col("other")).alias("is_left"), "fp"))
    none = F.struct(F.lit(-1).alias("pc"), F.lit(-1).alias("sub"))
    cold = cells.join(large.select("choice", "bits"), ["choice", "bits"], "left_anti").select(
        "choice", "bits", none.alias("left"), none.alias("right"), F.lit(True).alias("is_left"), "fp")
    return hot.union(cold).select("choice", "bits", "left.pc", "left.sub", F.col("right.pc").alias("pc2"),
                                  F.col("right.sub").alias("sub2"), "is_left", "fp")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per index 0..n-1 over links (a[i], b[i])."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
    return root


def _links(fps: np.ndarray, is_left: np.ndarray, triangle: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, centre) of the fingerprints linked within one tile or pair of tiles."""
    fps = fps.view(np.uint64)
    pc = np.bitwise_count(fps)
    order = np.argsort(pc, kind="stable")
    fps, pc, is_left = fps[order], pc[order].astype(np.int16), is_left[order]
    left = np.arange(len(fps)) if triangle else np.flatnonzero(is_left)
    right = left if triangle else np.flatnonzero(~is_left)
    found_a, found_b = [], []
    step = 512
    for i in range(0, len(left), step):
        rows = left[i:i + step]
        if not len(right):
            break
        # population counts are sorted: only this range of the other side can be within the radius
        lo = np.searchsorted(pc[right], pc[rows[0]] - radius, side="left")
        hi = np.searchsorted(pc[right], pc[rows[-1]] + radius, side="right")
        if triangle:
            lo = max(lo, i)
        cols = right[lo:hi]
        x, y = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[cols][None, :]) <= radius)
        keep = rows[x] != cols[y]
        found_a.append(rows[x][keep])
        found_b.append(cols[y][keep])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    root = forest(len(fps), a, b)
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[member].view(np.int64), fps[root[member]].view(np.int64)


def compare_tiles(radius: int):
    """A mapInPandas body over rows sorted by tile pair; a pair may cross batches."""
    keys = ["choice", "bits", "pc", "sub", "pc2", "sub2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def done(part: pd.DataFrame) -> pd.DataFrame:
            k = part[keys].to_numpy()
            fp, side = part["fp"].to_numpy(), part["is_left"].to_numpy()
            cut = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]))
            sizes = np.diff(cut)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in np.flatnonzero(sizes > 1):
                s, e = cut[i], cut[i + 1]
                row = k[s]
                if sizes[i] == 2:  # the usual set: one comparison
                    if (int(fp[s] ^ fp[s + 1]) & (1 << 64) - 1).bit_count() <= radius:
                        a.append(fp[s:s + 1])
                        b.append(fp[s + 1:s + 2])
                    continue
                x, y = _links(fp[s:e], side[s:e], row[2] == row[4] and row[3] == row[5], radius)
                a.append(x)
                b.append(y)
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(part):
                continue
            k = part[keys].to_numpy()
            same = (k == k[-1]).all(axis=1)
            first = len(k) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = part.iloc[first:]
            if first:
                yield done(part.iloc[:first])
        if rest is not None and len(rest):
            yield done(rest)

    return run


def linked(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Star links (a, b) between distinct fingerprints (column fp); they span every linked group."""
    m = blocks or blocks_for(prints.count(), radius, tile)
    keys = ["choice", "bits", "pc", "sub", "pc2", "sub2"]
    dealt = _tiles(_cells(prints, radius, m), radius, tile).repartition(*[F.col(k) for k in keys])
    return dealt.sortWithinPartitions(*keys).mapInPandas(compare_tiles(radius), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): the fingerprint of every row and the smallest id its links reach.

    Null and blank texts have fingerprint 0 and link like any other.  Repeated rows give
    repeated results.  A row with a null id gets its group's smallest non-null id (null if
    there is none) and never names a group.  An empty table gives an empty result.
    """
    rows = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp"))
    prints = landed(rows, "fingerprints")
    return grouped(prints, radius).select("id", "fp", "component")


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(id, fp) rows with their component, the smallest id in the linked group."""
    distinct = landed(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(linked(distinct.select("fp"), radius), "a", "b")
    by_root = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = by_root.groupBy("root").agg(F.min("least").alias("component"))
    named = by_root.join(least, "root").select("fp", "component")
    return prints.join(named, "fp")


def op8_simhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))
