"""Hard negatives by threshold joins with suffix-norm bounds (L2AP style).

Each anchor asks for the best rows of its own label (its positives), then, for each of them,
for the best rows of other labels within a window below its score.  A window's threshold
starts where a bounded sample expects enough rows and is lowered, for the windows that are
not full, to what the sample proves: as many sampled rows as are asked for reach it, so a
second round is always enough.

Rows stand in blocks, anchors in chunks; a task joins one block with one chunk.  Dimensions
are put in order of their weight.  A row is indexed only up to the dimension from which its
suffix norm times the anchors' can no longer reach a threshold; partial scores are
accumulated over slabs of the index, pairs whose partial score and remaining norms stay
below the threshold are dropped, and those left get their exact integer score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pedigraph.llm.common import landed, pick

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # hundredths of the positive's score
SCALE = 256
SAMPLE = 4096
BLOCK = 4096
CHUNK = 4096
SLAB = 16
_STEP = 128
_DENSE = 0.125  # above this share of live pairs a slab is added for all of them
_PAIRS = 65536
_MOST = 1 << 27  # components up to this keep every score a long
_END = 1 << 62


def whole(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.empty((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    x, y = a.astype(float), b.astype(float)
    most = np.sqrt((x * x).sum(axis=1).max()) * np.sqrt((y * y).sum(axis=1).max())
    return (x @ y.T).astype(np.int64) if most < 2.0**52 else a @ b.T


def above(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of every pair whose inner product is at least ``least`` of the anchor."""
    width = rows.shape[1]
    if not width or not len(rows) or not len(anchors):
        i, j = np.nonzero(np.repeat((least <= 0)[:, None], len(rows), axis=1))
        return i, j, np.zeros(len(i), np.int64)
    order = np.argsort(-(rows.astype(float) ** 2).sum(axis=0), kind="stable")
    a, x = anchors[:, order].astype(float), rows[:, order].astype(float)
    rest = lambda m: np.sqrt(np.concatenate([np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(m), 1))], axis=1))
    rest_a, rest_x = rest(a) * (1 + 1e-9), rest(x) * (1 + 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(least[:, None] <= 0, -np.inf, least[:, None] / rest_a).min(axis=0, initial=np.inf)
    covered = rest_x < need  # from here on a row's dimensions cannot reach any threshold alone
    length = np.where(covered.any(axis=1), covered.argmax(axis=1), width)
    by_length = np.argsort(-length, kind="stable")
    by_length = by_length[:np.count_nonzero(length)]
    x, rest_x, length = x[by_length], rest_x[by_length], length[by_length]
    reach = np.minimum(-(-length // slab) * slab, width)  # a slab that was begun is added whole
    each, i, j = np.arange(len(x)), None, None
    sums = np.zeros((len(a), len(x)))
    live = np.ones(sums.shape, bool)
    for at in range(0, width, slab):
        upto = min(at + slab, width)
        posted = np.searchsorted(-length, -at)  # rows indexed beyond the slab's start
        if i is None:
            sums[:, :posted] += a[:, at:upto] @ x[:posted, at:upto].T
            done = np.minimum(upto, reach)
            live = sums + rest_a[:, done] * rest_x[each, done][None, :] + 1e-6 >= least[:, None]
            if upto < width and live.size and live.mean() > _DENSE:
                continue
            i, j = np.nonzero(live)
            sums = sums[i, j]
        else:
            more = j < posted
            sums[more] += np.einsum("ij,ij->i", a[i[more], at:upto], x[j[more], at:upto])
            done = np.minimum(upto, reach[j])
            on = sums + rest_a[i, done] * rest_x[j, done] + 1e-6 >= least[i]
            i, j, sums = i[on], j[on], sums[on]
    j = by_length[j]
    score = np.concatenate([np.einsum("ij,ij->i", anchors[i[k:k + _PAIRS]], rows[j[k:k + _PAIRS]]) for k in range(0, len(i), _PAIRS)] or [np.empty(0, np.int64)])
    hit = score >= least[i]
    return i[hit], j[hit], score[hit]


def _lists(column: pd.Series, fill: int) -> np.ndarray:
    """Lists of numbers as rows of one length."""
    most = max(map(len, column), default=0)
    return np.array([[*x, *[fill] * (most - len(x))] for x in column], dtype=np.int64).reshape(len(column), most)


def _joined(top: int, same: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The best ``top`` rows of one block for every window of one chunk's anchors."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        asks, held = part[part["tags"].notna()], part[part["tags"].isna()]
        found = [pd.DataFrame({"anchor": np.empty(0, np.int64), "tag": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        if len(asks) and len(held):
            ids, labels, x = held["id"].to_numpy(), held["label"].to_numpy(), whole(held["q"])
            for at in range(0, len(asks), _STEP):
                own = asks.iloc[at:at + _STEP]
                tags, starts, highs = _lists(own["tags"], 0), _lists(own["starts"], _END + 1), _lists(own["highs"], -_END)
                names, kinds = own["id"].to_numpy(), own["label"].to_numpy()
                i, j, score = above(whole(own["q"]), x, starts.min(axis=1))
                fits = (names[i] != ids[j]) & ((kinds[i] == labels[j]) == same)
                i, j, score = i[fits], j[fits], score[fits]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                for w in range(tags.shape[1]):
                    on = (score >= starts[i, w]) & (score <= highs[i, w])
                    a, b, s = i[on], j[on], score[on]
                    first = np.arange(len(a)) - np.searchsorted(a, a, side="left") < top
                    found.append(pd.DataFrame({"anchor": names[a[first]], "tag": tags[a[first], w], "id": ids[b[first]], "score": s[first]}))
        return pd.concat(found, ignore_index=True)

    return run


def _sampled(sample: pd.DataFrame, share: float, top: int, same: bool) -> Callable:
    """Where each window's threshold starts, and the bound that the sample proves."""
    kept = {int(dim): (part["id"].to_numpy(), part["label"].to_numpy(), whole(part["q"])) for dim, part in sample.groupby("dim")}
    some = min(top, int(np.ceil(2 * top * share)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, asks in batch.groupby("dim"):
                ids, labels, x = kept.get(int(dim), (np.empty(0), np.empty(0), np.empty((0, int(dim)), np.int64)))
                for at in range(0, len(asks), _STEP):
                    own = asks.iloc[at:at + _STEP]
                    scores, out = products(whole(own["q"]), x), []
                    for row, line in zip(own.itertuples(), scores):
                        met = np.sort(line[(ids != row.id) & ((labels == row.label) == same)])[::-1]
                        for tag, low, high in zip(row.tags, row.lows, row.highs):
                            inside = met[(met >= low) & (met <= high)]
                            at_rank = lambda n: int(inside[n - 1]) if len(inside) >= n else int(low)  # noqa: B023, E731
                            out.append((row.id, tag, high, at_rank(max(1, some)), at_rank(top)))
                    yield pd.DataFrame(out, columns=["anchor", "tag", "high", "start", "safe"])

    return run


def _joins(items: DataFrame, anchors: DataFrame, windows: DataFrame, threshold: str, top: int, same: bool, block: int, chunk: int) -> DataFrame:
    """(anchor, tag, id, score): what the blocks hold for each window, best ``top`` a window and rank."""
    keys = ["dim", "label"] if same else ["dim"]
    asked = windows.groupBy(F.col("anchor").alias("id")).agg(  # a handful of windows an anchor
        F.collect_list(F.struct("tag", F.col(threshold).alias("start"), "high")).alias("w"))
    asks = anchors.join(asked, "id").select("id", "label", "dim", "q", F.col("w.tag").alias("tags"), F.col("w.start").alias("starts"), F.col("w.high").alias("highs"))
    sizes = items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    counts = asks.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    both = sizes.join(counts, keys)
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, seed: F.expr(f"cast(pmod(xxhash64(id, {seed}), {n}) as int)")
    held = items.join(both, keys).select("id", "label", "dim", "q", deal("blocks", 1).alias("block"), many("chunks").alias("chunk"),
                                         *[F.lit(None).cast("array<bigint>").alias(n) for n in ("tags", "starts", "highs")])
    sent = asks.join(both, keys).select("id", "label", "dim", "q", many("blocks").alias("block"), deal("chunks", 2).alias("chunk"), "tags", "starts", "highs")
    found = held.union(sent).groupBy(*keys, "block", "chunk").applyInPandas(_joined(top, same), "anchor long, tag long, id long, score long")
    line = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)


def _filled(items: DataFrame, anchors: DataFrame, windows: DataFrame, top: int, same: bool, block: int, chunk: int, name: str) -> DataFrame:
    """The best rows of every window: thresholds are lowered once, to the proven bound, where a window is not full."""
    found = landed(_joins(items, anchors, windows, "start", top, same, block, chunk), name)
    got = found.groupBy("anchor", "tag").agg(F.count(F.lit(1)).alias("got"))
    short = landed(windows.join(got, ["anchor", "tag"], "left").where((F.coalesce("got", F.lit(0)) < top) & (F.col("safe") < F.col("start"))).drop("got"), f"{name}-short")
    if not short.limit(1).count():
        return found
    again = _joins(items, anchors, short, "safe", top, same, block, chunk)
    return landed(found.join(short.select("anchor", "tag"), ["anchor", "tag"], "left_anti").unionByName(again), f"{name}-full")


def mined(rows: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
          negatives: int = NEGATIVES, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) of the rows that satisfy ``is_anchor``.

    ``is_anchor`` is a condition on ``id``.  Scores are inner products of floor(256 x).  Rows with
    a null id or label, a null vector, null or non-finite components, or components beyond 2^27
    after scaling take no part; zero vectors do.  Vectors of different lengths are never
    compared.  Repeated rows count once; rows with the anchor's id are its own, and an id that
    stands with several vectors or labels is the anchor by the least of them.  An empty table
    gives an empty result.  ``sample`` bounds only the rows that set thresholds.
    """
    taken = pick(rows, id_col, vector_col, label_col).toDF("id", "vector", "label")
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(_MOST // SCALE)))
    scaled = F.when(fits, F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE)))
    items = taken.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), scaled.alias("q"))
    items = landed(items.where("id is not null and label is not null and q is not null").distinct().withColumn("dim", F.size("q")), "items")
    anchors = landed(items.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "q")).alias("own")).select(
        "id", "own.label", "own.q", F.size("own.q").alias("dim")), "anchors")
    count = items.count()
    share = min(1.0, sample / max(1, count))
    draw = F.shiftrightunsigned(F.xxhash64("id", "q", F.lit("windows")), 11) / F.lit(float(1 << 53))
    drawn = items.where(draw < share).select("id", "label", "q", "dim").toPandas()
    one = lambda n: F.array(F.lit(n).cast("long"))
    kind = "anchor long, tag long, high long, start long, safe long"
    asks = anchors.withColumns({"tags": one(0), "lows": one(-_END), "highs": one(_END)})
    windows = landed(asks.mapInPandas(_sampled(drawn, share, positives, True), kind), "windows")
    near = _filled(items, anchors, windows, positives, True, block, chunk, "positives")
    near = near.select("anchor", F.col("rank").cast("long").alias("tag"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    exact = near.select("anchor", "tag",  # div cuts towards zero
                        F.expr(f"positive_score * {LOW} div 100 + int(positive_score * {LOW} % 100 > 0)").cast("long").alias("low"),
                        F.expr(f"positive_score * {HIGH} div 100 - int(positive_score * {HIGH} % 100 < 0)").cast("long").alias("high"))
    grouped = exact.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("tag", "low", "high")).alias("w"))  # few positives an anchor
    asks = anchors.join(grouped, "id").select("id", "label", "q", "dim", F.col("w.tag").alias("tags"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    windows = landed(asks.mapInPandas(_sampled(drawn, share, negatives, False), kind), "windows")
    hard = _filled(items, anchors, windows, negatives, False, block, chunk, "negatives")
    return hard.join(near, ["anchor", "tag"]).select("anchor", "positive", "rank", F.col("id").alias("negative"), "positive_score",
                                                     F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for every anchor (ids divisible by 100) and each of its five positives."""
    rows = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(moved, "id % 100 = 0").select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                               F.col("negative").alias("negative_id"), "positive_score", "negative_score")


ORACLE = f"""
with kept as (select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)::double) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x) >= {_MOST // SCALE})) = 0),
anchors as (select id, label, q from kept where id % 100 = 0 qualify row_number() over (partition by id order by label::varchar, q) = 1),
scored as (select a.id as anchor, a.label as own, k.id, k.label, list_inner_product(a.q, k.q)::bigint as score
  from anchors a join kept k on a.id <> k.id and len(a.q) = len(k.q)),
near as (select anchor, id, score, row_number() over (partition by anchor order by score desc, id) as place from scored where own = label qualify place <= {POSITIVES})
select n.anchor as anchor_id, n.id as positive_id, row_number() over (partition by n.anchor, n.place order by s.score desc, s.id)::int as rank,
  s.id as negative_id, n.score as positive_score, s.score as negative_score
from near n join scored s on n.anchor = s.anchor and s.own <> s.label and {LOW} * n.score <= 100 * s.score and 100 * s.score <= {HIGH} * n.score
qualify rank <= {NEGATIVES}"""
