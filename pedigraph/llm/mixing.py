"""Temperature mixing of sources to target weights, in DataFrame functions only.

A source's share of all tokens is raised to an exponent and normalised.  The exponent is
bisected to meet an entropy or a repetition limit; each step needs two sums over the table
of sources.  The weights become token budgets, and a budget is realised as block
permutations: a source's documents are dealt to blocks by a hash, every epoch orders the
blocks and the documents inside them anew, and a copy is taken while the tokens before it
in its source stay below the budget.  No source is ever ordered in one task: a source of
n documents has about sqrt(n) blocks of sqrt(n) documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pedigraph.llm.common import at, landed, pick

REPETITION = 2.0
_POINTS, _PASSES = 16, 8
_DIGITS = 9


@dataclass(frozen=True)
class Target:
    """What to meet: a repetition limit, or an entropy as a share of the largest possible one.

    ``budget`` is in tokens; None takes as many as keep every document at least once.
    """

    repetition: float | None = REPETITION
    entropy: float | None = None
    budget: int | None = None

    def __post_init__(self):
        if (self.repetition is None) == (self.entropy is None):
            raise ValueError("give a repetition limit or an entropy")


def tokens(text: Column) -> Column:
    """Words between white space; every document counts at least one."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^\s]+")), F.lit(0))).cast("long")


def sources(rows: DataFrame) -> DataFrame:
    """(source, docs, total, p) from rows of (source, tokens)."""
    made = landed(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("total")), "sources")
    whole = made.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return made.withColumn("p", F.col("total") / F.lit(float(max(1, whole))))


def exponent(shares: DataFrame, target: Target) -> float:
    """The exponent from 0 to 1 that meets the target, by repeated sections of the interval.

    For a repetition limit the smallest exponent whose most repeated source stays within it,
    for an entropy the largest exponent whose entropy reaches it; the nearer end of the
    interval if none does.
    """
    count, low, high, whole = shares.agg(F.count(F.lit(1)), F.min("p"), F.max("p"), F.sum("total")).first()
    if not count or low == high:
        return 1.0
    a, b = 0.0, 1.0
    for _ in range(_PASSES):
        points = [a + (b - a) * k / _POINTS for k in range(1, _POINTS)]
        sums = shares.agg(*[F.sum(F.pow("p", F.lit(x))).alias(f"z{k}") for k, x in enumerate(points)],
                          *[F.sum(F.pow("p", F.lit(x)) * F.log("p")).alias(f"l{k}") for k, x in enumerate(points)]).first()
        met = []
        for k, x in enumerate(points):
            z, l = sums[f"z{k}"], sums[f"l{k}"]
            if target.entropy is not None:
                met.append(log(z) - x * l / z < target.entropy * log(count))
            elif target.budget is None:
                met.append((low / high) ** (x - 1) <= target.repetition)
            else:
                met.append(low ** (x - 1) / z * target.budget / whole <= target.repetition)
        first = met.index(True) if True in met else len(points)
        a, b = (points[first - 1] if first else a), (points[first] if first < len(points) else b)
    return round(b if target.entropy is None else a, 6)


def budgets(shares: DataFrame, target: Target, alpha: float) -> DataFrame:
    """(source, docs, total, weight, budget, blocks) with weights that sum to 1 and budgets in tokens."""
    z, high, whole = shares.agg(F.sum(F.pow("p", F.lit(alpha))), F.max("p"), F.sum("total")).first()
    raised = F.pow("p", F.lit(alpha))
    weight = F.round(raised / F.lit(z or 1.0), _DIGITS)
    if target.budget is None:
        # the largest source once; the others by the ratio of the weights, never below once
        budget = F.greatest(F.col("total"), F.floor(F.round(F.lit(high or 1.0) * raised / F.lit((high or 1.0) ** alpha), _DIGITS) * F.lit(float(whole or 0))))
    else:
        budget = F.floor(weight * F.lit(float(target.budget)))
    return shares.select("source", "docs", "total", weight.alias("weight"), budget.cast("long").alias("budget"),
                         F.ceil(F.sqrt("docs")).cast("long").alias("blocks"))


def _order(*parts: Column) -> Column:
    """A hash that any engine can compute: the MD5 digest of the parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def schedule(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per copy of a document: id, source, tokens, weight, epoch, block, start, position.

    ``start`` counts the source's tokens before the copy, ``position`` (0 to below 1) is that
    over the source's budget: sorting all copies by it deals the sources out evenly.  A copy
    is in the mix while its start is below the budget.  A null source is a source of its
    own, null texts count one token, null ids order as empty ones, repeated rows are
    documents of their own, and an empty table gives an empty result.
    """
    rows = landed(pick(docs, id_col, source_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("tokens")), "mixed")
    shares = sources(rows)
    plan = landed(budgets(shares, target, exponent(shares, target)), "budgets").withColumnRenamed("source", "of")
    block = F.expr("pmod(conv(substring(name_hash, 1, 8), 16, 10), blocks)").cast("long")
    dealt = (rows.join(plan, rows.source.eqNullSafe(plan.of))
             .withColumn("name_hash", _order(F.col("name"))).withColumn("block", block)
             .select("id", "name", "source", "tokens", "weight", "budget", "total", "block"))
    per_block = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("held"), F.first("budget").alias("budget"), F.first("total").alias("total"))
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("budget") / F.col("total")))).alias("epoch")
    line = Window.partitionBy("source", "epoch").orderBy(_order(F.coalesce("source", F.lit("")), F.col("block"), F.col("epoch")), "block")
    turn = (per_block.select("*", epochs).withColumn("upto", F.sum("held").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .select(F.col("source").alias("of"), F.col("block").alias("in_block"), F.col("epoch").alias("in_epoch"),
                    (F.col("epoch") * F.col("total") + F.col("upto") - F.col("held")).alias("begin")).where(F.col("begin") < F.col("budget")))
    inside = Window.partitionBy("source", "epoch", "block").orderBy(_order(F.col("name"), F.col("epoch")), "name", "tokens")
    copies = dealt.select("*", epochs)
    placed = copies.join(turn, copies.source.eqNullSafe(turn.of) & (copies.epoch == turn.in_epoch) & (copies.block == turn.in_block)).withColumn(
        "start", F.col("begin") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    return placed.where("start < budget").select("id", "source", "tokens", "weight", "epoch", "block", "start",
                                                 (F.col("start") / F.col("budget")).alias("position"))


def mixed(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: each document as often as its source's budget says, all columns kept.

    Rows with the same id share one count (the larger, where it does not divide).
    """
    times = schedule(docs, target, id_col, text_col, source_col).groupBy("id", F.col("epoch")).agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(
        F.sum("n").alias("copies"), F.max("n").alias("rows"))
    times = times.select(F.col("id").alias("mixed_id"), F.ceil(F.col("copies") / F.col("rows")).cast("int").alias("mixed_copies"))
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return (numbered.join(times, F.col(f"_{at(docs, id_col)}").eqNullSafe(F.col("mixed_id")))
            .withColumn("mixed_copy", F.explode(F.sequence(F.lit(1), F.col("mixed_copies"))))
            .drop("mixed_id", "mixed_copies", "mixed_copy").toDF(*names))


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents under a repetition limit of two."""
    planned = schedule(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return planned.withColumnRenamed("id", "doc_id").withColumn("position", F.round("position", 9))


ORACLE = f"""
with recursive rows as (select doc_id, coalesce(doc_id::varchar, '') as name, source,
  greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')))::bigint as tokens from documents),
shares as (select source, count(*) as docs, sum(tokens)::bigint as total, sum(tokens) / (select sum(tokens)::double from rows) as p from rows group by source),
ends as (select min(p) as low, max(p) as high, sum(total)::double as whole from shares),
bisect(i, a, b) as (select 0, 0::double, 1::double union all
  select i + 1, case when ok then a else m end, case when ok then m else b end
  from (select i, a, b, (a + b) / 2 as m, pow(low / high, (a + b) / 2 - 1) <= {REPETITION} as ok from bisect, ends where i < 32)),
alpha as (select case when (select low = high from ends) then 1 else round(b, 6) end as x from bisect where i = 32),
plan as (select source, docs, total, round(pow(p, x) / (select sum(pow(p, x)) from shares, alpha), {_DIGITS}) as weight,
  greatest(total, floor(round(high * pow(p, x) / pow(high, x), {_DIGITS}) * whole)::bigint) as budget, ceil(sqrt(docs))::bigint as blocks
  from shares, alpha, ends),
dealt as (select doc_id, name, r.source, tokens, weight, budget, total, ('0x' || md5(name)[1:8])::bigint % blocks as block
  from rows r join plan p on r.source is not distinct from p.source),
held as (select source, block, sum(tokens)::bigint as held, any_value(budget) as budget, any_value(total) as total from dealt group by source, block),
turn as (select source, block, epoch, (epoch * total + sum(held) over w - held)::bigint as begins
  from (select *, unnest(range(budget // total + 1)) as epoch from held)
  window w as (partition by source, epoch order by md5(concat_ws('|', coalesce(source, ''), block, epoch)), block rows unbounded preceding)),
copies as (select *, unnest(range(budget // total + 1)) as epoch from dealt),
placed as (select c.*, (begins + sum(tokens) over (partition by c.source, c.epoch, c.block order by md5(concat_ws('|', name, c.epoch)), name, tokens
  rows unbounded preceding) - tokens)::bigint as start
  from copies c join turn t on c.source is not distinct from t.source and c.epoch = t.epoch and c.block = t.block where begins < budget)
select doc_id, source, tokens, weight, epoch, block, start, round(start / budget, 9) as position from placed where start < budget"""
