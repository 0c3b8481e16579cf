"""Hypothesis beliefs, elimination, entropy and expected information gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pedigraph.functions.numeric import fixed, round_even
from pedigraph.functions.stats import logistic
from pedigraph.operators.graph import signed_weight

# Default cost of an experiment type in lab-months.
DEFAULT_COSTS = {
    "loss_of_function": 3.0, "gain_of_function": 3.0, "crispr_screen": 6.0, "perturb_seq": 9.0, "base_edit": 5.0,
    "mouse_in_vivo": 12.0, "human_tissue": 6.0, "spatial": 5.0, "time_course": 7.0, "clinical_arm": 36.0,
}


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(q / (F.lit(1.0) - q))


def chain_log_odds(score: Column) -> Column:
    return F.when(score <= 0, F.lit(-2.0)).otherwise(score * 4.0 - 0.5)


def belief(prior: Column, chain: Column, evidence: Column, debate: Column) -> Column:
    return logistic(logit(prior) + chain_log_odds(chain) + evidence + debate)


def evidence_sums(attached: DataFrame, key: str = "hyp") -> DataFrame:
    """Per hypothesis: log-odds, contradicting lines, best supporting tier, independent support (map-side sums)."""
    supports, against = F.col("polarity") == "supports", F.col("polarity") == "contradicts"
    w = signed_weight(F.col("tier"), F.col("polarity"), F.col("strength"), F.col("is_independent"))
    return attached.groupBy(key).agg(
        F.sum(w).alias("evidence_lo"), F.count_if(against).alias("n_contradicting"),
        F.max(F.when(supports, F.col("tier"))).alias("top_tier"),
        F.count_if(supports & F.col("is_independent") & (F.col("strength") >= 0.5)).alias("n_independent"),
    )


def refresh(hyps: DataFrame, debate: DataFrame | None = None) -> DataFrame:
    """Beliefs of active hypotheses from prior, chain score, evidence and a transient debate shift."""
    x = hyps
    shift = F.lit(0.0)
    if debate is not None:
        x = x.join(debate.select("hyp", F.col("delta").alias("_delta")), "hyp", "left")
        shift = F.coalesce("_delta", F.lit(0.0))
    new = belief(F.col("prior"), F.coalesce("chain_score", F.lit(0.0)), F.coalesce("evidence_lo", F.lit(0.0)), shift)
    x = x.withColumn("belief", F.when(F.col("status") == "active", new).otherwise(F.col("belief")))
    return x.drop("_delta")


def rank_order() -> list[Column]:
    """Strongest first: belief, chain score, programme flags, novelty; insertion order breaks ties."""
    return [F.desc(round_even(F.col("belief"), 4)), F.desc(round_even(F.coalesce("chain_score", F.lit(0.0)), 4)), F.desc("relevance"),
            F.desc("novelty"), F.asc("ins")]


def prune(hyps: DataFrame, floor: float = 0.12, require_chain: bool = True, min_survivors: int = 3,
          max_negative: int = 3) -> DataFrame:
    """Adds ``why`` (elimination reasons, empty when kept) and the new status.

    The protected top group is a top-k of the active rows, so no window over all
    hypotheses is needed.
    """
    top = hyps.where(F.col("status") == "active").orderBy(*rank_order()).limit(min_survivors).select(
        "hyp", F.lit(True).alias("_safe"))
    x = hyps.join(F.broadcast(top), "hyp", "left")
    n, tier = F.coalesce("n_contradicting", F.lit(0)), F.coalesce("top_tier", F.lit(0))
    open_ = (F.col("status") == "active") & F.col("_safe").isNull()
    why = F.concat_ws(
        "; ",
        F.when(F.col("belief") < floor, F.concat(F.lit("belief "), fixed(F.col("belief"), 2), F.lit(f" < floor {floor:.2f}"))),
        F.when(F.lit(require_chain) & (F.coalesce("chain_score", F.lit(0.0)) <= 0),
               F.lit("no traceable causal chain to a clinical endpoint")),
        F.when((n >= max_negative) & (tier < 4),
               F.concat(n.cast("string"), F.lit(" contradicting lines, no perturbation/genetic support"))),
    )
    x = x.withColumn("why", F.when(open_, why).otherwise(F.lit("")))
    return x.withColumn("status", F.when(F.col("why") != "", "eliminated").otherwise(F.col("status"))).drop("_safe")


def underpowered(hyps: DataFrame, chain_floor: float = 0.25) -> DataFrame:
    """Active, plausible (belief 0.12 and up) rows with a weak chain and no independent support."""
    return hyps.where((F.col("status") == "active") & (F.col("belief") >= 0.12)
                      & (F.coalesce("chain_score", F.lit(0.0)) < chain_floor) & (F.coalesce("n_independent", F.lit(0)) == 0))


def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Put the one row of ``totals`` beside every row (a hash join on a constant)."""
    one = F.lit(1).alias("_one")
    return df.select("*", one).join(F.broadcast(totals.select("*", one)), "_one").drop("_one")


def distribution(hyps: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Belief shares of active rows per group; uniform when nothing has belief."""
    groups = groups or []
    live = hyps.where(F.col("status") == "active")
    totals = live.groupBy(*groups).agg(F.sum("belief").alias("_t"), F.count(F.lit(1)).alias("_n"))
    joined = live.join(totals, groups) if groups else beside(live, totals)
    return joined.withColumn("share", F.when(F.col("_t") > 0, F.col("belief") / F.col("_t")).otherwise(
        F.lit(1.0) / F.col("_n"))).drop("_t", "_n")


def entropy_bits(p: Column) -> Column:
    """Aggregate: Shannon entropy of the shares in ``p``."""
    return F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def marked(outcomes: DataFrame) -> DataFrame:
    """Outcomes with ``_first``, true in one row of each tested hypothesis of an experiment."""
    first = F.row_number().over(W.partitionBy("exp", "hyp").orderBy("outcome")) == 1
    return outcomes.select("exp", "outcome", "hyp", "lik", first.alias("_first"))


def information_gain(outcomes: DataFrame, prior: DataFrame, experiments: DataFrame) -> DataFrame:
    """(exp, eig, value) of every experiment.

    outcomes: exp, outcome, hyp, lik with one row per outcome and tested hypothesis;
    prior: hyp, share; experiments: exp, cost, feasibility.
    """
    return marked_gain(marked(outcomes), prior, experiments)


def marked_gain(outcomes: DataFrame, prior: DataFrame, experiments: DataFrame) -> DataFrame:
    """``information_gain`` of marked outcomes: one map-side aggregation per outcome and one over its few rows."""
    joined = outcomes.join(prior.select("hyp", "share"), "hyp")
    s, j = F.when(F.col("_first"), F.col("share")), F.col("j")
    post = joined.withColumn("j", F.coalesce("lik", F.lit(0.0)) * F.col("share")).groupBy("exp", "outcome").agg(
        F.sum("j").alias("pj"), F.sum(F.when(j > 0, j * F.log2(j)).otherwise(0.0)).alias("jl"),
        F.sum(s).alias("_s"), F.sum(F.when(s > 0, s * F.log2(s))).alias("_sl"))
    # H = log2(mass) - sum(s log2 s) / mass for shares renormalised over the tested hypotheses
    # P(o) H(post) = (pj log2 pj - sum j log2 j) / mass
    whole = post.groupBy("exp").agg(
        F.sum(F.when(F.col("pj") > 0, F.col("pj") * F.log2("pj") - F.col("jl")).otherwise(0.0)).alias("_h"),
        F.sum("_s").alias("mass"), F.coalesce(F.sum("_sl"), F.lit(0.0)).alias("_sl"))
    gain = whole.where(F.col("mass") > 0).select(
        "exp", (F.log2("mass") - F.col("_sl") / F.col("mass") - F.col("_h") / F.col("mass")).alias("gain"))
    out = experiments.join(gain, "exp", "left")
    eig = F.greatest(F.coalesce("gain", F.lit(0.0)), F.lit(0.0)) * F.col("feasibility")
    return out.select("exp", "cost", "feasibility", eig.alias("eig"), (eig / F.greatest("cost", F.lit(0.5))).alias("value"))


def experiment_cost(cost: Column, kind: Column) -> Column:
    """Given cost, else the default of the type."""
    table = F.create_map(*[F.lit(v) for pair in DEFAULT_COSTS.items() for v in pair])
    return F.coalesce(F.when(cost != 0, cost), F.try_element_at(table, kind))


def assume_likeliest(outcomes: DataFrame, prior: DataFrame, exp: str) -> DataFrame:
    """Shares after the most probable outcome of one experiment (first outcome on ties)."""
    mine = outcomes.where(F.col("exp") == exp).join(prior.select("hyp", "share"), "hyp")
    scored = mine.withColumn("j", F.coalesce("lik", F.lit(0.0)) * F.col("share"))
    per = scored.groupBy("outcome").agg(F.sum("j").alias("pj"))
    best = per.orderBy(F.desc("pj"), F.asc("outcome")).limit(1)
    won = scored.join(F.broadcast(best), "outcome").withColumn(
        "p", F.col("j") / F.when(F.col("pj") != 0, F.col("pj")).otherwise(1.0))
    mass = mine.select("hyp", "share").distinct().agg(F.sum("share").alias("m"))
    moved = beside(won, mass).select("hyp", (F.col("p") * F.col("m")).alias("_new"))
    x = prior.join(moved, "hyp", "left").withColumn("share", F.coalesce("_new", "share")).drop("_new")
    total = x.agg(F.sum(F.greatest("share", F.lit(0.0))).alias("_t"))
    return beside(x, total).withColumn("share", F.greatest("share", F.lit(0.0)) / F.col("_t")).drop("_t")


def plan_experiments(outcomes: DataFrame, prior: DataFrame, experiments: DataFrame, budget: float = 18.0,
                     max_experiments: int = 4) -> dict:
    """Greedy budgeted choice.  Each round is one distributed scoring job whose best row decides.

    At most ``max_experiments`` experiments are chosen, so there are few rounds; the
    shares are rewritten after each one.  The outcomes are derived once for all rounds,
    and the scores of a round once for all looks at them.
    """
    from pedigraph.session import stored

    def entropy(shares):
        return float(shares.agg(entropy_bits(F.col("share")).alias("h")).first()["h"] or 0.0)

    outcomes = stored(marked(outcomes))
    experiments = stored(experiments)
    belief_now = stored(prior.select("hyp", "share"))
    before = entropy(belief_now)

    def scored():
        return stored(marked_gain(outcomes, belief_now, experiments).join(experiments.select("exp", "ins"), "exp"))

    scores = ranked = scored()
    chosen, spent, still = [], 0.0, F.lit(True)
    while len(chosen) < max_experiments:
        best = scores.where(still).orderBy(F.desc("value"), F.asc("ins")).limit(1).collect()
        if not best or best[0]["eig"] <= 1e-6:
            break
        b = best[0]
        still = still & (F.col("exp") != b["exp"])
        if spent + b["cost"] > budget:
            still = still & (F.col("cost") + spent <= budget)
            continue
        chosen.append(b["exp"])
        spent += b["cost"]
        belief_now = stored(assume_likeliest(outcomes, belief_now, b["exp"]))
        if len(chosen) < max_experiments:
            scores = scored()
    return {"ranked": ranked, "chosen": chosen, "prior_bits": before, "residual_bits": entropy(belief_now),
            "belief": belief_now}
