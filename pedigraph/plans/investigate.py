"""`investigate`: agent payloads folded into an evidence graph, elimination rounds and an experiment plan.

Payloads are JSON files named after the agent.  Each agent is a projection of its
payload onto one of a few event logs (nodes, edges with evidence, evidence attached
to hypotheses, notes); state is the fold of those logs, never an object that agents
change in place.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pedigraph.functions import coerce as co
from pedigraph.operators import beliefs as bel, graph as gr
from pedigraph.operators.validation import validated_in_order
from pedigraph.session import durable

# Agents with their layer, in roster order.
AGENTS = [
    ("literature", 1), ("evidence_ranking", 1), ("public_database", 1), ("clinical_guideline", 1), ("cell_state", 2),
    ("trajectory", 2), ("regulatory_network", 2), ("ligand_receptor", 2), ("genetic_causality", 2), ("evolutionary", 2),
    ("tissue_ecology", 2), ("metabolism", 2), ("mechanism_generator", 3), ("counterfactual", 3), ("alternative", 3),
    ("reviewer", 3), ("novelty", 3), ("public_validation", 4), ("experimental_design", 4), ("statistics", 4),
    ("drug_discovery", 5), ("biomarker", 5), ("precision_medicine", 5), ("trial_design", 5), ("debate", 6),
    ("consensus", 6), ("skeptic", 6), ("meta_reviewer", 6), ("causal_graph", 0), ("negative_evidence", 0),
    ("experiment_planner", 0),
]
ORDER = {name: i for i, (name, _) in enumerate(AGENTS)}

S = "string"
SHAPES = {
    "literature": ("key_references", "pmid string, claim string, tier string"),
    "public_database": ("datasets", "accession string, used_for string"),
    "cell_state": ("states", "name string"),
    "trajectory": ("transitions", "`from` string, `to` string, evidence_tier string"),
    "regulatory_network": ("regulators", "tf string, targets array<string>, edge_support string, role string"),
    "ligand_receptor": ("interactions", "sender string, receiver string, tier string"),
    "genetic_causality": ("causal_genes", "gene string, variant string, coloc string, finemapped string, "
                                          "perturbation_confirmed string, direction string"),
    "tissue_ecology": ("niches", "name string, supports_state string"),
    "mechanism_generator": ("hypotheses", "id string, statement string, mechanism string, novelty double, touches_switch string, "
                            "touches_ecology string, touches_fork string, chain array<struct<node:string,type:string,sign:string>>"),
    "alternative": ("alternatives", "statement string, mechanism string, chain_source string, chain_target string"),
    "counterfactual": ("counterfactuals", "hypothesis_id string, already_supported_by_data string"),
    "reviewer": ("reviews", "hypothesis_id string, fatal_flaw string, fixable string, severity double"),
    "novelty": ("novelty", "hypothesis_id string, level string, score double, closest_prior string"),
    "public_validation": ("validations", "hypothesis_id string, dataset string, result string, independent string, strength double"),
    "statistics": ("flags", "hypothesis_id string, issue string, severity double, recommendation string"),
    "experimental_design": ("experiments", "id string, title string, type string, hypotheses_tested array<string>, cost_months double, "
                            "feasibility double, outcomes array<struct<label:string,likelihoods:map<string,double>>>"),
    "negative_evidence": ("negatives", "hypothesis_id string, kind string, tier string, strength double"),
    "debate": ("exchanges", "hypothesis_id string, log_odds_delta double"),
}


def payload(spark: SparkSession, folder: str, agent: str) -> DataFrame:
    """One row per listed item of an agent's payload with its place ``i`` (empty without a file)."""
    key, fields = SHAPES[agent]
    item = f"struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _split(fields))}>"
    path = f"{folder}/{agent}.json"
    schema = f"`{key}` array<{item}>"
    if "://" not in path and not os.path.exists(path):
        raw = spark.createDataFrame([], schema)
    else:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.posexplode(key).alias("i", "p")).select("i", "p.*")


def _split(fields: str) -> list[str]:
    """Top-level commas of a field list."""
    out, depth = [""], 0
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def artifact(folder: str, agent: str) -> dict:
    path = f"{folder}/{agent}.json"
    if not os.path.exists(path):
        return {}
    with open(path) as fh:
        return json.load(fh)


def _seq(agent: str, place: Column, step: Column | int = 0) -> Column:
    """The order of additions: agent, place in its payload, step inside the item."""
    step = step if isinstance(step, Column) else F.lit(step)
    return F.struct(F.lit(ORDER[agent]).alias("agent"), place.cast("bigint").alias("place"), step.cast("bigint").alias("step"))


def _end(side: int) -> Column:
    """The two ends of an edge are added one after the other."""
    return F.struct("seq.agent", "seq.place", "seq.step", F.lit(side).alias("side"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# --------------------------------------------------------------------------- #
# Event logs
# --------------------------------------------------------------------------- #
def named_steps(chain: Column) -> Column:
    """The nodes of a declared chain; steps without one are left out (types and signs still go by the step's place)."""
    return F.filter(F.transform(chain, lambda s: s["node"]), lambda n: F.coalesce(n, F.lit("")) != "")


def edge_log(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with one supporting evidence each: src, dst, types, sign, seq, tier, strength."""
    def rows(df, agent, src, dst, st, dt, sign, tier, strength, step=0):
        def col(v):
            return v if isinstance(v, Column) else F.lit(v)
        return df.select(src.alias("src"), dst.alias("dst"), col(st).alias("src_type"), col(dt).alias("dst_type"),
                         col(sign).alias("sign"), _seq(agent, F.col("i"), step).alias("seq"), col(tier).cast("int").alias("tier"),
                         F.lit("supports").alias("polarity"), col(strength).cast("double").alias("strength"),
                         F.lit(True).alias("is_independent"))

    t = payload(spark, folder, "trajectory")
    r = payload(spark, folder, "regulatory_network").select("i", "tf", "edge_support", "role", F.posexplode("targets").alias("j", "target"))
    tested = F.coalesce(F.col("edge_support") == "perturbation", F.lit(False))
    lr = payload(spark, folder, "ligand_receptor")
    g = payload(spark, folder, "genetic_causality")
    causal = co.truth(F.col("coloc")) & co.truth(F.col("finemapped"))
    rank = F.greatest(F.when(causal, 5).otherwise(2), F.when(co.truth(F.col("perturbation_confirmed")), 4).otherwise(0))
    n = payload(spark, folder, "tissue_ecology").where(F.coalesce("supports_state", F.lit("")) != "")
    m = payload(spark, folder, "mechanism_generator").withColumn("names", named_steps(F.col("chain"))).where(F.size("names") >= 2).select(
        "i", "chain", "names", F.explode(F.sequence(F.lit(0), F.size("names") - 2)).alias("j"))
    here, there = F.get("chain", F.col("j")), F.get("chain", F.col("j") + 1)
    return _union([
        rows(t, "trajectory", F.col("from"), F.col("to"), "cell_state", "cell_state", "activates", co.tier(F.col("evidence_tier")), 0.55),
        rows(r, "regulatory_network", F.col("tf"), F.col("target"), "gene", "mechanism",
             F.when(F.col("role") == "activator", "activates").otherwise("inhibits"), F.when(tested, 4).otherwise(2),
             F.when(tested, 0.7).otherwise(0.5), F.col("j")),
        rows(lr, "ligand_receptor", F.col("sender"), F.col("receiver"), "cell_state", "cell_state", "activates", co.tier(F.col("tier")), 0.5),
        rows(g, "genetic_causality", F.coalesce("variant", F.concat(F.lit("variant_"), "i")), F.col("gene"), "variant", "gene",
             F.when(F.col("direction") == "risk", "activates").otherwise("inhibits"), rank, F.when(rank == 5, 0.85).otherwise(0.5)),
        rows(n, "tissue_ecology", F.col("supports_state"), F.col("name"), "cell_state", "tissue_pathology", "activates", 2, 0.5),
        rows(m, "mechanism_generator", F.get("names", F.col("j")), F.get("names", F.col("j") + 1), co.node_type(here["type"]), co.node_type(there["type"]),
             co.sign(there["sign"], "activates"), 1, 0.3, F.col("j")),
    ])


def node_log(spark: SparkSession, folder: str, edges: DataFrame) -> DataFrame:
    cells = payload(spark, folder, "cell_state").select("name", F.lit("cell_state").alias("type"), _seq("cell_state", F.col("i")).alias("seq"))
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("name"), F.col("src_type").alias("type"), _end(0).alias("seq")),
        F.struct(F.col("dst").alias("name"), F.col("dst_type").alias("type"), _end(1).alias("seq")))))
    return cells.withColumn("seq", _end(0)).unionByName(ends)


def hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """Declared hypotheses; a repeated id keeps its last row and first place."""
    m = payload(spark, folder, "mechanism_generator")
    flags = sum((co.truth(F.col(c)).cast("int") for c in ("touches_switch", "touches_ecology", "touches_fork")), F.lit(0))
    own = m.select(F.col("id").alias("hyp"), "statement", F.when(F.size(named_steps(F.col("chain"))) >= 2, named_steps(F.col("chain"))).alias("nodes"),
                   F.lit(None).cast(S).alias("source"), F.lit(None).cast(S).alias("target"), (flags * 0.34).alias("relevance"),
                   F.coalesce("novelty", F.lit(0.5)).alias("novelty"), _seq("mechanism_generator", F.col("i")).alias("seq"))
    a = payload(spark, folder, "alternative")
    known = m.select("id").distinct().count()
    alt = a.select(F.concat(F.lit("HA"), F.lpad((F.col("i") + known).cast(S), 2, "0")).alias("hyp"), "statement",
                   F.lit(None).cast("array<string>").alias("nodes"), F.col("chain_source").alias("source"), F.col("chain_target").alias("target"),
                   F.lit(0.0).alias("relevance"), F.lit(0.3).alias("novelty"), _seq("alternative", F.col("i")).alias("seq"))
    both = own.unionByName(alt)
    rest = [c for c in both.columns if c not in ("hyp", "seq")]
    folded = both.groupBy("hyp").agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.min("seq").alias("ins")).select("hyp", "r.*", "ins")
    score = payload(spark, folder, "novelty").groupBy(F.col("hypothesis_id").alias("hyp")).agg(F.max_by("score", "i").alias("_n"))
    return folded.join(score, "hyp", "left").withColumn("novelty", F.coalesce("_n", "novelty")).drop("_n").select(
        "*", F.lit(0.2).alias("prior"), F.lit(0.2).alias("belief"), F.lit("active").alias("status"))


def _attached(df: DataFrame, seq: Column, tier, polarity, strength: Column, independent=None) -> DataFrame:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)
    return df.select(F.col("hypothesis_id").alias("hyp"), seq.alias("seq"), col(tier).cast("int").alias("tier"), col(polarity).alias("polarity"),
                     strength.cast("double").alias("strength"), (F.lit(True) if independent is None else independent).alias("is_independent"))


def negatives(spark: SparkSession, folder: str) -> DataFrame:
    n = payload(spark, folder, "negative_evidence")
    return _attached(n, _seq("negative_evidence", F.col("i")), co.tier(F.col("tier")), "contradicts", F.coalesce("strength", F.lit(0.5)))


def challenges(spark: SparkSession, folder: str) -> DataFrame:
    """Counterfactuals that hold, and reviewer flaws."""
    c = payload(spark, folder, "counterfactual").where(co.truth(F.col("already_supported_by_data")))
    r = payload(spark, folder, "reviewer")
    return _attached(c, _seq("counterfactual", F.col("i")), 2, "contradicts", F.lit(0.5)).unionByName(
        _attached(r, _seq("reviewer", F.col("i")), F.when(co.truth(F.col("fixable")), 1).otherwise(2), "contradicts", F.coalesce("severity", F.lit(0.3))))


def validations(spark: SparkSession, folder: str) -> DataFrame:
    """Validation evidence; a dataset used for discovery makes it non-independent."""
    v = payload(spark, folder, "public_validation")
    used = payload(spark, folder, "public_database").where(F.col("used_for") == "discovery").select(
        F.col("accession").alias("dataset"), F.lit(True).alias("leaked")).distinct()
    v = v.join(used, "dataset", "left")
    free = F.col("leaked").isNull() & co.truth(F.col("independent"), True)
    return _attached(v, _seq("public_validation", F.col("i")), 2, co.polarity(F.coalesce("result", F.lit("inconclusive"))),
                     F.coalesce("strength", F.lit(0.6)), free)


def scored(hyps: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chain score, weakest link and path: the declared chain, else the best path between the endpoints."""
    base = hyps.drop("chain_score", "weakest", "path", "chain_nodes")
    declared = gr.declared_chains(base.where(F.col("nodes").isNotNull()).select("hyp", "nodes"), edges, nodes)
    ends = base.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    paths = gr.best_chains(edges, nodes, ends.select("source", "target").distinct())
    between = ends.join(paths.drop("mean_support", "n_edges").withColumnRenamed("nodes", "found"), ["source", "target"]).select(
        "hyp", F.col("score").alias("_s"), F.col("weakest").alias("_w"), "found")
    return base.join(declared.select("hyp", "score", F.col("weakest").alias("_dw"), "path"), "hyp", "left").join(between, "hyp", "left").select(
        *base.columns, F.coalesce("score", "_s", F.lit(0.0)).alias("chain_score"), F.coalesce("_dw", "_w").alias("weakest"),
        F.coalesce("path", F.concat_ws(" --> ", "found")).alias("path"),
        F.when(F.col("score").isNotNull(), F.col("nodes")).otherwise(F.col("found")).alias("chain_nodes"))


def with_evidence(hyps: DataFrame, attached: DataFrame) -> DataFrame:
    return hyps.drop("evidence_lo", "n_contradicting", "top_tier", "n_independent").join(bel.evidence_sums(attached), "hyp", "left")


def experiment_tables(spark: SparkSession, folder: str):
    e = payload(spark, folder, "experimental_design")
    tested = e.select(F.col("id").alias("exp"), F.explode("hypotheses_tested").alias("hyp"), "outcomes")
    outcomes = tested.select("exp", "hyp", F.posexplode("outcomes").alias("outcome", "o")).select(
        "exp", "outcome", "hyp", F.coalesce(F.try_element_at(F.col("o")["likelihoods"], F.col("hyp")), F.lit(0.0)).alias("lik"))
    exps = e.select(F.col("id").alias("exp"), "title", F.col("i").alias("ins"), F.coalesce("feasibility", F.lit(0.8)).alias("feasibility"),
                    bel.experiment_cost(F.col("cost_months"), co.experiment_type(F.col("type"), list(bel.DEFAULT_COSTS))).alias("cost"))
    return outcomes, exps


def confidence(belief: float) -> str:
    return "high" if belief >= 0.66 else "moderate" if belief >= 0.4 else "low"


def investigate(spark: SparkSession, question: str, folder: str, focus: str = "", floor: float = 0.12, min_survivors: int = 3,
                max_negative: int = 3, budget: float = 18.0, max_experiments: int = 3) -> dict:
    """Run every stage on a folder of payloads and return the report."""
    stages = []

    def stage(name, hyps):
        if hyps is None:
            stages.append((name, 0, 0.0))
            return
        d = bel.distribution(hyps)
        r = d.agg(F.count(F.lit(1)).alias("n"), bel.entropy_bits(F.col("share")).alias("h")).first()
        stages.append((name, r["n"], round(r["h"] or 0.0, 3)))

    log = durable(edge_log(spark, folder))
    nodes = durable(gr.fold_nodes(node_log(spark, folder, log)))
    evidence = log.select("src", "dst", "tier", "polarity", "strength", "is_independent")
    folded = durable(gr.fold_edges(log))
    edges = durable(gr.with_support(folded, evidence))
    stage("Layer 1 Knowledge Acquisition", None)
    stage("Layer 2 Mechanism Discovery", None)
    hyps = durable(scored(hypotheses(spark, folder), edges, nodes))
    stage("Layer 3 Hypothesis Generation", hyps)

    # the debate shift is transient: the elimination that follows recomputes from the prior
    against = negatives(spark, folder)
    attached = challenges(spark, folder).unionByName(against)
    first = durable(bel.prune(bel.refresh(with_evidence(hyps, attached)), floor, True, min_survivors, max_negative))
    stage("Challenge & Prune #1", first)

    checked = durable(validations(spark, folder))
    landing = checked.where("is_independent").join(hyps.select("hyp", "nodes", "source", "target"), "hyp").withColumn(
        "item", F.xxhash64("hyp", "seq")).withColumnRenamed("seq", "at")
    on_edges = validated_in_order(folded, evidence, landing, nodes)
    evidence = evidence.unionByName(on_edges.select("src", "dst", "tier", "polarity", "strength", "is_independent"))
    edges = durable(gr.with_support(folded, evidence))
    flags = payload(spark, folder, "statistics")
    flagged = _attached(flags.where(F.col("recommendation").isin("downgrade", "eliminate")), _seq("statistics", F.col("i")), 2, "contradicts",
                        F.coalesce("severity", F.lit(0.3)))
    leaked = (F.col("polarity") == "supports") & ~F.col("is_independent")
    capped = checked.withColumn("strength", F.when(leaked, F.least("strength", F.lit(0.3))).otherwise(F.col("strength")))
    dropped = flags.where(F.col("recommendation") == "eliminate").select(F.col("hypothesis_id").alias("hyp"), F.col("issue").alias("_issue")).dropDuplicates(["hyp"])
    second = first.withColumnRenamed("why", "why1").join(dropped, "hyp", "left").withColumn(
        "status", F.when(F.col("_issue").isNotNull(), "eliminated").otherwise(F.col("status")))
    second = durable(second)
    stage("Layer 4 Validation", second)
    # the negative-evidence agent runs again and attaches the same lines a second time
    attached = _union([attached, capped, flagged, against])
    second = with_evidence(scored(second, edges, nodes), attached)
    second = durable(bel.prune(bel.refresh(second), floor, True, 1, max_negative))
    stage("Challenge & Prune #2", second)

    outcomes, exps = experiment_tables(spark, folder)
    plan = bel.plan_experiments(outcomes, bel.distribution(second).select("hyp", "share"), exps, budget, max_experiments)
    stage("Experiment Planning", second)
    stage("Layer 5 Translation", second)
    debate = payload(spark, folder, "debate").groupBy(F.col("hypothesis_id").alias("hyp")).agg(
        F.max_by(F.coalesce("log_odds_delta", F.lit(0.0)), "i").alias("delta"))
    final = durable(bel.refresh(second, debate))
    stage("Layer 6 Meta Review", final)

    live = final.where(F.col("status") == "active").orderBy(*bel.rank_order()).collect()
    gone = final.where(F.col("status") == "eliminated").withColumn("reason", F.when(F.col("why1") != "", F.concat(F.lit("ELIMINATED round 1: "), "why1"))
        .when(F.col("_issue").isNotNull(), F.concat(F.lit("ELIMINATED by statistics: "), "_issue"))
        .otherwise(F.concat(F.lit("ELIMINATED round 2: "), "why"))).orderBy("ins").collect()
    weak = gr.weak_edges(edges).count()
    ranked = plan["ranked"].join(exps.select("exp", "title"), "exp").orderBy(F.desc("value"), "ins").collect()
    titles = {r["exp"]: r["title"] for r in ranked}
    return {
        "question": question, "focus": focus, "stages": stages,
        "headline_mechanism": live[0]["statement"] if live else "(no surviving hypothesis)",
        "hypotheses": [{
            "id": h["hyp"], "statement": h["statement"], "belief": round(h["belief"], 3), "evidence_score": round(h["chain_score"], 3),
            "confidence": confidence(h["belief"]), "causal_chain": h["path"] or "(no traceable chain)",
            "weakest_link": round(h["weakest"] or 0.0, 3), "independent_support": h["n_independent"] or 0, "novelty": round(h["novelty"], 2),
        } for h in live],
        "eliminated": [{"id": h["hyp"], "statement": h["statement"], "why": h["reason"]} for h in gone],
        "plan": {"ranked": [(r["exp"], r["title"], r["eig"], r["value"], r["cost"]) for r in ranked], "chosen": plan["chosen"],
                 "prior_bits": plan["prior_bits"], "residual_bits": plan["residual_bits"]},
        "critical_experiments": [f"{e}: {titles[e]}" for e in plan["chosen"]],
        "audit": {"coverage": {r["type"]: r["n"] for r in gr.node_coverage(nodes).collect()},
                  "contradictions": [tuple(r) for r in gr.contradictions(edges).collect()], "n_weak_edges": weak,
                  "n_contested_edges": edges.where("contested").count()},
        "consensus": artifact(folder, "consensus"), "skeptic": artifact(folder, "skeptic"),
        "translation": {a: artifact(folder, a) for a in ("drug_discovery", "biomarker", "precision_medicine", "trial_design")},
    }


def render_markdown(r: dict) -> str:
    """The report as Markdown tables."""
    out = ["# Evidence report", f"**Question:** {r['question']}"]
    if r["focus"]:
        out.append(f"**Focus:** {r['focus']}")
    out += ["## Headline mechanism", r["headline_mechanism"], "## Surviving hypotheses (ranked by belief)",
            "| id | belief | conf | evidence | weakest link | indep. support | novelty | causal chain |", "|" + "---|" * 8]
    out += [f"| {h['id']} | {h['belief']:.2f} | {h['confidence']} | {h['evidence_score']:.2f} | {h['weakest_link']:.2f} | "
            f"{h['independent_support']} | {h['novelty']:.2f} | {h['causal_chain']} |" for h in r["hypotheses"]]
    if r["eliminated"]:
        out.append("## Eliminated hypotheses")
        out += [f"- **{e['id']}** — {e['statement']}\n    - {e['why']}" for e in r["eliminated"]]
    p = r["plan"]
    out += ["## Decision-theoretic experiment plan", f"Uncertainty: **{p['prior_bits']:.2f} bits -> {p['residual_bits']:.2f} bits**"]
    out += [f"- {e} {t} | {eig:.3f} | {v:.3f} | {c:.0f}mo{'  * CHOSEN' if e in p['chosen'] else ''}" for e, t, eig, v, c in p["ranked"]]
    a = r["audit"]
    out += ["## Causal evidence graph audit", f"- Coverage: {a['coverage']}", f"- Contradictions: {a['contradictions']}",
            f"- Weak edges: {a['n_weak_edges']}; contested edges: {a['n_contested_edges']}"]
    if r["consensus"]:
        out += ["## Consensus & open questions"] + [f"- Open: {d}" for d in r["consensus"].get("open_disagreements", [])]
    if r["skeptic"]:
        out += ["## Falsification signatures"] + [f"- {t.get('conclusion', '')}\n    - breaks if: {t.get('breaking_observation', '')}"
                                                  for t in r["skeptic"].get("falsification_tests", [])]
    out += ["## Pipeline stages", "| stage | active hyp | uncertainty (bits) |", "|---|---|---|"]
    out += [f"| {n} | {k} | {h} |" for n, k, h in r["stages"]]
    return "\n".join(out) + "\n"
