"""Queries over the evidence graph, beliefs and experiment scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.catalog.derive import table
from pedigraph.operators import beliefs as bel, graph as gr, validation as va

# Node types by number.
TYPES = ["variant", "gene", "perturbation", "mechanism", "cell_state", "cell_phenotype", "tissue_pathology",
         "clinical_outcome", "drug", "biomarker"]


def _node(col):
    return F.concat(F.lit("n"), col.cast("string"))


def _ends():
    """Groups of ten parts point to suppliers; both are numbered alike, so edges run both ways and in circles."""
    return F.expr("l_partkey DIV 10"), F.col("l_suppkey")


def _nodes(spark, folder):
    li = table(spark, folder, "lineitem")
    src, dst = _ends()
    both = li.select(src.alias("i")).unionByName(li.select(dst.alias("i")))
    kinds = F.array(*[F.lit(t) for t in TYPES])
    log = both.select(_node(F.col("i")).alias("name"), F.get(kinds, (F.col("i") % 10).cast("int")).alias("type"), F.col("i").alias("seq"))
    return gr.fold_nodes(log)


def _log(spark, folder):
    p, s = _ends()
    turn = (p + s * 2 + F.least(p, s)) % 3
    sign = F.when(F.col("l_linenumber") % 2 == 1, "unknown").when(turn == 0, "activates").when(turn == 1, "inhibits").otherwise("unknown")
    polarity = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").when(
        F.col("l_linestatus") == "F", "supports").otherwise("neutral")
    return table(spark, folder, "lineitem").select(
        _node(p).alias("src"), _node(s).alias("dst"), sign.alias("sign"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.col("l_linenumber") % 5 + 1).cast("int").alias("tier"),
        polarity.alias("polarity"), (F.col("l_discount") * 61 / 7.3).alias("strength"),
        (F.col("l_tax") > 0.02).alias("is_independent"))


def _edges(spark, folder):
    log = _log(spark, folder)
    return gr.with_support(gr.fold_edges(log), log)


def edge_support(spark: SparkSession, folder: str) -> DataFrame:
    """Tier-weighted support per edge from every line item as evidence."""
    return gr.edge_support(_log(spark, folder)).select(
        "src", "dst", F.round("support", 8).alias("support"), "best_tier", "contested", "n_evidence")


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges folded from the append log: last known sign, support, contested."""
    return _edges(spark, folder).select("src", "dst", "sign", F.round("support", 8).alias("support"), "contested")


def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return gr.contradictions_of(log, log)


def weak_edges(spark: SparkSession, folder: str) -> DataFrame:
    return gr.weak_edges(_edges(spark, folder)).select("src", "dst", F.round("support", 8).alias("support"))


def node_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return gr.node_coverage(_nodes(spark, folder))


def tier_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gr.tier_counts(_log(spark, folder))


def _chains(spark, folder):
    """Every customer declares three steps along the first and last neighbours; each fifth chain ends elsewhere."""
    src, dst = _ends()
    ways = table(spark, folder, "lineitem").groupBy(src.alias("at")).agg(F.min(dst).alias("low"), F.max(dst).alias("high"))
    chains = table(spark, folder, "customer").select(F.col("c_custkey").alias("hyp"), F.expr("c_custkey DIV 8").alias("v0"))
    for i, way in enumerate(("if(hyp % 2 = 0, low, high)", "if(hyp % 3 = 0, high, low)", "if(hyp % 5 = 0, v0 + 1, low)")):
        chains = chains.join(ways, F.col(f"v{i}") == F.col("at")).withColumn(f"v{i + 1}", F.expr(way)).drop("at", "low", "high")
    return chains.select("hyp", F.array(*[_node(F.col(f"v{i}")) for i in range(4)]).alias("nodes"))


def declared_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer declares a three-edge chain; broken chains drop out."""
    out = gr.declared_chains(_chains(spark, folder), _edges(spark, folder), _nodes(spark, folder))
    return out.select("hyp", F.round("weakest", 8).alias("weakest"), F.round("mean_support", 8).alias("mean_support"),
                      F.round("score", 8).alias("score"), "path")


def _net(spark, folder):
    """Customers point to their number over 3 and over 5; each eleventh also points back up, which makes circles."""
    c = F.col("c_custkey")
    customers = table(spark, folder, "customer")
    ways = F.array(F.floor(c / 3), F.floor(c / 5), F.when(c % 11 == 0, c * 3))
    rows = customers.select(c.alias("src"), F.explode(F.array_distinct(ways)).alias("dst"), (F.abs("c_acctbal") % 1000 / 1700).alias("support"))
    known = customers.select(F.col("c_custkey").alias("dst"))
    return rows.where("src <> dst and (dst = 0 or dst < src)").unionByName(rows.where("dst > src").join(known, "dst", "left_semi").select(*rows.columns)).withColumn(
        "edge_no", F.col("dst"))


def _walks(spark, folder):
    c = F.col("c_custkey")
    pairs = table(spark, folder, "customer").select(c.alias("source"), F.floor(c / 15).alias("target"))
    nodes = table(spark, folder, "customer").select(c.alias("name"), F.when(c % 4 == 0, "gene").when(
        c % 4 == 1, "biomarker").otherwise("mechanism").alias("type"))
    return _net(spark, folder), nodes, pairs


def simple_chains(spark: SparkSession, folder: str) -> DataFrame:
    """All simple paths from each customer to its ancestor two short or long steps up."""
    out = gr.simple_chains(*_walks(spark, folder))
    return out.select("source", "target", F.concat_ws(">", F.col("nodes").cast("array<string>")).alias("path"),
                      F.round("weakest", 6).alias("weakest"), F.round("score", 6).alias("score"), "n_edges")


def best_chains(spark: SparkSession, folder: str) -> DataFrame:
    """The best chain of each pair with its path; of equal ones the first found."""
    out = gr.best_chains(*_walks(spark, folder))
    return out.select("source", "target", F.concat_ws(">", F.col("nodes").cast("array<string>")).alias("path"), F.round("score", 6).alias("score"), "n_edges")


def clinic_chains(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest way of every customer to each biomarker it reaches."""
    edges, nodes, pairs = _walks(spark, folder)
    out = gr.chains_to_clinic(edges, nodes, pairs.select("source"))
    return out.select("source", "target", F.round("weakest", 6).alias("weakest"), F.round("score", 6).alias("score"), "n_edges")


def ordered_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The orders of a customer's quarter are validations between the ends of a rhombus: which side each lands on."""
    o = table(spark, folder, "orders").select(
        "o_orderkey", F.concat_ws("-", "o_custkey", F.year("o_orderdate"), F.quarter("o_orderdate")).alias("g"), F.col("o_custkey").alias("c"),
        (F.col("o_orderkey") % 3 + 2).cast("int").alias("tier"), F.when(F.col("o_orderstatus") == "F", "contradicts").otherwise("supports").alias("polarity"),
        (F.floor("o_totalprice") % 100 / 100).alias("strength"))
    at = lambda letter: F.concat("g", F.lit(letter))
    sides = o.select("g", "c").distinct().select("g", "c", F.explode(F.array(*[
        F.struct(F.lit(n).alias("no"), at(a).alias("src"), at(b).alias("dst"), F.lit(m).alias("m")) for n, (a, b, m) in enumerate((("a", "b", 1), ("a", "c", 7), ("b", "d", 1), ("c", "d", 7)))
    ])).alias("e"))
    edges = sides.select("e.src", "e.dst", F.lit("activates").alias("sign"), F.col("e.no").cast("long").alias("edge_no"))
    base = sides.select("e.src", "e.dst", F.lit(2).alias("tier"), F.lit("supports").alias("polarity"), ((F.col("c") * F.col("e.m") % 10 + 1) / 10).alias("strength"),
                        F.lit(True).alias("is_independent"))
    items = o.select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("at"), F.lit(None).cast("array<string>").alias("nodes"), at("a").alias("source"),
                     at("d").alias("target"), "tier", "polarity", "strength", F.lit(True).alias("is_independent"))
    nodes = edges.select(F.col("src").alias("name"), F.lit("gene").alias("type")).distinct()
    out = va.validated_in_order(edges, base, items, nodes, 2).where(F.col("src").endswith("a"))
    return out.select(F.col("item").alias("o_orderkey"), F.right("dst", F.lit(1)).alias("side"))


def _hyps(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    attached = o.select(
        F.col("o_custkey").alias("hyp"), (k % 5 + 1).cast("int").alias("tier"),
        F.when(F.col("o_orderstatus") == "F", "contradicts").when(F.col("o_orderstatus") == "O", "supports").otherwise("neutral").alias("polarity"),
        (F.floor("o_totalprice") % 100 / 250).alias("strength"), (k % 3 != 0).alias("is_independent"))
    c = F.col("c_custkey")
    base = table(spark, folder, "customer").select(
        c.alias("hyp"), c.alias("ins"), ((c % 17 + 1) / 40).alias("prior"), F.lit(0.2).alias("belief"), F.lit("active").alias("status"),
        (F.floor(F.abs("c_acctbal")) % 90 / 100 - 0.1).alias("chain_score"), (c % 4 * 0.34).alias("relevance"),
        (c % 10 / 10).alias("novelty"), "c_mktsegment")
    return base.join(bel.evidence_sums(attached), "hyp", "left")


def belief_update(spark: SparkSession, folder: str) -> DataFrame:
    """Beliefs from prior, chain score, order evidence and a debate shift."""
    debate = table(spark, folder, "customer").where(F.col("c_custkey") % 5 == 0).select(
        F.col("c_custkey").alias("hyp"), ((F.col("c_custkey") % 7 - 3) / 5).alias("delta"))
    return bel.refresh(_hyps(spark, folder), debate).select(
        "hyp", F.round("belief", 8).alias("belief"), F.coalesce("n_contradicting", F.lit(0)).alias("n_contradicting"), "top_tier",
        F.coalesce("n_independent", F.lit(0)).alias("n_independent"))


def prune_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    """One elimination round with its reasons."""
    out = bel.prune(bel.refresh(_hyps(spark, folder)))
    return out.select("hyp", "status", "why")


def park_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    return bel.underpowered(bel.refresh(_hyps(spark, folder))).select("hyp")


def belief_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised beliefs and their entropy per market segment."""
    d = bel.distribution(bel.refresh(_hyps(spark, folder)), ["c_mktsegment"])
    return d.groupBy("c_mktsegment").agg(F.round(bel.entropy_bits(F.col("share")), 8).alias("bits"),
                                         F.round(F.max("share"), 10).alias("top_share"), F.count(F.lit(1)).alias("n"))


def _experiments(spark, folder):
    li = table(spark, folder, "lineitem")
    outcomes = li.groupBy((F.col("l_partkey") % 200).alias("exp"), F.col("l_returnflag").alias("outcome"),
                          F.col("l_suppkey").alias("hyp")).agg((F.avg("l_discount") * 8).alias("lik"))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("hyp"), (F.floor(F.abs("s_acctbal")) + 1).alias("belief"),
                                                F.lit("active").alias("status"))
    prior = bel.distribution(s).select("hyp", "share")
    e = outcomes.select("exp").distinct()
    exps = e.select("exp", F.col("exp").alias("ins"), (F.col("exp") % 10 + 1.0).cast("double").alias("cost"),
                    (F.col("exp") % 5 / 10 + 0.5).alias("feasibility"))
    return outcomes, prior, exps


def information_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Expected information gain of experiments over suppliers as hypotheses."""
    out = bel.information_gain(*_experiments(spark, folder))
    return out.select("exp", F.round("eig", 7).alias("eig"), F.round("value", 7).alias("value"))


def experiment_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy budgeted plan of at most three experiments."""
    plan = bel.plan_experiments(*_experiments(spark, folder), budget=18.0, max_experiments=3)
    return plan["ranked"].where(F.col("exp").isin(*plan["chosen"])).select("exp", F.round("eig", 7).alias("eig"), "cost")


QUERIES = {
    "edge_support": edge_support,
    "graph_edges": graph_edges,
    "contradictions": contradictions,
    "weak_edges": weak_edges,
    "node_coverage": node_coverage,
    "tier_counts": tier_counts,
    "declared_chains": declared_chains,
    "simple_chains": simple_chains,
    "best_chains": best_chains,
    "clinic_chains": clinic_chains,
    "ordered_validation": ordered_validation,
    "belief_update": belief_update,
    "prune_hypotheses": prune_hypotheses,
    "park_hypotheses": park_hypotheses,
    "belief_entropy": belief_entropy,
    "information_gain": information_gain,
    "experiment_plan": experiment_plan,
}

_LOG = """
WITH log AS (SELECT 'n' || (l_partkey // 10) AS src, 'n' || l_suppkey AS dst,
  CASE WHEN l_linenumber % 2 = 1 THEN 'unknown' WHEN (l_partkey // 10 + l_suppkey * 2 + least(l_partkey // 10, l_suppkey)) % 3 = 0 THEN 'activates'
       WHEN (l_partkey // 10 + l_suppkey * 2 + least(l_partkey // 10, l_suppkey)) % 3 = 1 THEN 'inhibits' ELSE 'unknown' END AS sign,
  l_orderkey * 8 + l_linenumber AS seq, l_linenumber % 5 + 1 AS tier,
  CASE WHEN l_returnflag = 'A' THEN 'supports' WHEN l_returnflag = 'R' THEN 'contradicts' WHEN l_linestatus = 'F' THEN 'supports' ELSE 'neutral' END AS polarity,
  l_discount * 61 / 7.3 AS strength, l_tax > 0.02 AS ind FROM lineitem),
wt AS (SELECT *, [0.15, 0.35, 0.6, 0.85, 1.0][tier] * greatest(0.0, least(1.0, strength)) * CASE WHEN ind THEN 1.0 ELSE 0.4 END
        * CASE polarity WHEN 'supports' THEN 1 WHEN 'contradicts' THEN -1 ELSE 0 END AS w FROM log)
"""


def _support(source: str) -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w DESC) AS r FROM {source}),
sup AS (SELECT src, dst, coalesce(sum(CASE WHEN w > 0 AND r < 1100 THEN w * pow(0.5, r - 1) ELSE 0 END), 0) + coalesce(sum(CASE WHEN w < 0 THEN w ELSE 0 END), 0) AS support,
  max(CASE WHEN polarity = 'supports' THEN tier END) AS best_tier,
  bool_or(polarity = 'supports') AND bool_or(polarity = 'contradicts') AS contested, count(*) AS n_evidence FROM ranked GROUP BY src, dst)
"""


_EDGES = _LOG + "," + _support("wt") + """,
folded AS (SELECT src, dst, coalesce(max(CASE WHEN sign <> 'unknown' THEN sign END), 'unknown') AS sign FROM log GROUP BY src, dst),
edges AS (SELECT f.src, f.dst, sign, coalesce(support, 0) AS support, coalesce(contested, false) AS contested
          FROM folded f LEFT JOIN sup s ON s.src = f.src AND s.dst = f.dst)
"""
_TYPES = "['variant', 'gene', 'perturbation', 'mechanism', 'cell_state', 'cell_phenotype', 'tissue_pathology', 'clinical_outcome', 'drug', 'biomarker']"

_HYPS = """
WITH att AS (SELECT o_custkey AS hyp, o_orderkey % 5 + 1 AS tier,
  CASE o_orderstatus WHEN 'F' THEN 'contradicts' WHEN 'O' THEN 'supports' ELSE 'neutral' END AS polarity,
  floor(o_totalprice) % 100 / 250 AS strength, o_orderkey % 3 <> 0 AS ind FROM orders),
ev AS (SELECT hyp, sum([0.15, 0.35, 0.6, 0.85, 1.0][tier] * strength * CASE WHEN ind THEN 1.0 ELSE 0.4 END
    * CASE polarity WHEN 'supports' THEN 1 WHEN 'contradicts' THEN -1 ELSE 0 END) AS lo,
  count(*) FILTER (polarity = 'contradicts') AS n_contradicting, max(CASE WHEN polarity = 'supports' THEN tier END) AS top_tier,
  count(*) FILTER (polarity = 'supports' AND ind AND strength >= 0.5) AS n_independent FROM att GROUP BY hyp),
base AS (SELECT c_custkey AS hyp, (c_custkey % 17 + 1) / 40.0 AS prior, floor(abs(c_acctbal)) % 90 / 100 - 0.1 AS chain,
  c_custkey % 4 * 0.34 AS relevance, c_custkey % 10 / 10.0 AS novelty, c_mktsegment,
  coalesce(lo, 0) AS lo, coalesce(n_contradicting, 0) AS n_contradicting, top_tier, coalesce(n_independent, 0) AS n_independent
  FROM customer LEFT JOIN ev ON hyp = c_custkey),
scored AS (SELECT *, ln(prior / (1 - prior)) + CASE WHEN chain <= 0 THEN -2.0 ELSE 4 * chain - 0.5 END + lo AS z FROM base)
"""

_PATHS = """
WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS src, d AS dst, abs(c_acctbal) % 1000 / 1700 AS s
  FROM (SELECT c_custkey, c_acctbal, unnest([c_custkey // 3, c_custkey // 5, CASE WHEN c_custkey % 11 = 0 THEN c_custkey * 3 END]) AS d FROM customer)
  WHERE c_custkey <> d AND (d = 0 OR d < c_custkey OR d IN (SELECT c_custkey FROM customer))),
p AS (SELECT c_custkey AS source, c_custkey // 15 AS target, [c_custkey] AS nodes, CAST('infinity' AS DOUBLE) AS w, 0 AS n,
             c_custkey = c_custkey // 15 AS hit FROM customer
  UNION ALL
  SELECT source, target, list_append(nodes, dst), least(w, s), n + 1, dst = target FROM p JOIN e ON src = nodes[len(nodes)]
  WHERE NOT hit AND n < 8 AND NOT list_contains(nodes, dst)),
f AS (SELECT source, target, nodes, CASE WHEN n = 0 THEN 0.0 ELSE w END AS w, n FROM p WHERE hit),
sc AS (SELECT *, CASE WHEN w <= 0 THEN w ELSE w * (1 + CASE WHEN target % 4 = 1 THEN 0.25 ELSE 0 END + CASE WHEN source % 4 = 0 THEN 0.25 ELSE 0 END) END AS score FROM f)
"""

def _round(i: int) -> str:
    """One round of the plan in SQL: score with the shares of round i, take the best one that fits, assume its likeliest outcome."""
    taken = " UNION ALL ".join(f"SELECT exp, cost FROM best{k}" for k in range(i)) or "SELECT 0 AS exp, 0.0 AS cost WHERE false"
    return f"""
tested{i} AS (SELECT DISTINCT exp, o.hyp, share FROM o JOIN pr{i} p ON p.hyp = o.hyp),
p{i} AS (SELECT exp, hyp, share, share / sum(share) OVER (PARTITION BY exp) AS p FROM tested{i}),
h{i} AS (SELECT exp, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS h FROM p{i} GROUP BY exp),
j{i} AS (SELECT o.exp, outcome, o.hyp, lik * p AS j FROM o JOIN p{i} p ON p.exp = o.exp AND p.hyp = o.hyp),
po{i} AS (SELECT exp, outcome, sum(j) AS po FROM j{i} GROUP BY ALL),
q{i} AS (SELECT j.exp, sum(CASE WHEN j > 0 THEN po * -(j / po) * log2(j / po) ELSE 0 END) AS hq FROM j{i} j JOIN po{i} po ON po.exp = j.exp AND po.outcome = j.outcome WHERE po > 0 GROUP BY j.exp),
g{i} AS (SELECT h.exp, h.exp % 10 + 1.0 AS cost, greatest(0, h - coalesce(hq, 0)) * (h.exp % 5 / 10.0 + 0.5) AS eig FROM h{i} h LEFT JOIN q{i} q ON q.exp = h.exp),
taken{i} AS ({taken}),
best{i} AS (SELECT exp, cost FROM g{i} WHERE exp NOT IN (SELECT exp FROM taken{i}) AND eig > 1e-6 AND cost + (SELECT coalesce(sum(cost), 0) FROM taken{i}) <= 18
  ORDER BY eig / cost DESC, exp LIMIT 1),
mine{i} AS (SELECT outcome, o.hyp, lik * share AS j, share FROM o JOIN pr{i} p ON p.hyp = o.hyp WHERE exp = (SELECT exp FROM best{i})),
won{i} AS (SELECT outcome, sum(j) AS pj FROM mine{i} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
moved{i} AS (SELECT hyp, j / CASE WHEN pj <> 0 THEN pj ELSE 1 END * (SELECT sum(share) FROM (SELECT DISTINCT hyp, share FROM mine{i})) AS share
  FROM mine{i} m JOIN won{i} w ON w.outcome = m.outcome),
pr{i + 1} AS (SELECT p.hyp, greatest(coalesce(m.share, p.share), 0) / sum(greatest(coalesce(m.share, p.share), 0)) OVER () AS share
  FROM pr{i} p LEFT JOIN moved{i} m ON m.hyp = p.hyp)"""


ORACLE = {
    "experiment_plan": """
WITH o AS (SELECT l_partkey % 200 AS exp, l_returnflag AS outcome, l_suppkey AS hyp, avg(l_discount) * 8 AS lik FROM lineitem GROUP BY ALL),
s AS (SELECT s_suppkey AS hyp, floor(abs(s_acctbal)) + 1 AS b FROM supplier),
pr0 AS (SELECT hyp, b / sum(b) OVER () AS share FROM s),""" + ",".join(map(_round, range(3))) + """
SELECT g.exp, round(eig, 7) AS eig, g.cost::DOUBLE AS cost FROM g0 g WHERE g.exp IN (SELECT exp FROM best0 UNION ALL SELECT exp FROM best1 UNION ALL SELECT exp FROM best2)""",
    "edge_support": _LOG + "," + _support("wt") + "SELECT src, dst, round(support, 8) AS support, best_tier, contested, n_evidence FROM sup",
    "graph_edges": _EDGES + "SELECT src, dst, sign, round(support, 8) AS support, contested FROM edges",
    "contradictions": _EDGES + """SELECT a.src, a.dst, 'bidirectional sign conflict' AS conflict FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src
WHERE a.sign = 'activates' AND b.sign = 'inhibits' AND a.support > 0.2 AND b.support > 0.2""",
    "weak_edges": _EDGES + "SELECT src, dst, round(support, 8) AS support FROM edges WHERE support < 0.2",
    "node_coverage": f"""SELECT {_TYPES}[i % 10 + 1] AS type, count(*) AS n FROM (
  SELECT l_partkey // 10 AS i FROM lineitem UNION SELECT l_suppkey FROM lineitem) GROUP BY 1""",
    "tier_counts": _LOG + "SELECT ['REVIEW', 'ASSOCIATION', 'ANIMAL', 'PERTURBATION', 'HUMAN_GENETICS'][tier] AS tier_name, count(*) AS n FROM log GROUP BY 1",
    "declared_chains": _EDGES + f""",
ways AS (SELECT l_partkey // 10 AS a, min(l_suppkey) AS low, max(l_suppkey) AS high FROM lineitem GROUP BY 1),
s0 AS (SELECT c_custkey AS hyp, c_custkey // 8 AS v0 FROM customer),
s1 AS (SELECT s0.*, CASE WHEN hyp % 2 = 0 THEN low ELSE high END AS v1 FROM s0 JOIN ways ON a = v0),
s2 AS (SELECT s1.*, CASE WHEN hyp % 3 = 0 THEN high ELSE low END AS v2 FROM s1 JOIN ways ON a = v1),
s3 AS (SELECT s2.*, CASE WHEN hyp % 5 = 0 THEN v0 + 1 ELSE low END AS v3 FROM s2 JOIN ways ON a = v2),
ch AS (SELECT hyp, ['n' || v0, 'n' || v1, 'n' || v2, 'n' || v3] AS v, v0 % 10 AS t0, v3 % 10 AS t1 FROM s3),
st AS (SELECT hyp, v, t0, t1, unnest([1, 2, 3]) AS i FROM ch),
j AS (SELECT hyp, v, t0, t1, i, support, CASE sign WHEN 'activates' THEN ' --> ' WHEN 'inhibits' THEN ' --| ' ELSE ' -?- ' END AS a
      FROM st JOIN edges ON src = v[i] AND dst = v[i + 1]),
g AS (SELECT hyp, v, t0, t1, count(*) AS n, min(support) AS w, avg(support) AS m, string_agg(v[i] || a, '' ORDER BY i) AS p FROM j GROUP BY ALL)
SELECT hyp, round(w, 8) AS weakest, round(m, 8) AS mean_support,
  round(CASE WHEN w <= 0 THEN w ELSE w * (1 + CASE WHEN t1 IN (6, 7, 9) THEN 0.25 ELSE 0 END + CASE WHEN t0 IN (0, 1) THEN 0.25 ELSE 0 END) END, 8) AS score,
  p || v[4] AS path FROM g WHERE n = 3""",
    "simple_chains": _PATHS + """SELECT source, target, array_to_string(nodes, '>') AS path, round(w, 6) AS weakest, round(score, 6) AS score, n AS n_edges FROM sc""",
    "best_chains": _PATHS + """SELECT source, target, array_to_string(nodes, '>') AS path, round(score, 6) AS score, n AS n_edges FROM (
  SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, nodes) AS r FROM sc) WHERE r = 1""",
    "clinic_chains": _PATHS.replace("\nsc AS", """
ways AS (SELECT c_custkey AS source, c_custkey AS node, CAST('infinity' AS DOUBLE) AS w, 0 AS n FROM customer UNION ALL
  SELECT source, dst, max(least(w, s)), n + 1 FROM ways JOIN e ON src = node WHERE n < 8 AND dst <> source GROUP BY source, dst, n),
sc AS""") + """, clinic AS (SELECT source, node AS target, max(w) AS w, arg_min(n, (-w, n)) AS n FROM ways JOIN customer ON c_custkey = node WHERE n > 0 AND node % 4 = 1 GROUP BY ALL)
SELECT source, target, round(w, 6) AS weakest, round(CASE WHEN w <= 0 THEN w ELSE w * (1.25 + CASE WHEN source % 4 = 0 THEN 0.25 ELSE 0 END) END, 6) AS score, n AS n_edges FROM clinic""",
    "ordered_validation": """
WITH o AS (SELECT o_orderkey, o_custkey AS c, year(o_orderdate) * 10 + quarter(o_orderdate) AS q, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END
  * [0.15, 0.35, 0.6, 0.85, 1.0][o_orderkey % 3 + 2] * (floor(o_totalprice) % 100 / 100) AS w FROM orders),
g AS (SELECT c, q, list({'k': o_orderkey, 'w': w} ORDER BY o_orderkey) AS l, {'p': [0.35 * ((c % 10 + 1) / 10)], 'n': 0.0, 'p2': [0.35 * ((c * 7 % 10 + 1) / 10)], 'n2': 0.0, 's': ''} AS z
  FROM o GROUP BY ALL),
f AS (SELECT l, list_reduce(l, lambda a, x: CASE
    WHEN list_sum(list_transform(list_reverse_sort(a.p), lambda v, i: v * pow(0.5, i - 1))) - a.n >= list_sum(list_transform(list_reverse_sort(a.p2), lambda v, i: v * pow(0.5, i - 1))) - a.n2
    THEN {'p': CASE WHEN x.w > 0 THEN list_append(a.p, x.w) ELSE a.p END, 'n': a.n - CASE WHEN x.w < 0 THEN x.w ELSE 0 END, 'p2': a.p2, 'n2': a.n2, 's': a.s || 'b'}
    ELSE {'p': a.p, 'n': a.n, 'p2': CASE WHEN x.w > 0 THEN list_append(a.p2, x.w) ELSE a.p2 END, 'n2': a.n2 - CASE WHEN x.w < 0 THEN x.w ELSE 0 END, 's': a.s || 'c'} END, z) AS r FROM g)
SELECT u.k AS o_orderkey, u.side FROM (SELECT unnest(list_transform(l, lambda x, i: {'k': x.k, 'side': substr(r.s, i, 1)})) AS u FROM f)""",
    "belief_update": _HYPS + """SELECT hyp, round(1 / (1 + exp(-(z + CASE WHEN hyp % 5 = 0 THEN (hyp % 7 - 3) / 5.0 ELSE 0 END))), 8) AS belief,
  n_contradicting, top_tier, n_independent FROM scored""",
    "prune_hypotheses": _HYPS + """, b AS (SELECT *, 1 / (1 + exp(-z)) AS belief FROM scored),
r AS (SELECT *, row_number() OVER (ORDER BY round(belief, 4) DESC, round(chain, 4) DESC, relevance DESC, novelty DESC, hyp) AS k FROM b),
y AS (SELECT hyp, CASE WHEN k <= 3 THEN '' ELSE concat_ws('; ', CASE WHEN belief < 0.12 THEN 'belief ' || printf('%.2f', belief) || ' < floor 0.12' END,
  CASE WHEN chain <= 0 THEN 'no traceable causal chain to a clinical endpoint' END,
  CASE WHEN n_contradicting >= 3 AND coalesce(top_tier, 0) < 4 THEN n_contradicting || ' contradicting lines, no perturbation/genetic support' END) END AS why FROM r)
SELECT hyp, CASE WHEN why <> '' THEN 'eliminated' ELSE 'active' END AS status, why FROM y""",
    "park_hypotheses": _HYPS + "SELECT hyp FROM scored WHERE 1 / (1 + exp(-z)) >= 0.12 AND chain < 0.25 AND n_independent = 0",
    "belief_entropy": _HYPS + """, b AS (SELECT c_mktsegment, 1 / (1 + exp(-z)) AS belief FROM scored),
s AS (SELECT c_mktsegment, belief / sum(belief) OVER (PARTITION BY c_mktsegment) AS p FROM b)
SELECT c_mktsegment, round(sum(-p * log2(p)), 8) AS bits, round(max(p), 10) AS top_share, count(*) AS n FROM s GROUP BY 1""",
    "information_gain": """
WITH o AS (SELECT l_partkey % 200 AS exp, l_returnflag AS outcome, l_suppkey AS hyp, avg(l_discount) * 8 AS lik FROM lineitem GROUP BY ALL),
s AS (SELECT s_suppkey AS hyp, floor(abs(s_acctbal)) + 1 AS b FROM supplier),
pr AS (SELECT hyp, b / sum(b) OVER () AS share FROM s),
tested AS (SELECT DISTINCT exp, o.hyp, share FROM o JOIN pr ON pr.hyp = o.hyp),
p AS (SELECT exp, hyp, share / sum(share) OVER (PARTITION BY exp) AS p FROM tested),
h AS (SELECT exp, sum(-p * log2(p)) AS h FROM p GROUP BY exp),
j AS (SELECT o.exp, outcome, lik * p AS j FROM o JOIN p ON p.exp = o.exp AND p.hyp = o.hyp),
po AS (SELECT exp, outcome, sum(j) AS po FROM j GROUP BY ALL),
q AS (SELECT j.exp, sum(CASE WHEN j > 0 THEN po * -(j / po) * log2(j / po) ELSE 0 END) AS hq FROM j JOIN po ON po.exp = j.exp AND po.outcome = j.outcome WHERE po > 0 GROUP BY j.exp),
g AS (SELECT h.exp, greatest(0, h - coalesce(hq, 0)) * (h.exp % 5 / 10.0 + 0.5) AS eig FROM h LEFT JOIN q ON q.exp = h.exp)
SELECT exp, round(eig, 7) AS eig, round(eig / greatest(exp % 10 + 1.0, 0.5), 7) AS value FROM g""",
}
