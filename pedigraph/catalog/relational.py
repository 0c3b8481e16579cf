"""Queries over the relational operators and scalar kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.catalog import derive
from pedigraph.catalog.cascade import sql_cdf, sql_fisher, sql_sf
from pedigraph.catalog.derive import table
from pedigraph.config import load_config
from pedigraph.functions import ladders as lad
from pedigraph.functions.genotype import depths_of
from pedigraph.functions.numeric import fixed, general, scientific
from pedigraph.functions.stats import binom_cdf, binom_sf, fisher_exact, log_sum_exp, wilson_interval
from pedigraph.functions.text import info_double, info_flag, info_text, trim_suffix
from pedigraph.operators import consensus
from pedigraph.operators.intervals import first_containing, merge_intervals, overlaps_any
from pedigraph.sources.tables import complete_trios, parse_pedigree

CFG = load_config()


def _windows(spark, folder):
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    o = table(spark, folder, "orders").select("o_custkey", day.alias("s"), (day + 30).alias("e"))
    return merge_intervals(o, ["o_custkey"], "s", "e", chunk=4096)


def interval_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty-day windows after each order, merged per customer."""
    return _windows(spark, folder)


def interval_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Line items shipped inside an order window of the customer with the part's number."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    q = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("o_custkey"), day.alias("d"), "l_returnflag")
    w = _windows(spark, folder).withColumn("e", F.col("e") - 1)
    hit = overlaps_any(q, w, ["o_custkey"], "d", "d", "s", "e", width=512)
    return hit.groupBy("o_custkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def segment_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """First segment (by number) that contains a customer's position on its nation's axis."""
    s = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("axis"), (F.col("s_suppkey") * 97 % 10000).alias("start"),
        (F.col("s_suppkey") * 97 % 10000 + 800).alias("end"), F.col("s_suppkey").alias("seg_no"),
        F.col("s_suppkey").alias("seg"), F.round("s_acctbal", 2).alias("cn"))
    c = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("axis"), (F.col("c_custkey") * 37 % 10000).alias("at"))
    return first_containing(c, s, ["axis"], "at", "start", "end", "seg_no", ["seg", "cn"])


def cluster_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user with another event of that user within ten minutes."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))
    return consensus.close_neighbours(e, ["user_id"], "pos", 600).select("event_id", "user_id", "clustered")


def consensus_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as sites, return flags as callers: agreement and tier per part."""
    li = table(spark, folder, "lineitem")
    named = consensus.caller_names(li.select("l_partkey", F.col("l_returnflag").alias("caller")), ["l_partkey"])
    facts = li.groupBy("l_partkey").agg(F.max("l_discount").alias("post"), F.max("l_tax").alias("tax"))
    x = named.join(facts, "l_partkey").withColumn("post", F.col("post") * 9.7)
    t = consensus.tier(F.col("tax") > 0.01, F.size("callers"), 3, F.col("post"), F.col("tax") > 0.07, F.lit("germline"), CFG)
    return x.select("l_partkey", F.concat_ws(",", "callers").alias("callers"), t.alias("tier"))


def cover_union(spark: SparkSession, folder: str) -> DataFrame:
    """Event keys as a second engine: first record per key, kept where no order covers it, with the orders."""
    o = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 1000).alias("who"), (F.col("o_orderkey") % 50).alias("what"))
    e = table(spark, folder, "events").select(
        F.col("user_id").alias("who"), (F.col("event_id") % 70).alias("what"), "event_id", "event_type")
    first = consensus.first_engine_record(e, ["who", "what"], "event_id")
    only = consensus.not_covered(first, o, ["who", "what"])
    own = o.groupBy("who", "what").agg(F.count(F.lit(1)).alias("n"))
    return own.select("who", "what", F.lit("primary").alias("source"), "n").unionByName(
        only.select("who", "what", F.col("event_type").alias("source"), F.lit(1).cast("bigint").alias("n")))


def pedigree_trios(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as people with parents by number; children with both parents listed."""
    c = F.col("c_custkey")
    text = F.concat_ws(" ", F.concat(F.lit("F"), F.col("c_nationkey")), c, (c * 2 + 1) % 2000, (c * 3 + 2) % 2500,
                       c % 3, c % 4)
    lines = table(spark, folder, "customer").select(text.alias("value"), F.lit(0).cast("bigint").alias("block"), c.alias("seq"))
    return complete_trios(parse_pedigree(lines)).drop("first_seen")


def median_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median depth of called genotypes per sample of the derived calls."""
    v = derive.trio_calls(spark, folder)
    calls = F.transform("calls", lambda c, i: F.struct(i.alias("sample_no"), c.alias("call")))
    d = depths_of(v.records.select("format", F.inline(calls)), {"d": F.col("call")}, ("sample_no",))
    return d.groupBy("sample_no").agg(F.median("d").alias("median_depth"), F.count("d").alias("n"))


def wilson_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Returned share per supplier with its Wilson interval."""
    g = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("ci", wilson_interval(F.col("k"), F.col("n")))
    return g.select("l_suppkey", "k", "n", F.round("ci.lo", 8).alias("lo"), F.round("ci.hi", 8).alias("hi"))


def binomial_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Tail probabilities of high discounts per supplier."""
    g = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") > 0.085).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("l_suppkey", "k", "n", F.round(binom_cdf(F.col("k"), F.col("n"), 0.18), 8).alias("cdf"),
                    F.round(binom_sf(F.col("k"), F.col("n"), 0.18), 8).alias("sf"))


def fisher_test(spark: SparkSession, folder: str) -> DataFrame:
    """Return flag against line status per supplier."""
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    g = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(r & o).alias("a"), F.count_if(r & ~o).alias("b"), F.count_if(~r & o).alias("c"), F.count_if(~r & ~o).alias("d"))
    return g.select("*", F.round(fisher_exact(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 8).alias("p"))


def log_sum_exp_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stable log of summed exponentials of every vector."""
    e = table(spark, folder, "embeddings")
    big = F.transform("embedding", lambda v: v.cast("double") * 900.0)
    return e.select("vec_id", F.round(log_sum_exp(big), 6).alias("lse"))


def evidence_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated rungs and point classes over part prices."""
    cal = CFG["annotation"]["calibration"]["REVEL"]
    p = table(spark, folder, "part").withColumn("v", F.round((F.col("p_retailprice") * 7) % 1000 / 1000, 4))
    up, down = lad.rung(F.col("v"), cal["pp3"], True), lad.rung(F.col("v"), cal["bp4"], False)
    points = (F.coalesce(lad.strength_points(up), F.lit(0)) - F.coalesce(lad.strength_points(down), F.lit(0))
              + F.col("p_size") % 9 - F.lit(2))
    return p.select(
        "p_partkey", F.when(up.isNotNull(), lad.label("PP3", up, "Supporting")).otherwise(
            F.when(down.isNotNull(), lad.label("BP4", down, "Supporting")).otherwise("")).alias("code"),
        points.alias("points"), lad.point_class(points).alias("class"))


def number_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed, scientific and shortest number texts of every line item."""
    li = table(spark, folder, "lineitem").withColumn("v", F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice", fixed(F.col("v"), 3).alias("f3"),
                     scientific(F.col("v"), 2).alias("e2"), general(F.col("v"), 4).alias("g4"),
                     general(F.col("l_extendedprice"), 6).alias("g6"))


def info_fields(spark: SparkSession, folder: str) -> DataFrame:
    """INFO text built from events and read back: last value wins, flags, first comma value."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    info = F.concat_ws(";", F.concat(F.lit("K="), k), F.when(F.col("user_id") % 2 == 0, F.lit("HOT")),
                       F.concat(F.lit("AF="), F.round("value", 2).cast("string"), F.lit(",9")),
                       F.when(F.col("user_id") % 3 == 0, F.lit("K=7")), F.concat(F.lit("TYPE="), "event_type"))
    x = e.select("event_id", info.alias("info"))
    i = F.col("info")
    return x.select("event_id", info_double(i, "K").alias("k"), info_double(i, "AF").alias("af"), info_flag(i, "HOT").alias("hot"),
                    info_text(i, "TYPE").alias("type"), info_text(i, "NONE").alias("none"))


def allele_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Alleles spelled with a shared ending, trimmed to the shortest equal pair."""
    o = table(spark, folder, "orders")
    bases = F.translate((F.col("o_orderkey") * 7919 + 100003).cast("string"), "0123456789", "ACGTACGTAC")
    other = F.translate((F.col("o_custkey") * 104729 + 10007).cast("string"), "0123456789", "ACGTACGTAC")
    x = o.select("o_orderkey", bases.alias("ref"), other.alias("alt")).withColumn("t", trim_suffix(F.col("ref"), F.col("alt")))
    return x.select("o_orderkey", F.col("t.ref").alias("ref"), F.col("t.alt").alias("alt"))


QUERIES = {
    "interval_merge": interval_merge,
    "interval_semi_join": interval_semi_join,
    "segment_first_match": segment_first_match,
    "cluster_flags": cluster_flags,
    "consensus_tiers": consensus_tiers,
    "cover_union": cover_union,
    "pedigree_trios": pedigree_trios,
    "median_depth": median_depth,
    "wilson_ci": wilson_ci,
    "binomial_tails": binomial_tails,
    "fisher_test": fisher_test,
    "log_sum_exp": log_sum_exp_rows,
    "evidence_ladder": evidence_ladder,
    "number_formats": number_formats,
    "info_fields": info_fields,
    "allele_trim": allele_trim,
}

_WINDOWS = """
WITH o AS (SELECT o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, o_orderkey FROM orders),
f AS (SELECT *, s + 30 AS e, CASE WHEN s <= max(s + 30) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS grp FROM f),
w AS (SELECT o_custkey, min(s) AS s, max(e) AS e FROM g GROUP BY o_custkey, grp)
"""

ORACLE = {
    "interval_merge": _WINDOWS + "SELECT o_custkey, s, e FROM w",
    "interval_semi_join": _WINDOWS + """
SELECT l_partkey AS o_custkey, l_returnflag, count(*) AS n FROM (
  SELECT l_partkey, l_returnflag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem) l
WHERE EXISTS (SELECT 1 FROM w WHERE w.o_custkey = l.l_partkey AND w.s <= d AND d < w.e) GROUP BY ALL
""",
    "segment_first_match": """
WITH s AS (SELECT s_nationkey AS axis, s_suppkey * 97 % 10000 AS a, s_suppkey * 97 % 10000 + 800 AS b, s_suppkey AS seg,
             round(s_acctbal, 2) AS cn FROM supplier),
c AS (SELECT c_custkey, c_nationkey AS axis, c_custkey * 37 % 10000 AS "at" FROM customer),
j AS (SELECT c.*, seg, cn, row_number() OVER (PARTITION BY c_custkey ORDER BY seg) AS r
      FROM c LEFT JOIN s ON s.axis = c.axis AND c."at" BETWEEN a AND b)
SELECT c_custkey, axis, "at", seg, cn FROM j WHERE r = 1
""",
    "cluster_flags": """
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS p FROM events)
SELECT event_id, user_id, coalesce(p - lag(p) OVER w <= 600, false) OR coalesce(lead(p) OVER w - p <= 600, false) AS clustered
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY p, event_id)
""",
    "consensus_tiers": """
WITH g AS (SELECT l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS callers,
  count(DISTINCT l_returnflag) AS k, max(l_discount) * 9.7 AS post, max(l_tax) AS tax FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, callers, CASE WHEN NOT tax > 0.01 THEN 'FAIL' WHEN k >= 3 AND (post >= 0.95 OR tax > 0.07) THEN 'HIGH'
  WHEN k >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM g
""",
    "cover_union": """
WITH o AS (SELECT o_custkey % 1000 AS who, o_orderkey % 50 AS what FROM orders),
e AS (SELECT user_id AS who, event_id % 70 AS what, event_type,
        row_number() OVER (PARTITION BY user_id, event_id % 70 ORDER BY event_id) AS r FROM events)
SELECT who, what, 'primary' AS source, count(*) AS n FROM o GROUP BY who, what
UNION ALL SELECT who, what, event_type, 1 FROM e WHERE r = 1 AND NOT EXISTS
  (SELECT 1 FROM o WHERE o.who = e.who AND o.what = e.what)
""",
    "pedigree_trios": """
WITH p AS (SELECT 'F' || c_nationkey AS family, c_custkey AS i, (c_custkey * 2 + 1) % 2000 AS f, (c_custkey * 3 + 2) % 2500 AS m,
             c_custkey % 3 AS sx, c_custkey % 4 AS af FROM customer)
SELECT family, CAST(i AS VARCHAR) AS proband, CAST(f AS VARCHAR) AS father, CAST(m AS VARCHAR) AS mother,
  CASE sx WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'unknown' END AS sex, af = 2 AS affected
FROM p WHERE f <> 0 AND m <> 0 AND f IN (SELECT i FROM p) AND m IN (SELECT i FROM p)
""",
    "median_depth": f"""
WITH d AS ({derive.numbers_sql()}),
s AS (SELECT 0 AS sample_no, kid_ref + kid_alt + spare AS x FROM d UNION ALL SELECT 1, kid2_ref + kid2_alt + spare FROM d
 UNION ALL SELECT 2, CASE WHEN dad_gt <> './.' THEN dad_ref + dad_alt + spare END FROM d
 UNION ALL SELECT 3, CASE WHEN mom_gt <> './.' THEN mom_ref + mom_alt END FROM d)
SELECT sample_no, median(x) AS median_depth, count(x) AS n FROM s WHERE x > 0 GROUP BY sample_no
""",
    "wilson_ci": """
WITH g AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey),
q AS (SELECT *, k * 1.0 / n AS p, 3.8416 AS z2 FROM g),
c AS (SELECT *, p + z2 / (2 * n) AS mid, 1.96 * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) AS half, 1 + z2 / n AS den FROM q)
SELECT l_suppkey, k, n, round(greatest(0, (mid - half) / den), 8) AS lo, round(least(1, (mid + half) / den), 8) AS hi FROM c
""",
    "binomial_tails": f"""
WITH g AS (SELECT l_suppkey, count(*) FILTER (l_discount > 0.085) AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, k, n, round({sql_cdf('k', 'n', '0.18')}, 8) AS cdf, round({sql_sf('k', 'n', '0.18')}, 8) AS sf FROM g
""",
    "fisher_test": f"""
WITH g AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS a,
  count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS c,
  count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS d FROM lineitem GROUP BY l_suppkey)
SELECT *, round({sql_fisher('a', 'b', 'c', 'd')}, 8) AS p FROM g
""",
    "log_sum_exp": """
SELECT vec_id, round(m + ln(list_sum(list_transform(v, lambda x: exp(x - m)))), 6) AS lse FROM (
  SELECT vec_id, v, list_max(v) AS m FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 900.0) AS v FROM embeddings))
""",
    "evidence_ladder": """
WITH p AS (SELECT p_partkey, p_size, round((p_retailprice * 7) % 1000 / 1000, 4) AS v FROM part),
r AS (SELECT *, CASE WHEN v >= 0.932 THEN 2 WHEN v >= 0.773 THEN 1 WHEN v >= 0.644 THEN 0 END AS up,
  CASE WHEN v <= 0.003 THEN 3 WHEN v <= 0.016 THEN 2 WHEN v <= 0.183 THEN 1 WHEN v <= 0.290 THEN 0 END AS down FROM p),
q AS (SELECT *, coalesce([1, 2, 4, 8][up + 1], 0) - coalesce([1, 2, 4, 8][down + 1], 0) + p_size % 9 - 2 AS points FROM r)
SELECT p_partkey, CASE WHEN up IS NOT NULL THEN 'PP3' || ['', '_Moderate', '_Strong', '_VeryStrong'][up + 1]
  WHEN down IS NOT NULL THEN 'BP4' || ['', '_Moderate', '_Strong', '_VeryStrong'][down + 1] ELSE '' END AS code, points,
  CASE WHEN points >= 10 THEN 'Pathogenic' WHEN points >= 6 THEN 'Likely_pathogenic' WHEN points >= 0 THEN 'VUS'
       WHEN points >= -6 THEN 'Likely_benign' ELSE 'Benign' END AS class FROM q
""",
    "number_formats": """
SELECT l_orderkey, l_linenumber, l_extendedprice, printf('%.3f', v) AS f3, printf('%.2e', v) AS e2, printf('%.4g', v) AS g4,
  printf('%.6g', l_extendedprice) AS g6 FROM (SELECT *, l_extendedprice * l_discount * l_tax AS v FROM lineitem)
""",
    "info_fields": """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 7.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
  round(value, 2) AS af, user_id % 2 = 0 AS hot, event_type AS type, CAST(NULL AS VARCHAR) AS none FROM events
""",
    "allele_trim": """
WITH o AS (SELECT o_orderkey, translate(CAST(o_orderkey * 7919 + 100003 AS VARCHAR), '0123456789', 'ACGTACGTAC') AS ref,
             translate(CAST(o_custkey * 104729 + 10007 AS VARCHAR), '0123456789', 'ACGTACGTAC') AS alt FROM orders),
n AS (SELECT *, list_max(list_filter(range(0, least(length(ref), length(alt))), lambda x: right(ref, x) = right(alt, x))) AS k FROM o)
SELECT o_orderkey, left(ref, CAST(length(ref) - k AS INT)) AS ref, left(alt, CAST(length(alt) - k AS INT)) AS alt FROM n
""",
}
