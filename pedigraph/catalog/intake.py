"""Queries over sample sheets, gates, site filters, exact annotation, engine sites and the evidence pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.catalog import derive
from pedigraph.catalog.derive import table
from pedigraph.operators import intake

# A sample sheet with one row per customer; both engines run this text.
SHEET = """
SELECT c_custkey AS line, concat('F', CAST(c_custkey // 3 AS VARCHAR(12))) AS family_id,
  CASE WHEN c_custkey % 101 = 7 THEN '' ELSE concat('S', CAST(CASE WHEN c_custkey % 53 = 11 THEN c_custkey - 1 ELSE c_custkey END AS VARCHAR(12))) END AS sample_id,
  CASE WHEN c_custkey % 47 = 3 THEN 'aunt' WHEN c_custkey % 3 = 0 THEN 'Proband' WHEN c_custkey % 3 = 1 THEN 'father' ELSE 'mother' END AS role,
  CASE WHEN c_custkey % 41 = 5 THEN 'both' WHEN c_custkey % 9 = 4 THEN '' WHEN c_custkey % 3 = 1 THEN 'male' ELSE 'FEMALE' END AS sex,
  CASE WHEN c_custkey % 37 = 6 THEN 'hair' WHEN c_custkey % 4 = 0 THEN 'Blood' ELSE '' END AS dna_source,
  CASE WHEN c_custkey % 5 = 0 THEN 'L1' ELSE '' END AS library, CASE WHEN c_custkey % 7 < 3 THEN '1' ELSE '' END AS lane,
  CASE WHEN c_custkey % 2 = 0 THEN 'x.bam' ELSE '' END AS bam,
  CASE WHEN c_custkey % 2 = 1 OR c_custkey % 29 = 2 THEN CASE WHEN c_custkey % 31 = 9 THEN 'a.fastq' ELSE 'a.fq.gz' END ELSE '' END AS fastq_1,
  CASE WHEN c_custkey % 2 = 1 AND c_custkey % 43 <> 8 THEN 'b.fastq.gz' ELSE '' END AS fastq_2
FROM {customer}
"""


def sheet_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Broken sample-sheet rules with every customer as a row."""
    sheet = spark.sql(SHEET.replace("//", "DIV"), customer=table(spark, folder, "customer"))
    return intake.sheet_findings(sheet)


def gate_passing(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as trios whose orders as gates hold no failed one."""
    trios = table(spark, folder, "customer").select(F.col("c_custkey").alias("family"), "c_name")
    gates = table(spark, folder, "orders").select(F.col("o_custkey").alias("family"),
                                                  F.when(F.col("o_orderkey") % 13 == 0, "fail").otherwise("PASS").alias("status"))
    return intake.passing_trios(trios, gates)


def _quality(spark, folder):
    n = derive.call_numbers(spark, folder)
    return n.select("k", "n", "chrom", "pos", "ref", "alt", (F.col("x") % 50 / 8).alias("QD"), F.when(F.col("p") % 9 != 0, F.col("q") * 2.0).alias("QUAL"),
                    (F.col("fs") * 3.0).alias("FS"), F.col("mq").cast("double").alias("MQ"), (F.col("mqr") * -1.1).alias("MQRankSum"),
                    (F.col("s") % 30 * -1.0).alias("ReadPosRankSum"), (F.col("sor10") / 4).alias("SOR"))


def hard_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Failed hard filters of every derived site."""
    return intake.site_filters(_quality(spark, folder)).select("k", "n", F.concat_ws(";", "site_filters").alias("site_filters"))


def exact_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """Frequencies, clinical labels and panel frequencies joined on the exact site."""
    n = derive.call_numbers(spark, folder).withColumn("seq", F.col("k") * 8 + F.col("n"))
    site = ["chrom", "pos", "ref", "alt"]
    rows = n.select(*site, "seq")
    sources = [(n.where("af5 is not null"), {"af5": "af"}), (n.where("clnsig is not null"), {"clnsig": "label"}), (n.where("pon3 is not null"), {"pon3": "pon"})]
    return intake.exact_annotation(rows, sources, site)


def engine_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites that either of two engines calls as a violation: odd lines are one engine's, even lines the other's."""
    n = derive.call_numbers(spark, folder).select("n", "chrom", "pos", F.col("kid_gt").alias("child_gt"), F.col("dad_gt").alias("father_gt"), F.col("mom_gt").alias("mother_gt"))
    return intake.violation_sites([n.where("n % 2 = 1"), n.where("n % 2 = 0")])


def mosaic_depths(spark: SparkSession, folder: str) -> DataFrame:
    """Allele depths at the sites a predictor calls mosaic."""
    n = derive.call_numbers(spark, folder)
    label = F.when(F.col("p") % 11 == 0, "mosaic").when(F.col("p") % 11 == 1, "mosaic;cautious").when(F.col("p") % 11 == 2, "het").otherwise("refhom")
    predicted = n.select(F.concat_ws("~", F.lit("kid"), "chrom", F.col("pos").cast("string"), "ref", "alt").alias("id"), label.alias("prediction"))
    depths = n.select("chrom", "pos", "ref", "alt", F.concat_ws(",", F.col("kid_ref").cast("string"), F.col("kid_alt").cast("string")).alias("ad_proband"))
    return intake.mosaic_candidates(predicted, depths)


def called_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Copy-number segments of the suppliers."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(
        (k % 22 + 1).cast("string").alias("chrom"), (k * 5000).alias("start"), (k * 5000 + 4000).alias("end"), (k % 6).alias("cn"),
        F.when(k % 4 != 0, k % 3).alias("cn1"), (k % 5).alias("cn2"))
    return intake.call_segments(rows)


def pooled_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item registers evidence under its part; suppliers re-rank; reviews are capped."""
    li = table(spark, folder, "lineitem")
    log = li.select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
                    (F.col("l_linenumber") % 3 + 1).cast("int").alias("tier"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("polarity"),
                    (F.col("l_quantity") / 50).alias("strength"), (F.col("l_tax") > 0.03).alias("is_independent"))
    k = F.col("s_suppkey")
    rerank = table(spark, folder, "supplier").select((k * 3).alias("id"), (k % 5 + 1).cast("int").alias("tier"), F.when(k % 2 == 0, k % 10 / 10).alias("strength"),
                                                     F.lit(None).cast("boolean").alias("is_independent"))
    return intake.evidence_pool(log, rerank)


QUERIES = {
    "sheet_rules": sheet_rules,
    "gate_passing": gate_passing,
    "hard_filters": hard_filters,
    "exact_annotation": exact_annotation,
    "engine_sites": engine_sites,
    "mosaic_depths": mosaic_depths,
    "called_segments": called_segments,
    "pooled_evidence": pooled_evidence,
}

_D = f"WITH d AS ({derive.numbers_sql()}) "


def _fails(rules, number):
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {number[f]} {'<' if lo is not None else '>'} {lo if lo is not None else hi} THEN '{n}' END" for n, f, lo, hi in rules) + ")"


_NUMBERS = {"QD": "x % 50 / 8", "QUAL": "CASE WHEN p % 9 <> 0 THEN q * 2.0 END", "FS": "fs * 3.0", "MQ": "mq", "MQRankSum": "mqr * -1.1",
            "ReadPosRankSum": "s % 30 * -1.0", "SOR": "sor10 / 4"}

ORACLE = {
    "sheet_rules": f"""
WITH r AS (SELECT line, family_id, sample_id, lower(role) AS role, CASE WHEN sex = '' THEN 'unknown' ELSE lower(sex) END AS sex, lower(dna_source) AS dna_source,
  library, lane, bam, fastq_1, fastq_2 FROM ({SHEET.replace('{customer}', 'customer')})),
l AS (SELECT 'line' AS scope, line::VARCHAR AS place, unnest([
  CASE WHEN family_id = '' OR sample_id = '' THEN 'ids_missing' END, CASE WHEN role = 'aunt' THEN 'role_unknown' END, CASE WHEN sex = 'both' THEN 'sex_unknown' END,
  CASE WHEN dna_source = 'hair' THEN 'dna_source_unknown' END, CASE WHEN bam <> '' AND fastq_1 || fastq_2 <> '' THEN 'bam_and_fastq' END,
  CASE WHEN bam = '' AND (fastq_1 = '' OR fastq_2 = '') THEN 'reads_missing' END,
  CASE WHEN bam = '' AND fastq_1 = 'a.fastq' AND fastq_2 <> '' THEN 'fastq_not_gzipped' END]) AS rule FROM r),
u AS (SELECT *, CASE WHEN lane <> '' THEN lane ELSE row_number() OVER (PARTITION BY sample_id ORDER BY line)::VARCHAR END AS unit FROM r),
s AS (SELECT 'sample' AS scope, sample_id AS place, unnest([
  {', '.join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN 'conflicting_{c}' END" for c in ('family_id', 'role', 'sex', 'dna_source', 'library'))},
  CASE WHEN bool_or(bam <> '') AND count(*) > 1 THEN 'bam_with_other_rows' END, CASE WHEN count(DISTINCT unit) <> count(*) THEN 'duplicate_lane' END]) AS rule
  FROM u GROUP BY sample_id),
f AS (SELECT 'family' AS scope, family_id AS place, unnest([
  {', '.join(f"CASE WHEN count(DISTINCT sample_id) FILTER (role = '{r}') <> 1 THEN 'not_one_{r}' END" for r in ('proband', 'father', 'mother'))}]) AS rule
  FROM r GROUP BY family_id)
SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM s UNION ALL SELECT * FROM f) WHERE rule IS NOT NULL""",
    "gate_passing": "SELECT c_custkey AS family, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 13 = 0)",
    "hard_filters": _D + f"SELECT k, n, CASE WHEN length(ref) = length(alt) THEN {_fails(intake.POINT_FILTERS, _NUMBERS)} ELSE {_fails(intake.LENGTH_FILTERS, _NUMBERS)} END AS site_filters FROM d",
    "exact_annotation": _D + """, e AS (SELECT *, k * 8 + n AS seq FROM d),
a AS (SELECT chrom, pos, ref, alt, arg_min(af5, seq) AS af FROM e WHERE af5 IS NOT NULL GROUP BY ALL),
b AS (SELECT chrom, pos, ref, alt, arg_min(clnsig, seq) AS label FROM e WHERE clnsig IS NOT NULL GROUP BY ALL),
c AS (SELECT chrom, pos, ref, alt, arg_min(pon3, seq) AS pon FROM e WHERE pon3 IS NOT NULL GROUP BY ALL)
SELECT chrom, pos, ref, alt, seq, af, label, pon FROM e LEFT JOIN a USING (chrom, pos, ref, alt) LEFT JOIN b USING (chrom, pos, ref, alt) LEFT JOIN c USING (chrom, pos, ref, alt)""",
    "engine_sites": _D + "SELECT DISTINCT chrom, pos FROM d WHERE kid_gt <> '0/0' AND dad_gt = '0/0' AND mom_gt = '0/0'",
    "mosaic_depths": _D + """, m AS (SELECT chrom, pos, min(CASE WHEN p % 11 = 0 THEN 'mosaic' ELSE 'mosaic;cautious' END) AS mf_prediction FROM d WHERE p % 11 < 2 GROUP BY ALL)
SELECT chrom, pos, ref, alt, kid_ref || ',' || kid_alt AS ad_proband, mf_prediction FROM d JOIN m USING (chrom, pos)""",
    "called_segments": """SELECT (s_suppkey % 22 + 1)::VARCHAR AS chrom, s_suppkey * 5000 AS start, s_suppkey * 5000 + 4000 AS "end", s_suppkey % 6 AS total_cn,
  CASE WHEN s_suppkey % 4 <> 0 THEN least(s_suppkey % 3, s_suppkey % 5) END AS minor_cn FROM supplier""",
    "pooled_evidence": """
WITH p AS (SELECT l_partkey AS id, arg_max({'t': l_linenumber % 3 + 1, 'p': CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END, 's': l_quantity / 50, 'i': l_tax > 0.03},
  l_orderkey * 8 + l_linenumber) AS e FROM lineitem GROUP BY 1),
q AS (SELECT id, coalesce(s_suppkey % 5 + 1, e.t)::INT AS tier, e.p AS polarity, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 10 / 10 END, e.s) AS strength,
  e.i AS is_independent, CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS hit FROM p LEFT JOIN supplier ON id = s_suppkey * 3)
SELECT id, tier, polarity, CASE WHEN tier = 1 AND strength > 0.4 THEN 0.4 ELSE strength END AS strength, is_independent,
  hit + CASE WHEN tier = 1 AND strength > 0.4 THEN 1 ELSE 0 END AS adjusted FROM q""",
}
