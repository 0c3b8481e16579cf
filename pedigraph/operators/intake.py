"""Checks and joins around the cascade: sample sheets, gates, site filters, exact annotation, engine sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

# What a sample sheet may say.
ROLES = ("proband", "father", "mother", "tumor", "tissue")
SEXES = ("male", "female", "unknown")
SOURCES = ("", "blood", "saliva", "lcl", "tissue")
SHEET = ("family_id", "sample_id", "role", "sex", "dna_source", "library", "lane", "bam", "fastq_1", "fastq_2")

# Hard site filters per class, (name, field, least, most); a missing field passes.
POINT_FILTERS = (("QD2", "QD", 2.0, None), ("QUAL30", "QUAL", 30.0, None), ("FS60", "FS", None, 60.0), ("MQ40", "MQ", 40.0, None),
                 ("MQRS", "MQRankSum", -12.5, None), ("RPRS8", "ReadPosRankSum", -8.0, None), ("SOR3", "SOR", None, 3.0))
LENGTH_FILTERS = (("QD2", "QD", 2.0, None), ("QUAL30", "QUAL", 30.0, None), ("FS200", "FS", None, 200.0),
                  ("RPRS20", "ReadPosRankSum", -20.0, None), ("SOR10", "SOR", None, 10.0))


def sheet_findings(sheet: DataFrame) -> DataFrame:
    """(scope, place, rule) for every broken rule of a sample sheet; an empty result is a clean sheet.

    ``sheet`` has the text columns of SHEET and ``line``; null and empty cells are alike.
    Line rules look at one row, sample and family rules at grouped counts.
    """
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in SHEET}
    rows = sheet.select("line", *[(F.lower(v) if c in ("role", "sex", "dna_source") else v).alias(c) for c, v in text.items()]).withColumn(
        "sex", F.when(F.col("sex") == "", "unknown").otherwise(F.col("sex")))
    has = lambda c: F.col(c) != ""
    packed = lambda c: F.col(c).rlike(r"\.(fastq|fq)\.gz$")
    pair = has("fastq_1") & has("fastq_2")
    rules = {
        "ids_missing": ~has("family_id") | ~has("sample_id"), "role_unknown": ~F.col("role").isin(*ROLES), "sex_unknown": ~F.col("sex").isin(*SEXES),
        "dna_source_unknown": ~F.col("dna_source").isin(*SOURCES), "bam_and_fastq": has("bam") & (has("fastq_1") | has("fastq_2")),
        "reads_missing": ~has("bam") & ~pair, "fastq_not_gzipped": ~has("bam") & pair & ~(packed("fastq_1") & packed("fastq_2")),
    }
    by_line = _broken(rows, "line", F.col("line").cast("string"), rules)
    unit = rows.withColumn("unit", F.when(has("lane"), F.col("lane")).otherwise(
        F.row_number().over(W.partitionBy("sample_id").orderBy("line")).cast("string")))
    facts = unit.groupBy("sample_id").agg(
        *[F.count_distinct(c).alias(c) for c in ("family_id", "role", "sex", "dna_source", "library", "unit")],
        F.bool_or(has("bam")).alias("any_bam"), F.count(F.lit(1)).alias("n"))
    by_sample = _broken(facts, "sample", F.col("sample_id"), {
        **{f"conflicting_{c}": F.col(c) > 1 for c in ("family_id", "role", "sex", "dna_source", "library")},
        "bam_with_other_rows": F.col("any_bam") & (F.col("n") > 1), "duplicate_lane": F.col("unit") != F.col("n")})
    members = rows.groupBy("family_id").agg(*[F.count_distinct(F.when(F.col("role") == r, F.col("sample_id"))).alias(r) for r in ROLES[:3]])
    by_family = _broken(members, "family", F.col("family_id"), {f"not_one_{r}": F.col(r) != 1 for r in ROLES[:3]})
    return by_line.unionByName(by_sample).unionByName(by_family)


def _broken(rows: DataFrame, scope: str, place: Column, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return rows.select(F.lit(scope).alias("scope"), place.alias("place"), F.explode(found).alias("rule"))


def passing_trios(trios: DataFrame, gates: DataFrame, key: str = "family") -> DataFrame:
    """Trios of which no gate says FAIL; a trio without a gate passes."""
    return trios.join(gates.where(F.upper("status") == "FAIL").select(key).distinct(), key, "left_anti")


def site_filters(rows: DataFrame) -> DataFrame:
    """Add ``site_filters``: names of the hard filters a site fails, by the class of its alleles."""
    def failed(rules):
        return F.array_compact(F.array(*[
            F.when(F.coalesce(F.col(field) < least if least is not None else F.col(field) > most, F.lit(False)), F.lit(name))
            for name, field, least, most in rules]))
    point = F.length("ref") == F.length("alt")
    return rows.withColumn("site_filters", F.when(point, failed(POINT_FILTERS)).otherwise(failed(LENGTH_FILTERS)))


def exact_annotation(rows: DataFrame, sources: list[tuple[DataFrame, dict[str, str]]], site: list[str], order: str = "seq") -> DataFrame:
    """Left joins on the exact site; each source is (frame, field -> new name), its first row of a site counts."""
    for frame, names in sources:
        picked = frame.groupBy(*site).agg(F.min_by(F.struct(*[F.col(f).alias(n) for f, n in names.items()]), order).alias("_a"))
        rows = rows.join(picked, site, "left").select(*rows.columns, *[F.col(f"_a.{n}").alias(n) for n in names.values()])
    return rows


def violation_sites(engines: list[DataFrame], child: str = "child_gt", father: str = "father_gt", mother: str = "mother_gt") -> DataFrame:
    """(chrom, pos) seen by any engine where the child is called with an ALT and both parents are called without one."""
    def plain(c):
        return F.coalesce(F.col(c).rlike(r"^0([/|]0)*$"), F.lit(False))
    called = F.coalesce(~F.col(child).contains("."), F.lit(False))
    kept = [e.where(called & ~plain(child) & plain(father) & plain(mother)).select("chrom", "pos") for e in engines]
    return reduce(DataFrame.unionByName, kept).distinct()


def mosaic_candidates(predictions: DataFrame, depths: DataFrame) -> DataFrame:
    """Allele depths at the sites predicted mosaic; ids are sample~chrom~pos~ref~alt, labels may carry a suffix."""
    part = F.split("id", "~")
    sites = predictions.where(F.col("prediction").startswith("mosaic")).select(
        F.get(part, F.lit(1)).alias("chrom"), F.get(part, F.lit(2)).cast("bigint").alias("pos"), F.col("prediction").alias("mf_prediction"))
    first = sites.groupBy("chrom", "pos").agg(F.min("mf_prediction").alias("mf_prediction"))
    return depths.join(first, ["chrom", "pos"])


def call_segments(calls: DataFrame) -> DataFrame:
    """(chrom, start, end, total_cn, minor_cn) of called copy-number rows; no allele split gives no minor copy number."""
    return calls.select("chrom", "start", "end", F.col("cn").alias("total_cn"), F.when(F.col("cn1").isNotNull(), F.least("cn1", "cn2")).alias("minor_cn"))


def evidence_pool(log: DataFrame, rerank: DataFrame | None = None, cap: float = 0.4) -> DataFrame:
    """The shared evidence pool: the last registration of an id counts, explicit ranks replace, reviews are capped.

    ``log`` has id, seq, tier (1 is a review), polarity, strength, is_independent; ``rerank``
    may give tier, strength and is_independent per id.  ``adjusted`` counts both changes.
    """
    rest = [c for c in log.columns if c not in ("id", "seq")]
    pool = log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("id", "e.*").withColumn("adjusted", F.lit(0))
    if rerank is not None:
        new = rerank.select("id", *[F.col(c).alias(f"_{c}") for c in ("tier", "strength", "is_independent")], F.lit(1).alias("_hit"))
        pool = pool.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("tier", "strength", "is_independent")}).withColumn(
            "adjusted", F.coalesce("_hit", F.lit(0))).select(*pool.columns)
    high = (F.col("tier") == 1) & (F.col("strength") > cap)
    return pool.withColumns({"strength": F.when(high, F.lit(cap)).otherwise(F.col("strength")), "adjusted": F.col("adjusted") + high.cast("int")})
