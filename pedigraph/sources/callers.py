"""Sites of independent callers, panel-of-normals frequencies and caller-text converters."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pedigraph.functions.genotype import format_field, gt_called, gt_carries_alt, gt_text
from pedigraph.functions.numeric import to_double
from pedigraph.functions.text import bare_chrom, info_double
from pedigraph.operators.common import computed
from pedigraph.session import exists
from pedigraph.sources.tables import last_by
from pedigraph.sources.text import read_lines
from pedigraph.sources.vcf import is_vcf, read_vcf, reject_binary, require_samples

SITE = ["contig", "pos", "ref", "alt"]


def warn(message: str) -> None:
    print(f"WARNING: {message}", file=sys.stderr)


def alleles(records: DataFrame) -> DataFrame:
    """One row per record and ALT, keyed by contig without ``chr``."""
    return records.select("*", F.explode(F.concat(F.array("alt"), F.col("extra_alts"))).alias("_alt")).select(
        *[c for c in records.columns if c != "alt"], F.col("_alt").alias("alt"), bare_chrom(F.col("chrom")).alias("contig")
    )


def _vcf_sites(spark: SparkSession, path: str, probands: list[str] | None) -> DataFrame:
    vcf = read_vcf(spark, path)
    passing = vcf.records.where(F.col("filter").isin("PASS", "."))
    if not probands:
        return alleles(passing).select(F.lit("").alias("proband"), *SITE)
    keys = F.split("format", ":")
    for name in probands:
        if vcf.samples and name not in vcf.samples:
            warn(f"caller file {path}: proband {name} is not among its samples ({', '.join(vcf.samples)}); "
                 f"the proband-carries-ALT check is not applied")

    def carried(name: str) -> Column:
        if name not in vcf.samples:
            return F.lit(True)
        gt = gt_text(F.split(F.get("calls", F.lit(vcf.header.sample_index(name))), ":"), keys)
        return ~gt_called(gt) | gt_carries_alt(gt)

    named = F.array(*[F.struct(F.lit(p).alias("proband"), carried(p).alias("carried")) for p in probands])
    return alleles(passing.withColumn("_p", named)).select(F.inline("_p"), *SITE).where("carried").drop("carried")


def _tsv_sites(spark: SparkSession, path: str, probands: list[str] | None) -> DataFrame:
    exists(path)
    f = F.split("value", "\t")
    pos = F.get(f, F.lit(1))
    rows = read_lines(spark, path).where(
        (F.trim("value") != "") & ~F.col("value").startswith("#")
        & ~F.lower(F.get(f, F.lit(0))).isin("chrom", "chr") & pos.rlike("^[0-9]+$")
    )
    return rows.select(
        F.explode(F.array(*[F.lit(p) for p in (probands or [""])])).alias("proband"),
        bare_chrom(F.get(f, F.lit(0))).alias("contig"), pos.cast("bigint").alias("pos"),
        F.get(f, F.lit(2)).alias("ref"), F.get(f, F.lit(3)).alias("alt"),
    )


def caller_sites(spark: SparkSession, name: str, path: str, probands: list[str] | None = None) -> DataFrame:
    """(caller, proband, contig, pos, ref, alt), distinct; a comma list of files is one caller."""
    parts = []
    for one in path.split(","):
        reject_binary(one)
        exists(one)
        parts.append((_vcf_sites if is_vcf(one) else _tsv_sites)(spark, one, probands))
    sites = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return sites.select(F.lit(name).alias("caller"), "proband", *SITE)


def all_caller_sites(spark: SparkSession, callers: dict[str, str], probands: list[str] | None = None) -> DataFrame | None:
    frames = [caller_sites(spark, n, p, probands) for n, p in callers.items()]
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None


def site_frequency(records: DataFrame) -> DataFrame:
    """(contig, pos, ref, alt, pon_af): INFO/AF, else the share of called samples with ALT; last row wins."""
    keys = F.split("format", ":")
    gts = F.transform(F.col("calls"), lambda c: gt_text(F.split(c, ":"), keys))
    called = F.filter(gts, gt_called)
    carriers = F.size(F.filter(called, gt_carries_alt))
    share = F.when(F.size("calls") > 0, carriers / F.greatest(F.size(called), F.lit(1)))
    rows = records.select(
        bare_chrom(F.col("chrom")).alias("contig"), "pos", "ref", "alt",
        F.coalesce(info_double(F.col("info"), "AF"), share, F.lit(0.0)).alias("pon_af"), "block", "seq",
    )
    return last_by(rows, SITE).drop("block", "seq")


def read_site_frequency(spark: SparkSession, path: str | None) -> DataFrame | None:
    return site_frequency(read_vcf(spark, path).records) if path else None


# --------------------------------------------------------------------------- #
# Converters
# --------------------------------------------------------------------------- #
# Accepted spellings of the tokens of the de novo caller's text.
DNG_NAMES = {
    "chrom": ("ref_name", "chr", "chrom"),
    "pos": ("coor", "pos", "position"),
    "ref": ("ref_base", "ref"),
    "alt": ("ALT", "alt", "alt_base"),
    "pp": ("pp_dnm",),
}


def denovo_text_sites(lines: DataFrame, min_pp: float = 0.5) -> DataFrame:
    """(chrom, pos, ref, alt, pp_dnm) from ``key: value`` caller lines, one row per ALT.

    The child's genotype (``tgt_dnm``) overrides the ALT list of a one-base REF.
    """
    def token(name):
        found = F.regexp_extract("value", rf"(?:^|\s){name}:\s+(\S+)", 1)
        return F.when(F.col("value").contains(name.removesuffix(r"\S*")), F.nullif(found, F.lit("")))

    def first(key):
        return F.coalesce(*[token(n) for n in DNG_NAMES[key]])

    # each token is cut out once: the filters below look at the finished texts
    rows = computed(lines.where(F.col("value").startswith("DENOVO-")).select("value"), **{k: first(k) for k in DNG_NAMES},
                    child=F.get(F.split(token(r"tgt_dnm\S*"), "/"), F.lit(0))).drop("value")
    bases = F.array_sort(F.array_distinct(F.filter(F.split("child", ""), lambda b: (b != F.col("ref")) & (b != ""))))
    named = F.split("alt", ",")
    use_child = F.col("child").isNotNull() & (F.length("ref") == 1) & (F.size(bases) > 0)
    whole = rows.where(
        F.col("chrom").isNotNull() & F.col("pos").isNotNull() & F.col("ref").isNotNull() & F.col("pp").isNotNull()
        & (F.col("alt").isNotNull() | F.coalesce(use_child, F.lit(False)))
    )
    return (
        whole.where(to_double(F.col("pp")) >= min_pp)
        .select("chrom", "pos", "ref", F.explode(F.when(use_child, bases).otherwise(named)).alias("alt"),
                F.col("pp").alias("pp_dnm"))
        .where(F.col("alt") != F.col("ref"))
    )


def mosaic_sites_bed(records: DataFrame, header, sample: str, min_vaf: float = 0.03, max_vaf: float = 0.40) -> DataFrame:
    """(chrom, start, end, ref, alt, sample): passing biallelic SNVs with the sample's AF in range."""
    require_samples(header, [sample], "sample")
    keys = F.split("format", ":")
    call = F.split(F.get("calls", F.lit(header.sample_index(sample))), ":")
    af = to_double(F.get(F.split(format_field(call, keys, "AF"), ","), F.lit(0)))
    base = r"^[ACGTacgt]$"
    return records.where(
        F.col("filter").isin("PASS", ".") & (F.size("extra_alts") == 0)
        & F.col("ref").rlike(base) & F.col("alt").rlike(base) & af.between(min_vaf, max_vaf)
    ).select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "ref", "alt",
             F.lit(sample).alias("sample"))
