"""Variant, pedigree and evidence inputs derived from the tables, row for row.

``lineitem`` becomes call-file lines of two trios with shared parents: one line per
row, so the work of the cascade grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.operators.common import computed
from pedigraph.session import tuned
from pedigraph.sources.tables import Trio
from pedigraph.sources.vcf import VcfFile, VcfHeader, parse_records

SAMPLES = ("kid", "kid2", "dad", "mom")
TRIOS = [Trio("F1", "kid", "dad", "mom", "male"), Trio("F1", "kid2", "dad", "mom", "female")]
DEPTH = {"kid": 32.0, "kid2": 30.0, "dad": 30.0, "mom": 31.0}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The plain numbers behind a derived call line; both engines run this text.
CALL_NUMBERS = """
SELECT k, n, p, s, q, x, dc, tx, rf, ls,
       CASE WHEN s % 25 < 22 THEN concat('chr', CAST(s % 25 + 1 AS VARCHAR(2)))
            WHEN s % 25 = 22 THEN 'chrX' WHEN s % 25 = 23 THEN 'chrY' ELSE 'chrM' END AS chrom,
       1 + (k * 7919 + p * 131 + n * 17) % 3000000 AS pos,
       CASE WHEN p % 20 = 0 THEN concat(substr('ACGT', b, 1), 'AT')
            WHEN p % 20 = 2 THEN concat(substr('ACGT', b, 1), 'A') ELSE substr('ACGT', b, 1) END AS ref,
       CASE WHEN p % 97 = 5 THEN '*'
            WHEN p % 20 = 0 THEN substr('ACGT', b, 1)
            WHEN p % 20 = 1 THEN concat(substr('ACGT', b, 1), 'CA')
            WHEN p % 20 = 2 THEN concat(substr('CGTA', b, 1), 'C')
            WHEN p % 8 >= 4 THEN substr('GTAC', b, 1) ELSE substr('CGTA', b, 1) END AS alt,
       CASE WHEN s % 11 = 0 THEN 'LowQual' WHEN s % 11 = 1 THEN '.' ELSE 'PASS' END AS filt,
       CASE WHEN rf = 'R' THEN '0/0' WHEN rf = 'A' THEN '0/1' WHEN ls = 'O' THEN '1/1' ELSE '0|1' END AS kid_gt,
       CASE WHEN rf = 'N' AND ls = 'O' THEN x % 3 ELSE x % 40 END AS kid_ref,
       CASE WHEN rf = 'R' THEN q % 5 ELSE q END AS kid_alt,
       CASE WHEN n % 2 = 0 THEN '0/1' ELSE '0/0' END AS kid2_gt,
       p % 35 AS kid2_ref,
       CASE WHEN n % 2 = 0 THEN (x // 7) % 30 ELSE q % 4 END AS kid2_alt,
       CASE WHEN dc >= 9 THEN '0/1' WHEN dc = 8 THEN './.' ELSE '0/0' END AS dad_gt,
       12 + x % 37 AS dad_ref,
       CASE WHEN dc >= 9 THEN p % 25 WHEN dc IN (6, 7) THEN dc - 4 WHEN dc = 5 THEN 1 ELSE 0 END AS dad_alt,
       CASE WHEN tx = 8 THEN '0/1' WHEN tx = 7 THEN './.' ELSE '0/0' END AS mom_gt,
       10 + (x // 40) % 45 AS mom_ref,
       CASE WHEN tx = 8 THEN s % 20 WHEN tx = 6 THEN 2 + p % 5 ELSE 0 END AS mom_alt,
       10 + p % 80 AS kid_gq, 12 + k % 75 AS kid2_gq, 15 + k % 70 AS dad_gq, 15 + s % 70 AS mom_gq,
       k % 3 AS spare,
       30 + p % 35 AS mq, x % 90 AS fs, s % 50 AS sor10, k % 14 AS mqr,
       CASE WHEN p % 6 = 0 THEN p % 50 END AS af5,
       CASE WHEN p % 7 = 0 THEN s % 30 END AS pon3,
       CASE WHEN p % 30 = 0 THEN 'Pathogenic' WHEN p % 30 = 6 THEN 'Conflicting_pathogenic' END AS clnsig,
       k % 4 = 0 AS hi, ls = 'F' AS has_pl, p % 3 = 0 AS has_sb,
       CASE WHEN p % 9 = 0 THEN 0 ELSE q // 2 END AS sb_cut
FROM (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q,
             CAST(floor(l_extendedprice) AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS dc,
             CAST(round(l_tax * 100) AS BIGINT) AS tx, l_returnflag AS rf, l_linestatus AS ls,
             CAST(l_partkey % 4 + 1 AS INT) AS b
      FROM {lineitem}) z
"""


def numbers_sql(relation: str = "lineitem") -> str:
    return CALL_NUMBERS.replace("{lineitem}", relation)


def call_numbers(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    )
    text = numbers_sql("{lineitem}").replace("//", "DIV")
    # the lines of an order stay together, whatever the splits of the file are
    return spark.sql(text, lineitem=used.repartition("l_orderkey"))


def call_lines(numbers: DataFrame) -> DataFrame:
    """VCF text (column ``value``) with the file-order key the readers expect."""

    def sample(name, with_dp):
        r, a, gt = (F.col(f"{name}_{x}") for x in ("ref", "alt", "gt"))
        dp = r + a
        pl = F.when(
            F.col("has_pl"),
            F.when(gt == "0/0", F.concat_ws(",", F.lit("0"), (dp * 3).cast("string"), (dp * 30).cast("string")))
            .when(gt.isin("0/1", "0|1"), F.concat_ws(",", (a * 30).cast("string"), F.lit("0"), (r * 30).cast("string")))
            .when(gt == "1/1", F.concat_ws(",", (dp * 30).cast("string"), (dp * 3).cast("string"), F.lit("0")))
            .otherwise("."),
        ).otherwise(".")
        depth = (dp + F.col("spare")).cast("string") if with_dp else F.lit(".")
        cut = F.least(F.col("sb_cut"), a)
        half = F.floor(r / 2)
        sb = F.when(F.col("has_sb"), F.concat_ws(",", half.cast("string"), (r - half).cast("string"),
                                                 cut.cast("string"), (a - cut).cast("string"))).otherwise(".")
        return F.concat_ws(":", gt, F.concat_ws(",", r.cast("string"), a.cast("string")), depth,
                           F.col(f"{name}_gq").cast("string"), pl, sb)

    def tag(key, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), value))

    info = F.concat_ws(
        ";", tag("MQ", F.col("mq").cast("string")), tag("FS", F.col("fs").cast("string")),
        tag("SOR", F.concat((F.floor(F.col("sor10") / 10)).cast("string"), F.lit("."), (F.col("sor10") % 10).cast("string"))),
        tag("MQRankSum", (-F.col("mqr")).cast("string")),
        tag("gnomAD_AF", F.concat(F.lit("0.000"), F.lpad(F.col("af5").cast("string"), 2, "0"))),
        tag("PON_AF", F.concat(F.lit("0.0"), F.lpad(F.col("pon3").cast("string"), 2, "0"))),
        tag("CLNSIG", F.col("clnsig")), F.when(F.col("hi"), F.lit("hiConfDeNovo=kid,other")),
    )
    value = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), F.concat_ws("_", F.col("k").cast("string"), F.col("n").cast("string")),
        "ref", "alt", F.lit("50"), "filt", info, F.lit("GT:AD:DP:GQ:PL:SB"),
        sample("kid", True), sample("kid2", True), sample("dad", True), sample("mom", False),
    )
    return computed(numbers, value=value).select(
        "value", F.lit("derived").alias("file"), F.lit(0).cast("bigint").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def trio_calls(spark: SparkSession, folder: str) -> VcfFile:
    lines = call_lines(call_numbers(tuned(spark), folder))
    return VcfFile(VcfHeader("derived", (), SAMPLES), parse_records(lines))
