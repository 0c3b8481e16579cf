"""Queries over side inputs: panels and recurrence, reference context, pileups, parent of origin, caller text, second hits, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.catalog import derive
from pedigraph.catalog.cascade import CFG
from pedigraph.catalog.derive import table
from pedigraph.config import load_config
from pedigraph.functions import coerce as co
from pedigraph.operators import layers
from pedigraph.operators.strand import pileup_counts, with_pileup
from pedigraph.plans.somatic import hit_evidence, two_hit_table
from pedigraph.sources.callers import denovo_text_sites
from pedigraph.sources.fasta import with_window
from pedigraph.sources.tables import parse_parent_of_origin

SITE = ["contig", "pos", "ref", "alt"]
WIDE = load_config(**{"regions": {**CFG["regions"], "n_pad": 30}})


def _numbers(spark, folder):
    return derive.call_numbers(spark, folder).withColumn("contig", F.expr("substr(chrom, 4)")).withColumn("seq", F.col("k") * 8 + F.col("n"))


def population_sides(spark: SparkSession, folder: str) -> DataFrame:
    """The population layer with a panel-of-normals table and a recurrence table joined by site."""
    n = _numbers(spark, folder)
    info = F.concat_ws(";", F.when(F.col("af5").isNotNull(), F.concat(F.lit("gnomAD_AF=0.000"), F.lpad(F.col("af5").cast("string"), 2, "0"))),
                       F.when(F.col("pon3").isNotNull(), F.concat(F.lit("PON_AF=0.0"), F.lpad(F.col("pon3").cast("string"), 2, "0"))),
                       F.when(F.col("clnsig").isNotNull(), F.concat(F.lit("CLNSIG="), F.col("clnsig"))))
    pon = n.where("p % 5 = 0").groupBy(*SITE).agg((F.max(F.col("s") % 40) / 1000).alias("pon_af"))
    recurrence = n.where("p % 3 = 0").groupBy(*SITE).agg(F.max(F.col("q") % 9).cast("bigint").alias("n_trios"))
    rows = n.select(*SITE, "seq", info.alias("info")).join(pon, SITE, "left").join(recurrence, SITE, "left")
    x = layers.population_layer(rows, CFG)
    return x.select("seq", F.concat_ws(";", "L4_population").alias("reasons"), F.concat_ws(";", "population_flags").alias("flags"))


# Reference pieces of 256 bases per supplier; both engines run this text.
PIECES = """
SELECT concat('chr', CAST(s_suppkey % 22 + 1 AS VARCHAR(2))) AS chrom, s_suppkey // 22 AS chunk, s_suppkey // 22 * 256 + 1 AS first,
  substr(concat(translate(md5(CAST(s_suppkey AS VARCHAR(12))), '0123456789abcdef', 'ACGTACGTACGTACGT'), repeat('T', s_suppkey % 13),
    CASE WHEN s_suppkey % 5 = 0 THEN 'N' ELSE 'G' END, repeat(translate(md5(concat('x', CAST(s_suppkey AS VARCHAR(12)))), '0123456789abcdef', 'TGCATGCATGCATGCA'), 8)), 1, 256) AS seq
FROM {supplier}
"""


def reference_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context, homopolymer and near-N of every line item inside its supplier's reference piece, with a pad of 30."""
    pieces = spark.sql(PIECES.replace("//", "DIV"), supplier=table(spark, folder, "supplier")).withColumnRenamed("seq", "seq_ref")
    s, key = F.col("l_suppkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        key.alias("rec"), F.concat(F.lit("chr"), (s % 22 + 1).cast("string")).alias("chrom"), (F.expr("l_suppkey DIV 22") * 256 + 33 + key % 190).alias("pos"),
        F.lit("A").alias("ref"), F.when(key % 3 == 0, "AC").otherwise("G").alias("alt"), F.lit(None).cast("array<string>").alias("masks")).repartition("rec")  # a table has few row groups
    x = layers.region_layer(with_window(rows, pieces, 30, 31, 256), WIDE, True)
    return x.select("rec", "context", "homopolymer", F.concat_ws(";", "L3_region").alias("reasons"))


def pileup_join(spark: SparkSession, folder: str) -> DataFrame:
    """Strand counts of pileup records found by candidates whose alleles end in other shared bases."""
    n = _numbers(spark, folder).where("alt <> '*'")
    text = F.concat_ws(":", F.lit("0,0"), F.concat_ws(",", "kid_ref", "sb_cut"), F.concat_ws(",", "kid_alt", (F.col("q") - F.col("sb_cut"))))
    records = n.where("n % 2 = 1").select("chrom", "pos", "ref", "alt", F.array(F.lit("<*>")).alias("extra_alts"), F.lit("AD:ADF:ADR").alias("format"),
                                          F.array(text.cast("string")).alias("calls"), F.lit(0).cast("bigint").alias("block"), "seq")
    asked = n.select(F.lit("kid").alias("proband"), "contig", "pos", F.concat("ref", F.lit("GG")).alias("ref"), F.concat("alt", F.lit("GG")).alias("alt"), "seq")
    found = with_pileup(asked, pileup_counts(records, ("kid",), ["kid"]))
    return found.select("seq", "pileup.ref_fwd", "pileup.ref_rev", "pileup.alt_fwd", "pileup.alt_rev")


def parent_of_origin(spark: SparkSession, folder: str) -> DataFrame:
    """The last known parent of origin of each site, sample ids before keywords."""
    n = _numbers(spark, folder)
    word = F.element_at(F.array(*[F.lit(w) for w in ("dad", "mom", "Paternal", "mat", "father", "unclear", "")]), (F.col("p") % 7 + 1).cast("int"))
    return parse_parent_of_origin(n.select("chrom", "pos", word.alias("origin"), F.lit(0).alias("block"), "seq"), "dad", "mom")


def caller_text(spark: SparkSession, folder: str) -> DataFrame:
    """Sites from the text lines of a de novo caller, one line per line item."""
    n = _numbers(spark, folder)
    line = F.concat_ws(" ", F.when(F.col("p") % 10 == 0, "NOTE").otherwise("DENOVO-SNP"), F.lit("ref_name:"), "chrom", F.lit("coor:"), F.col("pos").cast("string"),
                       F.lit("ref_base:"), "ref", F.lit("ALT:"), "alt", F.lit("pp_dnm:"), F.concat(F.lit("0."), F.lpad((F.col("x") % 100).cast("string"), 2, "0")),
                       F.when(F.col("p") % 4 == 0, F.concat(F.lit("tgt_dnm(kid): "), "ref", F.lit("T/x"))))
    return denovo_text_sites(n.select(line.alias("value")))


def second_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Germline hits of the suppliers with the passing somatic rows of their genes and LOH over them."""
    k = F.col("s_suppkey")
    hits = table(spark, folder, "supplier").select(
        F.concat(F.lit("G"), k * 4).alias("gene"), k.alias("hit_no"), F.concat(F.lit("germline:"), k).alias("desc"), (k % 3 == 0).alias("loh"),
        F.lit("chr5").alias("chrom"), (k * 100).alias("start"), (k * 100 + 50).alias("end"), (k % 4).cast("double").alias("total_cn"))
    n = _numbers(spark, folder)
    rows = n.where("alt <> '*'").select("chrom", "pos", "ref", "alt", "seq", F.concat(F.lit("G"), "p").alias("gene"), F.when(F.col("p") % 8 == 0, "p.A1T").otherwise("").alias("hgvsp"),
                                        (F.col("q") / 64).alias("tv"), F.when(F.col("k") % 5 == 0, "PASS").otherwise("FILTERED").alias("status"))
    return two_hit_table(hit_evidence(rows, hits, ["seq"]), ["seq"])


WORDS = ("human_genetics", " Animal ", "CRISPR", "opinion", "", "negative", "+", "Refuted", "inconclusive", "risk", "yes", "1", "drug", "cell_state", "lof", "mouse", "whatever")


def word_values(spark: SparkSession, folder: str) -> DataFrame:
    """Loose words to tiers, polarities, signs, types and truth values, one word per order."""
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("o_orderkey") % len(WORDS) + 1).cast("int"))
    w = F.col("w")
    return table(spark, folder, "orders").select("o_orderkey", word.alias("w")).select(
        "o_orderkey", co.tier(w).alias("tier"), co.polarity(w).alias("polarity"), co.sign(w).alias("sign"), co.node_type(w).alias("node_type"),
        co.experiment_type(w, ["human_tissue"]).alias("experiment_type"), co.truth(w).alias("truth"))


QUERIES = {
    "population_sides": population_sides,
    "reference_context": reference_context,
    "pileup_join": pileup_join,
    "parent_of_origin": parent_of_origin,
    "caller_text": caller_text,
    "second_hits": second_hits,
    "word_values": word_values,
}

_D = f"WITH d AS (SELECT *, substr(chrom, 4) AS contig, k * 8 + n AS seq FROM ({derive.numbers_sql()})) "


def _choice(words: dict, default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in words.items())
    return f"CASE lower(trim(w)) {cases} ELSE {default} END"


def _groups(groups: dict) -> dict:
    return {w: name for name, words in groups.items() for w in words}


def _run(at: str) -> str:
    lead = "^(A+|C+|G+|T+)"
    return (f"CASE WHEN {at} BETWEEN 1 AND length(win) AND substr(win, {at}, 1) <> 'N' THEN length(regexp_extract(reverse(substr(win, 1, {at})), '{lead}')) "
            f"+ length(regexp_extract(substr(win, {at}), '{lead}')) - 1 ELSE 0 END")


ORACLE = {
    "population_sides": _D + """, pn AS (SELECT contig, pos, ref, alt, max(s % 40) / 1000 AS pon_af FROM d WHERE p % 5 = 0 GROUP BY ALL),
rc AS (SELECT contig, pos, ref, alt, max(q % 9) AS nt FROM d WHERE p % 3 = 0 GROUP BY ALL),
j AS (SELECT d.*, greatest(pon_af, pon3 / 1000.0) AS pon, coalesce(nt, 0) AS nt, coalesce(clnsig = 'Pathogenic', false) AS plp, coalesce(af5 >= 10, false) AS common
  FROM d LEFT JOIN pn USING (contig, pos, ref, alt) LEFT JOIN rc USING (contig, pos, ref, alt))
SELECT seq, concat_ws(';', CASE WHEN common AND NOT plp THEN 'gnomAD_AF=' || printf('%.2f', af5 / 10.0) || 'e-04' END,
  CASE WHEN pon > 0.01 THEN 'panel_of_normals_AF=' || printf('%.3f', pon::DOUBLE) END, CASE WHEN nt >= 5 AND NOT plp THEN 'recurrent_in_' || nt || '_trios' END) AS reasons,
  concat_ws(';', CASE WHEN plp THEN 'CLINVAR_PLP' END, CASE WHEN plp AND common THEN 'POP_AF_RESCUED_BY_CLINVAR' END,
  CASE WHEN plp AND nt >= 5 THEN 'RECURRENT_KNOWN_PATHOGENIC(n=' || nt || ')' END) AS flags FROM j""",
    "reference_context": f"""
WITH pieces AS ({PIECES.replace('{supplier}', 'supplier')}),
r AS (SELECT l_orderkey * 8 + l_linenumber AS rec, 'chr' || (l_suppkey % 22 + 1) AS chrom, l_suppkey // 22 AS chunk FROM lineitem),
a AS (SELECT rec, rec % 190 + 33 AS here, rec % 3 <> 0 AS snv, seq FROM r LEFT JOIN pieces USING (chrom, chunk)),
b AS (SELECT *, CASE WHEN snv THEN here ELSE here + 1 END AS anchor FROM a),
c AS (SELECT *, greatest(1, anchor - 20) AS lo, substr(seq, greatest(1, anchor - 20), anchor + 20 - greatest(1, anchor - 20) + 1) AS win,
  substr(seq, greatest(1, here - 30), here + 30 - greatest(1, here - 30) + 1) AS near, substr(seq, greatest(1, here - 1), here + 1 - greatest(1, here - 1) + 1) AS ctx FROM b),
h AS (SELECT *, coalesce(greatest({_run('anchor - lo')}, {_run('anchor - lo + 1')}, {_run('anchor - lo + 2')}), 0) AS run FROM c)
SELECT rec, CASE WHEN snv AND length(ctx) = 3 THEN ctx ELSE '' END AS context, run::INT AS homopolymer,
  concat_ws(';', CASE WHEN run > CASE WHEN snv THEN 7 ELSE 5 END THEN 'homopolymer_' || run || 'bp' END, CASE WHEN near LIKE '%N%' THEN 'near_reference_N' END) AS reasons FROM h""",
    "pileup_join": _D + """, m AS (SELECT contig, pos, ref, alt, arg_min({'rf': kid_ref, 'rr': kid_alt, 'af': sb_cut, 'ar': q - sb_cut}, seq) AS c FROM d WHERE alt <> '*' AND n % 2 = 1 GROUP BY ALL)
SELECT seq, c.rf AS ref_fwd, c.rr AS ref_rev, c.af AS alt_fwd, c.ar AS alt_rev FROM d LEFT JOIN m USING (contig, pos, ref, alt) WHERE alt <> '*'""",
    "parent_of_origin": _D + """SELECT substr(chrom, 4) || ':' || pos AS site, arg_max(CASE WHEN p % 7 IN (0, 2, 4) THEN 'paternal' ELSE 'maternal' END, seq) AS origin
FROM d WHERE p % 7 < 5 GROUP BY 1""",
    "caller_text": _D + """, t AS (SELECT chrom, pos::VARCHAR AS pos, ref, alt, '0.' || lpad((x % 100)::VARCHAR, 2, '0') AS pp_dnm, x % 100 >= 50 AS sure,
  p % 4 = 0 AND length(ref) = 1 AND ref <> 'T' AS child FROM d WHERE p % 10 <> 0)
SELECT chrom, pos, ref, CASE WHEN child THEN 'T' ELSE alt END AS alt, pp_dnm FROM t WHERE sure AND CASE WHEN child THEN 'T' ELSE alt END <> ref""",
    "second_hits": _D + """, g AS (SELECT 'G' || p AS gene, string_agg(concat_ws(' ', chrom || ':' || pos || ref || '>' || alt, CASE WHEN p % 8 = 0 THEN 'p.A1T' END, 'VAF=' || printf('%.3f', q / 64)), '; ' ORDER BY seq) AS told
  FROM d WHERE alt <> '*' AND k % 5 = 0 GROUP BY 1)
SELECT 'G' || s_suppkey * 4 AS gene, s_suppkey AS hit_no, 'germline:' || s_suppkey AS germline_variant,
  concat_ws('+', CASE WHEN told IS NOT NULL THEN 'somatic_variant' END, CASE WHEN s_suppkey % 3 = 0 THEN 'LOH' END) AS hit_type,
  concat_ws('; ', told, CASE WHEN s_suppkey % 3 = 0 THEN 'LOH chr5:' || s_suppkey * 100 || '-' || s_suppkey * 100 + 50 || ' minor_cn=0 total_cn=' || s_suppkey % 4 END) AS somatic_evidence
FROM supplier LEFT JOIN g ON gene = 'G' || s_suppkey * 4 WHERE told IS NOT NULL OR s_suppkey % 3 = 0""",
    "word_values": f"""SELECT o_orderkey, {_choice(co.TIER_WORDS, '2')} AS tier, {_choice(_groups(co.POLARITY_WORDS), "'supports'")} AS polarity,
  {_choice(_groups(co.SIGN_WORDS), "'unknown'")} AS sign, {_choice(co.NODE_WORDS, "'mechanism'")} AS node_type,
  CASE WHEN lower(trim(w)) = 'human_tissue' THEN 'human_tissue' ELSE {_choice(co.EXPERIMENT_WORDS, "'human_tissue'")} END AS experiment_type,
  lower(trim(w)) IN ('true', 'yes', '1', 'y') AS truth FROM (SELECT o_orderkey, {list(WORDS)!r}[o_orderkey % {len(WORDS)} + 1] AS w FROM orders)""",
}
