"""Kernels against closed forms and plain Python."""

import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pedigraph.config import DEFAULTS, load_config
from pedigraph.functions import genome, numeric as nm, stats, text
from pedigraph.plans.sanity import wilson


def test_number_texts_equal_c_formats(spark):
    rng = random.Random(3)
    xs = [0.0625, 2.675, 1.005, 9.9995, 99999.95, 1e-5, 38.0, 1 / 3] + [k / 16 for k in range(1, 16)]
    xs += [rng.random() * 10 ** rng.randint(-6, 6) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    c = F.col("x")
    for r in df.select("x", nm.fixed(c, 3).alias("f"), nm.round_even(c, 2).alias("r"), nm.scientific(c, 2).alias("e"),
                       nm.general(c, 4).alias("g")).collect():
        assert (r.f, r.r, r.e, r.g) == (f"{r.x:.3f}", round(r.x, 2), f"{r.x:.2e}", f"{r.x:.4g}")


def test_binomial_tails(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 90), rng.randint(0, 120), rng.choice([0.5, 0.005, 0.995])) for _ in range(200)]

    def pmf(i, n, p):
        return math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p))

    df = spark.createDataFrame(rows, "k int, n int, p double")
    for r in df.select("*", stats.binom_cdf(F.col("k"), F.col("n"), F.col("p")).alias("c"),
                       stats.binom_sf(F.col("k"), F.col("n"), F.col("p")).alias("s")).collect():
        cdf = 1.0 if r.k >= r.n else min(1.0, sum(pmf(i, r.n, r.p) for i in range(r.k + 1)))
        sf = 1.0 if r.k <= 0 else min(1.0, sum(pmf(i, r.n, r.p) for i in range(r.k, r.n + 1)))
        assert r.c == pytest.approx(cdf, abs=1e-10) and r.s == pytest.approx(sf, abs=1e-10)


def test_fisher(spark):
    one = spark.range(1).select(stats.fisher_exact(3, 1, 1, 3).alias("a"), stats.fisher_exact(15, 15, 0, 20).alias("b"),
                                stats.fisher_exact(0, 0, 0, 0).alias("c")).first()
    assert one.a == pytest.approx(0.485714, abs=1e-6) and one.b < 1e-3 and one.c == pytest.approx(1.0)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 200), st.integers(1, 200))
def test_wilson_holds_the_share(k, n):
    k = min(k, n)
    lo, hi = wilson(k, n)
    assert 0 <= lo <= k / n + 1e-12 and k / n - 1e-12 <= hi <= 1


def test_trim_and_protein_change(spark):
    rows = spark.createDataFrame([("CAAA", "CAA"), ("CA", "C"), ("A", "T"), ("GTA", "CTA")], "r string, a string")
    got = [tuple(x.t) for x in rows.select(text.trim_suffix(F.col("r"), F.col("a")).alias("t")).collect()]
    assert got == [("CA", "C"), ("CA", "C"), ("A", "T"), ("G", "C")]
    notes = ["p.Gly12Asp", "p.G12D", "G12D", "ENSP1.3:p.Gly12Asp", "p.(Gly12Asp)", " p.(G12D) ", "p.Arg424Ter", "ENSP1:p.Ser248%3D", ""]
    df = spark.createDataFrame([(n,) for n in notes], "s string").coalesce(1)
    assert [r[0] for r in df.select(text.protein_change(F.col("s"))).collect()] == ["G12D"] * 6 + ["R424*", "S248=", ""]


def test_info_reads_last_value(spark):
    df = spark.createDataFrame([("A=1;B;A=2,5;XA=9",), ("B=3;A",)], "i string").coalesce(1)
    i = F.col("i")
    got = df.select(text.info_double(i, "A"), text.info_flag(i, "B"), text.info_text(i, "B"), text.info_has(i, "X")).collect()
    assert [tuple(r) for r in got] == [(2.0, True, None, False), (1.0, False, "3", False)]


def test_contig_class_and_ploidy(spark):
    rows = [("chrX", 3_000_000, "male"), ("X", 20_000, "male"), ("chrY", 3_000_000, "female"), ("chrM", 1, "male"), ("2", 1, "female")]
    df = spark.createDataFrame(rows, "c string, p long, s string").coalesce(1)
    cls = genome.chrom_class(F.col("c"), F.col("p"))
    got = [tuple(r) for r in df.select(cls, genome.class_ploidy(cls, F.col("s"))).collect()]
    assert got == [("X", 1), ("PAR", 2), ("Y", 0), ("MT", 2), ("auto", 2)]


def test_homopolymer_and_channel(spark):
    df = spark.createDataFrame([("ACGTAAAAAAGT", 6), ("NNNNNN", 3), ("ACGT", 1)], "s string, c int").coalesce(1)
    assert [r[0] for r in df.select(genome.homopolymer_run(F.col("s"), F.col("c"))).collect()] == [6, 0, 1]
    df = spark.createDataFrame([("G", "A", "T", "C"), ("C", "T", "A", "G"), ("C", "T", "N", "G")], "r string, a string, x string, y string").coalesce(1)
    got = [r[0] for r in df.select(genome.mutation_channel(F.col("r"), F.col("a"), F.col("x"), F.col("y"))).collect()]
    assert got == ["G[C>T]A", "A[C>T]G", None]


def test_config_keeps_the_preset(tmp_path):
    import copy
    import json

    full = copy.deepcopy(DEFAULTS)
    full["proband"]["min_gq"] = 30
    path = tmp_path / "c.json"
    path.write_text(json.dumps(full))
    cfg = load_config(str(path), "wes")
    assert (cfg["proband"]["min_dp"], cfg["proband"]["min_alt"], cfg["proband"]["min_gq"]) == (20, 7, 30)
    assert load_config(str(path), "wgs")["parent"]["min_dp"] == 15 and DEFAULTS["proband"]["min_gq"] == 20


def test_info_and_contigs_without_patterns(spark):
    """Plain searches give what the patterns gave, and only a key that is also a bare flag still needs one."""
    import random

    from pyspark.sql import functions as F

    from pedigraph.functions import text as tx
    from pedigraph.functions.genome import chrom_class

    rng = random.Random(3)
    part = lambda: rng.choice(["A", "A=1", "A=", "A=2,3", "BA=4", "A=5=6", "AB", "AB=7", "", "B;A"])
    infos = [None, "", "."] + [";".join(part() for _ in range(rng.randint(1, 4))) for _ in range(300)]
    has = F.coalesce(F.col("i").contains("A") & F.col("i").rlike(tx._info_pattern("A")), F.lit(False))
    value = F.when(F.col("i").rlike(r"^(?:.*;)?A=[^;]*(?:;.*)?$"), F.regexp_extract("i", tx._info_pattern("A"), 1))
    df = spark.createDataFrame([(i,) for i in infos], "i string").select(
        "i", tx.info_has(F.col("i"), "A").alias("h"), has.alias("h0"), tx.info_text(F.col("i"), "A").alias("t"), value.alias("t0"),
        tx.info_flag(F.col("i"), "A").alias("f"), (has & value.isNull()).alias("f0"))
    assert [r for r in df.collect() if (r.h, r.t, r.f) != (r.h0, r.t0, r.f0)] == []
    names = ["chr1", "CHRX", "cHrM", "chrmt", "x", "chr", "chrchr2", "ch1", None, "", "Mt", "HLA"]
    got = spark.createDataFrame([(n,) for n in names], "c string").select(tx.bare_chrom(F.col("c")), F.regexp_replace("c", "^(?i)chr", ""), chrom_class(F.col("c"), F.lit(5))).collect()
    assert all(r[0] == r[1] for r in got) and [r[2] for r in got] == ["auto", "X", "MT", "MT", "X", "auto", "auto", "auto", "auto", "auto", "MT", "auto"]
    fresh = spark.createDataFrame([("A=1",)], "i string").select(tx.info_text(F.col("i"), "A"), tx.info_flag(F.col("i"), "A"))
    assert "RLIKE" not in fresh._jdf.queryExecution().analyzed().toString().upper()


def test_homopolymer_runs_are_cut_without_patterns(spark):
    column = genome.homopolymer_run(F.col("s"), F.col("c"))
    df = spark.createDataFrame([("GGAAAAC", 4), ("NAAN", 1), ("ACGT", 4), ("A", 1), ("", 1), (None, 1), ("TTTNTT", 4)], "s string, c int")
    assert [r[0] for r in df.select(column).collect()] == [4, 2, 1, 1, 0, 0, 3]
    assert "regexp" not in df.select(column)._jdf.queryExecution().toString().lower()


def test_genotype_values_that_are_asked_for_are_read_as_before(spark):
    from pedigraph.functions.genotype import READS, add_genotypes

    rows = [("0|1:12,3:20:12.5", 12, 3, 20, 0.2), ("1:1e1,2.7:.:7", 10, 2, 12, 2 / 12), ("./.:4,5,6:3:.", 4, 11, 15, 11 / 15), ("0/0", 0, 0, 0, None),
            ("0/1:.,7:1e1:0.5", 0, 7, 10, 1.0), ("0/1:.:5:1f", 0, 0, 5, None)]
    df = spark.createDataFrame([("GT:AD:DP:GQ", r[0]) for r in rows], "format string, call string")
    got = add_genotypes(df, {"g": "call"}, READS).select("g.*")
    assert got.columns == list(READS)
    assert [tuple(r) for r in got.collect()] == [tuple(r[1:]) for r in rows]
    whole = add_genotypes(df, {"g": "call"}).select("g.gq", "g.ploidy", "g.alt_count").collect()
    assert [tuple(r) for r in whole] == [(12, 2, 1), (7, 1, 1), (None, 2, None), (None, 2, 0), (0, 2, 1), (None, 2, 1)]


def test_tails_below_a_limit_are_told_without_a_walk(spark):
    rows = [(k, n, p) for n in (0, 1, 7, 30, 95, 400) for k in (-1, 0, 1, 2, 3, 5, 9, 14, 29, 60, 95, 180) for p in (0.005, 0.5, 0.995)]
    df = spark.createDataFrame([*rows, (None, 9, 0.5), (4, None, 0.5), (4, 9, None)], "k long, n long, p double")
    k, n, p = F.col("k"), F.col("n"), F.col("p")
    for limit in (1e-4, 1e-3, 0.05, 0.7):
        off = df.where(~(stats.binom_cdf_below(k, n, p, limit).eqNullSafe(stats.binom_cdf(k, n, p) < limit)
                         & stats.binom_sf_below(k, n, p, limit).eqNullSafe(stats.binom_sf(k, n, p) < limit)))
        assert off.count() == 0
    tables = spark.createDataFrame([(a, b, c, d) for a in (0, 1, 8, 40) for b in (0, 3, 22) for c in (0, 2, 17) for d in (0, 1, 30)], "a long, b long, c long, d long")
    cells = [F.col(c) for c in "abcd"]
    got = tables.select(stats.fisher_exact(*cells).alias("p"), stats.fisher_exact(*cells, limit=1e-3).alias("q")).collect()
    assert all(r.q == r.p if r.p < 1e-3 else 1e-3 <= r.q <= r.p * (1 + 1e-9) for r in got) and any(r.p < 1e-3 for r in got)


def test_short_numbers_as_general_text(spark):
    values = [3.1, 30.0, -13.0, 999999.0, 1000000.0, 99999.95, 123456.7, 0.25, 12.5, -7.125, 1e22, 100000.5, 9.999999, 2.0]
    for sig in (3, 4, 6):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", nm.general(F.col("v"), sig).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.v:.{sig}g}" for r in got]
