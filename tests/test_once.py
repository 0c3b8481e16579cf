"""Work is done once: what is read, cut and summed again would give the same results, only later."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pedigraph.catalog import interpretation
from pedigraph.functions.numeric import double_list, largest
from pedigraph.functions.text import info_double, info_flag, info_text, info_without
from pedigraph.operators import beliefs as bel, graph as gr


def test_largest_number_reads_what_the_list_reads(spark):
    texts = ["", ".", "0.5", " 0.5 ", "0.1&.&0.7", "0.1,0.9", "&", "nan", "1.5d", "2f&0.5", "-3", "x", "inf", "1e-4", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(largest(F.col("t"), "&,").cast("string"), F.array_max(double_list(F.col("t"), "[&,]")).cast("string")).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] and rows[4][0] == "0.7"


def test_other_keys_are_found_without_the_transcripts(spark):
    infos = ["A=1;CSQ=x|A=2,y;B=3", "CSQ=q", "A=1", "CSQ=1;A=4;CSQ=2;F", "XCSQ=5;A=1", "CSQ", "", "CSQ=a;A=", None, "F;CSQ=;A=7;A=8", "A;CSQ=1;A=2"]
    df = spark.createDataFrame([(t,) for t in infos], "i string").select("i", info_without(F.col("i"), "CSQ").alias("rest"))
    for key in ("A", "B", "F", "XCSQ"):
        for read in (info_text, info_flag, info_double):
            assert all(r[0] == r[1] for r in df.select(read(F.col("i"), key), read(F.col("rest"), key)).collect()), (key, read)
    assert df.where(F.col("i").contains("|")).select("rest").first()[0].strip(";") == "A=1;B=3"


def test_ranks_look_at_scores_that_are_there(spark):
    plan = interpretation.priority_rank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan and "priority_rank" in plan


def test_contradictions_of_a_log(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(["activates", "inhibits", "inhibits", "unknown", "modulates"]), i, rng.randrange(1, 6),
             rng.choice(["supports"] * 9 + ["contradicts", "neutral"]), rng.random(), rng.random() < 0.7) for i in range(500)]
    log = spark.createDataFrame(rows, "src string, dst string, sign string, seq long, tier int, polarity string, strength double, is_independent boolean")
    for floor, evidence in ((0.2, log), (-0.5, log), (-0.1, log.where("seq % 7 = 0")), (0.2, log.where("false"))):
        want = sorted(map(tuple, gr.contradictions(gr.with_support(gr.fold_edges(log), evidence), floor).collect()))
        assert sorted(map(tuple, gr.contradictions_of(log, evidence, floor).collect())) == want
        assert want or evidence is not log


def test_outcomes_of_a_plan_are_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    rows = [(e, o, h, ((e * 7 + h * 3 + o * 5) % 10) / 10) for e in range(4) for h in range(5) for o in range(2)]
    outcomes = spark.createDataFrame(rows, "exp int, outcome int, hyp int, lik double").withColumn("lik", watched("lik"))
    prior = spark.createDataFrame([(h, (h + 1) / 15) for h in range(5)], "hyp int, share double")
    exps = spark.createDataFrame([(e, e, 2.0 + e, 1.0) for e in range(4)], "exp int, ins int, cost double, feasibility double")
    plan = bel.plan_experiments(outcomes, prior, exps, 9.0, 3)
    got = {r.exp: r.eig for r in plan["ranked"].collect()}
    assert seen.value == len(rows)
    for e in range(4):
        lik = {(o, h): v for x, o, h, v in rows if x == e}
        left = -sum((h + 1) / 15 * math.log2((h + 1) / 15) for h in range(5))
        for o in range(2):
            j = [lik[o, h] * (h + 1) / 15 for h in range(5)]
            left += sum(v * math.log2(v / sum(j)) for v in j if v > 0)
        assert got[e] == pytest.approx(max(left, 0), abs=1e-9)
    assert plan["chosen"] and sum(2.0 + e for e in plan["chosen"]) <= 9
