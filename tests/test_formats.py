"""Normalised records, JSON in other text, validation in order, and small reading rules, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pedigraph.functions.numeric import double_list, long_list
from pedigraph.functions.text import json_text
from pedigraph.operators import beliefs as bel, normalise, validation
from pedigraph.plans.call import last_of_keys
from pedigraph.plans.investigate import named_steps


def test_alleles_split_with_their_numbers(spark):
    rows = [("1", 5, "A", "C", ["G", "AT"], "AC=1,2,3;DP=9;MQ=4,4", "GT:AD:PL", ["0/2:10,1,2,3:0,1,2,3,4,5,6,7,8,9", "1|3:5,6,7,8:1,2,3,4", ".:.:."]),
            ("1", 9, "A", "C", [], "AC=7", "GT:AD", ["0/1:3,4"])]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, extra_alts array<string>, info string, format string, calls array<string>")
    numbers = normalise.declared_numbers(["##INFO=<ID=AC,Number=A,Type=Integer>", "##INFO=<ID=DP,Number=1,Type=Integer>", "##FORMAT=<ID=AD,Number=R>"], "INFO")
    assert numbers == {"AC": "A"}
    got = [(r.pos, r.alt, r.allele, r.info, r.calls) for r in normalise.split_alleles(df, numbers).orderBy("pos", "allele").collect()]
    assert got == [
        (5, "C", 0, "AC=1;DP=9;MQ=4,4", ["0/0:10,1:0,1,2", "1|0:5,6:1,2", ".:.:."]),
        (5, "G", 1, "AC=2;DP=9;MQ=4,4", ["0/1:10,2:0,3,5", "0|0:5,7:1,3", ".:.:."]),
        (5, "AT", 2, "AC=3;DP=9;MQ=4,4", ["0/0:10,3:0,6,9", "0|1:5,8:1,4", ".:.:."]),
        (9, "C", 0, "AC=7", ["0/1:3,4"])]


def rolled(bases, pos, ref, alt):
    """Base by base: cut equal ends, and take the base before when one allele is used up."""
    while True:
        if ref and alt and ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        elif (not ref or not alt) and pos > 1:
            pos -= 1
            ref, alt = bases[pos - 1] + ref, bases[pos - 1] + alt
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


def test_indels_roll_to_the_left_over_many_windows(spark):
    rng = random.Random(1)
    bases = "".join(rng.choices("ACGT", k=100)) + "CA" * 60 + "".join(rng.choices("ACGT", k=80)) + "T" * 30
    chunk, before = 64, 16
    pieces = [("c", k, max(1, k * chunk - before), bases[max(1, k * chunk - before) - 1:(k + 1) * chunk]) for k in range(len(bases) // chunk + 1)]
    chunks = spark.createDataFrame(pieces, "chrom string, chunk long, first long, seq_ref string")
    rows = []
    for i in range(300):
        p, n, kind = rng.randrange(2, len(bases) - 12), rng.choice([1, 1, 2, 2, 3, 4, 6]), rng.random()
        if kind < 0.4:
            ref, alt = bases[p - 1:p + n], bases[p - 1]
        elif kind < 0.8:
            ref, alt = bases[p - 1], bases[p - 1] + rng.choice([bases[max(0, p - 1 - n):p - 1] or "A", bases[p:p + n], "".join(rng.choices("ACGT", k=n))])
        else:
            ref, alt = bases[p - 1:p + 2], rng.choice("ACGT") + bases[p:p + 2]
        if ref != alt:
            rows.append((i, "c", p, ref, alt))
    rows += [(900, "c", 20, "A", "<DEL>"), (901, "none", 7, "CAA", "CA"), (902, "c", 30, "A", "*")]
    df = spark.createDataFrame(rows, "n long, chrom string, pos long, ref string, alt string")
    got = {r.n: (r.pos, r.ref, r.alt) for r in normalise.left_aligned(df, chunks, before, chunk).collect()}
    assert got[900] == (20, "A", "<DEL>") and got[901] == (7, "CAA", "CA") and got[902] == (30, "A", "*") and len(got) == len(rows)
    for n, _, p, ref, alt in rows[:-3]:
        assert got[n] == rolled(bases, p, ref, alt)
    assert max(p - got[n][0] for n, _, p, _, _ in rows) > 64


def test_json_in_other_text(spark):
    inner = '{"a": "x } \\" { y", "b": {"c": [1]}}'
    cases = {
        '{"a": 1}': '{"a": 1}', f"Sure!\n```json\n{inner}\n```\nbye }}": inner, 'text {"k": "}"} and {"z": 2}': '{"k": "}"}', "no json": None,
        '{"a": ': None, "say {bad} then": None, '``` {"q": "back\\\\"} ```': '{"q": "back\\\\"}', "": None, '  {"t": "```json {}"} ': '{"t": "```json {}"}'}
    got = {r.t: r.j for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", json_text(F.col("t")).alias("j")).collect()}
    assert got == cases and all(json.loads(v) is not None for v in got.values() if v)


def test_small_reading_rules(spark):
    row = spark.createDataFrame([("3d,4,0.95f,.", "1;A=1;B;A=2;C=0;B", "0.5f&0.7", "7,8")], "a string, i string, s string, b string").select(
        long_list(F.col("a")).alias("a"), last_of_keys(F.split("i", ";")).alias("i"), F.array_max(double_list(F.col("s"), "[&,]")).alias("s"), long_list(F.col("b")).alias("b")).first()
    assert row.a == [None, 4, None, None] and row.i == ["1", "A=2", "B", "C=0"] and row.s == 0.7 and row.b == [7, 8]
    chain = spark.createDataFrame([([("a", "x"), (None, "y"), ("", "z"), ("b", "w")],)], "chain array<struct<node:string,type:string>>")
    assert chain.select(named_steps(F.col("chain")).alias("n")).first().n == ["a", "b"]
    # 0.40625 / 4 digits keeps an exact tie: half goes to the even neighbour, and the earlier row stays first
    tied = spark.createDataFrame([("p", 0.40625, 1), ("q", 0.4062, 0)], "hyp string, belief double, ins long").selectExpr(
        "*", "0.0D as chain_score", "0.0D as relevance", "0.0D as novelty")
    assert [r.hyp for r in tied.orderBy(*bel.rank_order()).collect()] == ["q", "p"]


def test_the_first_validation_moves_the_second(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "d", 1), ("a", "c", 2), ("c", "d", 3), ("x", "y", 4)], "src string, dst string, edge_no long").withColumn("sign", F.lit("activates"))
    evidence = spark.createDataFrame([(s, d, 5, "supports", w, True) for s, d, w in (("a", "b", 0.5), ("b", "d", 0.6), ("a", "c", 0.45), ("c", "d", 0.7), ("x", "y", 0.2))],
                                     "src string, dst string, tier int, polarity string, strength double, is_independent boolean")
    items = spark.createDataFrame([
        (1, 10, None, "a", "d", 5, "contradicts", 0.2, True),  # lands on a-b-d, which falls below a-c-d
        (2, 20, None, "a", "d", 3, "supports", 0.5, True), (3, 15, ["a", "b"], None, None, 2, "supports", 0.1, True),
        (4, 5, None, "x", "y", 2, "supports", 0.1, True), (5, 30, ["a", "d"], None, None, 2, "supports", 0.1, True), (6, 40, None, "a", "y", 2, "supports", 0.1, True)],
        "item long, at long, nodes array<string>, source string, target string, tier int, polarity string, strength double, is_independent boolean")
    nodes = spark.createDataFrame([(n, "gene") for n in "abcdxy"], "name string, type string")
    got = validation.validated_in_order(edges, evidence, items, nodes).collect()
    landed = {k: sorted(r.src + r.dst for r in got if r.item == k) for k in range(1, 7)}
    assert landed == {1: ["ab", "bd"], 2: ["ac", "cd"], 3: ["ab"], 4: ["xy"], 5: [], 6: []}


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_parts(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)]
    part = {n: n for e in links for n in e}
    for _ in range(len(part)):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = {r.name: r.part for r in validation.connected_parts(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == part


def test_common_beginnings_need_no_letters(spark):
    from pedigraph.operators.normalise import shared_beginning

    pairs = [("", "A"), ("A", ""), ("A", "A"), ("AC", "AG"), ("ACGT", "ACG"), ("ACG", "ACGTT"), ("T" * 129 + "A", "T" * 129 + "C"), ("T" * 64, "T" * 64), ("äß", "äa"), (None, "A")]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(shared_beginning(F.col("a"), F.col("b")).alias("n"))
    assert [r[0] for r in df.collect()] == [0, 0, 1, 1, 3, 3, 129, 64, 1, None]
    assert "regexp" not in df._jdf.queryExecution().toString().lower()
