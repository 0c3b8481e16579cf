"""`qc-gate`: contamination, coverage, sex and relatedness findings per trio as joins on sample ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pedigraph.config import DEFAULTS
from pedigraph.functions.numeric import fixed, to_double
from pedigraph.session import exists
from pedigraph.sources.tables import Trio, last_by, tsv_table
from pedigraph.sources.text import head_lines

LCL_NOTE = "lymphoblastoid cell-line DNA: expect culture-derived low-VAF artefacts"
TRIO = "trio_no int, family string, proband string, father string, mother string, sex string"


def gates(cfg: dict | None) -> dict:
    return {**DEFAULTS["qc"], **((cfg or {}).get("qc") or {})}


def inferred_sex(depth: Column, y_depth: Column, x_het: Column, x_n: Column, q: dict) -> Column:
    """male / female / unknown from the Y to autosome depth ratio and X heterozygosity."""
    y = y_depth / depth
    return (
        F.when(depth <= 0, "unknown")
        .when((y >= q["male_y_ratio"]) & ((x_n == 0) | (x_het / x_n < q["male_max_x_het"])), "male")
        .when(y < q["male_y_ratio"] / 2, "female").otherwise("unknown")
    )


def sample_sexes(table: DataFrame, q: dict) -> DataFrame:
    """(sample, inferred) of a per-sample table; the last row of a sample wins."""
    def num(name):
        return to_double(F.col(name)) if name in table.columns else F.lit(None).cast("double")

    def nonzero(*names):
        return F.coalesce(*[F.when(num(n) != 0, num(n)) for n in names], F.lit(0.0))

    sex = inferred_sex(nonzero("depth_mean", "gt_depth_mean"), nonzero("Y_depth_mean"), nonzero("X_het"), nonzero("X_n"), q)
    rows = table.select(F.col("sample_id").alias("sample"), sex.alias("inferred"), "block", "seq")
    return last_by(rows, ["sample"]).drop("block", "seq")


def pair_table(table: DataFrame) -> DataFrame:
    """(pair, relatedness, ibs0, n) keyed by the unordered sample pair; the last row wins."""
    def num(name, default):
        return F.coalesce(to_double(F.col(name)), F.lit(default)) if name in table.columns else F.lit(default)

    rows = table.select(F.array_sort(F.array("sample_a", "sample_b")).alias("pair"), num("relatedness", 0.0).alias("relatedness"),
                        num("ibs0", 0.0).alias("ibs0"), num("n", 1.0).alias("n"), "block", "seq")
    return last_by(rows, ["pair"]).drop("block", "seq")


def members(trios: DataFrame) -> DataFrame:
    role = [("proband", F.col("sex"), ""), ("father", F.lit("male"), " (PED father)"), ("mother", F.lit("female"), " (PED mother)")]
    return trios.select("trio_no", F.inline(F.array(*[
        F.struct(F.lit(i).alias("place"), F.col(r).alias("sample"), s.alias("reported"), F.lit(t).alias("role"))
        for i, (r, s, t) in enumerate(role)])))


def sex_findings(trios: DataFrame, sexes: DataFrame) -> DataFrame:
    m = members(trios).join(sexes, "sample", "left")
    clash = F.col("reported").isin("male", "female") & (F.col("inferred") != F.col("reported"))
    fail = F.when(F.col("inferred").isNull(), F.concat("sample", F.lit(": not in somalier samples.tsv (sample IDs must match the PED)"))).when(
        (F.col("inferred") != "unknown") & clash,
        F.concat("sample", F.lit(": reported sex "), "reported", "role", F.lit(" but inferred "), "inferred", F.lit(" – sample swap or PED error")))
    warn = F.when(F.col("inferred") == "unknown", F.concat("sample", F.lit(
        ": sex could not be inferred from X/Y signal – possible sex-chromosome aneuploidy (e.g. XXY, X0) or low coverage; "
        "resolve before interpreting chrX/chrY calls")))
    return m.select("trio_no", F.lit(2).alias("section"), F.col("place"), fail.alias("fail"), warn.alias("warn"))


def relatedness_findings(trios: DataFrame, pairs: DataFrame, q: dict, consanguineous: bool) -> DataFrame:
    lo, hi = q["parent_child_relatedness"]
    want = trios.select("trio_no", "proband", F.inline(F.array(
        *[F.struct(F.lit(i * 2).alias("place"), F.col(p).alias("other"), F.array_sort(F.array("proband", p)).alias("pair"))
          for i, p in enumerate(("father", "mother"))],
        F.struct(F.lit(9).alias("place"), F.lit("").alias("other"), F.array_sort(F.array("father", "mother")).alias("pair")))))
    j = want.join(pairs, "pair", "left")
    child = F.col("place") < 9
    who = F.concat("proband", F.lit("/"), "other")
    r = F.col("relatedness")
    off = F.when(~r.between(lo, hi), F.concat(who, F.lit(": relatedness "), fixed(r, 2),
                 F.lit(f" not in [{lo}, {hi}] (non-paternity/maternity or swap)")))
    share = F.col("ibs0") / F.when(F.col("n") != 0, F.col("n"))
    ibs = F.when(share > q["parent_child_max_ibs0"], F.concat(who, F.lit(": IBS0 fraction "), fixed(share, 4),
                 F.lit(" incompatible with parent–child")))
    first = F.when(child, F.when(r.isNull(), F.concat(F.lit("no somalier pair for "), who)).otherwise(off))
    kin = F.when(~child & (r > q["unrelated_max_relatedness"]) & F.lit(not consanguineous),
                 F.concat(F.lit("parents relatedness "), fixed(r, 2), F.lit(" – undeclared consanguinity?")))
    none = F.lit(None).cast("string")
    return j.select("trio_no", F.lit(3).alias("section"), F.inline(F.array(
        F.struct(F.col("place").alias("place"), first.alias("fail"), kin.alias("warn")),
        F.struct((F.col("place") + 1).alias("place"), F.when(child, ibs).alias("fail"), none.alias("warn")))))


def gate_status(trios: DataFrame, findings: DataFrame) -> DataFrame:
    """(trio_no, fail, warn, status); a trio has a fixed number of findings."""
    def texts(kind):
        rows = F.array_sort(F.collect_list(F.when(F.col(kind).isNotNull(), F.struct("section", "place", F.col(kind).alias("text")))))
        return F.transform(rows, lambda x: x["text"]).alias(kind)

    g = findings.groupBy("trio_no").agg(texts("fail"), texts("warn"))
    none = F.array().cast("array<string>")
    out = trios.join(g, "trio_no", "left").select(*trios.columns, F.coalesce("fail", none).alias("fail"), F.coalesce("warn", none).alias("warn"))
    return out.withColumn("status", F.when(F.size("fail") > 0, "FAIL").when(F.size("warn") > 0, "WARN").otherwise("PASS"))


def freemix(path: str) -> float | None:
    lines = [ln for ln in head_lines(exists(path), lambda ln: True) if ln.strip()]
    if len(lines) < 2:
        return None
    row = dict(zip(lines[0].lstrip("#").split("\t"), lines[1].split("\t")))
    try:
        return float(row.get("FREEMIX", ""))
    except ValueError:
        return 0.0


def coverage(path: str) -> float | None:
    seen = [ln.split("\t")[3] for ln in head_lines(exists(path), lambda ln: True) if ln.split("\t")[0] in ("total", "total_region")]
    return float(seen[-1]) if seen else None


def evaluate(spark: SparkSession, trios: list[Trio], pairs_tsv: str | None = None, samples_tsv: str | None = None,
             selfsm: dict[str, str] | None = None, mosdepth: dict[str, str] | None = None, data_type: str = "wgs",
             consanguineous: bool = False, cfg: dict | None = None, lcl=()) -> list[dict]:
    """One verdict per trio.  With several trios each is judged on its own members' files."""
    q = gates(cfg)
    table = spark.createDataFrame([(i, t.family, *t.members, t.sex) for i, t in enumerate(trios)], TRIO)
    mix = {s: v for s, p in (selfsm or {}).items() if (v := freemix(p)) is not None}
    depth = {s: v for s, p in (mosdepth or {}).items() if (v := coverage(p)) is not None}
    need = q["min_mean_depth"].get(data_type, 0) if isinstance(q["min_mean_depth"], dict) else q["min_mean_depth"]

    def own(i, values):
        return values if len(trios) == 1 else {s: v for s, v in values.items() if s in trios[i].members}

    rows = []
    for i, t in enumerate(trios):
        for n, (s, v) in enumerate(own(i, mix).items()):
            if v > q["freemix_fail"]:
                rows.append((i, 0, n, f"{s}: FREEMIX {v:.3f} > {q['freemix_fail']}", None))
            elif v > q["freemix_warn"]:
                rows.append((i, 0, n, None, f"{s}: FREEMIX {v:.3f} – investigate"))
        for n, (s, v) in enumerate(own(i, depth).items()):
            if v < need:
                rows.append((i, 1, n, None, f"{s}: mean depth {v:.1f} < {need}"))
        for n, s in enumerate(m for m in t.members if m in set(lcl or [])):
            rows.append((i, 4, n, None, f"{s}: {LCL_NOTE}"))
    found = [spark.createDataFrame(rows, "trio_no int, section int, place int, fail string, warn string")]
    sexes = pairs = None
    if samples_tsv:
        sexes = sample_sexes(tsv_table(spark, samples_tsv, strip_hash=True), q)
        found.append(sex_findings(table, sexes))
    if pairs_tsv:
        pairs = pair_table(tsv_table(spark, pairs_tsv, strip_hash=True))
        found.append(relatedness_findings(table, pairs, q, consanguineous))
    verdicts = gate_status(table, reduce(lambda a, b: a.unionByName(b), found)).orderBy("trio_no").collect()
    out = []
    for r in verdicts:
        t = trios[r["trio_no"]]
        one = {"family": t.family, "proband": t.proband, "freemix": own(r["trio_no"], mix), "mean_depth": own(r["trio_no"], depth)}
        if sexes is not None:
            one["inferred_sex"] = {s["sample"]: s["inferred"] for s in sexes.where(F.col("sample").isin(*t.members)).collect()}
        if pairs is not None:
            one["relatedness"] = {"/".join(x for x in p["pair"] if x): p["relatedness"]
                                  for p in pairs.where(F.arrays_overlap("pair", F.array(*[F.lit(m) for m in t.members]))).collect()}
        one.update(lcl=[m for m in t.members if m in set(lcl or [])], fail=list(r["fail"]), warn=list(r["warn"]), status=r["status"])
        out.append(one)
    return out
