"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

Every text gives counts, and four transformed statistics of them: mean word length, share of
symbols, of repeated lines and of words in repeated passages, smoothed so that short texts
do not stray.  The statistics are whole numbers (1,024ths of a logarithm), so sums of them
and of their products are exact and the same whatever the order of the rows.

For every language and source the minimum-covariance-determinant estimate is found by
concentration steps from two starts (medians with absolute deviations, and all rows): order
the rows by their distance, keep the nearest three quarters, take mean and covariance of
these.  Nearest is decided on buckets of the logarithm of the distance, so a step is one
aggregation whose result does not grow with the rows.  Of the two fixed points the one with
the smaller determinant stands.  A diagonal target is added to every covariance, as shares
that are zero in most texts have none of their own.  Small groups use the estimate of all rows.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.llm.common import landed, pick

SCALE = 1024  # parts of one unit of the logarithm
LEAST_ROWS = 200  # groups below this use the estimate of all rows
STEPS = 4
BUCKETS = 32  # per unit of the logarithm of a squared distance
#: Least standard deviations of the four statistics: word length, symbols, lines, passages.
FLOORS = (0.05, 0.25, 0.75, 0.75)
TAIL = 1e-6  # share of regular texts beyond the cut, if they were normal
WINDOW = 5
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"

#: The statistics as expressions both engines read.
STATISTICS = (
    "ln((word_chars + 500.0e0) / (n_words + 100.0e0))",
    "ln(1.0e0 + (100.0e0 * n_symbols) / (word_chars + 500.0e0))",
    "ln(1.0e0 + (100.0e0 * n_dup_lines) / (n_lines + 20.0e0))",
    "ln(1.0e0 + (100.0e0 * n_repeat_words) / (n_words + 100.0e0))",
)
GROUP = "concat(coalesce(cast(length(lang) as varchar(10)), '-'), ':', coalesce(lang, ''), ':', coalesce(concat('s', source), 'n'))"
_DIMS = range(1, len(STATISTICS) + 1)
_PAIRS = [(i, j) for i in _DIMS for j in _DIMS if j <= i]


def chi_square(share: float, even: int) -> float:
    """The quantile of a chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, even) < share else (low, middle)
    return high


def chi_square_below(x: float, even: int) -> float:
    term, total = 1.0, 1.0
    for k in range(1, even // 2):
        term *= x / 2 / k
        total += term
    return 1 - exp(-x / 2) * total


CUT = chi_square(1 - TAIL, len(STATISTICS))
#: Makes the covariance of the nearest three quarters that of all rows, were they normal.
CONSISTENT = 0.75 / chi_square_below(chi_square(0.75, len(STATISTICS)), len(STATISTICS) + 2)


# One step each, as SQL that both engines run; {name} is a table.
_TARGET = {i: repr((FLOORS[i - 1] * SCALE) ** 2) for i in _DIMS}
_MOMENTS = ", ".join(["sum(n) as n", *[f"sum(n * v{i}) as s{i}" for i in _DIMS], *[f"sum(n * v{i} * v{j}) as q{i}{j}" for i, j in _PAIRS]])
_SUMMED = ", ".join(f"sum({x}) as {x}" for x in ["n", *[f"s{i}" for i in _DIMS], *[f"q{i}{j}" for i, j in _PAIRS]])
_FACTORS = [f"l{i}{j}" for i, j in _PAIRS]
_MEANS = [f"m{i}" for i in _DIMS]


def _factored(table: str, scale: str) -> str:
    """Mean and Cholesky factor of scale * covariance + target, column by column."""
    sql = f"select g, s, {', '.join(f'cast(s{i} as double) / n as m{i}' for i in _DIMS)}, " + ", ".join(
        f"{scale} * (cast(q{i}{j} as double) / n - (cast(s{i} as double) / n) * (cast(s{j} as double) / n))" + (f" + {_TARGET[i]}" if i == j else "") + f" as c{i}{j}"
        for i, j in _PAIRS) + f" from {table}"
    for j in _DIMS:
        inner = lambda i: "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))  # noqa: B023, E731
        sql = f"select *, sqrt(c{j}{j}{inner(j)}) as l{j}{j} from ({sql}) a{j}"
        below = ", ".join(f"(c{i}{j}{inner(i)}) / l{j}{j} as l{i}{j}" for i in _DIMS if i > j)
        sql = f"select *, {below} from ({sql}) b{j}" if below else sql
    det = " * ".join(f"l{i}{i}" for i in _DIMS)
    return f"select g, s, {', '.join(_MEANS + _FACTORS)}, {det} as det from ({sql}) f"


def _distance(table: str) -> str:
    """table with d2, the squared distance of v1.. from m1.. under the factor l11.. ."""
    sql = table
    for i in _DIMS:
        known = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        sql = f"(select *, (v{i} - m{i}{known}) / l{i}{i} as y{i} from {sql} y{i}t)"
    return f"(select *, {' + '.join(f'y{i} * y{i}' for i in _DIMS)} as d2 from {sql} dt)"


def _median(value: str, name: str, source: str) -> str:
    """One column per statistic with the median of ``value`` in each group, from counts per value."""
    levels = " union all ".join(f"select g, {i} as d, {value.replace('?', str(i))} as v, sum(n) as n from {source} group by g, {value.replace('?', str(i))}" for i in _DIMS)
    line = f"select g, d, v, sum(n) over (partition by g, d order by v) as upto, sum(n) over (partition by g, d) as whole from ({levels}) lv"
    return f"select g, {', '.join(f'min(case when d = {i} and 2 * upto >= whole then v end) as {name}{i}' for i in _DIMS)} from ({line}) cv group by g"


MEDIANS = _median("v?", "m", "{vec}")
DEVIATIONS = _median("abs(v? - m?)", "a", "(select v.*, m1, m2, m3, m4 from {vec} v join {medians} m on v.g = m.g)")
STARTS = (
    "select medians.g as g, 1 as s, " + ", ".join(f"cast(m{i} as double) as m{i}" for i in _DIMS) + ", " + ", ".join(
        f"sqrt(2.198e0 * a{i} * a{i} + {_TARGET[i]}) as l{i}{j}" if i == j else f"0.0e0 as l{i}{j}" for i, j in _PAIRS)
    + ", 0.0e0 as det from {medians} medians join {deviations} dv on medians.g = dv.g union all "
    + _factored("(select g, 2 as s, " + _MOMENTS + " from {vec} group by g) mo", "1.0e0"))
_NEAR = ("select g, s, b, " + _MOMENTS + " from (select g, s, n, v1, v2, v3, v4, cast(floor(" + str(BUCKETS) + " * ln(d2 + 1.0e-6)) as int) as b from "
         + _distance("(select v.*, " + ", ".join(["s", *_MEANS, *_FACTORS]) + " from {vec} v join {fits} p on v.g = p.g)") + " dd) bb group by g, s, b")
_HELD = f"select *, sum(n) over (partition by g, s order by b) as upto, sum(n) over (partition by g, s) as whole from ({_NEAR}) nr"
_HALF = f"(select g, s, {_SUMMED} from (select * from ({_HELD}) hd where 4 * (upto - n) < 3 * whole) hh group by g, s) mo"
STEP = _factored(_HALF, "1.0e0")
LAST = _factored(_HALF, repr(CONSISTENT))
BEST = "select * from (select *, row_number() over (partition by g order by det, s) as place from {fits}) ps where place = 1"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, counts): words, their characters, symbols, repeated lines, words in repeated passages, lines.

    Passages are windows of five words, compared by 64-bit hashes within a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, id_col, text_col, lang_col, source_col).toDF("id", "text", "lang", "source").select(
        "id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    long = lambda column: F.coalesce(column, F.lit(0)).cast("long")
    cut = rows.select(
        "id", "lang", "source", long(F.length(F.translate("text", _BLANKS, ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).alias("n_symbols"),
        F.transform(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)).alias("h"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.rtrim(line, F.lit(_BLANKS))) > 0).alias("lines"))
    base = ["id", "lang", "source", "word_chars", "n_symbols"]
    rolled = cut.select(
        *base, long(F.size("h")).alias("n_words"), long(F.size("lines")).alias("n_lines"), long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("h") >= WINDOW, F.transform(F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(
            x, *[F.get("h", i + k) for k in range(1, WINDOW)]))).alias("windows"))
    base += ["n_words", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")  # for most texts nothing is sorted
    lined = rolled.select(*base, F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("order"))
    same = lambda s, i: F.coalesce(s["x"] == F.get("order", i - 1)["x"], F.lit(False)) | F.coalesce(s["x"] == F.get("order", i + 1)["x"], F.lit(False))
    placed = lined.select(*base, F.sort_array(F.transform(F.filter("order", same), lambda s: s["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return placed.select(*base, long(covered).alias("n_repeat_words"))


def estimates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """(g, mean, factor) of every group of (g, v1.., n) rows; a few numbers for each language and source."""
    run = lambda sql, name, **tables: landed(spark.sql(sql, **tables), name)
    medians = run(MEDIANS, "medians", vec=vectors)
    deviations = run(DEVIATIONS, "deviations", vec=vectors, medians=medians)
    fits = run(STARTS, "starts", vec=vectors, medians=medians, deviations=deviations)
    for _ in range(STEPS):
        fits = run(STEP, "fits", vec=vectors, fits=fits)
    best = run(BEST, "best", fits=fits)
    return run(LAST, "estimates", vec=vectors, fits=best)


def screened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
             least_rows: int = LEAST_ROWS) -> DataFrame:
    """(id, counts, base_failed, distance, kept) of every row.

    Texts under ten words, or with more than a fifth of their words in repeated passages, fail the
    base rules and take no part in the estimates; other texts are kept unless their squared
    distance passes the cut.  Null texts are empty; null languages and sources are groups of their
    own; repeated rows count as often as they stand; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = counted(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", F.expr(_FAILED))
    rows = landed(made.select("*", F.expr(GROUP).alias("g"), *[F.expr(f"cast(floor({SCALE} * {sql}) as bigint)").alias(f"v{i}") for i, sql in zip(_DIMS, STATISTICS)]), "counted")
    stats = [f"v{i}" for i in _DIMS]
    distinct = landed(rows.where("not base_failed").groupBy("g", *stats).agg(F.count(F.lit(1)).alias("n")), "vectors")
    large = landed(distinct.groupBy("g").agg(F.sum("n").alias("rows")).where(F.col("rows") >= least_rows).select(F.col("g").alias("own")), "large")
    keyed = distinct.join(large, F.col("g") == F.col("own"), "left")
    vectors = landed(keyed.select(F.explode(F.when(F.col("own").isNull(), F.array(F.lit(""))).otherwise(F.array("own", F.lit("")))).alias("g"), *stats, "n"), "keyed")
    fits = estimates(spark, vectors).drop("det", "s").withColumnRenamed("g", "ref")
    joined = rows.join(large, F.col("g") == F.col("own"), "left").withColumn("ref", F.coalesce("own", F.lit(""))).join(fits, "ref", "left")
    measured = spark.sql(f"select * from {_distance('{joined}')} x", joined=joined)
    return measured.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           F.when(~F.col("base_failed"), F.col("d2")).alias("distance"),
                           (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUT, F.lit(True))).alias("kept"))


def op13_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return screened(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("distance").withColumnRenamed("id", "doc_id")


def _sql() -> str:
    steps, last = [], "f0"
    for k in range(1, STEPS + 1):
        steps.append(f"f{k} as materialized ({STEP.format(vec='vec', fits=last)})")
        last = f"f{k}"
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    line = r"regexp_matches(l, '[^\x20\x09-\x0D]')"
    return f"""
with cut as (select doc_id, row_number() over () as r, coalesce(text, '') as t, lang, source, {words} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: {line}) as lines from documents),
spans as (select r, i, count(*) over (partition by r, x) as c from (select r, unnest(range(len(w) - {WINDOW - 1})) as i,
  unnest(list_transform(range(len(w) - {WINDOW - 1}), lambda i: array_to_string(w[i + 1:i + {WINDOW}], ' '))) as x from cut where len(w) >= {WINDOW})),
again as (select r, sum(least({WINDOW}, coalesce(later - i, {WINDOW}))) as n from (select r, i, lead(i) over (partition by r order by i) as later from spans where c > 1) group by r),
counts as (select doc_id, r, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words from cut left join again using (r)),
judged as (select *, {_FAILED} as base_failed, {GROUP} as g, {', '.join(f'cast(floor({SCALE} * {sql}) as bigint) as v{i}' for i, sql in zip(_DIMS, STATISTICS))} from counts),
sized as (select *, case when count(*) filter (where not base_failed) over (partition by g) >= {LEAST_ROWS} then g else '' end as ref from judged),
vec as materialized (select k as g, v1, v2, v3, v4, count(*) as n from (select unnest(case when ref = '' then [''] else [ref, ''] end) as k, * from sized where not base_failed) group by all),
med as materialized ({MEDIANS.format(vec='vec')}),
dev as materialized ({DEVIATIONS.format(vec='vec', medians='med')}),
f0 as materialized ({STARTS.format(vec='vec', medians='med', deviations='dev')}),
{', '.join(steps)},
best as materialized ({BEST.format(fits=last)}),
fin as materialized ({LAST.format(vec='vec', fits='best')}),
joined as (select j.*, {', '.join(f'fin.{c}' for c in _MEANS + _FACTORS)} from sized j left join fin on j.ref = fin.g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= {CUT!r}, true) as kept
from {_distance('joined')} x"""


ORACLE = _sql()
