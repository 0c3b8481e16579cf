"""Probability kernels as Spark columns (no Python workers on the hot path)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from pedigraph.functions.numeric import item, let

_SMALL = 20
_LN_FACT_SMALL = "array(" + ", ".join(f"{math.lgamma(i + 1.0)!r}D" for i in range(_SMALL)) + ")"
P_MIN = 1e-12


def as_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ln_fact(n: Column) -> Column:
    """ln(n!) for whole ``n >= 0``: exact values below 20, Stirling's series above."""
    x = n.cast("double")
    inv = F.lit(1.0) / x
    inv2 = inv * inv
    series = (
        x * F.ln(x) - x + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * x)
        + inv * (F.lit(1 / 12) - inv2 * (F.lit(1 / 360) - inv2 * (F.lit(1 / 1260) - inv2 * F.lit(1 / 1680))))
    )
    return F.when(n < _SMALL, F.get(F.expr(_LN_FACT_SMALL), n.cast("int"))).otherwise(series)


def _clamp_p(p) -> Column:
    if isinstance(p, (int, float)):
        return F.lit(min(max(float(p), P_MIN), 1 - P_MIN))
    return F.least(F.greatest(p, F.lit(P_MIN)), F.lit(1 - P_MIN))


def ln_binom_pmf(k: Column, n: Column, p) -> Column:
    q = _clamp_p(p)
    return (
        ln_fact(n) - ln_fact(k) - ln_fact(n - k)
        + k.cast("double") * F.ln(q) + (n - k).cast("double") * F.ln(F.lit(1.0) - q)
    )


def _tail(start: Column, end: Column, n: Column, p: Column, up: bool) -> Column:
    """Sum of the pmf from ``start`` outward to ``end``: the first term times a sum of ratio products.

    Away from the mode every ratio is below 1, so nothing overflows and one
    multiplication per term is enough.
    """
    odds = p / (F.lit(1.0) - p)

    def step(acc, i):
        x = i.cast("double")
        ratio = (n - x + 1.0) / x * odds if up else (x + 1.0) / (n - x) / odds
        t = acc["t"] * ratio
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    walk = F.sequence(start + 1, end) if up else F.sequence(start - 1, end, F.lit(-1).cast("bigint"))
    more = (start < end) if up else (start > end)
    total = F.when(more, F.aggregate(walk, one, step)["s"]).otherwise(F.lit(1.0))
    return F.exp(ln_binom_pmf(start, n, p)) * total


def _upper(k: Column, n: Column, p: Column) -> Column:
    return _tail(k, n, n, p, up=True)


def _lower(k: Column, n: Column, p: Column) -> Column:
    return _tail(k, F.lit(0).cast("bigint"), n, p, up=False)


def binom_cdf(k, n, p) -> Column:
    """P(X <= k)."""
    k, n, p = as_col(k).cast("bigint"), as_col(n).cast("bigint"), _clamp_p(p)
    return (
        F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0))
        .when(k <= n * p, F.least(F.lit(1.0), _lower(k, n, p)))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - _upper(k + 1, n, p)))
    )


def binom_sf(k, n, p) -> Column:
    """P(X >= k); 0 when k is above n."""
    k, n, p = as_col(k).cast("bigint"), as_col(n).cast("bigint"), _clamp_p(p)
    return (
        F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0))
        .when(k >= n * p, F.least(F.lit(1.0), _upper(k, n, p)))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - _lower(k - 1, n, p)))
    )


def _short(first: Column, ratio: Column, limit: float, walked: Column) -> Column:
    """Is a tail below ``limit``: told by its first term and by the geometric series over it, walked only in between."""
    return (
        F.when(first >= limit, F.lit(False))
        .when((ratio < 1.0) & (first / (F.lit(1.0) - ratio) < 0.999 * limit), F.lit(True))
        .otherwise(F.least(F.lit(1.0), walked) < limit)
    )


def binom_cdf_below(k, n, p, limit: float) -> Column:
    """``binom_cdf(k, n, p) < limit``."""
    k, n, p = as_col(k).cast("bigint"), as_col(n).cast("bigint"), _clamp_p(p)
    ratio = k.cast("double") / (n - k + 1) * (F.lit(1.0) - p) / p
    return (
        F.when(k < 0, F.lit(0.0 < limit)).when(k >= n, F.lit(1.0 < limit))
        .when(k <= n * p, _short(F.exp(ln_binom_pmf(k, n, p)), ratio, limit, _lower(k, n, p)))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - _upper(k + 1, n, p)) < limit)
    )


def binom_sf_below(k, n, p, limit: float) -> Column:
    """``binom_sf(k, n, p) < limit``."""
    k, n, p = as_col(k).cast("bigint"), as_col(n).cast("bigint"), _clamp_p(p)
    ratio = (n - k).cast("double") / (k + 1) * p / (F.lit(1.0) - p)
    return (
        F.when(k <= 0, F.lit(1.0 < limit)).when(k > n, F.lit(0.0 < limit))
        .when(k >= n * p, _short(F.exp(ln_binom_pmf(k, n, p)), ratio, limit, _upper(k, n, p)))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - _lower(k - 1, n, p)) < limit)
    )


def wilson_interval(k, n, z: float = 1.96) -> Column:
    """struct(lo, hi) of the Wilson score interval; (0, 1) for n = 0."""
    k, n = as_col(k).cast("double"), as_col(n).cast("double")
    p = k / n
    denom = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (n * 2.0)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (n * n * 4.0)) / denom
    return F.when(n == 0, F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))).otherwise(
        F.struct(F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi"))
    )


def fisher_exact(a, b, c, d, limit: float | None = None) -> Column:
    """Two-sided Fisher exact p-value of the table [[a, b], [c, d]].

    Terms are taken relative to the observed table, walking outward from it, and
    count when they are not larger than it (up to 1e-7 in the logarithm).  With
    ``limit`` a table that alone reaches it is not walked from: its own probability
    stands for a p-value that is only known to be no smaller.
    """
    a, b, c, d = (as_col(v).cast("bigint") for v in (a, b, c, d))
    r, m, n = a + b, a + c, a + b + c + d
    lo, hi = F.greatest(F.lit(0).cast("bigint"), r + m - n), F.least(r, m)
    limit = math.exp(1e-7)

    def step(up):
        def one(acc, i):
            x = i.cast("double")
            # p(x) / p(x - 1) going up, p(x) / p(x + 1) going down
            ratio = ((r - x + 1.0) * (m - x + 1.0) / (x * (n - r - m + x)) if up
                     else (x + 1.0) * (n - r - m + x + 1.0) / ((r - x) * (m - x)))
            t = acc["t"] * ratio
            return F.struct(t.alias("t"), (acc["s"] + F.when(t <= limit, t).otherwise(0.0)).alias("s"))
        return one

    zero = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    above = F.when(a < hi, F.aggregate(F.sequence(a + 1, hi), zero, step(True))["s"]).otherwise(F.lit(0.0))
    below = F.when(
        a > lo, F.aggregate(F.sequence(a - 1, lo, F.lit(-1).cast("bigint")), zero, step(False))["s"]
    ).otherwise(F.lit(0.0))
    observed = F.exp(
        ln_fact(r) + ln_fact(n - r) + ln_fact(m) + ln_fact(n - m) - ln_fact(n)
        - ln_fact(a) - ln_fact(b) - ln_fact(c) - ln_fact(d)
    )
    p = F.least(F.lit(1.0), observed * (F.lit(1.0) + above + below))
    return p if limit is None else F.when(observed >= limit, observed).otherwise(p)


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(v))) of an array; -inf when every element is -inf."""
    ninf = float("-inf")
    return let(
        F.array_max(values),
        lambda m: F.when(m == ninf, F.lit(ninf)).otherwise(
            m + F.ln(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
        ),
    )


# --------------------------------------------------------------------------- #
# Trio posterior
# --------------------------------------------------------------------------- #
def genotype_likelihoods(df, name: str, pl: Column, ref_depth: Column, alt_depth: Column, ploidy: Column, err: float):
    """Add ``name``: struct(l0, l1, l2) of genotype likelihoods scaled so that the best one is 1.

    Phred likelihoods are used when there is one per genotype, otherwise a
    binomial read model with a symmetric error rate; its combinatorial term is the
    same for every genotype and cancels.  A haploid sample has no l2.
    """
    step = -math.log(10) / 10.0
    k, m = alt_depth.cast("double"), ref_depth.cast("double")
    hap = ploidy == 1
    given = F.size(pl) == ploidy + 1

    def phred(i):
        return item(pl, i).cast("double") * step

    hom_alt = k * math.log(1 - err) + m * math.log(err)
    raw = df.select(
        "*", F.when(given, phred(0)).otherwise(k * math.log(err) + m * math.log(1 - err)).alias("_l0"),
        F.when(given, phred(1)).otherwise(F.when(hap, hom_alt).otherwise((k + m) * math.log(0.5))).alias("_l1"),
        F.when(~hap, F.when(given, phred(2)).otherwise(hom_alt)).alias("_l2"),
    ).withColumn("_top", F.greatest("_l0", "_l1", "_l2"))
    scaled = [
        F.coalesce(F.exp(F.col(f"_l{i}") - F.col("_top")), F.lit(0.0)).alias(f"l{i}") for i in range(3)
    ]
    return raw.withColumn(name, F.struct(*scaled)).drop("_l0", "_l1", "_l2", "_top")


def add_de_novo_posterior(df, name: str, child: str, father: str, mother: str, father_ploidy: Column,
                          has_father: Column, has_mother: Column, pop_af: Column, mu: Column, floor: float):
    """Add ``name``: P(the child's ALT arose de novo) from scaled genotype likelihood structs.

    The joint sum over parental genotypes factorises: for each parent keep the
    mass that transmits REF and ALT, then convolve the two parents.  An absent
    parent transmits nothing, which is the unit of that convolution.
    """
    one, nil = F.lit(1.0), F.lit(0.0)
    base = df.select(
        "*", F.least(F.greatest(F.coalesce(pop_af, nil), F.lit(floor)), F.lit(0.5)).alias("_q"), mu.alias("_mu")
    )
    q, u = F.col("_q"), F.col("_mu")

    def weights(lik, hap):
        return [
            F.when(hap, one - q).otherwise((one - q) * (one - q)) * F.col(lik)["l0"],
            F.when(hap, q).otherwise(q * (one - q) * 2.0) * F.col(lik)["l1"],
            F.when(hap, nil).otherwise(q * q * F.col(lik)["l2"]),
        ]

    hap = father_ploidy == 1
    never = F.lit(False)
    base = base.select("*", *[w.alias(f"_f{i}") for i, w in enumerate(weights(father, hap))],
                       *[w.alias(f"_m{i}") for i, w in enumerate(weights(mother, never))])

    def masses(p, haploid, present):
        w0, w1, w2 = (F.col(f"_{p}{i}") for i in range(3))
        half = F.when(haploid, one).otherwise(F.lit(0.5))
        t1 = half * (one - u) + (one - half) * u
        return [
            F.when(present, w0 * (one - u) + w1 * (one - t1) + w2 * u).otherwise(one).alias(f"_{p}r"),
            F.when(present, w0 * u + w1 * t1 + w2 * (one - u)).otherwise(nil).alias(f"_{p}a"),
            F.when(present, w0 * (one - u)).otherwise(one).alias(f"_{p}r0"),
            F.when(present, w0 * u).otherwise(nil).alias(f"_{p}a0"),
        ]

    base = base.select("*", *masses("f", hap, has_father), *masses("m", never, has_mother))
    fr, fa, fr0, fa0, mr, ma, mr0, ma0 = (F.col(f"_{p}{x}") for p in "fm" for x in ("r", "a", "r0", "a0"))
    c0, c1, c2 = (F.col(child)[f"l{i}"] for i in range(3))
    total = c0 * fr * mr + c1 * (fa * mr + fr * ma) + c2 * fa * ma
    novo = c1 * (fa0 * mr0 + fr0 * ma0) + c2 * fa0 * ma0
    spare = ["_q", "_mu", *[f"_{p}{x}" for p in "fm" for x in (0, 1, 2, "r", "a", "r0", "a0")]]
    return base.withColumn(name, novo / total).drop(*spare)


def two_class_log_ratio(k: Column, n: Column, p1: Column, p0) -> Column:
    """ln of Binom(k; n, p1) / Binom(k; n, p0): the combinatorial term cancels."""
    a, b = _clamp_p(p1), _clamp_p(p0)
    return k.cast("double") * (F.ln(a) - F.ln(b)) + (n - k).cast("double") * (F.ln(F.lit(1.0) - a) - F.ln(F.lit(1.0) - b))


def logistic(x: Column) -> Column:
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))
