"""Number parsing, rounding and text formatting as Spark columns.

Spark's ``round``/``format_number`` round the shortest decimal text of a double
half-up.  The tables this engine writes need round-half-even on the exact binary
value, so :func:`round_even` decides ties with the rounding error of the scaled
product (an error-free product of two doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1, splits a double in two 26-bit halves


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(text: Column) -> Column:
    """Text with the missing marks (``.`` and the empty string) turned into NULL."""
    return F.when(text.isin(".", ""), F.lit(None).cast("string")).otherwise(text)


def _suffixed(text: Column, pattern: str) -> Column:
    """A letter that a cast would take for a number's type; the pattern is looked at only where one stands."""
    return (text.contains("d") | text.contains("D") | text.contains("f") | text.contains("F")) & text.rlike(pattern)


def to_double(text: Column) -> Column:
    """NULL for missing or unreadable text; ``nan`` and ``inf`` are read as such."""
    return F.when(~_suffixed(text, "[0-9.][dDfF]\\s*$"), present(text).try_cast("double"))


def _plain(text: Column) -> Column:
    """Digits alone, read without a double; NULL where a double may read something else."""
    return F.when((F.length(text) <= 15) & ~text.contains("."), text.try_cast("bigint"))


def to_long(text: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.when(~text.isin(".", ""), F.coalesce(_plain(text), F.bround(to_double(text), 0).try_cast("bigint")))


def cut_long(text: Column) -> Column:
    """One element of ``long_list``: cut toward zero, 0 where nothing can be read."""
    return F.coalesce(_plain(text), to_double(text).cast("bigint"), F.lit(0).cast("bigint"))


def long_list(text: Column) -> Column:
    """Comma list of numbers cut toward zero; a missing element is NULL and counts as 0."""
    return F.when(present(text).isNull(), F.array().cast("array<bigint>")).otherwise(double_list(text, ",").cast("array<bigint>"))


def double_list(text: Column, marks: str) -> Column:
    """The numbers between ``marks``, NULL for what ``to_double`` does not read; one cast unless some carry a suffix."""
    cells = F.split(text, marks)
    return F.when(_suffixed(text, "[0-9.][dDfF]\\s*([,&]|$)"), F.transform(cells, to_double)).otherwise(cells.try_cast("array<double>"))


def largest(text: Column, marks: str) -> Column:
    """The largest number between ``marks`` (single signs).

    A text without a mark is one number and a missing one none, so neither is cut into a list.  A cast that fails
    costs far more than one that is not tried.
    """
    several = F.array_max(double_list(text, f"[{marks}]"))
    for mark in marks:
        cut = text.contains(mark)
        marked = cut if mark == marks[0] else marked | cut
    return F.when(~text.isin(".", ""), F.when(marked, several).otherwise(to_double(text)))


def item(values: Column, i: int) -> Column:
    """Element ``i`` with NULL and out-of-range read as 0."""
    return F.coalesce(F.get(values, F.lit(i)), F.lit(0).cast("bigint"))


def sum_from(values: Column, first: int = 0) -> Column:
    """Sum of the elements from index ``first``; plain arithmetic for up to four of them."""
    few = item(values, first)
    for i in range(first + 1, first + 4):
        few = few + item(values, i)
    many = F.aggregate(
        F.slice(values, first + 1, 1_000_000), F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0))
    )
    return F.when(F.size(values) <= first + 4, few).otherwise(many)


def _even_product(v: Column, scale: Column) -> Column:
    """Whole number nearest to ``v * scale`` for ``v >= 0`` and an exact ``scale``, ties to even."""
    c = F.lit(_SPLIT) * scale
    s_hi = c - (c - scale)
    s_lo = scale - s_hi
    x_hi = F.lit(_SPLIT) * v - (F.lit(_SPLIT) * v - v)
    x_lo = v - x_hi
    p = v * scale
    err = ((x_hi * s_hi - p) + x_hi * s_lo + x_lo * s_hi) + x_lo * s_lo
    low = F.floor(p)
    part = p - low
    return (
        F.when(part > 0.5, low + 1)
        .when(part < 0.5, low)
        .when(err > 0, low + 1)
        .when(err < 0, low)
        .otherwise(low + F.pmod(low, F.lit(2)))
    )


def _even_quotient(v: Column, scale: Column) -> Column:
    """Whole number nearest to ``v / scale``, ties to even; the tie itself is an exact double."""
    low = F.floor(v / scale)
    tie = (low * 2 + 1).cast("double") * scale / 2.0
    return (
        F.when(v > tie, low + 1).when(v < tie, low).otherwise(low + F.pmod(low, F.lit(2)))
    )


def _scaled_even(x: Column, digits: int) -> Column:
    return let(x, lambda v: _even_product(v, F.lit(float(10**digits))))


def round_even(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals on the exact binary value, ties to even."""
    return F.signum(x) * _scaled_even(F.abs(x), digits) / F.lit(float(10**digits))


def round_even_column(x: Column, digits: int) -> Column:
    """``round_even`` of a column that is there already, in compiled arithmetic."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * _even_product(F.abs(x), scale) / scale


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals."""
    whole = _scaled_even(F.abs(x), digits)

    def text(n):
        body = n.cast("string")
        if digits:
            body = F.concat(
                F.floor(n / F.lit(10**digits)).cast("bigint").cast("string"),
                F.lit("."),
                F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"),
            )
        return body

    out = let(whole.cast("bigint"), text)
    return F.when(x < 0, F.concat(F.lit("-"), out)).otherwise(out)


def _digits_and_exponent(x: Column, sig: int) -> Column:
    """struct(d, e): ``sig`` significant digits as a whole number and the exponent."""

    def build(v):
        e0 = F.floor(F.log10(v)).cast("int")
        # log10 may land on the wrong side of a power of ten
        e = (
            F.when(F.pow(F.lit(10.0), e0.cast("double")) > v, e0 - 1)
            .when(F.pow(F.lit(10.0), (e0 + 1).cast("double")) <= v, e0 + 1)
            .otherwise(e0)
        )

        def scaled(exp):
            shift = F.lit(sig - 1) - exp
            up = _even_product(v, F.pow(F.lit(10.0), shift.cast("double")))
            down = _even_quotient(v, F.pow(F.lit(10.0), (-shift).cast("double")))
            d = F.when(shift >= 0, up).otherwise(down).cast("bigint")
            return (
                F.when(d >= 10**sig, F.struct(F.lit(10 ** (sig - 1)).cast("bigint").alias("d"), (exp + 1).alias("e")))
                .otherwise(F.struct(d.alias("d"), exp.cast("int").alias("e")))
            )

        return let(e, scaled)

    return let(x, build)


def _exponent_text(e: Column) -> Column:
    return F.concat(
        F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string"))).otherwise(F.abs(e).cast("string")),
    )


def scientific(x: Column, digits: int) -> Column:
    """Exponent text such as ``1.00e-02`` with ``digits`` decimals."""

    def text(de):
        d = de["d"].cast("string")
        head = F.substring(d, 1, 1)
        if digits:
            head = F.concat(head, F.lit("."), F.substring(d, 2, digits))
        return F.concat(head, _exponent_text(de["e"]))

    body = let(_digits_and_exponent(F.abs(x), digits + 1), text)
    zero = F.lit("0" + ("." + "0" * digits if digits else "") + "e+00")
    return F.when(x == 0, zero).when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def general(x: Column, sig: int = 6) -> Column:
    """Shortest of fixed and exponent text with at most ``sig`` significant digits."""

    def text(de):
        d, e = de["d"].cast("string"), de["e"]
        stripped = F.regexp_replace(d, "0+$", "")
        mantissa = F.when(
            F.length(stripped) > 1,
            F.concat(F.substring(stripped, 1, 1), F.lit("."), stripped.substr(F.lit(2), F.lit(sig))),
        ).otherwise(F.substring(stripped, 1, 1))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), stripped)
        whole = d.substr(F.lit(1), e + 1)
        rest = F.regexp_replace(d.substr(e + 2, F.lit(sig)), "0+$", "")
        plain = F.when(F.length(rest) > 0, F.concat(whole, F.lit("."), rest)).otherwise(whole)
        return (
            F.when((e < -4) | (e >= sig), F.concat(mantissa, _exponent_text(e)))
            .when(e < 0, small)
            .otherwise(plain)
        )

    body = let(_digits_and_exponent(F.abs(x), sig), text)
    # a whole number, or a shortest text of no more digits than asked for, is the answer already
    size = F.abs(x)
    near = size < 10 ** min(sig, 7)
    short = size.cast("string")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, F.lit("0"))
        .when(near & (size == F.floor(size)), x.cast("bigint").cast("string"))
        .when(near & (size >= 1) & (F.length(short) <= sig + 1) & ~short.endswith("0"), F.when(x < 0, F.concat(F.lit("-"), short)).otherwise(short))
        .when(x < 0, F.concat(F.lit("-"), body))
        .otherwise(body)
    )


def py_bool(b: Column) -> Column:
    return F.when(b, F.lit("True")).otherwise(F.lit("False"))


def py_float(x: Column) -> Column:
    """Decimal text of a double with at least one decimal (``2.0``), as used for copy numbers."""
    return x.cast("double").cast("string")
