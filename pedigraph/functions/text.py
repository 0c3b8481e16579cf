"""Allele, contig, key and INFO text helpers as Spark columns."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, functions as F

from pedigraph.functions.numeric import to_double

# Three-letter to one-letter amino-acid codes.
AMINO_ACIDS = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E",
    "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F",
    "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*",
}


# The spellings of the contig prefix.
_CHR = ["".join(c) for c in itertools.product("cC", "hH", "rR")]


def bare_chrom(chrom: Column) -> Column:
    return F.when(F.substring(chrom, 1, 3).isin(*_CHR), F.substring(chrom, 4, 1 << 30)).otherwise(chrom)


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", bare_chrom(chrom), pos.cast("string"), ref, alt)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def shared_suffix_length(ref: Column, alt: Column) -> Column:
    """Length of the common ending that leaves at least one base on each side."""
    mirrored = F.concat(F.reverse(ref), F.lit("|"), F.reverse(alt))
    found = F.length(F.regexp_extract(mirrored, r"^([^|]*)[^|]+\|\1[^|]+$", 1))
    return F.when((F.length(ref) > 1) & (F.length(alt) > 1), found).otherwise(F.lit(0))


def trim_suffix(ref: Column, alt: Column) -> Column:
    """struct(ref, alt) without their common ending."""
    n = shared_suffix_length(ref, alt)
    return F.struct(
        ref.substr(F.lit(1), F.length(ref) - n).alias("ref"),
        alt.substr(F.lit(1), F.length(alt) - n).alias("alt"),
    )


def _info_pattern(key: str) -> str:
    # the greedy prefix selects the last of repeated keys
    return r"^(?:.*;)?" + re.escape(key).replace(r"\-", "-") + r"(?:=([^;]*))?(?:;.*)?$"


def _items(info: Column) -> Column:
    return F.concat(F.lit(";"), info, F.lit(";"))


def info_has(info: Column, key: str) -> Column:
    items = _items(info)
    return F.coalesce(info.contains(key) & (items.contains(f";{key}=") | items.contains(f";{key};")), F.lit(False))


def info_text(info: Column, key: str) -> Column:
    """Text after ``key=`` (last one wins), NULL when the key is absent or a bare flag.

    Plain searches do; the pattern is for a key that also stands there as a bare flag.
    """
    items = _items(info)
    last = F.substring_index(F.substring_index(items, f";{key}=", -1), ";", 1)
    return F.when(info.contains(f"{key}=") & items.contains(f";{key}="), F.when(
        items.contains(f";{key};"), F.regexp_extract(info, _info_pattern(key), 1)).otherwise(last))


def info_without(info: Column, key: str) -> Column:
    """INFO without the last item ``key=``, for searches of other keys behind a long value."""
    items = _items(info)
    after = F.substring_index(items, f";{key}=", -1)
    before = F.left(items, F.length(items) - F.length(after) - len(key) - 1)
    rest = F.concat(before, after.substr(F.locate(";", after) + 1, F.length(after)))
    return F.when(items.contains(f";{key}="), rest).otherwise(info)


def info_flag(info: Column, key: str) -> Column:
    items = _items(info)
    return F.coalesce(info.contains(key) & items.contains(f";{key};") & ~items.contains(f";{key}="), F.lit(False))


def info_double(info: Column, key: str) -> Column:
    """First comma value as a double; a bare flag counts as 1.  A key that stands nowhere costs one search."""
    items = _items(info)
    last = F.substring_index(F.substring_index(items, f";{key}=", -1), ";", 1)
    value = F.when(items.contains(f";{key};"), F.regexp_extract(info, _info_pattern(key), 1)).otherwise(last)
    return F.when(info.contains(key), F.when(items.contains(f";{key}="), to_double(F.substring_index(value, ",", 1))).when(
        items.contains(f";{key};"), F.lit(1.0)))


def info_any(info: Column, keys: list[str]) -> Column:
    """True when any of ``keys`` occurs, with or without a value."""
    names = "|".join(re.escape(k) for k in keys)
    return F.coalesce(info.rlike(rf"(?:^|;)(?:{names})(?:=|;|$)"), F.lit(False))


def protein_change(text: Column) -> Column:
    """Comparable protein change: no transcript, ``p.`` or brackets, one-letter codes."""
    t = F.trim(F.coalesce(text, F.lit("")))
    t = F.replace(F.substring_index(t, ":", -1), F.lit("%3D"), F.lit("="))
    t = F.when(t.startswith("p."), F.substring(t, 3, 1 << 30)).otherwise(t)
    for bracket in "()":
        t = F.replace(t, F.lit(bracket), F.lit(""))
    for three, one in AMINO_ACIDS.items():
        t = F.replace(t, F.lit(three), F.lit(one))
    return t


def likely_pathogenic_text(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(
        low.contains("pathogenic") & ~low.contains("conflicting") & ~low.contains("benign"), F.lit(False)
    )


def first_of(*columns: Column) -> Column:
    """First non-empty text, else the empty string."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


_JSON_PIECES = r'(?s)\\.|["{}]|[^"{}\\]+|\\$'


def balanced_object(text: Column) -> Column:
    """The first ``{`` of a text up to the ``}`` that closes it, strings and escapes minded; NULL when none closes.

    A fold over the pieces of the text: escapes, quotes, braces and what stands between them.
    """
    opened = F.locate("{", text)
    rest = F.substring(text, opened, 1 << 30)
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("taken"), F.lit(False).alias("closed"))

    def step(state: Column, piece: Column) -> Column:
        plain = ~state["quoted"]
        depth = state["depth"] + F.when(plain & (piece == "{"), 1).when(plain & (piece == "}"), -1).otherwise(0)
        return F.when(state["closed"], state).otherwise(F.struct(
            depth.alias("depth"), (state["quoted"] != (piece == '"')).alias("quoted"), (state["taken"] + F.length(piece)).alias("taken"),
            (plain & (piece == "}") & (depth == 0)).alias("closed")))

    end = F.aggregate(F.regexp_extract_all(rest, F.lit(_JSON_PIECES), 0), start, step)
    return F.when(opened > 0, F.when(end["closed"], F.substring(rest, F.lit(1), end["taken"])))


def json_text(text: Column) -> Column:
    """The JSON object a text holds: all of it if it is one, else the one in its code fence, else the first; NULL without one."""
    whole = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    first = balanced_object(whole)
    fence = F.regexp_instr(whole, F.lit(r"```(?:json)?\s*\{"))
    fenced = F.when(fence > 0, balanced_object(F.substring(whole, fence + 3, 1 << 30)))
    valid = lambda found: F.when(F.try_parse_json(found).isNotNull(), found)
    return F.coalesce(F.when(first == whole, valid(first)), valid(F.coalesce(fenced, first)))
