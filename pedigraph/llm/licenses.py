"""License scan by diagonal voting, in DataFrame functions only.

Every pair of neighbouring words of every text is hashed and joined with the hashed word
pairs of the templates.  A match votes for its diagonal, the word number minus the place
in the template; votes are kept as a bit mask of template places, so nothing votes twice.
Base phrases need every vote on one diagonal.  For the longer notices neighbouring
diagonals (words put in or left out) are merged and the span is verified: enough of the
template's places, within a span not much longer than the template.  Longer runs, such as
repeats of a short notice, are verified stretch by stretch.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pedigraph.llm.common import pick

# The base phrases and their labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# Notices as their licenses word them.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "licensed under cc by"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
# Words that say nothing; pairs of two such words are not indexed.
PLAIN = frozenset("a an and any are as at be by for from in is it of on or that the this to under with you".split())

GAP = 3  # diagonals this near belong together
COVERAGE = 0.75  # share of a template's places that must be found
_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SELF = 0  # the hash that stands for the row itself, so that rows without a match stay


def template_pairs(phrase: str) -> list[tuple[int, str, str]]:
    """(place, word, next word) of the indexed pairs of a phrase; at most 63, the bits of a vote."""
    words = phrase.split()
    found = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if not (a in PLAIN and b in PLAIN)]
    if not found or len(words) > 63:
        raise ValueError(f"a template needs 1 to 62 indexed pairs: {phrase}")
    return found


def template_rows(base=BASE, notices=NOTICES) -> list[tuple]:
    """(template, label, is_base, places, length, place, word, next word) for every indexed pair."""
    rows = []
    for n, (label, phrase, is_base) in enumerate([(*t, True) for t in base] + [(*t, False) for t in notices]):
        pairs = template_pairs(phrase)
        rows += [(n, label, is_base, len(pairs), len(phrase.split()), place, a, b) for place, a, b in pairs]
    return rows


def _templates(spark: SparkSession, base, notices) -> DataFrame:
    made = spark.createDataFrame(template_rows(base, notices), "template int, label string, is_base boolean, places int, length int, place int, a string, b string")
    itself = spark.createDataFrame([(-1, None, False, 1, 0, 0)], "template int, label string, is_base boolean, places int, length int, place int")
    return made.withColumn("gram", F.xxhash64(F.xxhash64("a"), F.xxhash64("b"))).drop("a", "b").unionByName(
        itself.withColumn("gram", F.lit(_SELF).cast("long")))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """(id, th, n_words, copies, template, diagonal, mask ...): votes per row and diagonal.

    Every row of the input has the template -1 as well.  ``copies`` counts repeated rows,
    whose votes fall on the same bits.
    """
    rows = pick(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
        F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), _WORDS), "").alias("words"))
    hashed = rows.select("id", "th", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    pairs = F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + 1)))
    grams = hashed.select("id", "th", "n_words", F.posexplode(F.concat(F.array(F.lit(_SELF).cast("long")), pairs)).alias("at", "gram"))
    # as many rows as the templates have words: bounded by the given templates, not by the corpus
    found = grams.join(F.broadcast(_templates(docs.sparkSession, base, notices)), "gram")
    return found.groupBy("id", "th", "template", (F.col("at") - 1 - F.col("place")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        F.first("places").alias("places"), F.first("length").alias("length"),
        F.expr("bit_or(shiftleft(1L, place))").alias("mask"), F.min("at").alias("low"), F.max("at").alias("high"))


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans and the rows themselves (template -1): label, start and end word, coverage.

    A run of neighbouring diagonals too long for its template (repeats of a short notice) gives
    its best stretch of 2 * GAP diagonals, which is never too long.
    """
    line = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    near = votes.withColumn("before", F.lag("diagonal").over(line)).withColumn(
        "run", F.sum(F.when(F.col("diagonal") - F.col("before") <= F.when(F.col("is_base"), F.lit(0)).otherwise(F.lit(GAP)), 0).otherwise(1)).over(line))
    within = Window.partitionBy("id", "th", "template", "run").orderBy("diagonal").rangeBetween(0, 2 * GAP)
    tight = near.withColumn("tight", F.struct(
        (F.bit_count(F.bit_or("mask").over(within)) / F.col("places")).alias("coverage"),
        (1 - F.min("low").over(within)).alias("back"), (F.max("high").over(within) + 1).alias("end")))
    merged = tight.groupBy("id", "th", "template", "run").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        F.first("places").alias("places"), F.first("length").alias("length"), F.expr("bit_or(mask)").alias("mask"),
        (F.min("low") - 1).alias("start"), (F.max("high") + 1).alias("end"), F.max("tight").alias("tight"))
    coverage = F.bit_count("mask") / F.col("places")
    fits = F.when(F.col("is_base"), coverage == 1.0).otherwise(
        (coverage >= COVERAGE) & (F.col("end") - F.col("start") <= F.col("length") + 2 * GAP))
    best = ~F.col("is_base") & (F.col("tight.coverage") >= COVERAGE)
    found = merged.withColumn("coverage", coverage).withColumn("whole", (F.col("template") == -1) | fits).where(F.col("whole") | best)
    part = lambda name, own: F.when(F.col("whole"), F.col(name)).otherwise(own).alias(name)
    return found.select("id", "th", "template", "run", "n_words", "copies", "label", "is_base", "places", "length", "mask",
                        part("start", -F.col("tight.back")), part("end", F.col("tight.end")), part("coverage", F.col("tight.coverage")))


def license_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per input row: n_words, base places, labels and score.

    The score is the best coverage of a verified template (1 for a base phrase), else 0.
    Null texts are empty; rows with a null id and repeated rows each give their own row; an
    empty table gives an empty result.
    """
    is_base, itself = F.col("is_base"), F.col("template") == -1
    listed = lambda labels: F.array_join(F.array_sort(F.collect_set(labels)), ",")  # noqa: E731  a set of template labels
    found = spans(matches(docs, id_col, text_col, base, notices)).groupBy("id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max(F.when(itself, F.col("copies"))).alias("copies"),
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"), listed(F.when(is_base, F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"), F.max(F.when(itself, 0.0).otherwise(F.col("coverage"))).alias("score"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies", "th")


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return license_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def _sql_rows() -> str:
    return ", ".join(f"({n}, '{label}', {base}, {places}, {length}, {place}, '{a}', '{b}')" for n, label, base, places, length, place, a, b in template_rows())


ORACLE = re.sub(r"\n\s+", "\n", f"""
with templates(template, label, is_base, places, length, place, a, b) as (values {_sql_rows()}),
rows as (select doc_id, row_number() over () as r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as words
  from documents),
spots as (select r, words, unnest(range(len(words) - 1)) as i from rows where len(words) > 1),
hits as (select r, template, any_value(label) as label, any_value(is_base) as is_base, any_value(places) as places, any_value(length) as length,
  i - place as diagonal, bit_or(1::bigint << place) as mask, min(i) as low, max(i) as high
  from spots join templates on words[i + 1] = a and words[i + 2] = b group by r, template, i - place),
near as (select *, case when diagonal - lag(diagonal) over w <= case when is_base then 0 else {GAP} end then 0 else 1 end as fresh from hits
  window w as (partition by r, template order by diagonal)),
runs as (select *, sum(fresh) over (partition by r, template order by diagonal) as run from near),
near_by as (select *, bit_count(bit_or(mask) over (partition by r, template, run order by diagonal range between current row and {2 * GAP} following))::double / places as tight from runs),
merged as (select r, template, any_value(label) as label, any_value(is_base) as is_base, any_value(places) as places, any_value(length) as length,
  bit_count(bit_or(mask))::double / any_value(places) as coverage, min(low) as low, max(high) + 2 as high, max(tight) as tight from near_by group by r, template, run),
judged as (select *, case when is_base then coverage = 1 else coverage >= {COVERAGE} and high - low <= length + {2 * GAP} end as whole from merged),
fits as (select r, label, is_base, low, case when whole then coverage else tight end as coverage from judged where whole or not is_base and tight >= {COVERAGE})
select any_value(doc_id) as doc_id, any_value(len(words))::bigint as n_words, count(label) filter (where is_base) as n_base,
  min(low) filter (where is_base) as first_word, max(low) filter (where is_base) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (where is_base), '') as base_labels,
  coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(coverage), 0.0)::double as score
from rows left join fits using (r) group by r""")
