"""A corpus pipeline of five stages: language, near copies, secrets, mixing, pieces.

Every stage takes (spark, docs, sf_dir) and returns a frame; run() writes each one as
Parquet in the shared folder and reads it again for the next.  All stages but the last
return the columns of documents.  A stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.llm.common import at, landed, pick
from pedigraph.llm.langid import predict, train
from pedigraph.llm.mixing import mixed
from pedigraph.llm.pieces import encoded
from pedigraph.llm.secrets import redacted
from pedigraph.llm.shingles import grouped, key_column

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language.

    The model learns from the labelled rows of ``docs`` outside the held-out fold.  Null texts,
    texts without a letter, and texts of which the best language codes under a quarter of the
    bytes shorter than no model would go; everything else stays as it is.
    """
    model = train(docs)
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    found = numbered.withColumn("found", predict(spark, model, F.col(f"_{at(docs, 'text')}")))
    return found.where("not found.rejected").drop("found").toDF(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id.

    Texts link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more, or
    their SimHash fingerprints, those of ``op8_simhash_near_dup``, lie within its radius.
    A group is decided by id and set of shingles, not by id alone: texts of other groups that
    share the id stay.  Rows with a null id come last in their group, then the order is that
    of the sets; of rows alike in both one stays.
    """
    rooted = landed(grouped(pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")), "rooted")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    kept = landed(rooted.groupBy("root").agg(F.min(order).alias("first")).select("first.id", "first.key"), "kept")
    counts = rooted.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    repeated = landed(counts.where("n > 1").select("id"), "repeated")
    lone = rooted.where("id is not null").join(repeated, "id", "left_anti")
    gone = lone.join(kept.select("id", F.lit(True).alias("stays")), "id", "left").where("stays is null").select("id")
    names = docs.columns
    text, key = f"_{at(docs, 'text')}", f"_{at(docs, 'doc_id')}"
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    result = numbered.where(F.col(key).isNotNull()).join(landed(gone.union(repeated), "apart"), F.col(key) == F.col("id"), "left_anti")
    if kept.where("id is null").limit(1).count() or repeated.limit(1).count():
        unsure = numbered.where(F.col(key).isNull()).unionByName(numbered.join(repeated, F.col(key) == F.col("id"), "left_semi"))
        keyed = unsure.withColumn("key", key_column(F.col(text))).alias("d")
        match = F.col(f"d.{key}").eqNullSafe(F.col("k.id")) & (F.col("d.key") == F.col("k.key"))
        result = result.unionByName(keyed.join(kept.alias("k"), match, "left_semi").dropDuplicates([key, "key"]).drop("key"))
    return result.toDF(*names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found in a text; all documents stay and n_chars follows the text."""
    clean = redacted(docs)
    names = docs.columns
    numbered = clean.toDF(*[f"_{i}" for i in range(len(names))])
    text, count = f"_{at(docs, 'text')}", f"_{at(docs, 'n_chars')}"
    return numbered.withColumn(count, F.when(F.col(text).isNull(), F.col(count)).otherwise(F.length(text).cast("long"))).toDF(*names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources under a repetition limit of two: every document stays, small sources repeat."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids."""
    return encoded(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("pieces", pieces)]

#: Code lengths, hashes of shingles and piece ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
