"""Small tables with every awkward row: nulls, empty and long texts, repeated rows, clashing columns."""

import os
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def awkward(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta eps zeta", "en", "a", 31), (2, "alpha beta gamma delta eps zeta", "en", "a", 31),
        (3, "", "en", "a", 0), (4, None, None, None, None), (None, "password = hunter2hunter2", "fr", "b", 25),
        (5, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (6, "12 34 %% 5", None, "b", 10),
        (7, "\t \n\x0b", "de", "b", 4), (8, "éß 中文 \U0001f389 mit license", "de", None, 18), (2, "alpha beta gamma delta eps zeta", "en", "a", 31),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with columns of names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "fp", "component", "fingerprint", "key", "size", "shard", "slot", "epoch", "block", "start", "vector", "found", "of", "tokens",
                 "piece_ids", "parity", "words", "th", "label", "weight", "copies", "mixed_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
