"""Small plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    A filter is never pushed through a generator, so a costly column that later
    filters look at is evaluated once instead of once per mention.  The expressions
    stay in a projection below it, which always compiles; the generator only hands
    over the finished values.
    """
    held = df.select("*", *[c.alias(f"__{n}") for n, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns]
    return held.select(*kept, F.inline(F.array(F.struct(*[F.col(f"__{n}").alias(n) for n in columns]))))
