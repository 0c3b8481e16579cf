"""Shared by the vector operators: which vectors take part, and their second moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    """The vectors of a series as rows of a double matrix."""
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in batch.groupby("dim")["vector"]:
            x = unit(matrix(part))
            total[dim] = total.get(dim, 0) + x.T @ x
    for dim, m in total.items():
        yield pd.DataFrame({"dim": dim, "cell": np.arange(dim * dim), "x": m.ravel()})


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension met, the axes of the unit vectors' second moments, strongest first.

    Every task sends one row per matrix cell, summed in the shuffle; the driver gets one
    matrix per dimension.
    """
    sums = rows.select("dim", "vector").mapInPandas(_moments, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x")).toPandas()
    axes = {}
    for dim, part in sums.groupby("dim"):
        m = np.zeros(dim * dim)
        m[part["cell"].to_numpy()] = part["x"].to_numpy()
        axes[int(dim)] = np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1].copy()
    return axes
