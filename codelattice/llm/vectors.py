"""Rows of vectors as arrays, shared by the two vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of doubles) of the vectors that can take part, one row for each vec_id.

    Left out: null ids, null, empty or zero vectors, vectors with a null or non-finite component. Of rows
    with the same vec_id the smallest vector stays. Other columns are dropped. Vectors may differ in
    length; the operators compare those of one length with each other.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    """An Arrow list column of doubles as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row number of each distinct row, and for each row the number of its distinct one."""
    x = np.ascontiguousarray(x + 0.0)  # one zero only
    odd = np.random.default_rng(1).integers(1, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = x.view(np.uint64)
    _, first, group = np.unique(((bits ^ (bits >> np.uint64(29))) * odd).sum(axis=1, dtype=np.uint64), return_index=True, return_inverse=True)
    if not (x[first][group] == x).all():  # two different rows met in the hash
        _, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
    return first, group.reshape(-1)
