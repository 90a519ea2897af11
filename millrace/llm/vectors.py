"""Reading embedding vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(rows whose vector can be compared, the dimension). Left out: null, empty and zero vectors, those with a null or
    non-finite component, and those whose length is not the most frequent one (ties: the smaller length)."""
    x = F.col(vec_col)
    big = float("inf")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(big))) & F.exists(x, lambda v: v != 0)
    good = df.where(F.coalesce(ok, F.lit(False)))
    lengths = good.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    return good.where(F.size(x) == dim), dim


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as float64, of length 1."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x  # no overflow or underflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] if len(x) else x
