"""Key handling: SQL semantics by default (null keys join nothing and form one group), strict keys on demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names(keys: str | Sequence[str]) -> list[str]:
    out = [keys] if isinstance(keys, str) else list(keys)
    if not out:
        raise ValueError("at least one key column is needed")
    return out


def require_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The rows, failing at run time on the first null key."""
    for k in names(keys):
        df = df.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null key {k}"))).otherwise(F.col(k)))
    return df


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: no column {', '.join(missing)}; there are {', '.join(df.columns)}")
