"""Relational idioms that are made of the generic operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.keys import names


def _on(left: DataFrame, right: DataFrame, left_keys, right_keys) -> Column:
    return reduce(Column.__and__, (left[a] == right[b] for a, b in zip(names(left_keys), names(right_keys))))


def anti(left: DataFrame, right: DataFrame, left_keys, right_keys) -> DataFrame:
    """Left rows without a partner (NOT EXISTS)."""
    return left.join(right, _on(left, right, left_keys, right_keys), "left_anti")


def semi(left: DataFrame, right: DataFrame, left_keys, right_keys) -> DataFrame:
    """Left rows with a partner (EXISTS), each once."""
    return left.join(right, _on(left, right, left_keys, right_keys), "left_semi")


def outer(left: DataFrame, right: DataFrame, left_keys, right_keys, side: str = "full") -> DataFrame:
    """Outer join; ``side`` is left, right or full."""
    return left.join(right, _on(left, right, left_keys, right_keys), f"{side}_outer")


def theta(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Join on any condition; equalities among its conjuncts become a hash or merge join."""
    return left.join(right, condition)


def distinct(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(keys)) if keys else df.distinct()


def intersect(left: DataFrame, right: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return left.intersectAll(right) if keep_duplicates else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return left.exceptAll(right) if keep_duplicates else left.subtract(right)


def keep_least(df: DataFrame, keys: str | Sequence[str], value: str) -> DataFrame:
    """Every row of a group whose value is the group's least (ties stay): a window rank, whose group limit drops rows
    before the shuffle."""
    w = Window.partitionBy(*names(keys)).orderBy(F.col(value))
    return df.withColumn("__rank", F.rank().over(w)).where(F.col("__rank") == 1).drop("__rank")


def coalesce_union(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Field-wise union of two records with equal keys: left's value where it is not null, else right's. Keys of either
    side stay."""
    keys = names(keys)
    columns = list(dict.fromkeys([*left.columns, *right.columns]))
    a, b = left.alias("__l"), right.alias("__r")
    on = reduce(Column.__and__, (F.col(f"__l.{k}") == F.col(f"__r.{k}") for k in keys))

    def field(c: str) -> Column:
        sides = [F.col(f"__{s}.{c}") for s, df in (("l", left), ("r", right)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return a.join(b, on, "full_outer").select([field(c) for c in columns])


def group_difference(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, out: str = "difference") -> DataFrame:
    """Sum of left's values minus sum of right's, by every key of either side; a missing side counts 0."""
    both = left.select(key, F.col(left_value).alias(out)).unionByName(right.select(key, (-F.col(right_value)).alias(out)))
    return both.groupBy(key).agg(F.sum(out).alias(out))
