"""What a caller knows or measures of an input's size, and the choices that hang on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether the input has at most so many rows; no more than these and one are counted."""
    return df.limit(rows + 1).count() <= rows


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's threshold for automatic broadcasts."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


@dataclass(frozen=True)
class Hints:
    """Estimates for an operator's input; None where nothing is known. ``selectivity`` is the share of the rows that pass,
    ``distinct`` the number of keys and ``rows_per_key`` the rows of one, of which one follows from the other."""

    rows: int | None = None
    row_bytes: float | None = None
    selectivity: float = 1.0
    distinct: int | None = None
    rows_per_key: float | None = None

    def cardinality(self) -> float | None:
        if self.rows is not None:
            return self.rows * self.selectivity
        if self.distinct is not None and self.rows_per_key is not None:
            return self.distinct * self.rows_per_key * self.selectivity
        return None

    def bytes(self) -> float | None:
        n = self.cardinality()
        return None if n is None or self.row_bytes is None else n * self.row_bytes

    def fits_broadcast(self, spark: SparkSession) -> bool:
        size = self.bytes()
        return size is not None and size <= broadcast_bytes(spark)
