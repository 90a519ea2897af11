"""Places in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.iterate import cut_lineage


def placed(df: DataFrame, column: str = "place") -> DataFrame:
    """The rows of an input that is sorted across and within its partitions, numbered from 1. Partitions number their own rows,
    and the sums of the partitions before (one row each) are added."""
    own = df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    own = cut_lineage(own)  # the order is computed once
    sizes = own.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__part").alias("__of"), (before - F.col("__first") + 1).alias("__shift"))
    return own.join(F.broadcast(offsets), F.col("__part") == F.col("__of")).withColumn(column, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__of", "__shift")  # one row per partition


def in_order(df: DataFrame, *keys: Column, column: str = "in_order") -> DataFrame:
    """Whether each row of a partition is not before the one ahead of it, by ascending keys."""
    own = cut_lineage(df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    here = F.struct(*keys)
    ahead = F.lag(here).over(Window.partitionBy("__part").orderBy("__at"))
    return own.withColumn(column, F.coalesce(ahead <= here, F.lit(True))).drop("__part", "__at")
