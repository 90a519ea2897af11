"""Streaming is no part of the query catalogue (all programs are batch). These are the same operators over a stream, for
sources that grow: windowed counts with late data dropped after a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts by keys and event-time window; rows more than ``delay`` behind the latest are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, delay).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def follow(spark, path: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)
