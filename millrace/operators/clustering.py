"""K-means over (id, coords) points and (cid, centre) centres; the centres are broadcast where they are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import euclidean
from millrace.operators.hints import small_enough
from millrace.operators.iterate import bulk

#: Centres that are broadcast at most.
MAX_BROADCAST = 10_000


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Points with the nearest centre's ``cid`` (ties: the smaller) and ``distance``. Row by row: the centres travel as
    one array, so no pair is ever a row."""
    few = small_enough(centres, MAX_BROADCAST)
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("cid", "centre"))).alias("__centres"))
    scored = F.transform("__centres", lambda c: F.struct(euclidean(F.col("coords"), c["centre"]).alias("distance"), c["cid"].alias("cid")))
    best = points.crossJoin(F.broadcast(packed) if few else packed).withColumn("__best", F.array_min(scored)).drop("__centres")
    return best.select(*points.columns, F.col("__best.cid").alias("cid"), F.col("__best.distance").alias("distance"))


def kmeans_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """New (cid, centre): each dimension's mean over the centre's points; centres without points vanish."""
    placed = nearest(points, centres).select("cid", F.posexplode("coords").alias("d", "x"))
    means = placed.groupBy("cid", "d").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "x")))
    return means.groupBy("cid").agg(F.transform(ordered, lambda p: p["x"]).alias("centre"))


def kmeans(points: DataFrame, centres: DataFrame, rounds: int) -> DataFrame:
    return bulk(centres, lambda c: kmeans_step(points, c), rounds, every=1)
