"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), a > b. Large: every node points its larger neighbours to its least neighbour.
    Small: every node points itself and its smaller neighbours to the least of them. Only aggregates and joins with one
    row per node, so that a hub with very many neighbours is split by adaptive execution."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        # larger neighbours u of v: edges (u, v) seen from v
        out = edges.join(least, F.col("b") == F.col("v")).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
        moved = edges.join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge the least node reachable from it. Rows with a null end or two
    equal ends add nothing; repeated edges count once; no edges give no rows. Each round is written to the shared
    checkpoint folder."""
    now = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = cut(now.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def roots(n: int, a, b):
    """Union-find over local edges of nodes 0..n-1: the least node of each node's component."""
    import numpy as np

    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i in range(n):
        parent[i] = parent[parent[i]]
    return np.array(parent, dtype=np.int64)
