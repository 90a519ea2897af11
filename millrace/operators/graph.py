"""Graph algorithms over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.iterate import bulk, cut_lineage, delta
from millrace.operators.relational import keep_least


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(both.alias("e")).select("e.src", "e.dst").distinct()


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges as (a, b), a < b, each once; loops are dropped."""
    return edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def adjacency_lists(edges: DataFrame, both: bool = True) -> DataFrame:
    """(vid, neighbours), neighbours distinct and sorted."""
    e = undirected(edges) if both else edges.distinct()
    return e.groupBy(F.col("src").alias("vid")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def adjacency_edges(lists: DataFrame, both: bool = True, whole: bool = False) -> DataFrame:
    """(src, dst) for every neighbour of adjacency lists (vid, neighbours), each once; ``both``: and backwards. ``whole`` lists
    are one for each vid, without repeats, so their edges need no shuffle to be distinct."""
    forward = lists.select(F.col("vid").alias("src"), F.explode("neighbours").alias("dst"))
    return undirected(forward) if both else forward if whole else forward.distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), a > b. Large: a vertex sends its larger neighbours to its least one. Small: a vertex sends
    itself and its smaller neighbours to the least of them. One row per vertex is aggregated before it is joined, so a hub
    is no group of its neighbours."""
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = (edges.union(swapped) if large else edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    if large:
        out = edges.join(least, F.col("b") == F.col("v")).select("a", F.col("m").alias("b"))
    else:
        out = edges.join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vid, cid): each vertex with the least vertex that it reaches, by alternating large and small stars: rounds grow with
    the logarithm of the longest path, and go on until none changes an edge."""
    loops = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    now = cut_lineage(edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = None
    while True:
        now = cut_lineage(_star(_star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return loops.join(now, F.col("vid") == F.col("a"), "left").select("vid", F.coalesce("b", "vid").alias("cid"))


def components_delta(edges: DataFrame) -> DataFrame:
    """The same by delta iteration: vertices whose component improved tell their neighbours, until none does. A round
    carries a component one edge further, so this suits graphs of small diameter."""
    both = cut_lineage(undirected(edges))
    solution = both.select(F.col("src").alias("vid")).distinct().withColumn("cid", F.col("vid"))

    def step(workset: DataFrame, _: DataFrame) -> DataFrame:
        return workset.join(both, F.col("vid") == F.col("src")).select(F.col("dst").alias("vid"), "cid")

    return delta(solution, solution, step, "vid", "cid")


def components_bulk(edges: DataFrame, rounds: int = 2**31) -> DataFrame:
    """The same by bulk iteration: in a round every vertex takes the least component among itself and its neighbours; it ends
    when a round changes none."""
    both = cut_lineage(undirected(edges))

    def step(state: DataFrame) -> DataFrame:
        told = state.join(both, F.col("vid") == F.col("src")).select(F.col("dst").alias("vid"), "cid")
        return state.unionByName(told).groupBy("vid").agg(F.min("cid").alias("cid"))

    def settled(old: DataFrame, new: DataFrame) -> bool:
        return old.select("vid", F.col("cid").alias("was")).join(new, "vid").where("was <> cid").isEmpty()

    return bulk(both.select(F.col("src").alias("vid")).distinct().withColumn("cid", F.col("vid")), step, rounds, done=settled)


def metis_lines(edges: DataFrame) -> DataFrame:
    """(line, text) of a METIS graph file: line 0 has the numbers of vertices and edges, line v the neighbours of vertex v. Vertices
    are 1 to the largest id; those without edges have an empty line."""
    both = undirected(edges.where(F.col("src") != F.col("dst")))
    size = both.agg(F.coalesce(F.max("src"), F.lit(0)).alias("n"), (F.count(F.lit(1)) / 2).cast("long").alias("m")).first()
    lists = both.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), " ").alias("text"))
    body = edges.sparkSession.range(1, size["n"] + 1).join(lists, F.col("id") == F.col("src"), "left").select(F.col("id").alias("line"), F.coalesce("text", F.lit("")).alias("text"))
    return _metis_head(edges.sparkSession, size["n"], size["m"]).union(body)


def _metis_head(spark: SparkSession, n: int, m: int) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("line"), F.lit(f"{n} {m}").alias("text"))


def metis_text(texts: DataFrame, vertices: DataFrame, n: int, m: int) -> DataFrame:
    """The same of texts (vid, text), one for each of ``vertices`` (vid), those with edges. Only ids are shuffled, to find the
    lines without edges, no texts."""
    spark = texts.sparkSession
    empty = spark.range(1, n + 1).join(vertices.hint("merge"), F.col("id") == F.col("vid"), "left_anti").select(F.col("id").alias("line"), F.lit("").alias("text"))
    return _metis_head(spark, n, m).union(texts.select(F.col("vid").alias("line"), "text")).union(empty)


def metis_partition(vertices: DataFrame, parts: DataFrame) -> DataFrame:
    """Vertices (vid) with the part that a METIS result (line, part), lines from 1, gives them; null where it gives none."""
    return vertices.join(parts.select(F.col("line").alias("vid"), "part"), "vid", "left")


def pagerank(edges: DataFrame, rounds: int = 21, damping: float = 0.85) -> DataFrame:
    """(vid, rank) after ``rounds`` rounds from 1/N: (1 - damping)/N plus damping times what in-edges bring; a vertex without
    out-edges keeps its rank to itself (it is not dealt out)."""
    e = cut_lineage(edges.distinct())
    vertices = cut_lineage(e.select(F.col("src").alias("vid")).union(e.select("dst")).distinct())
    n = vertices.count()
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = cut_lineage(e.join(degree, "src"))

    def step(ranks: DataFrame) -> DataFrame:
        sent = ranks.join(links, F.col("vid") == F.col("src")).select(F.col("dst").alias("vid"), (F.col("rank") / F.col("degree")).alias("part"))
        kept = vertices.select("vid", F.lit(0.0).alias("part"))
        return sent.unionByName(kept).groupBy("vid").agg((F.lit((1 - damping) / n) + damping * F.sum("part")).alias("rank"))

    return bulk(vertices.withColumn("rank", F.lit(1.0 / max(n, 1))), step, rounds, every=3)


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c), a < b < c. Edges are oriented from the end of lower degree, so that no vertex makes more than
    the square root of the edges' number of candidates per edge; only then are ends sorted by id."""
    e = cut_lineage(canonical(edges))  # read four times
    ends = e.select(F.col("a").alias("v")).union(e.select("b"))
    degree = ends.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    da, db = (degree.select(F.col("v").alias(f"v{s}"), F.col("d").alias(f"d{s}")) for s in "ab")
    ranked = e.join(da, F.col("a") == F.col("va")).join(db, F.col("b") == F.col("vb"))
    lower = F.struct("da", "a") < F.struct("db", "b")
    arcs = ranked.select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("y"))
    first, second = arcs.alias("p"), arcs.alias("q")
    triads = first.join(second, (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("x"), F.col("p.y").alias("a"), F.col("q.y").alias("b"))
    closed = triads.join(e, ["a", "b"])
    t = F.array_sort(F.array("x", "a", "b"))
    return closed.select(t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def edge_apexes(edges: DataFrame) -> DataFrame:
    """(a, b, apexes): for each edge in a triangle the sorted third corners."""
    corner = lambda x, y, z: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("apex"))
    rows = triangles(edges).select(F.explode(F.array(corner("a", "b", "c"), corner("a", "c", "b"), corner("b", "c", "a"))).alias("t"))
    return rows.select("t.*").groupBy("a", "b").agg(F.array_sort(F.collect_list("apex")).alias("apexes"))


def double_paths(paths: DataFrame) -> DataFrame:
    """One doubling step over (from, to, length, hops): joins of paths that meet, without those back to their start, and all
    the shortest by (from, to) of old and new; ``hops`` are the vertices between."""
    p, q = paths.alias("p"), paths.alias("q")
    joined = p.join(q, F.col("p.to") == F.col("q.from")).where(F.col("p.from") != F.col("q.to"))
    hops = F.concat(F.col("p.hops"), F.array(F.col("p.to")), F.col("q.hops"))
    new = joined.select(F.col("p.from").alias("from"), F.col("q.to").alias("to"), (F.col("p.length") + F.col("q.length")).alias("length"), hops.alias("hops"))
    return keep_least(paths.unionByName(new).distinct(), ["from", "to"], "length")


def shortest_paths(edges: DataFrame, doublings: int | None = None) -> DataFrame:
    """All shortest paths of up to 2^doublings edges, or of any length: then until a doubling finds no new one."""
    start = edges.distinct().select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(1).alias("length"), F.array().cast(f"array<{dict(edges.dtypes)['src']}>").alias("hops"))
    if doublings is not None:
        return bulk(start, double_paths, doublings, every=1)
    # old shortest paths stay, so their number tells whether a doubling found any
    return bulk(start, double_paths, 2**31, done=lambda old, new: old.count() == new.count())


def transitive_closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path. Only pairs found last are joined, on either end with all that are known, so the length of the
    paths covered doubles: rounds grow with the logarithm of the longest path, and go on until nothing is new."""

    def cut(df: DataFrame) -> DataFrame:
        # as one struct: a checkpoint of plain columns may keep constraints on columns of its source, which a union can't resolve
        return cut_lineage(df.select(F.struct("src", "dst").alias("pair"))).select("pair.src", "pair.dst")

    def chained(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.alias("x").join(b.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"))

    known = new = cut(edges.select("src", "dst").distinct())
    while not new.isEmpty():
        step = chained(new, known).union(chained(known, new)).distinct()
        new = cut(step.join(known, ["src", "dst"], "left_anti"))
        known = cut(known.unionByName(new))
    return known
