"""Operators on small inputs, against plain Python."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import operators as O
from millrace.operators import graph
from millrace.operators.ordering import in_order, placed
from millrace.plans import all_queries


def kv(spark, pairs):
    return spark.createDataFrame(pairs, "k int, v int")


def some(seed, n, keys):
    rng = random.Random(seed)
    return [(rng.randrange(keys), rng.randrange(100)) for _ in range(n)]


def test_map_forms_agree(spark):
    rows = some(1, 200, 9)
    df = kv(spark, rows)
    native = O.map_(df, F.col("v"), (F.col("k") + 10).alias("k"), where=F.col("k") + F.col("v") < 40)
    opaque = O.map_(df, fn=lambda x: pd.DataFrame({"v": x[x.k + x.v < 40].v, "k": x[x.k + x.v < 40].k + 10}), schema="v int, k int")
    want = sorted((v, k + 10) for k, v in rows if k + v < 40)
    assert sorted(map(tuple, native.collect())) == want == sorted(map(tuple, opaque.collect()))


def test_reduce_with_combiner(spark):
    rows = some(2, 500, 7)
    want = defaultdict(int)
    for k, v in rows:
        want[k] += v
    combine = lambda g: pd.DataFrame({"k": [g.k.iloc[0]], "v": [g.v.sum()]})
    assert dict(map(tuple, O.combine_reduce(kv(spark, rows), "k", combine, "k int, v int").collect())) == dict(want)
    assert dict(map(tuple, O.reduce_(kv(spark, rows), "k", F.sum("v").alias("v")).collect())) == dict(want)


@pytest.mark.parametrize(("strategy", "node"), [("broadcast", "BroadcastHashJoin"), ("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_match_strategies(spark, strategy, node):
    a, b = some(3, 80, 12), some(4, 80, 12)
    right = kv(spark, b).toDF("k2", "v2")
    df = O.match(kv(spark, a), right, "k", "k2", F.col("v"), F.col("v2"), where=F.col("v") < F.col("v2"), strategy=strategy)
    assert node in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted((v, w) for k, v in a for j, w in b if k == j and v < w)


def test_cogroup_visits_keys_of_either_side(spark):
    a, b = [(1, 1), (1, 2), (2, 5)], [(2, 1), (3, 9)]
    df = O.cogroup(kv(spark, a), kv(spark, b), "k", [F.sum("v").alias("x")], [F.sum("v").alias("y")])
    assert {r.k: (r.x, r.y) for r in df.collect()} == {1: (3, None), 2: (5, 1), 3: (None, 9)}


def test_strict_keys_fail_on_null(spark):
    df = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    assert O.reduce_(df, "k", F.sum("v").alias("v")).count() == 2
    with pytest.raises(Exception, match="null key"):
        O.reduce_(df, "k", F.sum("v").alias("v"), strict_keys=True).collect()


@pytest.mark.parametrize("mode", ["full_cross", "triangle_incl_diag", "triangle_excl_diag"])
def test_self_match(spark, mode):
    rows = list({(k, v) for k, v in some(5, 40, 4)})
    ok = {"full_cross": lambda x, y: True, "triangle_incl_diag": lambda x, y: x <= y, "triangle_excl_diag": lambda x, y: x < y}[mode]
    got = sorted(map(tuple, O.self_match(kv(spark, rows), "k", "v", mode).select("k_l", "v_l", "v_r").collect()))
    assert got == sorted((k, v, w) for k, v in rows for j, w in rows if k == j and ok(v, w))


def test_delta_iteration_finds_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {v: find(v) for e in edges for v in e}


def test_pagerank_keeps_vertices_without_in_edges(spark):
    got = dict(map(tuple, graph.pagerank(spark.createDataFrame([(1, 2), (3, 2), (2, 3)], "src long, dst long"), rounds=1).collect()))
    assert got[1] == pytest.approx(0.05)
    assert got[2] == pytest.approx(0.05 + 0.85 * 2 / 3)


def test_triangles_ignore_repeats_and_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (3, 4)], "src long, dst long")
    assert [tuple(r) for r in graph.triangles(e).collect()] == [(1, 2, 3)]
    assert {(r.a, r.b): list(r.apexes) for r in graph.edge_apexes(e).collect()} == {(1, 2): [3], (1, 3): [2], (2, 3): [1]}


def test_empty_inputs(spark):
    empty = kv(spark, [])
    assert O.union(empty, empty).count() == 0
    assert O.match(empty, empty.toDF("a", "b"), "k", "a").count() == 0
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_year_ranges_reach_the_scan(spark, sf_dir):
    from millrace.plans import all_queries

    queries = all_queries()[0]
    for name in ("filter_year_after", "filter_year_equal", "q03_revenue", "q10_returns", "anti_customers", "semi_customers"):
        assert "GreaterThanOrEqual(o_orderdate" in formatted(queries[name](spark, sf_dir)), name
    dates = spark.sql("SELECT explode(sequence(TIMESTAMP '1996-12-31 22:00:00', TIMESTAMP '1999-01-01 02:00:00', INTERVAL 1 HOUR)) AS t")
    for year in (1996, 1997, 1998, 1999):
        assert dates.where(fn.year_is(F.col("t"), year)).count() == dates.where(F.year("t") == year).count()
        assert dates.where(fn.year_after(F.col("t"), year)).count() == dates.where(F.year("t") > year).count()


def test_cross_broadcasts_only_what_it_counted(spark):
    a, b = kv(spark, some(1, 30, 5)), kv(spark, some(2, 20, 5)).toDF("x", "y")
    few, many = O.cross(a, b, small="right", rows=20), O.cross(a, b, small="right", rows=19)
    assert "BroadcastNestedLoopJoin" in plan(few) and "ResolvedHint (strategy=broadcast)" not in many._jdf.queryExecution().analyzed().toString()
    assert few.count() == many.count() == 600
    got = O.cross(a, b, F.col("v"), F.col("y"), small="right", fn=lambda p: pd.DataFrame({"s": p.v + p.y}), schema="s long")
    assert sorted(r.s for r in got.collect()) == sorted(v + y for _, v in some(1, 30, 5) for _, y in some(2, 20, 5))


def test_no_second_exchange_for_grouped_input(spark):
    df = kv(spark, some(3, 100, 9)).repartition("k")
    assert plan(O.reduce_(O.reduce_(df, ["k", "v"], F.count(F.lit(1)).alias("n")), "k", F.sum("n").alias("n"))).count("Exchange hashpartitioning") == 1


def test_maps_are_chained_in_one_stage(spark):
    df = O.map_(O.map_(O.map_(spark.range(10), (F.col("id") * 2).alias("a")), (F.col("a") + 1).alias("b"), where=F.col("a") > 3), F.col("b"), where=F.col("b") < 15)
    assert "Exchange" not in plan(df) and plan(df).count("Project") == 1
    assert sorted(r.b for r in df.collect()) == [5, 7, 9, 11, 13]


def test_sorted_reduce_sees_rows_in_order(spark):
    rows = some(7, 400, 6) + [(None, 3), (None, 1)]

    def values(key, group):
        yield key[0], ",".join(str(int(r.v)) for r in group)

    got = {r.k: r.s for r in O.sorted_reduce(kv(spark, rows), "k", "v", values, "k int, s string").collect()}
    assert got == {key: ",".join(str(v) for k, v in sorted(rows, key=lambda p: p[1]) if k == key) for key in {k for k, _ in rows}}
    ordered = O.reduce_(kv(spark, some(7, 400, 6)), "k", fn=lambda g: pd.DataFrame({"k": [g.k.iloc[0]], "ok": [bool(g.v.is_monotonic_increasing)]}), schema="k int, ok boolean", order="v")
    assert all(r.ok for r in ordered.collect())


class Offset:
    def open(self):
        self.by = 5

    def __call__(self, rows):
        return pd.DataFrame({"v": rows.v + self.by})

    def close(self):
        self.by = None


def test_functions_with_setup_and_declared_rows(spark):
    df = kv(spark, some(8, 50, 5))
    assert sorted(r.v for r in O.map_(df, fn=Offset(), schema="v int", rows_out=(1, 1)).collect()) == sorted(v + 5 for _, v in some(8, 50, 5))
    with pytest.raises(Exception, match="declared 0 to 1"):
        O.map_(df, fn=lambda x: pd.concat([x, x])[["v"]], schema="v int", rows_out=(0, 1)).collect()


def test_reads_prune_opaque_inputs(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = lambda g: pd.DataFrame({"o_custkey": [g.o_custkey.iloc[0]], "o_totalprice": [g.o_totalprice.max()]})
    reads = ["o_custkey", "o_totalprice"]
    one = O.combine_reduce(orders, "o_custkey", last, "o_custkey long, o_totalprice double", reads=reads)
    two = O.cogroup(orders, orders, "o_custkey", fn=lambda a, b: last(a), schema="o_custkey long, o_totalprice double", left_reads=reads, right_reads=reads)
    for df in (one, two):
        assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan(df)


def test_hints_choose_a_broadcast(spark):
    a, b = kv(spark, some(3, 80, 12)), kv(spark, some(4, 80, 12)).toDF("k2", "v2")
    hinted = lambda h: "ResolvedHint (strategy=broadcast)" in O.match(a, b, "k", "k2", hints=h)._jdf.queryExecution().analyzed().toString()
    assert hinted(O.Hints(rows=80, row_bytes=16))
    assert hinted(O.Hints(distinct=12, rows_per_key=7, row_bytes=16, selectivity=0.5))
    assert not hinted(O.Hints(rows=10**9, row_bytes=16)) and not hinted(O.Hints(rows=5)) and not hinted(None)


def test_places_and_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = placed(df.repartition(7).orderBy("x")).collect()
    assert [r.place for r in sorted(got, key=lambda r: r.x)] == list(range(1, 5001))
    assert not in_order(df, F.col("x")).where("NOT in_order").isEmpty()
    assert in_order(df.sortWithinPartitions("x"), F.col("x")).where("NOT in_order").isEmpty()


def test_groups_come_whole_in_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)
    pairs = some(9, 3000, 700) + [(701, 1)] * 500 + [(None, 5)] * 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:

        def total(g):
            calls.add(1)
            return g.groupby("k", dropna=False).v.agg(n="size", v="sum").reset_index().astype({"k": "Int64"})

        got = sorted(map(tuple, O.groups_reduce(kv(spark, pairs), "k", total, "k int, n long, v long").collect()), key=str)
        other = kv(spark, some(10, 900, 900)).withColumnRenamed("v", "w")

        def both(a, b):
            a, b = a.groupby("k").v.sum(), b.groupby("k").w.sum()
            return pd.concat([a, b], axis=1).rename_axis("k").reset_index().astype("Int64")[["k", "v", "w"]]

        met = {r.k: (r.v, r.w) for r in O.groups_cogroup(kv(spark, pairs).dropna(), other, "k", both, "k int, v long, w long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, right = defaultdict(list), defaultdict(list)
    for k, v in pairs:
        want[k].append(v)
    for k, v in some(10, 900, 900):
        right[k].append(v)
    assert got == sorted(((k, len(v), sum(v)) for k, v in want.items()), key=str)
    assert calls.value < 100
    total = lambda x: sum(x) if x else None
    assert met == {k: (total(want.get(k)), total(right.get(k))) for k in (set(want) | set(right)) - {None}}


@pytest.mark.parametrize("name", ["reduce_python", "cogroup_python"])
def test_python_groups_are_not_called_one_by_one(spark, sf_dir, name):
    plan = all_queries()[0][name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan or "PythonMapInArrow" in plan or "MapInArrow" in plan
    assert "FlatMap" not in plan


@pytest.mark.parametrize("mode", ["full_cross", "triangle_incl_diag", "triangle_excl_diag"])
def test_self_match_spreads_large_keys(spark, mode):
    pairs = [(1, i % 70) for i in range(100)] + [(2, 5), (2, 6), (3, 1), (None, 1)]
    keep = {"full_cross": lambda x, y: True, "triangle_incl_diag": lambda x, y: x <= y, "triangle_excl_diag": lambda x, y: x < y}[mode]
    df = O.self_match(kv(spark, pairs), "k", "v", mode, block=10)
    want = sorted((k, x, k, y) for k, x in pairs for j, y in pairs if k is not None and k == j and keep(x, y))
    assert sorted(map(tuple, df.collect())) == want
    busy = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert busy < len(want) / 5
