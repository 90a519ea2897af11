"""Registered graph queries on small event tables, against plain Python and the registered SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from millrace.operators import delta, graph, meetings
from millrace.plans import all_queries
from tests.compare import rows

QUERIES, SQL = all_queries()


@pytest.fixture
def events(spark, tmp_path):
    """Makes a folder with a table of events in which just the given users meet, and a connection to it."""

    def make(pairs):
        start = datetime(2024, 1, 1)
        seen = [(u, start + timedelta(minutes=k)) for k, pair in enumerate(pairs) for u in pair]
        spark.createDataFrame(seen, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
        c = duckdb.connect()
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        return str(tmp_path), c

    return make


def test_transitive_closure_chains_all_edges(spark, events):
    pairs = [(i, i + 1) for i in range(8)] + [(3, 200), (200, 301), (301, 500), (40, 41), (2, 5)]
    want = set(pairs)
    while new := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
        want |= new
    folder, c = events(pairs)
    got = QUERIES["transitive_closure"](spark, folder).toPandas()
    assert sorted(zip(got.src, got.dst)) == sorted(want)
    assert rows(got) == rows(c.sql(SQL["transitive_closure"]).df())


def test_pagerank_runs_all_rounds(spark, events):
    pairs = [(i, i + 1) for i in range(30)] + [(3, 9), (3, 28), (40, 41)]
    vertices = {v for p in pairs for v in p}
    degree = {v: sum(a == v for a, _ in pairs) for v in vertices}
    want = {v: 1 / len(vertices) for v in vertices}
    for _ in range(21):
        want = {v: 0.15 / len(vertices) + 0.85 * sum(want[a] / degree[a] for a, b in pairs if b == v) for v in vertices}
    folder, c = events(pairs)
    got = QUERIES["pagerank"](spark, folder).toPandas()
    assert dict(zip(got.vid, got["rank"])) == pytest.approx(want, abs=1e-9)
    assert rows(got) == rows(c.sql(SQL["pagerank"]).df())


@pytest.fixture(scope="module")
def long_path(spark):
    """A path of 1,000 vertices, a cycle, a star, a loop and two vertices."""
    pairs = [(i, i + 1) for i in range(999)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(3000, 3000 + i) for i in range(1, 40)] + [(4000, 4000), (5001, 5000)]
    want = {i: 0 for i in range(1000)} | {2000 + i: 2000 for i in range(50)} | {3000 + i: 3000 for i in range(40)} | {4000: 4000, 5000: 5000, 5001: 5000}
    return spark.createDataFrame(pairs, "src long, dst long").cache(), want


def test_components_of_a_long_path(long_path):
    edges, want = long_path
    assert {r.vid: r.cid for r in graph.components(edges).collect()} == want


@pytest.mark.parametrize("form", ["components_delta", "components_bulk"])
def test_component_forms_agree(spark, form):
    pairs = [(i, i + 1) for i in range(12)] + [(20, 30), (30, 25), (40, 40)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    want = {i: 0 for i in range(13)} | {20: 20, 30: 20, 25: 20, 40: 40}
    assert {r.vid: r.cid for r in getattr(graph, form)(edges).collect()} == want
    assert getattr(graph, form)(edges.limit(0)).count() == 0


def test_closure_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, real=graph.cut_lineage: rounds.append(1) or real(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "src long, dst long")
    got = {(r.src, r.dst) for r in graph.transitive_closure(edges).collect()}
    assert got == {(i, j) for i in range(101) for j in range(i + 1, 101)} | {(a, b) for a in (200, 201) for b in (200, 201)}
    assert len(rounds) <= 2 * 9 + 1


def test_metis_form(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 4), (4, 4)], "src long, dst long")
    assert [r.text for r in graph.metis_lines(edges).orderBy("line").collect()] == ["4 2", "2", "1 4", "", "2"]
    assert [r.text for r in graph.metis_lines(edges.limit(0)).collect()] == ["0 0"]


def test_delta_iteration_may_be_limited(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    both = graph.undirected(edges)
    start = both.select(both.src.alias("vid")).distinct().selectExpr("vid", "vid AS cid")
    step = lambda workset, _: workset.join(both, workset.vid == both.src).selectExpr("dst AS vid", "cid")
    with pytest.raises(RuntimeError, match="2 rounds"):
        delta(start, start, step, "vid", "cid", rounds=2)


CROWDS = [tuple(range(20)), (5, 30, 31), (31, 40), (50, 51, 52), (60,), (0, 1, 19), (70, 200_000)]


@pytest.mark.parametrize("form", ["components", "components_delta", "components_bulk"])
def test_components_see_no_more_edges_than_memberships(spark, events, monkeypatch, form):
    seen = []
    monkeypatch.setattr(graph, form, lambda edges, real=getattr(graph, form): seen.append(edges.count()) or real(edges))
    folder, c = events(CROWDS)
    assert rows(QUERIES[form](spark, folder).toPandas()) == rows(c.sql(SQL[form]).df())
    assert seen[0] <= sum(map(len, CROWDS))


def test_metis_parts_of_large_ids(spark, events):
    folder, c = events(CROWDS)
    assert rows(QUERIES["metis_partition"](spark, folder).toPandas()) == rows(c.sql(SQL["metis_partition"]).df())


def crowds(seed, people, minutes, most):
    rng = random.Random(seed)
    return [tuple(rng.sample(range(people), rng.randint(1, most))) for _ in range(minutes)]


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("folk", [CROWDS, crowds(1, 400, 150, 4), [], [(1,), (2,)]])
def test_closure_makes_no_pairs_of_edges(spark, events, monkeypatch, limit, folk):
    seen = []
    monkeypatch.setattr(meetings, "LIMIT", limit)
    monkeypatch.setattr(graph, "transitive_closure", lambda edges, real=graph.transitive_closure: seen.append(edges.count()) or real(edges))
    folder, c = events(folk)
    assert rows(QUERIES["transitive_closure"](spark, folder).toPandas()) == rows(c.sql(SQL["transitive_closure"]).df())
    assert all(n <= sum(map(len, folk)) for n in seen)


PAIRWISE = ["edges", "undirected", "adjacency", "adjacency_directed", "adjacency_edges", "metis_lines"]


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("name", [*PAIRWISE, "pagerank"])
def test_pairs_of_groups_equal_sql(spark, events, monkeypatch, name, limit):
    monkeypatch.setattr(meetings, "LIMIT", limit)
    monkeypatch.setattr(meetings, "BATCH", 50)
    folder, c = events([*CROWDS, *crowds(2, 90, 60, 8), *((1000 + i, 1100 + i) for i in range(40))])
    assert rows(QUERIES[name](spark, folder).toPandas()) == rows(c.sql(SQL[name]).df())


@pytest.mark.parametrize("name", PAIRWISE)
def test_pairs_of_groups_are_not_shuffled(spark, events, name):
    folder, _ = events(CROWDS)
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert plan.count("Exchange") == (2 if name == "metis_lines" else 0)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_shortest_paths_of_any_length(spark, events, monkeypatch, limit):
    monkeypatch.setattr(meetings, "LIMIT", limit)
    monkeypatch.setattr(meetings, "PATHS", 3)
    folk = [(i, i + 1) for i in range(7)] + [(0, 20), (20, 3), (3, 21), (21, 5), (2, 3, 4), (40, 41)]
    folder, c = events(folk)
    got = QUERIES["shortest_paths"](spark, folder).toPandas()
    assert got.length.max() > 3
    assert rows(got) == rows(c.sql(SQL["shortest_paths"]).df())


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("name", ["triangles", "edge_apexes"])
def test_triangles_of_groups(spark, events, monkeypatch, name, limit):
    monkeypatch.setattr(meetings, "LIMIT", limit)
    monkeypatch.setattr(meetings, "MARKS", 1000)
    folder, c = events([*CROWDS, *crowds(3, 60, 50, 6)])
    df = QUERIES[name](spark, folder)
    assert rows(df.toPandas()) == rows(c.sql(SQL[name]).df())
    if limit:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
