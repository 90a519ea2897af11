"""The generic operators and relational idioms, each as a query on the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace import operators as O
from millrace.functions import year_is
from millrace.plans.catalog import query
from millrace.sources.tables import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_MAP = "SELECT s_suppkey + 10 AS k, s_nationkey AS v FROM supplier WHERE s_suppkey + s_nationkey < 60"


@query("map_native", _MAP)
def map_native(spark, sf_dir):
    return O.map_(table(spark, sf_dir, "supplier"), (F.col("s_suppkey") + 10).alias("k"), F.col("s_nationkey").alias("v"), where=F.col("s_suppkey") + F.col("s_nationkey") < 60)


@query("map_python", _MAP)
def map_python(spark, sf_dir):
    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.s_suppkey + rows.s_nationkey < 60]
        return pd.DataFrame({"k": rows.s_suppkey + 10, "v": rows.s_nationkey})

    return O.map_(table(spark, sf_dir, "supplier"), fn=keep, schema="k long, v int", reads=["s_suppkey", "s_nationkey"])


@query("map_tokenize", "SELECT part_word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS part_word FROM part) GROUP BY part_word")
def map_tokenize(spark, sf_dir):
    words = O.map_(table(spark, sf_dir, "part"), F.col("item").alias("part_word"), explode=F.split("p_name", " "))
    return O.reduce_(words, "part_word", F.count(F.lit(1)).alias("n"))


_REDUCE = "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey"


@query("reduce_native", _REDUCE)
def reduce_native(spark, sf_dir):
    return O.reduce_(_orders(spark, sf_dir), "o_custkey", F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), strict_keys=True)


@query("reduce_python", _REDUCE)
def reduce_python(spark, sf_dir):
    def total(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.groupby("o_custkey", dropna=False, sort=False).o_totalprice
        return pd.DataFrame({"n": out.size(), "total": out.sum(min_count=1).round(2)}).reset_index().astype({"o_custkey": "Int64"})

    return O.groups_reduce(_orders(spark, sf_dir), "o_custkey", total, "o_custkey long, n long, total double", reads=["o_custkey", "o_totalprice"])


@query("reduce_combine", "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority")
def reduce_combine(spark, sf_dir):
    def combine(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderpriority": [g.o_orderpriority.iloc[0]], "n": [g.n.sum()], "top": [g.top.max()]})

    rows = _orders(spark, sf_dir).select("o_orderpriority", F.lit(1).cast("long").alias("n"), F.col("o_totalprice").alias("top"))
    return O.combine_reduce(rows, "o_orderpriority", combine, "o_orderpriority string, n long, top double")


@query("reduce_sorted", "SELECT o_custkey, count(*) AS n, max(gap) AS gap FROM (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) GROUP BY o_custkey")
def reduce_sorted(spark, sf_dir):
    """Secondary sort: the largest rise of price from one order of a customer to the next, seen row by row."""

    def rises(key, rows):
        n, last, best = 0, None, None
        for r in rows:
            n += 1
            if last is not None and (best is None or r.o_totalprice - last > best):
                best = r.o_totalprice - last
            last = r.o_totalprice
        yield (*key, n, best)

    return O.sorted_reduce(_orders(spark, sf_dir), "o_custkey", "o_orderkey", rises, "o_custkey long, n long, gap double", reads=["o_custkey", "o_orderkey", "o_totalprice"])


@query("reduce_ordered", "SELECT s_nationkey, string_agg(s_suppkey, ',' ORDER BY s_acctbal, s_suppkey) AS keys FROM supplier GROUP BY s_nationkey")
def reduce_ordered(spark, sf_dir):
    """An opaque function over sorted groups."""
    join = lambda g: pd.DataFrame({"s_nationkey": [g.s_nationkey.iloc[0]], "keys": [",".join(map(str, g.s_suppkey))]})
    return O.reduce_(table(spark, sf_dir, "supplier"), "s_nationkey", fn=join, schema="s_nationkey int, keys string", reads=["s_nationkey", "s_suppkey", "s_acctbal"], order=["s_acctbal", "s_suppkey"])


class _Scaled:
    """A function with a set-up, which it needs."""

    def open(self):
        self.factor = 3

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": rows.s_suppkey, "v": rows.s_nationkey * self.factor})

    def close(self):
        del self.factor


@query("map_with_setup", "SELECT s_suppkey AS k, s_nationkey * 3 AS v FROM supplier")
def map_with_setup(spark, sf_dir):
    """A function that opens and closes, and makes just one row of each."""
    return O.map_(table(spark, sf_dir, "supplier"), fn=_Scaled(), schema="k long, v int", reads=["s_suppkey", "s_nationkey"], rows_out=(1, 1))


@query("match_python", "SELECT s_suppkey AS k, length(n_name) + s_nationkey AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def match_python(spark, sf_dir):
    """An opaque function over the pairs of a join."""
    size = lambda pairs: pd.DataFrame({"k": pairs.s_suppkey, "v": pairs.n_name.str.len() + pairs.s_nationkey})
    return O.match(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey", F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_name"), fn=size, schema="k long, v long", hints=O.Hints(rows=25, row_bytes=40))


@query("cross_python", "SELECT s_suppkey * n_nationkey AS v FROM supplier, nation WHERE n_regionkey = 1")
def cross_python(spark, sf_dir):
    """An opaque function over a Cartesian product; one side is counted and broadcast."""
    times = lambda pairs: pd.DataFrame({"v": pairs.s_suppkey * pairs.n_nationkey})
    return O.cross(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("s_suppkey"), F.col("n_nationkey"), small="right", fn=times, schema="v long")


_MATCH = "SELECT o_orderkey + 1 AS k, l_linenumber - 1 AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'"


def _match(strategy, build="right"):
    def run(spark, sf_dir):
        left = _orders(spark, sf_dir).where(F.col("o_orderstatus") == "P")
        return O.match(left, _lines(spark, sf_dir), "o_orderkey", "l_orderkey", (F.col("o_orderkey") + 1).alias("k"), (F.col("l_linenumber") - 1).alias("v"), strategy=strategy, build=build)

    return run


query("match_any", _MATCH)(_match(None))
query("match_hash", _MATCH)(_match("hash", "left"))
query("match_hash_second", _MATCH)(_match("hash", "right"))
query("match_merge", _MATCH)(_match("merge"))


@query("match_broadcast", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def match_broadcast(spark, sf_dir):
    """The 25 nations are broadcast."""
    return O.match(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", F.col("c_custkey"), F.col("n_name"), strategy="broadcast")


@query("match_memory_hash", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def match_memory_hash(spark, sf_dir):
    """A hash table that lies in memory as a whole: the five regions."""
    return O.match(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", F.col("n_nationkey"), F.col("r_name"), strategy="memory_hash")


@query("match_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'R'")
def match_composite(spark, sf_dir):
    a = _lines(spark, sf_dir).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))
    return O.match(a, _lines(spark, sf_dir), ["ok", "ln"], ["l_orderkey", "l_linenumber"], F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity"))


@query("cross_filter", "SELECT s_suppkey + n_nationkey AS k, s_nationkey - n_regionkey AS v FROM supplier, nation WHERE s_nationkey + n_nationkey <= 12")
def cross_filter(spark, sf_dir):
    """The 25 nations are broadcast."""
    return O.cross(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), (F.col("s_suppkey") + F.col("n_nationkey")).alias("k"), (F.col("s_nationkey") - F.col("n_regionkey")).alias("v"), where=F.col("s_nationkey") + F.col("n_nationkey") <= 12, small="right")


@query("theta_join", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey > r_regionkey * 4")
def theta_join(spark, sf_dir):
    return O.theta(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), F.col("n_nationkey") > F.col("r_regionkey") * 4).select("r_regionkey", "n_nationkey")


_COGROUP = """SELECT coalesce(a.k, b.k) AS k, a.n_orders, b.n_events FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) a
    FULL JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) b ON a.k = b.k"""


def _cogroup_sides(spark, sf_dir):
    return _orders(spark, sf_dir).select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))


@query("cogroup_native", _COGROUP)
def cogroup_native(spark, sf_dir):
    a, b = _cogroup_sides(spark, sf_dir)
    return O.cogroup(a, b, "k", [F.count(F.lit(1)).alias("n_orders")], [F.count(F.lit(1)).alias("n_events")])


@query("cogroup_python", _COGROUP)
def cogroup_python(spark, sf_dir):
    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        n = [side.groupby("k", dropna=False).size().rename(name).reset_index() for side, name in ((a, "n_orders"), (b, "n_events"))]
        met = n[0].dropna().merge(n[1].dropna(), how="outer", on="k")
        return pd.concat([met, *(x[x.k.isna()] for x in n)]).reindex(columns=["k", "n_orders", "n_events"]).astype("Int64")

    a, b = _cogroup_sides(spark, sf_dir)
    return O.groups_cogroup(a, b, "k", count, "k long, n_orders long, n_events long")


@query("union_all", "SELECT user_id AS k FROM events WHERE event_type = 'purchase' UNION ALL SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer")
def union_all(spark, sf_dir):
    return O.union(table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k")), _orders(spark, sf_dir).select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("self_match_excl", "SELECT a.s_nationkey AS nation, a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_match_excl(spark, sf_dir):
    return O.self_match(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey").select(F.col("s_nationkey_l").alias("nation"), F.col("s_suppkey_l").alias("x"), F.col("s_suppkey_r").alias("y"))


@query("self_match_incl", "SELECT a.s_nationkey AS nation, a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <= b.s_suppkey")
def self_match_incl(spark, sf_dir):
    return O.self_match(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", "triangle_incl_diag").select(F.col("s_nationkey_l").alias("nation"), F.col("s_suppkey_l").alias("x"), F.col("s_suppkey_r").alias("y"))


@query("self_match_full", "SELECT a.s_nationkey AS nation, a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def self_match_full(spark, sf_dir):
    return O.self_match(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", "full_cross").select(F.col("s_nationkey_l").alias("nation"), F.col("s_suppkey_l").alias("x"), F.col("s_suppkey_r").alias("y"))


@query("anti_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997)")
def anti_customers(spark, sf_dir):
    return O.anti(table(spark, sf_dir, "customer"), _orders(spark, sf_dir).where(year_is(F.col("o_orderdate"), 1997)), "c_custkey", "o_custkey").select("c_custkey")


@query("semi_customers", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997)")
def semi_customers(spark, sf_dir):
    return O.semi(table(spark, sf_dir, "customer"), _orders(spark, sf_dir).where(year_is(F.col("o_orderdate"), 1997)), "c_custkey", "o_custkey").select("c_custkey")


def _outer(side):
    def run(spark, sf_dir):
        buyers = table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 50").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        big = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
        return O.outer(big, buyers, "c_custkey", "user_id", side).select("c_custkey", "user_id", "n")

    return run


for _side in ("left", "right", "full"):
    query(f"outer_{_side}", f"""SELECT c_custkey, user_id, n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) {_side.upper()} JOIN
        (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 50 GROUP BY user_id) ON c_custkey = user_id""")(_outer(_side))


@query("group_difference", "SELECT k, CAST(sum(v) AS BIGINT) AS difference FROM (SELECT o_custkey AS k, 1 AS v FROM orders UNION ALL SELECT user_id, -1 FROM events) GROUP BY k")
def group_difference(spark, sf_dir):
    a, b = _cogroup_sides(spark, sf_dir)
    return O.group_difference(a.withColumn("v", F.lit(1).cast("long")), b.withColumn("v", F.lit(1).cast("long")), "k", "v", "v")


@query("coalesce_union", "SELECT coalesce(c_custkey, user_id) AS k, c_mktsegment AS segment, n FROM customer FULL JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON c_custkey = user_id")
def coalesce_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return O.coalesce_union(a, b, "k")


@query("keep_least", "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem) WHERE r = 1")
def keep_least(spark, sf_dir):
    return O.keep_least(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return O.distinct(_lines(spark, sf_dir).select("l_returnflag", "l_linestatus"))


def _sides(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k")), _orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))


_A, _B = "SELECT user_id AS k FROM events", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'"


@query("union_distinct", f"{_A} UNION {_B}")
def union_distinct(spark, sf_dir):
    return O.distinct(O.union(*_sides(spark, sf_dir)))


@query("intersect", f"{_A} INTERSECT {_B}")
def intersect(spark, sf_dir):
    return O.intersect(*_sides(spark, sf_dir))


@query("except", f"{_A} EXCEPT {_B}")
def except_(spark, sf_dir):
    return O.except_(*_sides(spark, sf_dir))


@query("except_all", f"{_A} EXCEPT ALL {_B}")
def except_all(spark, sf_dir):
    return O.except_(*_sides(spark, sf_dir), keep_duplicates=True)
