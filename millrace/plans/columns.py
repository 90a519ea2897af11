"""Predicates, projections, scalar functions and aggregates as queries on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators.ordering import in_order, placed
from millrace.plans.catalog import query
from millrace.sinks import bounded_sorted, local_sorted
from millrace.sources.tables import table


def _select(name, source, sql, columns, where=None):
    """Register a projection of one table, optionally filtered; columns and filter are made when the query runs."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        if where is not None:
            df = df.where(where())
        return df.select(*columns())

    run.__name__ = name
    return query(name, sql)(run)


c = F.col
_select("filter_equal", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", lambda: ["o_orderkey"], where=lambda: c("o_orderstatus") == "F")
_select("filter_prefix", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'", lambda: ["o_orderkey"], where=lambda: c("o_orderpriority").startswith("1"))
_select("filter_year_after", "orders", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1999", lambda: ["o_orderkey"], where=lambda: fn.year_after(c("o_orderdate"), 1999))
_select("filter_year_equal", "orders", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1998", lambda: ["o_orderkey"], where=lambda: fn.year_is(c("o_orderdate"), 1998))
_select("filter_keywords", "documents", "SELECT doc_id FROM documents WHERE text LIKE '% the %' AND text LIKE '% of %' AND text LIKE '% and %'", lambda: ["doc_id"], where=lambda: reduce(lambda a, b: a & b, [c("text").contains(w) for w in (" the ", " of ", " and ")]))
_select("filter_number", "part", "SELECT p_partkey FROM part WHERE p_size > 25", lambda: ["p_partkey"], where=lambda: c("p_size") > 25)
_select("filter_date_before", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01'", lambda: ["l_orderkey", "l_linenumber"], where=lambda: c("l_shipdate") < F.to_timestamp(F.lit("1996-06-01")))
_select("filter_open_interval", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'", lambda: ["o_orderkey"], where=lambda: (c("o_orderdate") > F.to_timestamp(F.lit("1997-01-01"))) & (c("o_orderdate") < F.add_months(F.to_timestamp(F.lit("1997-01-01")), 3)))
_select("filter_columns", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax", lambda: ["l_orderkey", "l_linenumber"], where=lambda: c("l_discount") < c("l_tax"))
_select("filter_flag", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'", lambda: ["l_orderkey", "l_linenumber"], where=lambda: c("l_returnflag") == "R")
_select("filter_contains", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%'", lambda: ["p_partkey", "p_name"], where=lambda: c("p_name").contains("red"))
_select("filter_arithmetic", "supplier", "SELECT s_nationkey AS k, s_suppkey AS v FROM supplier WHERE s_suppkey + s_nationkey < 30", lambda: [c("s_nationkey").alias("k"), c("s_suppkey").alias("v")], where=lambda: c("s_suppkey") + c("s_nationkey") < 30)
_select("filter_regex", "documents", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{4}')", lambda: ["doc_id"], where=lambda: c("text").rlike("[0-9]{4}"))
_select("project_computed", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS price FROM lineitem", lambda: ["l_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("price")])
_select("project_nulled", "customer", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey FROM customer", lambda: ["c_custkey", F.lit(None).cast("string").alias("c_name"), "c_nationkey"])
_select("project_mask", "nation", "SELECT n_nationkey, n_regionkey FROM nation", lambda: [*[n for n, keep in zip(("n_nationkey", "n_name", "n_regionkey"), (1, 0, 1)) if keep]])
_select("project_canonical", "supplier", "SELECT s_suppkey, least(s_suppkey, s_nationkey) AS a, greatest(s_suppkey, s_nationkey) AS b FROM supplier", lambda: ["s_suppkey", F.least("s_suppkey", c("s_nationkey").cast("long")).alias("a"), F.greatest("s_suppkey", c("s_nationkey").cast("long")).alias("b")])

_select("fn_substring", "part", "SELECT p_partkey, substr(p_name, 3, 4) AS s, substr(p_name, 3) AS rest FROM part", lambda: ["p_partkey", fn.substring(c("p_name"), 2, 6).alias("s"), fn.substring(c("p_name"), 2).alias("rest")])
_select("fn_find", "part", "SELECT p_partkey, CAST(instr(p_name, 'e') - 1 AS INTEGER) AS at FROM part", lambda: ["p_partkey", fn.find(c("p_name"), "e").alias("at")])
_select("fn_starts_with", "part", "SELECT p_partkey, substr(p_name, 2, 2) = 're' AS hit FROM part", lambda: ["p_partkey", fn.starts_with(c("p_name"), "re", 1).alias("hit")])
_select("fn_length", "part", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 2, 1) AS ch FROM part", lambda: ["p_partkey", F.length("p_name").alias("n"), fn.char_at(c("p_name"), 1).alias("ch")])
_select("fn_decode", "part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS ascii_text, 'é€' || p_name AS utf8_text FROM part", lambda: ["p_partkey", fn.decode_ascii(F.unhex(F.regexp_replace(c("p_size").cast("string"), "([0-9])", "3$1"))).alias("ascii_text"), fn.decode_utf8(F.concat(F.unhex(F.lit("C3A9E282AC")), c("p_name").cast("binary"))).alias("utf8_text")])
_select("fn_lower", "customer", "SELECT c_custkey, lower(c_name) AS s FROM customer", lambda: ["c_custkey", fn.to_lower(c("c_name")).alias("s")])
_select("fn_replace_non_word", "documents", r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{Nd}_]', ' ', 'g')) AS s FROM documents", lambda: ["doc_id", F.md5(fn.replace_non_word(c("text"))).alias("s")])
_select("fn_tokenize", "part", r"SELECT p_partkey, len(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> '')) AS n FROM part", lambda: ["p_partkey", F.size(fn.tokenize(c("p_name"))).cast("long").alias("n")])
_select("fn_split_line", "customer", "SELECT c_custkey, string_split(c_name, '#')[1] AS head, CAST(len(string_split(c_name, '#')) AS BIGINT) AS n FROM customer", lambda: ["c_custkey", F.get(fn.split_line(c("c_name"), "#"), F.lit(0)).alias("head"), F.size(fn.split_line(c("c_name"), "#")).cast("long").alias("n")])
_select("fn_map_lookup", "supplier", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS v, CAST(NULL AS VARCHAR) AS none FROM supplier", lambda: ["s_suppkey", fn.map_lookup(F.concat(F.lit("k="), c("s_suppkey"), F.lit(",n="), c("s_nationkey")), "n").alias("v"), fn.map_lookup(F.concat(F.lit("k="), c("s_suppkey")), "x").alias("none")])
def _vec():
    return F.array(c("l_quantity"), c("l_discount"), c("l_tax"))


_select("fn_euclidean", "lineitem", "SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - 1) * (l_quantity - 1) + l_discount * l_discount + l_tax * l_tax), 6) AS d FROM lineitem", lambda: ["l_orderkey", "l_linenumber", F.round(fn.euclidean(_vec(), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))), 6).alias("d")])
_select("fn_vector_add", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_quantity + 1, 6) AS x FROM lineitem", lambda: ["l_orderkey", "l_linenumber", F.round(F.get(fn.vector_add(_vec(), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))), F.lit(0)), 6).alias("x")])
def _words():
    return F.split("p_name", " ")


_W = "string_split(p_name, ' ')"
_select("fn_list", "part", f"SELECT p_partkey, CAST(len(list_append({_W}, 'x')) AS BIGINT) AS n, {_W}[1] AS first, list_contains({_W}, 'red') AS red, CAST(coalesce(list_position({_W}, 'red'), 0) - 1 AS BIGINT) AS at, array_to_string({_W}[1:1], ' ') AS sub, array_to_string(list_filter({_W}, lambda w: w <> 'red'), ' ') AS others FROM part", lambda: ["p_partkey", F.size(F.array_append(_words(), "x")).cast("long").alias("n"), F.get(_words(), F.lit(0)).alias("first"), F.array_contains(_words(), "red").alias("red"), fn.index_of(_words(), "red").alias("at"), F.array_join(fn.sublist(_words(), 0, 1), " ").alias("sub"), F.array_join(F.array_remove(_words(), "red"), " ").alias("others")])
_select("fn_list_sets", "part", f"SELECT p_partkey, array_to_string(list_filter({_W}, lambda w: w IN ('red', 'blue')), ' ') AS kept, array_to_string(list_filter({_W}, lambda w: w NOT IN ('red', 'blue')), ' ') AS rest FROM part", lambda: ["p_partkey", F.array_join(fn.retain_all(_words(), F.array(F.lit("red"), F.lit("blue"))), " ").alias("kept"), F.array_join(fn.remove_all(_words(), F.array(F.lit("red"), F.lit("blue"))), " ").alias("rest")])
def _map():
    return F.create_map(F.lit("k"), c("s_suppkey").cast("string"), F.lit("n"), c("s_nationkey").cast("string"))


_select("fn_map", "supplier", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS n, true AS has_k, CAST(3 AS BIGINT) AS size_put, CAST(1 AS BIGINT) AS size_removed, s_nationkey = 7 OR s_suppkey = 7 AS has_seven, 'k,n' AS keys FROM supplier", lambda: ["s_suppkey", F.element_at(_map(), "n").alias("n"), F.map_contains_key(_map(), "k").alias("has_k"), F.size(fn.map_put(_map(), "x", "1")).cast("long").alias("size_put"), F.size(fn.map_remove(_map(), "k")).cast("long").alias("size_removed"), fn.contains_value(_map(), "7").alias("has_seven"), F.array_join(F.array_sort(F.map_keys(_map())), ",").alias("keys")])
def _pair():
    return F.struct(c("c_nationkey").alias("first"), c("c_mktsegment").alias("second"))


_select("fn_pair", "customer", "SELECT c_custkey, c_nationkey AS first, c_mktsegment AS second FROM customer", lambda: ["c_custkey", _pair()["first"].alias("first"), _pair()["second"].alias("second")])
_select("fn_json", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", lambda: ["event_id", fn.json_get(c("props"), "$.k").cast("long").alias("k")])
_select("fn_json_set", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events", lambda: ["event_id", fn.json_get(fn.json_set(c("props"), "t", c("event_type")), "$.k").cast("long").alias("k"), fn.json_get(fn.json_set(c("props"), "t", c("event_type")), "$.t").alias("t")])
_select("fn_json_typed", "events", """SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"t":3}' AS s FROM events""", lambda: ["event_id", fn.json_set(c("props"), "t", F.lit(3)).alias("s")])
_select("fn_json_variant", "events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", lambda: ["event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")])
_select("fn_number_text", "supplier", "SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS bad, s_suppkey + 0.5 AS comma FROM supplier", lambda: ["s_suppkey", fn.parse_number(c("s_suppkey").cast("string")).alias("n"), fn.parse_number(F.concat(F.lit("x"), c("s_suppkey"))).alias("bad"), fn.parse_number(F.concat(c("s_suppkey"), F.lit(",5")), decimal=",").alias("comma")])
_select("fn_format", "supplier", "SELECT s_suppkey, printf('%.1f', s_suppkey * 1.0) AS s FROM supplier", lambda: ["s_suppkey", fn.format_number(c("s_suppkey").cast("double"), "%.1f").alias("s")])
_select("fn_dates", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS later, strftime(CAST('1997-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-01' AS DATE), '%Y-%m-%d') AS parsed FROM orders", lambda: ["o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.date_format(F.add_months("o_orderdate", 3), "yyyy-MM-dd").alias("later"), F.date_format(F.to_date(F.format_string("1997-%02d-01", F.month("o_orderdate"))), "yyyy-MM-dd").alias("parsed")])


@query("agg_sum", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey")
def agg_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("agg_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_two_sums", "SELECT l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS a, round(sum(l_tax), 2) AS b FROM lineitem GROUP BY l_linestatus")
def agg_two_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum(c("l_linenumber").cast("long")).alias("a"), F.round(F.sum("l_tax"), 2).alias("b"))


@query("agg_min_max", "SELECT o_custkey, min(o_orderkey) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_custkey")
def agg_min_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("low"), F.max("o_totalprice").alias("high"))


@query("agg_argmin", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def agg_argmin(spark, sf_dir):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", by).alias("cheapest"), F.max_by("o_orderkey", by).alias("dearest"))


@query("agg_vector_avg", "SELECT label, d, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY label, d")
def agg_vector_avg(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    return rows.groupBy("label", c("d").cast("long").alias("d")).agg(F.round(F.avg("x"), 5).alias("mean"))


@query("agg_min_ties", "SELECT s_nationkey, s_suppkey FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3) AS r FROM supplier) WHERE r = 1")
def agg_min_ties(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy(c("s_suppkey") % 3)
    return table(spark, sf_dir, "supplier").withColumn("r", F.rank().over(w)).where("r = 1").select("s_nationkey", "s_suppkey")


@query("agg_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_collect(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("agg_count_distinct", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def agg_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n"))


@query("agg_sum_distinct", "SELECT l_suppkey, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def agg_sum_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum_distinct(c("l_linenumber").cast("long")).alias("s"), F.countDistinct("l_partkey").alias("n"))


@query("agg_conditional", "SELECT user_id, count(*) FILTER (hour(ts) < 12) AS morning, count(*) FILTER (hour(ts) >= 12) AS afternoon FROM events GROUP BY user_id")
def agg_conditional(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.hour("ts") < 12).alias("morning"), F.count_if(F.hour("ts") >= 12).alias("afternoon"))


@query("agg_global", "SELECT round(sum(value), 2) AS total, round(avg(value), 6) AS mean, count(*) AS n FROM events")
def agg_global(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("agg_flagged_min", "SELECT l_orderkey, m AS low, bool_and(l_quantity > 10) AS flag FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_linenumber = m GROUP BY l_orderkey, m")
def agg_flagged_min(spark, sf_dir):
    """The least line of an order with whether all rows at it are flagged: one pass, no window."""
    low = F.min(F.struct(c("l_linenumber"), c("l_quantity") > 10))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(low.alias("m")).select("l_orderkey", c("m")[F.lit("l_linenumber")].alias("low"), c("m.col2").alias("flag"))


@query("order_mixed", "SELECT l_returnflag, l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 100")
def order_mixed(spark, sf_dir):
    """A top-100 report in mixed ascending and descending order."""
    top = table(spark, sf_dir, "lineitem").orderBy("l_returnflag", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
    w = Window.orderBy("l_returnflag", F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return top.withColumn("place", F.row_number().over(w).cast("long")).select("l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber", "place")


@query("terasort", "SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def terasort(spark, sf_dir):
    """All lines in global order of ship date, with their places: range partitioning by sampled bounds, local sorts, and the
    numbers of rows of the partitions before."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return placed(lines.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "place")


@query("sort_bounded", "SELECT o_orderkey, CAST((o_totalprice > 100000)::INT + (o_totalprice > 300000)::INT AS INTEGER) AS partition, true AS in_order FROM orders")
def sort_bounded(spark, sf_dir):
    """Orders by price in partitions with given bounds: where each row lies, and whether it lies behind the one ahead of it."""
    rows = bounded_sorted(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", [100000.0, 300000.0])
    return in_order(rows.withColumn("partition", F.spark_partition_id()), c("o_totalprice")).select("o_orderkey", "partition", "in_order")


@query("sort_local", "SELECT event_id, true AS in_order FROM events")
def sort_local(spark, sf_dir):
    """Events sorted by type, then by falling value, in each partition by itself."""
    rows = local_sorted(table(spark, sf_dir, "events").select("event_id", "event_type", "value").repartition(5, "user_id"), "event_type", F.desc("value"))
    return in_order(rows, c("event_type"), -c("value")).select("event_id", "in_order")


_select("fn_find_from", "part", "SELECT p_partkey, CAST(CASE WHEN instr(substr(p_name, 4), 'e') = 0 THEN -1 ELSE instr(substr(p_name, 4), 'e') + 2 END AS INTEGER) AS at FROM part", lambda: ["p_partkey", fn.find(c("p_name"), "e", 3).alias("at")])
_select("fn_list_more", "part", f"SELECT p_partkey, array_to_string(['x'] || {_W}[2:], ' ') AS replaced, CAST(CASE WHEN list_contains({_W}, 'red') THEN len({_W}) - list_position(list_reverse({_W}), 'red') ELSE -1 END AS BIGINT) AS last FROM part", lambda: ["p_partkey", F.array_join(fn.list_set(_words(), 0, F.lit("x")), " ").alias("replaced"), fn.last_index_of(_words(), "red").cast("long").alias("last")])
_select("fn_map_more", "supplier", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || ',new,1' AS joined, 'k,n,x' AS entries FROM supplier", lambda: ["s_suppkey", F.concat_ws(",", F.element_at(_both(), "k"), F.element_at(_both(), "n"), F.element_at(_both(), "x")).alias("joined"), F.array_join(F.transform(F.array_sort(F.map_entries(_both())), lambda e: e["key"]), ",").alias("entries")])
_select("fn_powers", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(floor(log2(l_linenumber)) AS BIGINT) AS log, (l_linenumber & (l_linenumber - 1)) = 0 AS power, CAST(pow(2, ceil(log2(l_linenumber))) AS BIGINT) AS up FROM lineitem", lambda: ["l_orderkey", "l_linenumber", fn.log2_floor(c("l_linenumber").cast("long")).cast("long").alias("log"), fn.is_power_of_two(c("l_linenumber")).alias("power"), fn.next_power_of_two(c("l_linenumber").cast("long")).alias("up")])


@query("project_hash_id", "SELECT count(*) AS n, count(DISTINCT c_name) AS ids FROM customer")
def project_hash_id(spark, sf_dir):
    """Names as 64-bit ids: as many as there are names."""
    return table(spark, sf_dir, "customer").select(fn.hash_id(c("c_name")).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def _both():
    return fn.map_put_all(_map(), F.create_map(F.lit("n"), F.lit("new"), F.lit("x"), F.lit("1")))
