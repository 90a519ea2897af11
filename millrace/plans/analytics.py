"""Web-analytics programs on ``events`` as page views: user, action, time, revenue, a map of properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.ordering import placed
from millrace.plans.catalog import query
from millrace.sources.tables import table


def _views(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), F.col("value").alias("revenue"), "ts", "props")


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), "c_acctbal", "c_mktsegment")


@query("pigmix_l1", "SELECT user_id AS user, count(*) AS n FROM (SELECT user_id, unnest(json_keys(props)) AS k FROM events) GROUP BY user_id")
def pigmix_l1(spark, sf_dir):
    """Members of the nested maps by user."""
    members = _views(spark, sf_dir).select("user", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return members.groupBy("user").agg(F.count(F.lit(1)).alias("n"))


@query("pigmix_l2", "SELECT user_id AS user, round(value, 4) AS revenue FROM events JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) ON user_id = c_custkey")
def pigmix_l2(spark, sf_dir):
    """Views of power users; the strategy is left to adaptive execution, which broadcasts the side that turns out small."""
    power = _users(spark, sf_dir).where("c_acctbal > 9000").select("user")
    return _views(spark, sf_dir).join(power, "user").select("user", F.round("revenue", 4).alias("revenue"))


@query("pigmix_l3", "SELECT user_id AS user, round(sum(value), 4) AS revenue FROM events JOIN customer ON user_id = c_custkey GROUP BY user_id")
def pigmix_l3(spark, sf_dir):
    return _views(spark, sf_dir).join(_users(spark, sf_dir).select("user"), "user").groupBy("user").agg(F.round(F.sum("revenue"), 4).alias("revenue"))


@query("pigmix_l4", "SELECT user_id AS user, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def pigmix_l4(spark, sf_dir):
    return _views(spark, sf_dir).groupBy("user").agg(F.countDistinct("action").alias("n"))


@query("pigmix_l5", "SELECT DISTINCT user_id AS user FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pigmix_l5(spark, sf_dir):
    return _views(spark, sf_dir).select("user").join(_users(spark, sf_dir).where("c_acctbal > 0"), "user", "left_anti").distinct()


@query("pigmix_l6", "SELECT user_id AS user, event_type AS action, CAST(day(ts) AS BIGINT) AS day, CAST(hour(ts) AS BIGINT) AS hour, round(sum(value), 4) AS revenue FROM events GROUP BY ALL")
def pigmix_l6(spark, sf_dir):
    keys = [F.col("user"), F.col("action"), F.dayofmonth("ts").cast("long").alias("day"), F.hour("ts").cast("long").alias("hour")]
    return _views(spark, sf_dir).groupBy(*keys).agg(F.round(F.sum("revenue"), 4).alias("revenue"))


@query("pigmix_l7", "SELECT user_id AS user, count(*) FILTER (hour(ts) < 12) AS morning, count(*) FILTER (hour(ts) >= 12) AS afternoon FROM events GROUP BY user_id")
def pigmix_l7(spark, sf_dir):
    return _views(spark, sf_dir).groupBy("user").agg(F.count_if(F.hour("ts") < 12).alias("morning"), F.count_if(F.hour("ts") >= 12).alias("afternoon"))


@query("pigmix_l8", "SELECT round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events")
def pigmix_l8(spark, sf_dir):
    return _views(spark, sf_dir).agg(F.round(F.sum("revenue"), 4).alias("total"), F.round(F.avg("revenue"), 6).alias("mean"))


@query("pigmix_l9", "SELECT user_id AS user, event_type AS action, round(value, 4) AS revenue, row_number() OVER (ORDER BY event_type, user_id, ts, value) AS place FROM events")
def pigmix_l9(spark, sf_dir):
    """Views in order of action (then of the other columns), with their places."""
    return placed(_views(spark, sf_dir).orderBy("action", "user", "ts", "revenue")).select("user", "action", F.round("revenue", 4).alias("revenue"), "place")


@query("pigmix_l10", "SELECT user_id AS user, event_type AS action, round(value, 4) AS revenue, row_number() OVER (ORDER BY event_type, value DESC, ts, user_id) AS place FROM events")
def pigmix_l10(spark, sf_dir):
    """Views in mixed order, with their places."""
    return placed(_views(spark, sf_dir).orderBy(F.asc("action"), F.desc("revenue"), F.asc("ts"), "user")).select("user", "action", F.round("revenue", 4).alias("revenue"), "place")


@query("pigmix_l11", "SELECT user_id AS user FROM events UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def pigmix_l11(spark, sf_dir):
    return _views(spark, sf_dir).select("user").distinct().union(_users(spark, sf_dir).where("c_acctbal > 5000").select("user").distinct()).distinct()


@query("pigmix_l12", """SELECT 'max' AS part, user_id AS user, round(max(value), 4) AS x FROM events WHERE value < 20 GROUP BY user_id UNION ALL
    SELECT 'sum', user_id, round(sum(value), 4) FROM events WHERE value >= 20 AND value < 60 GROUP BY user_id UNION ALL
    SELECT 'count', user_id, CAST(count(*) AS DOUBLE) FROM events WHERE value >= 60 GROUP BY user_id""")
def pigmix_l12(spark, sf_dir):
    """Three aggregates under exclusive predicates, in one scan and one shuffle."""
    v = F.col("revenue")
    part = F.when(v < 20, "max").when(v < 60, "sum").when(v >= 60, "count")
    sums = _views(spark, sf_dir).select("user", "revenue", part.alias("part")).where(F.col("part").isNotNull()).groupBy("part", "user").agg(F.max("revenue").alias("m"), F.sum("revenue").alias("s"), F.count(F.lit(1)).alias("n"))
    x = F.when(F.col("part") == "max", F.round("m", 4)).when(F.col("part") == "sum", F.round("s", 4)).otherwise(F.col("n").cast("double"))
    return sums.select("part", "user", x.alias("x"))


@query("pigmix_l13", "SELECT user_id AS user, round(value, 4) AS revenue, c_mktsegment AS segment FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON user_id = c_custkey")
def pigmix_l13(spark, sf_dir):
    return _views(spark, sf_dir).join(_users(spark, sf_dir).where("c_acctbal > 5000"), "user", "left").select("user", F.round("revenue", 4).alias("revenue"), F.col("c_mktsegment").alias("segment"))


@query("pigmix_l14", "SELECT user_id AS user, round(value, 4) AS revenue FROM events JOIN customer ON user_id = c_custkey")
def pigmix_l14(spark, sf_dir):
    return _views(spark, sf_dir).join(_users(spark, sf_dir).select("user").hint("merge"), "user").select("user", F.round("revenue", 4).alias("revenue"))


@query("pigmix_l15", "SELECT user_id AS user, count(DISTINCT event_type) AS actions, CAST(sum(DISTINCT CAST(hour(ts) AS BIGINT)) AS BIGINT) AS hours FROM events GROUP BY user_id")
def pigmix_l15(spark, sf_dir):
    return _views(spark, sf_dir).groupBy("user").agg(F.countDistinct("action").alias("actions"), F.sum_distinct(F.hour("ts").cast("long")).alias("hours"))


@query("pigmix_l16", "SELECT event_type AS action, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def pigmix_l16(spark, sf_dir):
    return _views(spark, sf_dir).groupBy("action").agg(F.countDistinct("user").alias("users"))


_WIDE = [f"k{i}" for i in range(18)]


@query("pigmix_l17", f"SELECT user_id AS user, event_type AS action, CAST(hour(ts) AS BIGINT) AS hour, {', '.join(f'user_id % {i + 2} AS {k}' for i, k in enumerate(_WIDE))}, round(sum(value), 4) AS revenue FROM events GROUP BY ALL")
def pigmix_l17(spark, sf_dir):
    """A key of 21 columns."""
    keys = [F.col("user"), F.col("action"), F.hour("ts").cast("long").alias("hour")] + [(F.col("user") % (i + 2)).alias(k) for i, k in enumerate(_WIDE)]
    return _views(spark, sf_dir).groupBy(*keys).agg(F.round(F.sum("revenue"), 4).alias("revenue"))


@query("grep", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'token|password')")
def grep(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("token|password")).select("doc_id")
