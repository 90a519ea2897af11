"""TPC-H-style programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import NON_WORD, to_lower, year_after
from millrace.plans.catalog import query
from millrace.sources.tables import table


@query(
    "q03_revenue",
    """SELECT l_orderkey, round(sum(l_extendedprice), 2) AS revenue
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE o_orderstatus = 'F' AND year(o_orderdate) > 1996 AND o_orderpriority LIKE '5%'
       GROUP BY l_orderkey""",
)
def q03_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered orders joined with their lines; revenue by order."""
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & year_after(F.col("o_orderdate"), 1996) & F.col("o_orderpriority").startswith("5"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("q01_flags", """SELECT l_returnflag, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price
       FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-03' GROUP BY l_returnflag""")
def q01_flags(spark, sf_dir):
    """Quantities and prices of early lines by return flag."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.to_timestamp(F.lit("1998-09-03")))
    return lines.groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))


@query("q_segment_count", "SELECT c_mktsegment, count(o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q_segment_count(spark, sf_dir):
    """Orders by market segment."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n"))


@query("q04_priority_pairs", """SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey
       WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01' AND l_shipdate > o_orderdate + INTERVAL 45 DAY GROUP BY o_orderpriority""")
def q04_priority_pairs(spark, sf_dir):
    """Pairs of a quarter's orders (open interval) and their late lines, by priority."""
    start = F.to_timestamp(F.lit("1997-01-01"))
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") > start) & (F.col("o_orderdate") < F.add_months(start, 3)))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")
    return orders.join(lines, (F.col("o_orderkey") == F.col("l_orderkey")) & late).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("q09_profit", """SELECT n_name, year(o_orderdate) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 0.1 * p_retailprice * l_quantity), 4) AS profit
       FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
       JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%red%' GROUP BY n_name, year(o_orderdate)""")
def q09_profit(spark, sf_dir):
    """Profit on parts of one colour by nation and year; the supply cost is a tenth of the retail price."""
    part = table(spark, sf_dir, "part").where(F.col("p_name").contains("red")).select("p_partkey", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.col("price") - F.lit(0.1) * F.col("p_retailprice") * F.col("l_quantity")
    return joined.groupBy("n_name", "o_year").agg(F.round(F.sum(amount), 4).alias("profit"))


@query("q10_returns", """SELECT c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
       WHERE year(o_orderdate) > 1996 AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name""")
def q10_returns(spark, sf_dir):
    """Revenue lost to returns by customer. Summed by customer key before the customer's own columns are joined."""
    orders = table(spark, sf_dir, "orders").where(year_after(F.col("o_orderdate"), 1996)).select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    sums = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("price").alias("revenue"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return customers.join(sums, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "c_acctbal", "n_name", F.round("revenue", 4).alias("revenue"))


@query("weblog", """SELECT d.doc_id, d.source, d.n_chars FROM documents d JOIN labels q ON d.doc_id = q.doc_id AND q.quality = 1
       WHERE d.text LIKE '% the %' AND d.n_chars > 50 AND NOT EXISTS (SELECT 1 FROM labels t WHERE t.doc_id = d.doc_id AND t.toxic = 1)""")
def weblog(spark, sf_dir):
    """Ranked documents with a keyword that no excluded visit names."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains(" the ") & (F.col("n_chars") > 50)).select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels.where("quality = 1").select("doc_id"), "doc_id").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("wordcount", r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^\p{L}\p{Nd}_]', ' ', 'g')), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word""")
def wordcount(spark, sf_dir):
    """Words of all documents with their counts: each text is scanned once."""
    runs = table(spark, sf_dir, "documents").select(F.explode(F.split("text", NON_WORD + "+")).alias("run")).where("run <> ''")
    return runs.groupBy(to_lower(F.col("run")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
