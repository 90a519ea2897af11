"""Sources and sinks as queries: driver tables written in a format and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import temp
from millrace.operators.iterate import shared_folder
from millrace.plans.catalog import query
from millrace.sources import blocks, custom, formats
from millrace.sources.tables import table


def folder(spark: SparkSession) -> str:
    """A new folder beside the shared checkpoints, deleted at the end."""
    return shared_folder(spark, "io")


@query("io_records", "SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def io_records(spark, sf_dir) -> DataFrame:
    """Delimited records; two of four text fields are parsed, in another order."""
    path = folder(spark)
    sinks.records(table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.format_string("%.2f", "s_acctbal")), path, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], trailing=True)
    return formats.records(spark, path, "s_acctbal double, s_suppkey long", "|", positions=[3, 0]).select("s_suppkey", "s_acctbal")


@query("io_text", "SELECT n_name || ';' || n_nationkey AS line FROM nation")
def io_text(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.lines(table(spark, sf_dir, "nation"), path, F.concat_ws(";", "n_name", "n_nationkey"), "\t", single_file=True)
    return formats.text(spark, path, "\t")


@query("io_blocks", "SELECT p_partkey, p_name, p_size FROM part")
def io_blocks(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.blocks(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return formats.blocks(spark, path)


@query("io_sequential_blocks", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS records FROM part")
def io_sequential_blocks(spark, sf_dir) -> DataFrame:
    """Records in blocks with footers, which also give their number."""
    path = folder(spark)
    blocks.write(table(spark, sf_dir, "part"), path, F.to_json(F.struct("p_partkey", "p_name")), 4096)
    record = F.from_json(F.col("record").cast("string"), "p_partkey long, p_name string").alias("r")
    return blocks.read(spark, path, 4096).select(record).select("r.*", F.lit(blocks.count(path, 4096)).cast("long").alias("records"))


@query("io_lenient", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS segment FROM customer")
def io_lenient(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    sinks.records(rows, path, lenient=True)
    return formats.records(spark, path, "c_custkey long, segment string", "|")


@query("io_key_row", "SELECT CAST(s_suppkey AS INTEGER) AS key, s_suppkey || '|' || s_name AS row FROM supplier")
def io_key_row(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.records(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_name"])
    return formats.int_tuples(spark, path)


@query("io_edges", "SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM supplier WHERE s_nationkey > 0 AND s_suppkey > 0 AND s_suppkey <> s_nationkey")
def io_edges(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.records(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_nationkey"], delimiter=",")
    return formats.edges(spark, path)


def _degrees(spark, sf_dir) -> DataFrame:
    """Suppliers and their nations as edges, with the nations' numbers of suppliers."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))
    return rows.join(rows.groupBy("dst").agg(F.count(F.lit(1)).alias("dst_degree")), "dst").select("src", F.lit(1).cast("long").alias("src_degree"), "dst", "dst_degree")


@query("io_edges_with_degrees", "SELECT s_suppkey AS src, 1::BIGINT AS src_degree, CAST(s_nationkey AS BIGINT) AS dst, count(*) OVER (PARTITION BY s_nationkey) AS dst_degree FROM supplier")
def io_edges_with_degrees(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.edges_with_degrees(_degrees(spark, sf_dir), path)
    return formats.edges_with_degrees(spark, path)


@query("io_fixed_length", "SELECT p_partkey, substr(p_name, 1, 8) AS name FROM part")
def io_fixed_length(spark, sf_dir) -> DataFrame:
    """Records of 20 bytes: ten of the key, nine of the name, one that ends them."""
    path = folder(spark)
    sinks.lines(table(spark, sf_dir, "part"), path, F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.rpad(F.substring("p_name", 1, 8), 9, " ")))
    rows = formats.fixed_length(spark, path, 20, [("key", 0, 10, "text"), ("name", 10, 8, "text")])
    return rows.select(F.col("key").cast("long").alias("p_partkey"), F.rtrim("name").alias("name"))


@query("io_binary_ints", "SELECT CAST((ascii(s) * 65536 + ascii(substr(s, 2)) * 256 + ascii(substr(s, 3))) * 256 + 10 AS INTEGER) AS value FROM (SELECT CAST(100 + n_nationkey AS VARCHAR) AS s FROM nation)")
def io_binary_ints(spark, sf_dir) -> DataFrame:
    """Three digits and a line end are four bytes, so an integer."""
    path = folder(spark)
    sinks.lines(table(spark, sf_dir, "nation"), path, F.col("n_nationkey") + 100)
    return formats.binary_ints(spark, path)


@query("io_process_fixed", "SELECT unnest(['ab', 'cd', 'wx', 'yz']) AS record")
def io_process_fixed(spark, _: str) -> DataFrame:
    """Records of two bytes that two commands print."""
    return formats.external_process(spark, ["printf abcd", "printf wxyz"], record_length=2).select(F.col("record").cast("string").alias("record"))


@query("io_triples", "SELECT '<c' || o_custkey || '>' AS s, '<ordered>' AS p, '<o' || o_orderkey || '>' AS o FROM orders WHERE o_orderstatus = 'F'")
def io_triples(spark, sf_dir) -> DataFrame:
    """Triples of two predicates, of which one is read."""
    path = folder(spark)
    name = lambda prefix, c: F.concat(F.lit(f"<{prefix}"), F.col(c).cast("string"), F.lit(">"))
    predicate = F.when(F.col("o_orderstatus") == "F", "<ordered>").otherwise("<wanted>")
    sinks.lines(table(spark, sf_dir, "orders"), path, F.concat_ws(" ", name("c", "o_custkey"), predicate, name("o", "o_orderkey")))
    return formats.triples(spark, path, "<ordered>")


@query("io_page_links", "SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation")
def io_page_links(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.lines(table(spark, sf_dir, "nation"), path, F.format_string("<http://x/N%d> <http://x/in> <http://x/R%d> .", "n_nationkey", "n_regionkey"))
    return formats.page_links(spark, path, "http://x/")


@query("io_paths", """SELECT CAST(c_custkey AS VARCHAR) AS "from", r_name AS "to", 2 AS length, n_name AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def io_paths(spark, sf_dir) -> DataFrame:
    """Paths from customers over nations to regions."""
    path = folder(spark)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sinks.paths(rows.select(F.col("c_custkey").alias("from"), F.col("r_name").alias("to"), F.lit(2).alias("length"), F.array("n_name").alias("hops")), path)
    return formats.paths(spark, path).select("from", "to", "length", F.array_join("hops", ",").alias("hops"))


@query("io_points", "SELECT CAST(s_suppkey AS INTEGER) AS id, round(s_nationkey / 4.0, 2) AS x, s_suppkey * 0.5 AS y FROM supplier")
def io_points(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    coords = F.array(F.col("s_nationkey") / 4.0, F.col("s_suppkey") * 0.5)
    sinks.points(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), coords.alias("coords")), path)
    return formats.points(spark, path).select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


@query("io_sort_records", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderpriority AS value FROM orders")
def io_sort_records(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.lines(table(spark, sf_dir, "orders"), path, F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), "o_orderpriority"))
    return formats.sort_records(spark, path)


@query("io_adjacency", "SELECT CAST(n_regionkey AS BIGINT) AS vid, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS neighbours FROM nation GROUP BY n_regionkey")
def io_adjacency(spark, sf_dir) -> DataFrame:
    """Adjacency lists with tabs between fields and blanks between neighbours."""
    path = folder(spark)
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).cast("array<string>").alias("own"))
    sinks.lines(lists, path, F.concat_ws("\t", F.col("n_regionkey").cast("string"), F.array_join("own", " ")))
    return formats.adjacency(spark, path, "\t", " ").select("vid", F.array_join("neighbours", ",").alias("neighbours"))


@query("io_swapped_edges", "SELECT CAST(s_nationkey AS BIGINT) AS src, s_suppkey AS dst FROM supplier WHERE s_nationkey > 0 AND s_suppkey > 0 AND s_suppkey <> s_nationkey")
def io_swapped_edges(spark, sf_dir) -> DataFrame:
    """Followed-by pairs, tabs between, read the other way round."""
    path = folder(spark)
    sinks.records(table(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_nationkey"], delimiter="\t")
    return formats.edges(spark, path, "\t", swap=True)


@query("io_word_counts", "SELECT o_orderpriority || ' ' || count(*) AS line FROM orders GROUP BY o_orderpriority")
def io_word_counts(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.word_counts(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("word")).agg(F.count(F.lit(1)).alias("n")), path)
    return formats.text(spark, path)


@query("io_ranked_pages", "SELECT s_nationkey || '|' || s_name || '|' || s_suppkey || '|' AS line FROM supplier")
def io_ranked_pages(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.ranked_pages(table(spark, sf_dir, "supplier"), path, "s_nationkey", "s_name", "s_suppkey")
    return formats.text(spark, path)


@query("io_triangle_lines", "SELECT n_nationkey || ',' || n_regionkey || ',' || n_name AS line FROM nation")
def io_triangle_lines(spark, sf_dir) -> DataFrame:
    path = folder(spark)
    sinks.triangles(table(spark, sf_dir, "nation"), path, ["n_nationkey", "n_regionkey", "n_name"])
    return formats.text(spark, path)


@query("io_quoted", """SELECT c_custkey, c_name || ', "' AS name FROM customer""")
def io_quoted(spark, sf_dir) -> DataFrame:
    """Text fields between quotes, with the delimiter in them."""
    path = folder(spark)
    sinks.lines(table(spark, sf_dir, "customer"), path, F.concat(F.lit("'"), "c_name", F.lit(""", "',"""), F.col("c_custkey").cast("string"), F.lit(",x")))
    return formats.records(spark, path, "c_custkey long, name string", ",", positions=[1, 0], quote="'")


class _Decades(custom.InputFormat):
    """Ten numbers for each split, of which odd ones are skipped."""

    def splits(self):
        return [0, 10, 20, 30]

    def open(self, split):
        self.start = split

    def records(self):
        return ((n, n * n) if n % 2 == 0 else None for n in range(self.start, self.start + 10))


@query("io_custom_format", "SELECT range AS n, range * range AS square FROM range(40) WHERE range % 2 = 0")
def io_custom_format(spark, _: str) -> DataFrame:
    """A user format with four splits."""
    return custom.read(spark, _Decades(), "n long, square long")


@query("io_generated", "SELECT range % 8 AS split, range AS n FROM range(1000)")
def io_generated(spark, _: str) -> DataFrame:
    """A generator with eight splits."""
    return custom.generate(spark, lambda split, splits: ((split, n) for n in range(split, 1000, splits)), 8, "split long, n long")


@query("io_generated_points", "SELECT range % 3 AS centre, count(*) AS n, true AS near FROM range(3000) GROUP BY 1")
def io_generated_points(spark, _: str) -> DataFrame:
    """Generated points lie about their centres: means of a thousand within a tenth."""
    rows = formats.generate_points(spark, 3000, [(0.0, 0.0), (50.0, 0.0), (0.0, 50.0)], spread=0.5).withColumn("centre", F.col("centre").cast("long"))
    x, y = (F.avg(F.col("coords")[d]) for d in (0, 1))
    near = (F.abs(x - F.when(F.col("centre") == 1, 50.0).otherwise(0.0)) < 0.1) & (F.abs(y - F.when(F.col("centre") == 2, 50.0).otherwise(0.0)) < 0.1)
    return rows.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), near.alias("near"))


@query("io_generated_weblog", "SELECT 200::BIGINT AS docs, 200::BIGINT AS ranked, 5000::BIGINT AS visits, true AS valid")
def io_generated_weblog(spark, _: str) -> DataFrame:
    """A generated web log: visits go to generated documents, words come from the vocabulary."""
    docs, ranks, visits = formats.generate_weblog(spark, 200, 5000, ["alpha", "beta", "gamma"])
    known = F.forall(F.split("contents", " "), lambda w: w.isin("alpha", "beta", "gamma"))
    a = docs.agg(F.count(F.lit(1)).alias("docs"), F.every(known).alias("words"))
    b = ranks.agg(F.count(F.lit(1)).alias("ranked"), F.every(F.col("page_rank").between(0, 99)).alias("range"))
    v = visits.join(docs.select(F.col("url").alias("of")), F.col("url") == F.col("of"), "left").agg(F.count(F.lit(1)).alias("visits"), F.every(F.col("of").isNotNull()).alias("known"))
    return a.crossJoin(b).crossJoin(v).select("docs", "ranked", "visits", (F.col("words") & F.col("range") & F.col("known")).alias("valid"))  # one row each


@query("io_statistics", "SELECT (SELECT count(*) FROM part) AS rows, true AS sized")
def io_statistics(spark, sf_dir) -> DataFrame:
    """Rows and bytes of a table's files."""
    found = custom.statistics(spark, f"{sf_dir}/part.parquet")
    return spark.range(1).select(F.lit(found["rows"]).cast("long").alias("rows"), F.lit(found["bytes"] > 0 and found["row_bytes"] > 0).alias("sized"))


@query("temp", "SELECT s_nationkey, count(*) AS n, count(*) * count(*) AS pairs FROM supplier GROUP BY s_nationkey")
def temp_query(spark, sf_dir) -> DataFrame:
    """A materialised input that is read twice."""
    rows = temp(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"))
    n = rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.join(rows.select(F.col("s_nationkey").alias("k")), F.col("s_nationkey") == F.col("k")).groupBy("k").agg(F.count(F.lit(1)).alias("pairs"))
    return n.join(pairs, F.col("s_nationkey") == F.col("k")).select("s_nationkey", "n", "pairs")


@query("io_process", "SELECT unnest(['alpha', 'beta', 'gamma']) AS record")
def io_process(spark, _: str) -> DataFrame:
    """Lines that two commands print."""
    return formats.external_process(spark, ["printf 'alpha\\nbeta\\n'", "echo gamma"]).select(F.col("record").cast("string").alias("record"))


@query("io_range", "SELECT range AS id, range * range AS square FROM range(1000)")
def io_range(spark, _: str) -> DataFrame:
    """A generated source."""
    return spark.range(1000).withColumn("square", F.col("id") * F.col("id"))
