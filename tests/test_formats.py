"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from millrace import sinks
from millrace.session import file_splits
from millrace.sources import blocks, custom, formats


def put(path, content):
    mode = "wb" if isinstance(content, bytes) else "w"
    with open(path, mode) as f:
        f.write(content)
    return str(path)


def test_records_skip_malformed_and_keep_surplus(spark, tmp_path):
    path = put(tmp_path / "r", "1|a|2.5\nx|b|1\n2|c|3|more|fields\n3|d\n")
    assert [tuple(r) for r in formats.records(spark, path, "id int, n double", "|", positions=[0, 2]).orderBy("id").collect()] == [(1, 2.5), (2, 3.0)]


def test_records_decimal_comma_quotes_and_leading_delimiter(spark, tmp_path):
    path = put(tmp_path / "r", '|"a";1,5\n|"b";2,25\n')
    got = formats.records(spark, path, "s string, n double", ";", decimal=",", quote='"').collect()
    assert [(r.s, r.n) for r in got] == [('|"a"', 1.5), ('|"b"', 2.25)]
    path = put(tmp_path / "l", ",1,2\n3,4\n")
    assert sorted(tuple(r) for r in formats.records(spark, path, "a int, b int", leading_delimiter=True).collect()) == [(1, 2), (3, 4)]


def test_fixed_length_and_ints(spark, tmp_path):
    path = put(tmp_path / "f", b"ab" + formats.pack_int(7) + b"cd" + formats.pack_int(-9))
    assert [tuple(r) for r in formats.fixed_length(spark, path, 6, [("s", 0, 2, "text"), ("n", 2, 4, "int")]).collect()] == [("ab", 7), ("cd", -9)]
    assert formats.binary_ints(spark, put(tmp_path / "i", formats.pack_int(5))).first().value == 5
    with pytest.raises(Exception, match="incomplete record"):
        formats.binary_ints(spark, put(tmp_path / "x", b"12345")).collect()


def test_text_delimiters_and_charset(spark, tmp_path):
    assert [r.line for r in formats.text(spark, put(tmp_path / "t", "a;b;c"), ";").collect()] == ["a", "b", "c"]
    assert [r.line for r in formats.text(spark, put(tmp_path / "c", "é\nü".encode("latin-1")), charset="ISO-8859-1").collect()] == ["é", "ü"]


def test_graph_formats(spark, tmp_path):
    assert [tuple(r) for r in formats.edges(spark, put(tmp_path / "e", "1,2\n3,3\n0,4\nx,1\n5,6\n")).collect()] == [(1, 2), (5, 6)]
    assert [(r.vid, list(r.neighbours)) for r in formats.adjacency(spark, put(tmp_path / "a", "1|2,3\n2|\n")).collect()] == [(1, [2, 3]), (2, [])]
    assert formats.edges_with_degrees(spark, put(tmp_path / "d", "1,4|2,3\n")).first() == (1, 4, 2, 3)
    assert [tuple(r) for r in formats.triples(spark, put(tmp_path / "t", "<a> <knows> <b>\n<a> <likes> <c>\nbad\n"), "knows").collect()] == [("<a>", "<knows>", "<b>")]
    assert [tuple(r) for r in formats.page_links(spark, put(tmp_path / "l", "<http://x/A> <l> <http://x/B> .\n"), "http://x/").collect()] == [("A", "B")]
    p = formats.points(spark, put(tmp_path / "p", "7|1.5|2.0|\n")).first()
    assert (p.id, list(p.coords)) == (7, [1.5, 2.0])
    q = formats.paths(spark, put(tmp_path / "q", "a|b|2|1|c|\n")).first()
    assert (q["from"], q["to"], q.length, list(q.hops)) == ("a", "b", 2, ["c"])


def test_external_process_exit_codes(spark):
    assert sorted(bytes(r.record) for r in formats.external_process(spark, ["printf abcd", "printf wxyz"], record_length=2).collect()) == [b"ab", b"cd", b"wx", b"yz"]
    with pytest.raises(Exception, match="ended with 3"):
        formats.external_process(spark, ["exit 3"]).collect()
    assert formats.external_process(spark, ["exit 3"], allowed_exit_codes=(0, 3)).count() == 0


def test_strict_and_lenient_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.records(df, str(tmp_path / "o"), lenient=True)
    assert spark.read.text(str(tmp_path / "o")).first().value == "1|"
    with pytest.raises(Exception, match="null field b"):
        sinks.records(df, str(tmp_path / "s"))


def test_sorted_sinks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    parts = sinks.global_sorted(df, "x", partitions=5).withColumn("p", F.spark_partition_id()).collect()
    assert [r.x for r in sorted(parts, key=lambda r: r.p)] == list(range(1000))
    assert len({r.p for r in parts}) == 5
    bounded = sinks.bounded_sorted(df, "x", [99, 499]).withColumn("p", F.spark_partition_id()).collect()
    assert [[r.x for r in bounded if r.p == k] for k in range(3)] == [list(range(100)), list(range(100, 500)), list(range(500, 1000))]


def test_quoted_fields_and_exponents(spark, tmp_path):
    path = put(tmp_path / "q", "1,'a,b',2\n2,c,3\n3,'',4\n4,'it''s, ok',5\n")
    assert [tuple(r) for r in formats.records(spark, path, "n int, s string, m int", quote="'").orderBy("n").collect()] == [(1, "a,b", 2), (2, "c", 3), (3, "", 4), (4, "it''s, ok", 5)]
    path = put(tmp_path / "e", "1e3\n7\n")
    assert [r.x for r in formats.records(spark, path, "x double").collect()] == [1000.0, 7.0]
    assert [r.x for r in formats.records(spark, path, "x double", exponent=False).collect()] == [7.0]


def test_fixed_length_files_are_split(spark, tmp_path):
    path = put(tmp_path / "big", b"".join(formats.pack_int(i) for i in range(50_000)))
    conf, name = spark.sparkContext._jsc.hadoopConfiguration(), "mapreduce.input.fileinputformat.split.maxsize"
    conf.set(name, "30001")
    got = formats.binary_ints(spark, path)
    assert got.rdd.getNumPartitions() > 5
    conf.unset(name)
    assert sorted(r.value for r in got.collect()) == list(range(50_000))


class Lines(custom.InputFormat):
    def __init__(self, log):
        self.log = log

    def splits(self):
        return [["a", "", "b"], [], ["c"]]

    def open(self, split):
        self.split = split

    def records(self):
        for line in self.split:
            yield (line,) if line else None

    def close(self):
        with open(self.log, "a") as f:
            f.write("closed\n")


def test_user_formats(spark, tmp_path):
    df = custom.read(spark, Lines(str(tmp_path / "log")), "line string")
    assert sorted(r.line for r in df.collect()) == ["a", "b", "c"]
    assert (tmp_path / "log").read_text() == "closed\n" * 3
    assert df.rdd.getNumPartitions() == 3
    made = custom.generate(spark, lambda split, splits: iter([(split, splits)]), 4, "split int, splits int")
    assert sorted(map(tuple, made.collect())) == [(k, 4) for k in range(4)]
    out = []
    custom.local_sink(spark, lambda rows: out.append(rows.count()), "x int", batch=3)(iter([(k,) for k in range(7)]))
    assert out == [3, 3, 1] and sorted(custom.local_rows(made)) == [(k, 4) for k in range(4)]


@pytest.mark.parametrize("block_size", [29, 40, 64, 1000])
def test_blocks_are_split_and_counted(spark, tmp_path, monkeypatch, block_size):
    monkeypatch.setattr(blocks, "SPLIT_BLOCKS", 3)
    path = str(tmp_path / "blocks")
    values = [str(k) * (k % 13 if k % 50 else 300) for k in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(3)
    blocks.write(df, path, F.col("v"), block_size)
    got = blocks.read(spark, path, block_size)
    assert sorted(bytes(r.record).decode() for r in got.collect()) == sorted(values)
    assert blocks.count(path, block_size) == 400
    assert got.rdd.getNumPartitions() >= 3 + 3 * (block_size < 1000)
    blocks.write(df.limit(5), path, F.col("v"), block_size)
    assert blocks.read(spark, path, block_size).count() == 5
    blocks.write(df.limit(2), path, F.col("v"), block_size, overwrite=False)
    assert blocks.count(path, block_size) == 7


def test_statistics_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    first = custom.statistics(spark, path)
    assert first["rows"] == 100 and first["row_bytes"] == first["bytes"] / 100
    spark.range(50).write.mode("append").parquet(path)
    assert custom.statistics(spark, path)["rows"] == 150


def test_example_sinks(spark, tmp_path):
    read = lambda name: sorted(r.value for r in spark.read.text(str(tmp_path / name)).collect())
    sinks.points(spark.createDataFrame([(1, [1.0, 2.345])], "id int, coords array<double>"), str(tmp_path / "p"))
    sinks.paths(spark.createDataFrame([("a", "b", 2, ["c", "d"]), ("x", "y", 1, [])], "from string, to string, length int, hops array<string>"), str(tmp_path / "q"))
    sinks.edges_with_degrees(spark.createDataFrame([(1, 4, 2, 3)], "src long, src_degree long, dst long, dst_degree long"), str(tmp_path / "d"))
    sinks.word_counts(spark.createDataFrame([("w", 3)], "word string, n long"), str(tmp_path / "w"))
    assert (read("p"), read("q"), read("d"), read("w")) == (["1|1.00|2.35|"], ["a|b|2|2|c|d|", "x|y|1|0|"], ["1,4|2,3"], ["w 3"])
    sinks.noop(spark.range(5))


def test_sorted_records_and_splits(spark, tmp_path):
    assert [tuple(r) for r in formats.sort_records(spark, put(tmp_path / "s", "0123456789rest\n")).collect()] == [("0123456789", "rest")]
    path = put(tmp_path / "many", "line\n" * 20_000)
    with file_splits(spark, most_bytes=10_000):
        assert spark.read.text(path).rdd.getNumPartitions() >= 10
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert before != "10000"


def test_plan_as_json(spark):
    import json

    from millrace.__main__ import plan_json

    nodes = json.loads(plan_json(spark.range(5).where("id > 2")))
    assert nodes and all("num-children" in n for n in nodes)


def test_stream_window_counts(spark, tmp_path):
    from millrace.streaming import follow, windowed_counts

    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:00:10', 'a'), (TIMESTAMP '2024-01-01 00:00:50', 'a'), (TIMESTAMP '2024-01-01 00:01:10', 'b') AS t(ts, k)")
    rows.write.parquet(str(tmp_path / "in"))
    counts = windowed_counts(follow(spark, str(tmp_path / "in"), rows.schema), "ts", ["k"], "1 minute", "1 minute")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    assert sorted((r.k, r.n) for r in spark.table("windows").collect()) == [("a", 2), ("b", 1)]


def test_generators(spark):
    assert formats.generate_points(spark, 20, [(0.0, 0.0), (9.0, 9.0)]).count() == 20
    docs, ranks, visits = formats.generate_weblog(spark, 5, 8, ["a", "b"])
    assert (docs.count(), ranks.count(), visits.count()) == (5, 5, 8)
