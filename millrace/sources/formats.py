"""File sources: delimited text, typed records, fixed-length and block binary records, graph and point formats,
external processes and generators."""

from __future__ import annotations

import struct
import subprocess
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import parse_number, split_line


def text(spark: SparkSession, path: str, delimiter: str = "\n", charset: str = "UTF-8") -> DataFrame:
    """One ``line`` per record between delimiters. For other charsets than UTF-8 the delimiter is one character."""
    if charset.upper().replace("-", "") == "UTF8":
        return spark.read.text(path, lineSep=delimiter).withColumnRenamed("value", "line")
    options = {"encoding": charset, "lineSep": delimiter, "sep": "\x01", "quote": "", "escape": "", "header": "false"}
    return spark.read.schema("line string").options(**options).csv(path)


def records(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",", positions: Sequence[int] | None = None, record_delimiter: str = "\n", decimal: str = ".", quote: str | None = None, leading_delimiter: bool = False, exponent: bool = True) -> DataFrame:
    """Delimited records with typed fields.

    ``positions`` are the text positions of the schema's fields (default: the first ones), so that only those are
    parsed and in that order. Surplus fields are ignored; records with a missing or malformed field are skipped. A text
    field may stand between ``quote`` characters and then hold delimiters; ``leading_delimiter`` drops one delimiter at the start
    of a line; without ``exponent`` numbers like 1e3 are malformed."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    at = list(positions) if positions is not None else list(range(len(fields)))
    if len(at) != len(fields):
        raise ValueError("as many positions as fields are needed")
    line = F.col("value")
    if leading_delimiter:
        line = F.when(line.startswith(delimiter), F.substring(line, len(delimiter) + 1, 2**31 - 1)).otherwise(line)
    # with quotes: delimiters with an even number of quote characters behind them
    q = rf"\Q{quote}\E" if quote else ""
    split = F.split(line, rf"\Q{delimiter}\E(?=(?:[^{quote}]*{q}[^{quote}]*{q})*[^{quote}]*$)") if quote else split_line(line, delimiter)
    parts = spark.read.text(path, lineSep=record_delimiter).select(split.alias("f"))

    def field(f: T.StructField, i: int) -> Column:
        raw = F.get("f", F.lit(i))
        if isinstance(f.dataType, T.StringType):
            return F.regexp_replace(raw, f"^{quote}(.*){quote}$", "$1") if quote else raw
        return parse_number(raw, f.dataType.simpleString(), decimal, exponent)

    typed = parts.select(*[field(f, i).alias(f.name) for f, i in zip(fields, at)])
    return typed.dropna(how="any")


def fixed_length(spark: SparkSession, path: str, length: int, fields: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Binary records of ``length`` bytes. ``fields`` are (name, offset, width, kind): int (big-endian, signed), text
    (ASCII) or binary. Files are split between records, whatever their size. Bytes after the last complete record of a file
    are an error, found from the files' sizes alone."""
    odd = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") % length != 0).first()
    if odd is not None:
        raise ValueError(f"incomplete record in {odd['path']}: {odd['length']} bytes")
    # the one reader that splits at multiples of a length
    record = spark.sparkContext.binaryRecords(path, length).map(lambda r: (bytearray(r),)).toDF("r binary")

    def field(offset: int, width: int, kind: str) -> Column:
        raw = F.substring("r", offset + 1, width)
        if kind == "binary":
            return raw
        if kind == "text":
            return F.decode(raw, "US-ASCII")
        unsigned = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
        wrapped = F.when(unsigned >= 2 ** (8 * width - 1), unsigned - F.lit(2 ** (8 * width)).cast("decimal(20,0)")).otherwise(unsigned)
        return wrapped.cast("int" if width <= 4 else "bigint")

    return record.select(*[field(o, w, k).alias(n) for n, o, w, k in fields])


def binary_ints(spark: SparkSession, path: str) -> DataFrame:
    """Files of 4-byte big-endian integers: column ``value``."""
    return fixed_length(spark, path, 4, [("value", 0, 4, "int")])


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block-structured binary data with counts in block footers: Parquet."""
    return spark.read.parquet(path)


def external_process(spark: SparkSession, commands: Sequence[str], allowed_exit_codes: Sequence[int] = (0,), record_length: int | None = None) -> DataFrame:
    """Records that commands write to their standard output: lines, or ``record_length`` bytes each. One partition per
    command; another exit code than the allowed ones is an error. Commands run on the executors: for trusted use only."""
    allowed = set(allowed_exit_codes)
    listed = spark.createDataFrame([(c,) for c in commands], "command string").repartition(max(1, len(commands)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for command in batch["command"]:
                with subprocess.Popen(command, shell=True, stdout=subprocess.PIPE) as process:
                    if record_length is None:
                        found = (line.rstrip(b"\n") for line in process.stdout)
                    else:
                        found = iter(lambda out=process.stdout: out.read(record_length), b"")
                    while some := list(islice(found, 4096)):
                        if record_length is not None and len(some[-1]) < record_length:
                            raise ValueError(f"incomplete record from {command}")
                        yield pd.DataFrame({"command": command, "record": some})
                if process.returncode not in allowed:
                    raise RuntimeError(f"{command} ended with {process.returncode}")

    return listed.mapInPandas(run, "command string, record binary")


def int_tuples(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    """(key, row): the first field as an integer and the whole line."""
    return spark.read.text(path).select(parse_number(F.get(split_line(F.col("value"), delimiter), F.lit(0)), "int").alias("key"), F.col("value").alias("row")).where(F.col("key").isNotNull())


def triples(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    """RDF triples ``s p o`` between blanks; malformed lines are skipped."""
    f = F.split(F.trim("value"), " ")
    out = spark.read.text(path).where(F.size(f) >= 3).select(f[0].alias("s"), f[1].alias("p"), f[2].alias("o"))
    return out.where(F.col("p").contains(predicate)) if predicate else out


def edges(spark: SparkSession, path: str, delimiter: str = ",", swap: bool = False) -> DataFrame:
    """(src, dst) pairs of positive ids; self-loops and malformed lines are dropped."""
    f = split_line(F.col("value"), delimiter)
    a, b = parse_number(F.get(f, F.lit(0)), "bigint"), parse_number(F.get(f, F.lit(1)), "bigint")
    out = spark.read.text(path).select((b if swap else a).alias("src"), (a if swap else b).alias("dst"))
    return out.where((F.col("src") > 0) & (F.col("dst") > 0) & (F.col("src") != F.col("dst")))


def edges_with_degrees(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``v,d|v,d``: (src, src_degree, dst, dst_degree)."""
    part = lambda side, i: parse_number(F.get(F.split(F.get(F.split("value", r"\|"), F.lit(side)), ","), F.lit(i)), "bigint")
    return spark.read.text(path).select(part(0, 0).alias("src"), part(0, 1).alias("src_degree"), part(1, 0).alias("dst"), part(1, 1).alias("dst_degree")).dropna()


def adjacency(spark: SparkSession, path: str, delimiter: str = r"\|", inner: str = ",") -> DataFrame:
    """Lines ``v|n,n,...``: (vid, neighbours)."""
    f = F.split("value", delimiter)
    return spark.read.text(path).select(parse_number(f[0], "bigint").alias("vid"), F.transform(F.filter(F.split(F.get(f, F.lit(1)), inner), lambda x: x != ""), lambda x: x.cast("bigint")).alias("neighbours")).where(F.col("vid").isNotNull())


def page_links(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Link triples between resources: (src, dst) names without the brackets and the common prefix."""
    name = lambda c: F.regexp_extract(c, r"<\Q" + prefix + r"\E([^>]*)>", 1)
    return triples(spark, path).select(name("s").alias("src"), name("o").alias("dst")).where((F.col("src") != "") & (F.col("dst") != ""))


def points(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id|x|y|...|``: (id, coords)."""
    f = F.filter(F.split("value", r"\|"), lambda x: x != "")
    return spark.read.text(path).where(F.size(f) >= 2).select(f[0].cast("int").alias("id"), F.transform(F.slice(f, 2, F.size(f) - 1), lambda x: x.cast("double")).alias("coords"))


def paths(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``from|to|length|hop count|hop|...|``: (from, to, length, hops)."""
    f = F.split("value", r"\|")
    n = F.get(f, F.lit(3)).cast("int")
    return spark.read.text(path).where(F.size(f) >= 4).select(f[0].alias("from"), f[1].alias("to"), f[2].cast("int").alias("length"), F.slice(f, 5, n).alias("hops"))


def sort_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a 10-character key and a value."""
    return spark.read.text(path).select(F.substring("value", 1, 10).alias("key"), F.substring("value", 11, 2**31 - 1).alias("value"))


def generate_points(spark: SparkSession, n: int, centres: Sequence[Sequence[float]], spread: float = 1.0, seed: int = 1) -> DataFrame:
    """Points around centres, each chosen alike often: (id, centre, coords)."""
    c = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in centres])
    coords = F.array(*[F.get(F.get(c, F.col("centre")), F.lit(d)) + F.randn(seed + d) * spread for d in range(len(centres[0]))])
    return spark.range(n).withColumn("centre", (F.col("id") % len(centres)).cast("int")).withColumn("coords", coords)


def generate_weblog(spark: SparkSession, documents: int, visits: int, words: Sequence[str], seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, rankings, visits) of a synthetic web log."""
    vocabulary = F.array(*map(F.lit, words))
    word = F.get(vocabulary, F.floor(F.rand(seed) * len(words)).cast("int"))
    base = spark.range(documents).withColumn("url", F.concat(F.lit("url_"), "id"))
    docs = base.select("url", F.concat_ws(" ", *[F.get(vocabulary, F.floor(F.rand(seed + k) * len(words)).cast("int")) for k in range(20)]).alias("contents"))
    ranks = base.select(F.floor(F.rand(seed + 101) * 100).cast("int").alias("page_rank"), "url", F.floor(F.rand(seed + 102) * 90 + 1).cast("int").alias("avg_duration"))
    log = spark.range(visits).select(F.concat_ws(".", *[F.floor(F.rand(seed + 200 + k) * 256).cast("int") for k in range(4)]).alias("ip"), F.concat(F.lit("url_"), F.floor(F.rand(seed + 300) * documents).cast("bigint")).alias("url"), F.date_add(F.lit("2009-01-01"), F.floor(F.rand(seed + 301) * 730).cast("int")).alias("visit_date"), word.alias("search_word"))
    return docs, ranks, log


def pack_int(value: int) -> bytes:
    """A 4-byte big-endian integer, as ``binary_ints`` reads it."""
    return struct.pack(">i", value)
