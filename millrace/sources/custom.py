"""User formats: an object that makes splits and reads each of them, as a source of its own; and formats outside of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class InputFormat:
    """What a user format defines. It is copied to the executors, one copy for each split."""

    def splits(self) -> list:
        """Descriptions of the parts that are read independently."""
        return [None]

    def open(self, split) -> None:
        """Called before the first record of a split."""

    def records(self) -> Iterator[tuple | None]:
        """The open split's records; None skips one."""
        raise NotImplementedError

    def close(self) -> None:
        """Called after the last record, and after an error."""


class _Split(InputPartition):
    def __init__(self, value):
        self.value = value


def read(spark: SparkSession, source: InputFormat, schema: str) -> DataFrame:
    """The records of a user format, one partition for each of its splits."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Split(s) for s in source.splits()]

        def read(self, partition):
            source.open(partition.value)
            try:
                for record in source.records():
                    if record is not None:
                        yield tuple(record)
            finally:
                source.close()

    name_ = f"{type(source).__name__}_{uuid.uuid4().hex}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name_).load()


def generate(spark: SparkSession, make: Callable[[int, int], Iterator[tuple]], splits: int, schema: str) -> DataFrame:
    """Records that ``make(split, splits)`` yields, one partition for each split."""

    class Generated(InputFormat):
        def splits(self):
            return list(range(splits))

        def open(self, split):
            self.split = split

        def records(self):
            return make(self.split, splits)

    return read(spark, Generated(), schema)


def local_rows(df: DataFrame) -> Iterator[tuple]:
    """A source's records on the driver, one partition at a time, for use outside of a query."""
    return map(tuple, df.toLocalIterator(prefetchPartitions=False))


def local_sink(spark: SparkSession, write: Callable[[DataFrame], None], schema: str, batch: int = 10_000) -> Callable[[Iterator[tuple]], None]:
    """A sink for records on the driver: a function that hands them to ``write`` in batches of rows."""

    def put(records: Iterator[tuple]) -> None:
        some = []
        for r in records:
            some.append(tuple(r))
            if len(some) == batch:
                write(spark.createDataFrame(some, schema))
                some = []
        if some:
            write(spark.createDataFrame(some, schema))

    return put


_KNOWN: dict[tuple, tuple] = {}


def statistics(spark: SparkSession, path: str, format: str = "parquet") -> dict:
    """{bytes, rows, row_bytes} of a source's files: bytes from the file system, rows from Parquet's footers, or by reading other
    formats. Kept until a file changes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("time"), F.count(F.lit(1)).alias("files")).first()
    state = files["bytes"], files["time"], files["files"]
    if _KNOWN.get((path, format), (None,))[0] != state:
        _KNOWN[path, format] = state, spark.read.format(format).load(path).count()
    rows, size = _KNOWN[path, format][1], files["bytes"] or 0
    return {"bytes": size, "rows": rows, "row_bytes": size / rows if rows else None}
