"""Sessions with the settings that the library expects."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: Settings of shuffles by level of compression.
COMPRESSION = {
    "none": {"spark.shuffle.compress": "false", "spark.shuffle.spill.compress": "false"},
    "light": {"spark.io.compression.codec": "lz4"},
    "medium": {"spark.io.compression.codec": "snappy"},
    "heavy": {"spark.io.compression.codec": "zstd", "spark.io.compression.zstd.level": "6"},
    "dynamic": {"spark.io.compression.codec": "zstd", "spark.io.compression.zstd.level": "1"},
}


def session(name: str = "millrace", master: str | None = None, compression: str | None = None, parallelism: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC; other settings as ``key_with_underscores="value"`` or by
    the cluster's defaults. Shuffle partitions are coalesced at run time; ``parallelism`` is their number before that.
    ``compression`` of what is shuffled is one of COMPRESSION."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if compression is not None:
        fixed |= COMPRESSION[compression]
    if parallelism is not None:
        fixed |= {"spark.sql.shuffle.partitions": str(parallelism)}
    for k, v in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def file_splits(spark: SparkSession, least: int | None = None, most_bytes: int | None = None) -> Iterator[None]:
    """Within it, file sources are planned with at least so many splits, or splits of at most so many bytes."""
    wanted = {"spark.sql.files.minPartitionNum": least, "spark.sql.files.maxPartitionBytes": most_bytes}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        if v is not None:
            spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
