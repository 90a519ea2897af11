"""Sinks: delimited and binary files, sorted output, discarded output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, line: Column, delimiter: str = "\n", single_file: bool = False) -> None:
    """One text record per row, overwriting. ``single_file`` writes one part: for small results."""
    out = df.select(line.cast("string").alias("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("lineSep", delimiter).text(path)


def records(df: DataFrame, path: str, columns: Sequence[str] | None = None, delimiter: str = "|", record_delimiter: str = "\n", lenient: bool = False, trailing: bool = False) -> None:
    """Fields between delimiters. A null field is an error, or empty if ``lenient``; ``trailing`` ends a record with one more delimiter."""
    names = list(columns or df.columns)

    def field(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(text, F.lit("")) if lenient else F.when(text.isNull(), F.raise_error(F.lit(f"null field {c}")).cast("string")).otherwise(text)

    line = F.concat_ws(delimiter, *map(field, names))
    lines(df, path, F.concat(line, F.lit(delimiter)) if trailing else line, record_delimiter)


def word_counts(df: DataFrame, path: str, word: str = "word", count: str = "n") -> None:
    """Lines ``word count``."""
    lines(df, path, F.concat_ws(" ", word, F.col(count).cast("string")))


def ranked_pages(df: DataFrame, path: str, rank: str = "rank", url: str = "url", duration: str = "duration") -> None:
    """Lines ``rank|url|duration|``."""
    records(df, path, [rank, url, duration], trailing=True)


def triangles(df: DataFrame, path: str, corners: Sequence[str] = ("a", "b", "c")) -> None:
    """Lines ``a,b,c``."""
    records(df, path, corners, delimiter=",")


def edges_with_degrees(df: DataFrame, path: str) -> None:
    """Lines ``src,degree|dst,degree`` of (src, src_degree, dst, dst_degree)."""
    side = lambda v, d: F.concat_ws(",", F.col(v).cast("string"), F.col(d).cast("string"))
    lines(df, path, F.concat_ws("|", side("src", "src_degree"), side("dst", "dst_degree")))


def paths(df: DataFrame, path: str) -> None:
    """Lines ``from|to|length|hop count|hop|...|`` of (from, to, length, hops)."""
    head = [F.col(c).cast("string") for c in ("from", "to", "length")]
    lines(df, path, F.concat(F.concat_ws("|", *head, F.size("hops").cast("string"), F.col("hops").cast("array<string>")), F.lit("|")))


def points(df: DataFrame, path: str) -> None:
    """Lines ``id|x|y|...|`` of (id, coords), two digits after the point."""
    coords = F.transform("coords", lambda x: F.format_string("%.2f", x))
    lines(df, path, F.concat(F.concat_ws("|", F.col("id").cast("string"), coords), F.lit("|")))


def blocks(df: DataFrame, path: str) -> None:
    """Block-structured binary output."""
    df.write.mode("overwrite").parquet(path)


def local_sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """Every output partition sorted, by any mix of ascending and descending columns."""
    return df.sortWithinPartitions(*order)


def global_sorted(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """A total order over the output partitions: range partitioning by sampled bounds, then a local sort."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys) if partitions else df.orderBy(*keys)


def bounded_sorted(df: DataFrame, key: str, bounds: Sequence) -> DataFrame:
    """A total order with given partition bounds (a data distribution): a row goes to the partition whose number is the number
    of bounds that its key exceeds, and each partition is sorted."""
    part = sum(((F.col(key) > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    return df.repartitionById(len(bounds) + 1, F.coalesce(part, F.lit(0))).sortWithinPartitions(key)


def noop(df: DataFrame) -> None:
    """Compute and discard."""
    df.write.format("noop").mode("overwrite").save()
