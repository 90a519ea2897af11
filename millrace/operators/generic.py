"""The generic operators.

Each takes either Column expressions, which Catalyst compiles, or an opaque Python function, which runs on Arrow
batches. ``reads`` names the columns an opaque function uses, so that the others are pruned before the scan. A function
may be an object with ``open()`` and ``close()``, which run once for each part of the input that a task works on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.hints import Hints, small_enough
from millrace.operators.keys import names, require_columns, require_keys

#: Local join strategies and the hints that ask for them. A hash table in memory only is a broadcast one.
STRATEGIES = {"broadcast": "broadcast", "memory_hash": "broadcast", "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}
PandasMap = Callable[[pd.DataFrame], pd.DataFrame]


def _run(fn: PandasMap, batches: Iterator[pd.DataFrame], rows_out: tuple[int, int | None] | None = None) -> Iterator[pd.DataFrame]:
    """The function over batches, between its ``open`` and ``close`` where it has them."""
    getattr(fn, "open", lambda: None)()
    try:
        for batch in batches:
            out = fn(batch)
            if rows_out is not None:
                low, high = rows_out
                if len(out) < low * len(batch) or high is not None and len(out) > high * len(batch):
                    raise ValueError(f"{len(out)} rows from {len(batch)}, declared {low} to {high} for each")
            yield out
    finally:
        getattr(fn, "close", lambda: None)()


def _project(df: DataFrame, reads: Sequence[str] | None) -> DataFrame:
    if reads is None:
        return df
    require_columns(df, reads, "reads")
    return df.select(*reads)


def map_(df: DataFrame, *columns: Column, where: Column | None = None, explode: Column | None = None, fn: PandasMap | None = None, schema: str | None = None, reads: Sequence[str] | None = None, rows_out: tuple[int, int | None] | None = None) -> DataFrame:
    """A function of every record that emits 0 to n records.

    Native: rows that pass ``where``, once for each element of the array ``explode`` (column ``item``), projected to
    ``columns``. Opaque: ``fn`` from a batch of rows to any number of rows of ``schema``; ``rows_out`` declares the
    least and most (None: any) rows it makes of one, and what breaks that is an error."""
    if fn is not None:
        if schema is None:
            raise ValueError("an opaque function needs its output schema")
        return _project(df, reads).mapInPandas(lambda batches: _run(fn, batches, rows_out), schema)
    if where is not None:
        df = df.where(where)
    if explode is not None:
        df = df.withColumn("item", F.explode(explode))
    return df.select(*columns) if columns else df


def reduce_(df: DataFrame, keys: str | Sequence[str], *aggregates: Column, fn: PandasMap | None = None, schema: str | None = None, reads: Sequence[str] | None = None, strict_keys: bool = False, order: str | Sequence[str] | None = None) -> DataFrame:
    """A function of every group of records with equal keys.

    Native: aggregates, computed in part before the shuffle. Opaque: ``fn`` from a group to rows of ``schema``, the
    group sorted by the columns ``order`` if there are any (nulls last); a group must then fit in a task, so prefer
    ``combine_reduce`` where partial results exist, or ``sorted_reduce``, which holds one row at a time."""
    keys = names(keys)
    require_columns(df, keys, "reduce")
    if strict_keys:
        df = require_keys(df, keys)
    if fn is None:
        return df.groupBy(*keys).agg(*aggregates) if aggregates else df.groupBy(*keys).count()
    if schema is None:
        raise ValueError("an opaque function needs its output schema")
    by = names(order) if order is not None else []
    require_columns(df, by, "order")
    whole = (lambda g: fn(g.sort_values(by, kind="stable", ignore_index=True))) if by else fn
    return _project(df, reads).groupBy(*keys).applyInPandas(whole, schema)


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by keys, in frames of whole groups: a batch's last group waits for the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        same = np.logical_and.reduce([((batch[k] == last[k]) | (batch[k].isna() & pd.isna(last[k]))).to_numpy(dtype=bool) for k in keys])
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held and not _same_key(held[0], batch, keys):
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _same_key(a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> bool:
    return all(x == y or pd.isna(x) and pd.isna(y) for x, y in zip(a[keys].iloc[-1], b[keys].iloc[0]))


def groups_reduce(df: DataFrame, keys: str | Sequence[str], fn: PandasMap, schema: str, reads: Sequence[str] | None = None) -> DataFrame:
    """Opaque reduce for many small groups: ``fn`` gets frames of any number of whole groups, sorted by the keys, so that its cost
    is that of rows, not that of a call and a frame for each group."""
    keys = names(keys)
    rows = _project(df, reads)
    require_columns(rows, keys, "groups_reduce")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda batches: (fn(g) for g in _whole_groups(batches, keys)), schema)


def groups_cogroup(left: DataFrame, right: DataFrame, keys: str | Sequence[str], fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, left_reads: Sequence[str] | None = None, right_reads: Sequence[str] | None = None) -> DataFrame:
    """The same for co-groups: ``fn`` gets the rows of any number of keys in full, those of the left and those of the right side.
    Columns that both sides have must be of one type."""
    keys = names(keys)
    sides = [_project(left, left_reads), _project(right, right_reads)]
    columns = [df.columns for df in sides]
    both = sides[0].withColumn("__side", F.lit(0)).unionByName(sides[1].withColumn("__side", F.lit(1)), allowMissingColumns=True)

    def each(g: pd.DataFrame) -> pd.DataFrame:
        return fn(*(g.loc[g["__side"] == n, columns[n]].reset_index(drop=True) for n in (0, 1)))

    return groups_reduce(both, keys, each, schema)


def sorted_reduce(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str], fn: Callable[[tuple, Iterator], Iterator[tuple]], schema: str, reads: Sequence[str] | None = None) -> DataFrame:
    """Secondary sort: ``fn(key, rows)`` sees a group's rows (named tuples) one after another, in ascending ``order`` (nulls first),
    and yields tuples of ``schema``. Spark sorts the rows, spilling to disk, and a group is never held as a whole."""
    keys, order = names(keys), names(order)
    require_columns(df, [*keys, *order], "sorted_reduce")
    rows = _project(df, reads)
    columns = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (row for batch in batches for row in batch.itertuples(index=False, name="Row"))
        out = []
        null = lambda key: tuple(None if pd.isna(k) else k for k in key)
        for key, group in groupby(each, lambda row: null(getattr(row, k) for k in keys)):
            for made in fn(key, group):
                out.append(made)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def combine_reduce(df: DataFrame, keys: str | Sequence[str], combine: PandasMap, schema: str, final: PandasMap | None = None, final_schema: str | None = None, reads: Sequence[str] | None = None) -> DataFrame:
    """Reduce with a combiner: ``combine`` turns a group, or any part of one, into rows of ``schema`` (key columns
    included) and may run any number of times, on its own output too; ``final`` runs once for each group."""
    keys = names(keys)
    df = _project(df, reads)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [combine(g) for _, g in batch.groupby(keys, dropna=False, sort=False)]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    combined = df.mapInPandas(partial, schema)
    return combined.groupBy(*keys).applyInPandas(final or combine, final_schema or schema)


def match(left: DataFrame, right: DataFrame, left_keys: str | Sequence[str], right_keys: str | Sequence[str], *columns: Column, where: Column | None = None, strategy: str | None = None, build: str = "right", strict_keys: bool = False, fn: PandasMap | None = None, schema: str | None = None, hints: Hints | None = None) -> DataFrame:
    """Inner equi-join: every pair of records with equal keys that passes ``where``, projected to ``columns``, then given
    to the opaque function ``fn``, if there is one, a batch of pairs at a time (``columns`` are then what it reads).

    ``strategy`` asks for a local strategy (see STRATEGIES) with ``build`` as the hashed or broadcast side; without one
    the choice is Catalyst's and adaptive execution's, or a broadcast of the ``build`` side if its ``hints`` make it
    small."""
    left_keys, right_keys = names(left_keys), names(right_keys)
    if len(left_keys) != len(right_keys):
        raise ValueError("both sides need as many keys")
    if strict_keys:
        left, right = require_keys(left, left_keys), require_keys(right, right_keys)
    if strategy is None and hints is not None and hints.fits_broadcast(left.sparkSession):
        strategy = "broadcast"
    if strategy is not None:
        hint = STRATEGIES[strategy]
        left, right = (left.hint(hint), right) if build == "left" else (left, right.hint(hint))
    on = reduce(Column.__and__, (left[a] == right[b] for a, b in zip(left_keys, right_keys)))
    return _paired(left.join(right, on if where is None else on & where, "inner"), columns, fn, schema)


def _paired(pairs: DataFrame, columns: Sequence[Column], fn: PandasMap | None, schema: str | None) -> DataFrame:
    out = pairs.select(*columns) if columns else pairs
    return out if fn is None else map_(out, fn=fn, schema=schema)


def cross(left: DataFrame, right: DataFrame, *columns: Column, where: Column | None = None, small: str | None = None, rows: int = 100_000, fn: PandasMap | None = None, schema: str | None = None) -> DataFrame:
    """Cartesian product, filtered by ``where``, projected to ``columns`` and given to ``fn``, if there is one, as in ``match``.
    ``small`` names a side that is broadcast if it has at most so many ``rows``, which are counted; else Catalyst chooses."""
    if small == "right" and small_enough(right, rows):
        right = F.broadcast(right)
    elif small == "left" and small_enough(left, rows):
        left = F.broadcast(left)
    out = left.crossJoin(right)
    return _paired(out if where is None else out.where(where), columns, fn, schema)


def cogroup(left: DataFrame, right: DataFrame, keys: str | Sequence[str], left_aggregates: Sequence[Column] = (), right_aggregates: Sequence[Column] = (), fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame] | None = None, schema: str | None = None, left_reads: Sequence[str] | None = None, right_reads: Sequence[str] | None = None) -> DataFrame:
    """For every key in either input a function of both groups, of which one may be empty.

    Native: each side's aggregates by key, joined on all keys of either (null keys meet). Opaque: ``fn`` from two groups
    to rows of ``schema``; both groups must fit in a task."""
    keys = names(keys)
    if fn is not None:
        if schema is None:
            raise ValueError("an opaque function needs its output schema")
        return _project(left, left_reads).groupBy(*keys).cogroup(_project(right, right_reads).groupBy(*keys)).applyInPandas(fn, schema)
    a, b = left.groupBy(*keys).agg(*left_aggregates).alias("__l"), right.groupBy(*keys).agg(*right_aggregates).alias("__r")
    on = reduce(Column.__and__, (F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in keys))
    out = a.join(b, on, "full_outer")
    key_cols = [F.coalesce(F.col(f"__l.{k}"), F.col(f"__r.{k}")).alias(k) for k in keys]
    rest = [F.col(f"__l.{c}") for c in a.columns if c not in keys] + [F.col(f"__r.{c}") for c in b.columns if c not in keys]
    return out.select(*key_cols, *rest)


def union(*inputs: DataFrame) -> DataFrame:
    """Bag union by column name; duplicates stay."""
    if not inputs:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b), inputs)


def self_match(df: DataFrame, key: str, order: str, mode: str = "triangle_excl_diag", suffixes: tuple[str, str] = ("_l", "_r"), block: int = 2048) -> DataFrame:
    """Join of an input with itself on ``key``: ``full_cross`` all pairs, ``triangle_incl_diag`` pairs with
    l.order <= r.order, ``triangle_excl_diag`` with l.order < r.order.

    Pairs grow with the square of a key's rows. A key of over ``block`` rows is cut into blocks of about so many by a hash of the
    rows, and each pair of blocks is joined by itself, so a key's pairs are spread over tasks; a row travels once for each block
    of its key. Sizes of keys are counted first."""
    sized = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col(key).isNotNull()).select(key, F.ceil(F.col("__n") / block).cast("int").alias("__of"))
    large = sized.where("__of > 1")
    pairs = sized.agg(F.sum(F.pow("__of", 2))).first()[0] or 0
    a, b = (df.select([F.col(c).alias(c + s) for c in df.columns]) for s in suffixes)
    (x, y), (kx, ky) = ((order + s for s in suffixes), (key + s for s in suffixes))
    on = F.col(kx) == F.col(ky)
    more = {"full_cross": None, "triangle_incl_diag": F.col(x) <= F.col(y), "triangle_excl_diag": F.col(x) < F.col(y)}[mode]
    if large.isEmpty():
        return a.join(b, on if more is None else on & more)
    # a number of partitions that is set is not coalesced by the bytes of the input: the pairs are what a task has to make
    parts = int(min(max(pairs, df.sparkSession.sparkContext.defaultParallelism), 10_000))

    def cut(side: DataFrame, k: str, suffix: str, own: str, other: str) -> DataFrame:
        of, plain = F.coalesce("__of", F.lit(1)), [c for c, t in side.dtypes if "map<" not in t]
        block_of = F.pmod(F.xxhash64(*plain), of).cast("int").alias(own + suffix)
        rows = side.join(large, F.col(k) == F.col("__key"), "left").select(*side.columns, block_of, F.explode(F.sequence(F.lit(0), of - 1)).alias(other + suffix))
        return rows.repartition(parts, k, "__i" + suffix, "__j" + suffix)

    large = large.withColumnRenamed(key, "__key")
    left, right = cut(a, kx, "_a", "__i", "__j"), cut(b, ky, "_b", "__j", "__i")
    on = on & (F.col("__i_a") == F.col("__i_b")) & (F.col("__j_a") == F.col("__j_b"))
    return left.join(right, on if more is None else on & more).select(*a.columns, *b.columns)


def temp(df: DataFrame) -> DataFrame:
    """Materialise; storage spills to disk, and a lost part is computed anew from its lineage."""
    return df.persist()
