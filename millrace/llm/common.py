"""Helpers shared by the training-data operators.

Text operators look at a document as UTF-8 bytes in Arrow buffers: words are runs of bytes outside
``[ \\t\\n\\v\\f\\r]`` and every word gets a 64-bit hash computed for a whole batch at once with numpy.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import shutil
import tempfile
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MASK64 = (1 << 64) - 1
#: Bytes that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII lower-casing by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same word class for Spark's and Python's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads polynomial sums over the whole range."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
#: Words of up to so many bytes are hashed with numpy, eight bytes at a time.
SHORT = 64
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names in ``spark.checkpoint.dir``; make one only where none is set and all runs in one
    process (tests). On a cluster a folder of the driver's machine would be no shared one: an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """The table (of a few numbers a row) marked for broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Between the steps of a long job: let Spark's cleaner delete shuffle files and broadcasts that nothing refers to, and let
    the executors' heaps shrink to what is in use. A heap that has grown stays so otherwise, and later steps' Python
    workers need their memory beside it."""
    give_back()
    spark.sparkContext._jvm.System.gc()
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def give_back() -> None:
    """Return memory that Python and Arrow hold free to the system: workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a partition's batches that gives free memory back when it ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python get at most ``rows`` rows at a time (a session setting): a batch of whole texts lies in the JVM's, Arrow's and
    Python's memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """Rows kept away from every learner: crc32 of the id's decimal text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def text_chunks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20, max_rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``max_bytes`` bytes each (a longer text stands alone)."""
    yield from chunks(batch.column(column), max_bytes, max_rows)


def chunks(col: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 1024) -> Iterator[tuple[int, int]]:
    """The same for a column."""
    offs = text_offsets(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(n, i + max_rows, max(j, i + 1))
        yield i, j
        i = j


def text_offsets(col: pa.Array) -> np.ndarray:
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(col) == 0:
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets into them); a null text has no bytes."""
    offs = text_offsets(col)
    buf = col.buffers()[2] if len(col) else None
    if buf is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(offs), dtype=np.int64)
    data = np.frombuffer(buf, dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words of concatenated texts."""
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    first = offs[:-1][offs[1:] > offs[:-1]]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    start[first] |= inside[first]
    end[last] |= inside[last]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, s, side="right") - 1
    return s, e, doc


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span. Up to ``SHORT`` bytes: eight at a time, each eight mixed in by a bijection, so that words of
    up to eight bytes can't collide at one length and longer ones have no algebraic structure; longer spans: BLAKE2b."""
    n = e - s
    h = mix(n.astype(U64) + U64(0x51ED))
    if len(data) == 0 or len(s) == 0:
        return h
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data), dtype="<u8", buffer=padded, strides=(1,))
    live, at = np.flatnonzero((n > 0) & (n <= SHORT)), 0
    while len(live):
        part = eight[s[live] + at] & _FIRST[np.minimum(n[live] - at, 8)]
        h[live] = mix(h[live] * U64(_BASE) ^ part)
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > SHORT):
        h[i] = U64(int.from_bytes(hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little"))
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a word sequence (those that cross documents included; callers mask them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h * U64(_BASE) + words[j : n + j])
    return h


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def column_function(run: Callable[[Iterator], Iterator], kind):
    """A column function from an iterator over Arrow columns (tuples of them for several arguments) to one over Arrow arrays."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the kind is stated, not hinted
        return F.arrow_udf(tidy(run), kind, F.ArrowUDFType.SCALAR_ITER)
