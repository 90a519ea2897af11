"""Block-structured binary files whose blocks end in footers, so that files are split at blocks and counted without being read.

A file is a sequence of blocks of ``block_size`` bytes, the last of which may be shorter. A record is its length (4 bytes,
big-endian) and its bytes; records follow each other and may go on in the next block. A block ends in a footer of three 8-byte
integers: records that start in it, records that start in the file up to its end, and the place of the first one that
starts in it (-1: none). Files are reached through Arrow's file systems, so paths are local ones or URIs that Arrow knows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FOOTER = struct.Struct(">qqq")
LENGTH = struct.Struct(">i")
BLOCK_SIZE = 1 << 20
#: Blocks of a split.
SPLIT_BLOCKS = 64


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class BlockWriter:
    """Writes records into the blocks of one file."""

    def __init__(self, out, block_size: int):
        self.out, self.room = out, block_size - FOOTER.size
        self.block, self.started, self.total, self.first = bytearray(), 0, 0, -1

    def add(self, record: bytes) -> None:
        if len(self.block) == self.room:
            self._end()
        self.started, self.total = self.started + 1, self.total + 1
        if self.first < 0:
            self.first = len(self.block)
        data = memoryview(LENGTH.pack(len(record)) + record)
        while data:
            if len(self.block) == self.room:
                self._end()
            n = min(len(data), self.room - len(self.block))
            self.block += data[:n]
            data = data[n:]

    def _end(self) -> None:
        self.out.write(bytes(self.block) + FOOTER.pack(self.started, self.total, self.first))
        self.block, self.started, self.first = bytearray(), 0, -1

    def close(self) -> None:
        if self.block:
            self._end()


def _footer(file, at: int) -> tuple[int, int, int]:
    file.seek(at - FOOTER.size)
    return FOOTER.unpack(file.read(FOOTER.size))


def read_blocks(file, size: int, block_size: int, first: int, last: int) -> Iterator[bytes]:
    """The records that start in blocks ``first`` to before ``last`` of a file of ``size`` bytes: the footers say how many and
    where the first one starts, and from there they follow each other."""
    end = lambda block: min(size, (block + 1) * block_size)
    left = _footer(file, end(last - 1))[1] - (_footer(file, end(first - 1))[1] if first else 0)
    if not left:
        return
    block = first
    while (at := _footer(file, end(block))[2]) < 0:
        block += 1
    held = b""

    def load() -> bytes:
        nonlocal block
        file.seek(block * block_size)
        data = file.read(end(block) - block * block_size)
        block += 1
        return data[: -FOOTER.size]

    def take(n: int) -> bytes:
        nonlocal held, at
        parts = []
        while n:
            if at == len(held):
                held, at = load(), 0
            parts.append(held[at : at + n])
            at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    held = load()
    for _ in range(left):
        yield take(LENGTH.unpack(take(LENGTH.size))[0])


class _Split(InputPartition):
    def __init__(self, path: str, size: int, first: int, last: int):
        self.path, self.size, self.first, self.last = path, size, first, last


def _files(path: str) -> list[tuple[str, int]]:
    store, place = _store(path)
    found = store.get_file_info(pafs.FileSelector(place, allow_not_found=False))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.startswith("part-") and f.size)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequential_blocks"

    def schema(self) -> str:
        return "record binary"

    def reader(self, schema):
        return BlockReader(self.options)

    def writer(self, schema, overwrite):
        return BlockSink(self.options, overwrite)


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block_size = options["path"], int(options.get("block_size", BLOCK_SIZE))

    def partitions(self):
        out = []
        for path, size in _files(self.path):
            n = -(-size // self.block_size)
            out += [_Split(path, size, k, min(k + SPLIT_BLOCKS, n)) for k in range(0, n, SPLIT_BLOCKS)]
        return out or [None]

    def read(self, partition):
        if partition is None:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file:
            for record in read_blocks(file, partition.size, self.block_size, partition.first, partition.last):
                yield (record,)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class BlockSink(DataSourceWriter):
    """Tasks write files of hidden names, which the end of the job makes visible."""

    def __init__(self, options, overwrite: bool):
        self.path, self.block_size, self.overwrite = options["path"], int(options.get("block_size", BLOCK_SIZE)), overwrite

    def write(self, iterator):
        store, place = _store(self.path)
        store.create_dir(place)
        path = f"{place}/_part-{uuid.uuid4().hex}"
        with store.open_output_stream(path) as out:
            writer = BlockWriter(out, self.block_size)
            for row in iterator:
                writer.add(bytes(row[0]))
            writer.close()
        return _Written(path)

    def commit(self, messages):
        store, place = _store(self.path)
        if self.overwrite:
            for path, _ in _files(self.path):
                store.delete_file(path)
        for m in messages:
            if m is not None:
                head, _, name = m.path.rpartition("/")
                store.move(m.path, f"{head}/{name[1:]}")

    def abort(self, messages):
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


def write(df: DataFrame, path: str, record: Column, block_size: int = BLOCK_SIZE, overwrite: bool = True) -> None:
    """One file of blocks for each partition; ``record`` is a binary column, without nulls."""
    df.sparkSession.dataSource.register(BlockSource)
    rows = df.select(record.cast("binary").alias("record"))
    rows.write.format("sequential_blocks").option("block_size", block_size).mode("overwrite" if overwrite else "append").save(path)


def read(spark: SparkSession, path: str, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Column ``record`` of all files of a folder, split at blocks."""
    spark.dataSource.register(BlockSource)
    return spark.read.format("sequential_blocks").option("block_size", block_size).load(path)


def count(path: str, block_size: int = BLOCK_SIZE) -> int:
    """The records of a folder's files, from their last footers alone."""
    store, total = _store(path)[0], 0
    for name, size in _files(path):
        with store.open_input_file(name) as file:
            total += _footer(file, size)[1]
    return total
