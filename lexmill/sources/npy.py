"""Token sequences as one numpy file, read and written in byte ranges by many tasks.

Blocks of equal length have known places in the file, so every task writes its own ids where they belong
in a file beside the target; once all are done and the total is known, the header is written and the file
takes the target's name.  A task that is repeated writes the same bytes again.  That takes a file system
in which tasks can write to places of one file (a shared POSIX one), for reading as well; other stores
keep the Parquet blocks of ``token_store``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

# The code that runs in tasks travels with the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "block long, n int, ids array<int>"
BLOCK_TOKENS = 8192
# Bytes of a file that one task reads.
SPLIT_BYTES = 32 << 20
# The header takes a fixed number of bytes, a multiple of 64, so data may be written before it.
HEADER_BYTES = 128


def local_path(path: str) -> str:
    """The path on a mounted file system; other stores are refused."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"numpy files need a mounted file system, not {parts.scheme}:")
    return unquote(parts.path) if parts.scheme else path


def header(kind: str, count: int) -> bytes:
    """Format version 1.0: magic, version, length of the text, the text padded to the fixed size."""
    text = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': ({count},), }}"
    room = HEADER_BYTES - 10
    return b"\x93NUMPY\x01\x00" + room.to_bytes(2, "little") + text.ljust(room - 1).encode() + b"\n"


def parsed_header(path: str) -> tuple[np.dtype, int, int]:
    """Type and number of the entries, and where they begin."""
    with open(path, "rb") as file:
        version = np.lib.format.read_magic(file)
        read = {1: np.lib.format.read_array_header_1_0, 2: np.lib.format.read_array_header_2_0}.get(version[0])
        if read is None:
            raise ValueError(f"numpy format {version} is not read")
        shape, _, kind = read(file)
        if len(shape) != 1 or kind.kind not in "iu":
            raise ValueError("a token file holds one row of integers")
        if os.path.getsize(path) < file.tell() + shape[0] * kind.itemsize:
            raise ValueError("the token file is shorter than its header says")
        return kind, shape[0], file.tell()


@dataclass
class _Range(InputPartition):
    first: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, block_tokens: int, split_bytes: int) -> None:
        self.path, self.block_tokens, self.split_bytes = path, block_tokens, split_bytes
        kind, self.count, self.begin = parsed_header(path)
        self.kind = kind.str

    def partitions(self) -> list[InputPartition]:
        blocks = -(-self.count // self.block_tokens)
        step = max(1, self.split_bytes // (self.block_tokens * np.dtype(self.kind).itemsize))
        return [_Range(i, min(blocks, i + step)) for i in range(0, blocks, step)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(self.kind)
        # A few hundred thousand tokens make a batch, whatever the length of a block.
        step = max(1, (1 << 19) // self.block_tokens)
        with open(self.path, "rb") as file:
            for first in range(partition.first, partition.stop, step):
                stop = min(first + step, partition.stop)
                start, end = first * self.block_tokens, min(stop * self.block_tokens, self.count)
                file.seek(self.begin + start * kind.itemsize)
                data = file.read((end - start) * kind.itemsize)
                ids = np.frombuffer(data, kind)
                if len(ids) and int(ids.max()) >= 1 << 31:
                    raise ValueError("a token id does not fit four bytes")
                cuts = np.minimum(np.arange(first, stop + 1) * self.block_tokens, end) - start
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                columns = [
                    pa.array(np.arange(first, stop)),
                    pa.array(np.diff(cuts), pa.int32()),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "n", "ids"])


@dataclass
class _Written(WriterCommitMessage):
    tokens: int
    end: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, block_tokens: int, kind: str, overwrite: bool) -> None:
        if os.path.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        self.path, self.block_tokens, self.kind = path, block_tokens, kind
        self.waiting = f"{path}.writing"
        # What an earlier attempt left would otherwise lie behind a shorter sequence.
        with open(self.waiting, "wb"):
            pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        kind = np.dtype(self.kind)
        most = min(int(np.iinfo(kind).max), (1 << 31) - 1)
        tokens = end = 0
        with open(self.waiting, "r+b") as file:
            for batch in iterator:
                for block, ids in zip(batch["block"].to_pylist(), batch["ids"]):
                    values = ids.values
                    if values.null_count:
                        raise ValueError("token ids missing from the vocabulary")
                    values = values.to_numpy(zero_copy_only=False)
                    if len(values) and not 0 <= values.min() <= values.max() <= most:
                        raise ValueError(f"token ids out of the range of {kind.name}")
                    if len(values) > self.block_tokens:
                        raise ValueError(f"block {block} is longer than {self.block_tokens}")
                    start = block * self.block_tokens
                    file.seek(HEADER_BYTES + start * kind.itemsize)
                    file.write(values.astype(kind).tobytes())
                    tokens += len(values)
                    end = max(end, start + len(values))
            file.flush()
            os.fsync(file.fileno())
        return _Written(tokens, end)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        tokens, end = sum(m.tokens for m in done), max((m.end for m in done), default=0)
        if tokens != end:
            raise ValueError(f"{tokens} tokens do not fill a sequence of {end}: blocks are missing or short")
        with open(self.waiting, "r+b") as file:
            file.write(header(self.kind, tokens))
        os.replace(self.waiting, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.waiting):
            os.remove(self.waiting)


class NpyDataSource(DataSource):
    """``format("npy")`` with options ``path``, ``block_tokens``, ``split_bytes`` and, for writing, ``dtype``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def _place(self) -> tuple[str, int]:
        return local_path(self.options["path"]), int(self.options.get("block_tokens", BLOCK_TOKENS))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._place(), int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(*self._place(), np.dtype(self.options.get("dtype", "<u2")).newbyteorder("<").str, overwrite)


def read_npy(
    spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``(block, n, ids)`` of a one-dimensional numpy file of integers."""
    spark.dataSource.register(NpyDataSource)
    reader = spark.read.format("npy").option("block_tokens", block_tokens).option("split_bytes", split_bytes)
    return reader.load(path)


def write_npy(blocks: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS, uint16: bool = True) -> None:
    """Write ``(block, ids)``, all blocks but the last ``block_tokens`` long, as one numpy file.

    Ids that are missing, or beyond 65535 in the two-byte profile, are refused, and so are blocks
    that do not make a gapless sequence.
    """
    blocks.sparkSession.dataSource.register(NpyDataSource)
    rows = blocks.select(
        F.col("block").cast("long").alias("block"), F.size("ids").alias("n"), F.col("ids").cast("array<int>").alias("ids")
    )
    kind = "<u2" if uint16 else "<u4"
    rows.write.format("npy").mode("overwrite").option("block_tokens", block_tokens).option("dtype", kind).save(path)
