"""Handing many small rows back to the chunk of texts they belong to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Rows of a task that are put together at once.
TOGETHER = 400_000
# Bytes of texts a bucket of chunks is laid out for, and the bounds of their number: the upper one is
# what Spark allows, beyond it buckets grow.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000


def buckets_for(size: int) -> int:
    """Buckets for so many bytes of texts."""
    return min(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), MOST_BUCKETS)


@contextmanager
def bucketed(rows: DataFrame, folder: str, buckets: int) -> Iterator[DataFrame]:
    """``rows`` written to ``folder`` in buckets by chunk, without a shuffle.

    What joins the table by chunk moves to its buckets, the table stays.  The catalog knows the table
    inside the ``with`` block only; its files remain in the folder.
    """
    spark, name = rows.sparkSession, f"chunks_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "chunk").option("path", folder).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def packed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``(chunk, <name> binary, …)``: the rows of a chunk that a task meets together as one row.

    ``kinds`` gives the numpy type of each column packed; none may hold nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TOGETHER:
                yield together(held)
                held, size = [], 0
        if size:
            yield together(held)

    def together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        chunk = table["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        found, starts = np.unique(chunk[order], return_index=True)
        cuts = [*zip(starts, [*starts[1:], len(chunk)])]
        columns = [pa.array(found, pa.int64())]
        for name, kind in kinds.items():
            values = table[name].to_numpy()[order].astype(kind)
            columns.append(pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["chunk", *kinds])

    shape = ", ".join(["chunk long", *(f"{name} binary" for name in kinds)])
    return rows.select("chunk", *kinds).mapInArrow(run, shape)


def met(small: DataFrame, texts: DataFrame) -> DataFrame:
    """Both tables dealt by chunk, the packed rows of a chunk before its texts.

    ``texts`` has one row a chunk, with ``keys`` that are not null; ``small`` lacks its columns.
    """
    rows = small.unionByName(texts, allowMissingColumns=True)
    turn = F.shiftleft("chunk", 1) + F.when(F.col("keys").isNull(), 0).otherwise(1)
    return rows.repartition("chunk").sortWithinPartitions(turn)


def joined_parts(waiting: list[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The packed columns of a chunk's rows, put together."""
    return {
        name: np.concatenate(
            [np.frombuffer(x, kind) for batch in waiting for x in batch[name].to_pylist()]
            or [np.zeros(0, kind)]
        )
        for name, kind in kinds.items()
    }


def by_chunk(
    batches: Iterator[pa.RecordBatch], kinds: dict[str, str]
) -> Iterator[tuple[dict[str, np.ndarray], pa.RecordBatch]]:
    """For each chunk in turn its small rows, put together, and the row of its texts."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            at = np.flatnonzero(batch["keys"].is_valid().to_numpy(zero_copy_only=False))
            stop = int(at[0]) if len(at) else batch.num_rows
            waiting.append(batch.slice(0, stop).select([*kinds]))
            if not len(at):
                break
            yield joined_parts(waiting, kinds), batch.slice(stop, 1)
            waiting, batch = [], batch.slice(stop + 1)
