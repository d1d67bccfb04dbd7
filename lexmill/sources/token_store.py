"""Token sequences on storage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest id of the two-byte profile.
UINT16_MAX = 65535
# Blocks that share a directory, so that a reader of few blocks opens few files.
SHARD_BLOCKS = 32768


def ids_path(input_path: str, output: str | None = None) -> str:
    """The given path, or ``<name>_ids`` beside the input."""
    if output:
        return output
    return f"{os.path.splitext(input_path.rstrip('/'))[0]}_ids"


def checked_ids(df: DataFrame, uint16: bool, ids: str = "ids") -> DataFrame:
    """Refuse missing ids, and ids beyond two bytes when that profile is asked for."""
    low, high = F.array_min(ids), F.array_max(ids)
    complete = ~F.exists(ids, lambda i: i.isNull())
    good = complete & (F.coalesce(low, F.lit(0)) >= 0)
    if uint16:
        good = good & (F.coalesce(high, F.lit(0)) <= UINT16_MAX)
    refused = F.assert_true(good, "token ids missing from the vocabulary or out of range")
    return df.withColumn(ids, F.when(refused.isNull(), F.col(ids)))


def write_tokens(encoded: DataFrame, path: str, uint16: bool = True, ids: str = "ids") -> None:
    """Store encoded texts with their length ``n``."""
    checked = checked_ids(encoded, uint16, ids)
    checked.withColumn("n", F.size(ids)).write.mode("overwrite").parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Store ``(block, n, ids)`` in directories of consecutive blocks."""
    sharded = blocks.withColumn("shard", F.expr(f"block div {SHARD_BLOCKS}"))
    sharded.sortWithinPartitions("shard", "block").write.partitionBy("shard").mode(
        "overwrite"
    ).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    schema = "block long, n int, ids array<int>, shard long"
    return spark.read.schema(schema).parquet(path)
