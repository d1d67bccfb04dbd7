"""A stream of text files appended to one token sequence without gaps.

A micro-batch, an epoch, leaves three things in the output folder:

``blocks/epoch=<n>``
    the blocks that its tokens fill, and the open block at their end.  The open block of the epoch
    before is taken up first, so block numbers go on where they stopped.
``ledger/epoch=<n>``
    the length of the sequence after it, written last: an epoch without this row does not count.

Both replace what an earlier try left, and depend on the epoch's files and the epoch before only; an epoch
that is repeated after a failure so leaves the same blocks, once.  An open block is told from a full one
by its length, so nothing is ever taken back: readers leave out open blocks that a later epoch took up.

The order of the sequence is that of the epochs, inside them that of file paths and of places in a file.
Epochs without tokens, empty files among them, leave the sequence as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.sequence import (
    BLOCK_TOKENS,
    running_offsets,
    split_groups,
    token_blocks,
    token_total,
)
from lexmill.operators.tokenizer import Tokenizer
from lexmill.session import new_folder, stored
from lexmill.sources.token_store import read_blocks, write_blocks
from lexmill.streaming.encoding import encode_lines

BUCKET, INSIDE = ["file", "split"], ["row", "part"]


def _epoch_folder(output: str, kind: str, epoch: int) -> str:
    return f"{output}/{kind}/epoch={epoch}"


def settled_total(spark: SparkSession, output: str, epoch: int) -> int:
    """Length of the sequence after an epoch; 0 before the first."""
    if epoch < 0:
        return 0
    return spark.read.schema("total long").parquet(_epoch_folder(output, "ledger", epoch)).head().total


def append_epoch(
    lines: DataFrame, output: str, epoch: int, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Append ``lines(file, split, row, part, ids, n)`` as an epoch; epochs come in their order."""
    spark = lines.sparkSession
    columns = [*BUCKET, *INSIDE, "ids", "n"]
    rows = lines.select(columns)
    full, left = divmod(settled_total(spark, output, epoch - 1), block_tokens)
    if left:
        last = read_blocks(spark, _epoch_folder(output, "blocks", epoch - 1))
        # No path is empty, so the open block comes before all lines.
        place = [F.lit("" if c == "file" else 0).cast(rows.schema[c].dataType).alias(c) for c in columns[:4]]
        rows = rows.unionByName(last.where(F.col("block") == full).select(*place, "ids", "n"))
    rows = split_groups(stored(rows, new_folder(spark, "epoch")))
    blocks = token_blocks(running_offsets(rows, [*BUCKET, "group"], INSIDE, "n"), block_tokens)
    folder = _epoch_folder(output, "blocks", epoch)
    write_blocks(blocks.withColumn("block", F.col("block") + full), folder)
    total = full * block_tokens + token_total(read_blocks(spark, folder))
    ledger = spark.range(1, numPartitions=1).select(F.lit(total).cast("long").alias("total"))
    ledger.write.mode("overwrite").parquet(_epoch_folder(output, "ledger", epoch))


def write_sequence_stream(
    records: DataFrame, tok: Tokenizer, output: str, checkpoint: str,
    block_tokens: int = BLOCK_TOKENS, uint16: bool = True,
) -> StreamingQuery:
    """Encode the files that have arrived line by line and append them to the sequence in ``output``."""

    def write_batch(batch: DataFrame, epoch: int) -> None:
        append_epoch(encode_lines(batch, tok, uint16), output, epoch, block_tokens)

    return (
        records.writeStream.foreachBatch(write_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_sequence(
    spark: SparkSession, output: str, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``(block, n, ids, shard)``: the sequence of all settled epochs, as the windows take it."""
    last = spark.read.parquet(f"{output}/ledger").agg(F.max("epoch").cast("long")).head()[0]
    schema = "block long, n int, ids array<int>, epoch long, shard long"
    blocks = spark.read.schema(schema).parquet(f"{output}/blocks")
    full = (F.col("n") == block_tokens) & (F.col("epoch") < last)
    return blocks.where(full | (F.col("epoch") == last)).drop("epoch")
