"""Encoding a stream of text files line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.encoding import encode
from lexmill.operators.tokenizer import Tokenizer
from lexmill.sources.texts import MOST_FILES, line_parts, placed_records, with_ends
from lexmill.sources.token_store import checked_ids

# Bytes of files that one micro-batch takes on.
BATCH_BYTES = 4 << 30


def stream_records(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Records of the files that arrive in a folder: what stands between ``\\n``.

    Large files are read in splits, a record at a time, so a task holds a batch of records and never
    a file.  ``batch_bytes`` bounds what one micro-batch reads; a larger file is a batch of its own.
    """
    reader = spark.readStream.option("maxBytesPerTrigger", batch_bytes).option("lineSep", "\n")
    # The file columns travel with the value; they are not known any more inside a batch.
    return reader.text(path).select("value", "_metadata")


def encode_lines(records: DataFrame, tok: Tokenizer, uint16: bool = True) -> DataFrame:
    """``(file, split, row, part, ids, n)`` of the records of one batch, line ends kept.

    A small batch has few files and splits: then the files are not counted by jobs of their own, and the
    records are spread over all cores.
    """
    seen = Observation()
    placed = placed_records(records, seen)
    # The number of files is an estimate, hence the margin.
    few = 2 * (seen.get.get("files") or 0) <= MOST_FILES
    ended = with_ends(placed, "\n", few)
    cores = records.sparkSession.sparkContext.defaultParallelism
    if (seen.get.get("tasks") or 0) < cores:
        ended = ended.repartition(cores, "split", "row")
    lines = line_parts(ended)
    ids = encode(lines, tok, ["file", "split", "row", "part"]).drop("text")
    return checked_ids(ids, uint16).withColumn("n", F.size("ids"))


def write_encoded_stream(
    records: DataFrame, tok: Tokenizer, output: str, checkpoint: str, uint16: bool = True
) -> StreamingQuery:
    """Encode what has arrived so far into Parquet, each input file exactly once.

    A micro-batch replaces its own folder ``epoch=<number>`` of ``output``, so a repeated batch leaves
    the same result.
    """

    def write_batch(batch: DataFrame, epoch: int) -> None:
        encode_lines(batch, tok, uint16).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return (
        records.writeStream.foreachBatch(write_batch)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
