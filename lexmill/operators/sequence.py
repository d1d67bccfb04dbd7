"""One long token sequence out of many documents: offsets, blocks, windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexmill.functions import blocks
from lexmill.session import new_folder, stored
from lexmill.sources.token_store import SHARD_BLOCKS

# The code that cuts blocks travels with the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(blocks)

BLOCK_TOKENS = 8192
# Rows and tokens that one bucket of the ordering should hold.
BUCKET_ROWS = 1_000_000
BUCKET_TOKENS = 4_000_000
# Rows of a split of text that make a bucket.
GROUP_ROWS = 1 << 12


def order_buckets(
    df: DataFrame, key: str, output: str = "bucket", size: str | None = None
) -> DataFrame:
    """Add a number that cuts the order of a numeric ``key`` into ranges of similar row counts.

    There are as many ranges as rows, and the sum of ``size`` if given, ask for.  The cuts are approximate quantiles, so crowded key ranges get more of them.  The number is a
    function of the key alone: it is the same whenever a task is repeated.
    """
    number = f"{output}_key"
    keyed = df.withColumn(number, F.col(key).cast("double"))
    total = F.sum(size) if size else F.lit(0)
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys"), total.alias("total")
    ).head()
    rows = found.rows
    if rows != found.keys:
        raise ValueError(f"{rows - found.keys} rows have no {key} to order them by")
    cores = df.sparkSession.sparkContext.defaultParallelism
    buckets = max(cores, -(-rows // BUCKET_ROWS), -(-(found.total or 0) // BUCKET_TOKENS))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(keyed.approxQuantile(number, shares, 1 / (4 * buckets)))) if rows else []
    splits = [float("-inf"), *(cuts or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=number, outputCol=output).transform(keyed)
    return cut.withColumn(output, F.col(output).cast("int")).drop(number)


def prefix_sums(
    rows: DataFrame, order: Sequence[str], size: str, output: str
) -> DataFrame:
    """Add the sum of ``size`` over all rows before each one in a unique ``order``, as a tree.

    Rows are dealt by ranges of the order and stored with the number of their range.  A range is summed
    in its own task; the root adds up one total per range, of which there are as many as the shuffle has
    partitions, whatever the number of rows.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, new_folder(spark, "ranges"))
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("total"))
    listed = totals.agg(F.array_sort(F.collect_list(F.struct("_range", "total"))).alias("all"))
    summed = F.transform(
        "all",
        lambda r, i: F.struct(
            r["_range"].alias("_range"),
            F.aggregate(F.slice("all", 1, i), F.lit(0).cast("long"), lambda s, x: s + x["total"]).alias("_base"),
        ),
    )
    bases = F.broadcast(listed.select(F.inline(summed)))
    before = F.sum(size).over(
        W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    here = dealt.withColumn("_before", before).join(bases, "_range")
    total = F.coalesce("_before", F.lit(0)) + F.col("_base")
    return here.withColumn(output, total.cast("long")).drop("_range", "_before", "_base")


def running_offsets(
    df: DataFrame,
    bucket: Sequence[str],
    order: Sequence[str],
    size: str,
    output: str = "start",
) -> DataFrame:
    """Add the sum of ``size`` over all rows before each one in the order ``(bucket, order)``.

    A running sum inside each bucket, and ``prefix_sums`` over the bucket totals.  ``df`` is read
    twice, so it should be a stored table.  ``(bucket, order)`` must be unique.
    """
    inside = F.sum(size).over(
        W.partitionBy(*bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    totals = df.groupBy(*bucket).agg(F.sum(size).alias("total"))
    bases = prefix_sums(totals, bucket, "total", "base").drop("total")
    start = F.coalesce("inside", F.lit(0)) + F.coalesce("base", F.lit(0))
    return (
        df.withColumn("inside", inside)
        .join(bases, list(bucket))
        .withColumn(output, start.cast("long"))
        .drop("inside", "base")
    )


def split_groups(df: DataFrame, row: str = "row", rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``group``: stretches of a split in the order of ``row``, for buckets smaller than a split."""
    return df.withColumn("group", F.expr(f"{row} div {rows}"))


def token_offsets(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``start``, the position of each document's first token in the whole sequence."""
    return running_offsets(order_buckets(tokens, key, size="n"), ["bucket"], [key], "n")


def _slices(found: str) -> Column:
    """Concatenation of collected ``(at, part)`` pieces in their order."""
    return F.flatten(F.array_sort(F.collect_list(F.struct("at", found)))[found])


def token_blocks(offsets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(block, n, ids)``: the sequence cut into blocks of equal length, the last one shorter.

    ``offsets`` has ``start``, ``n`` and ``ids``.  A task cuts its rows in one pass as they come; those of
    a bucket follow each other, so blocks inside it are whole where they are.  What lies at the ends of
    buckets are pieces: these few are shuffled, to the task that writes their neighbours.
    """
    kind = offsets.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return blocks.BlockCutter(block_tokens).batches(batches)

    rows = offsets.where("n > 0").select(F.col("start").cast("long").alias("start"), "ids")
    cut = rows.mapInArrow(run, f"block long, at long, whole boolean, ids {kind}")
    cut = stored(cut, new_folder(offsets.sparkSession, "cut-blocks"))
    edges = cut.where("NOT whole").groupBy("block").agg(_slices("ids").alias("ids"))
    edges = edges.repartition(F.expr(f"block div {SHARD_BLOCKS}"))
    return cut.where("whole").select("block", "ids").unionByName(edges).select(
        "block", F.size("ids").alias("n"), "ids"
    )


def token_total(blocks: DataFrame) -> int:
    """Length of the whole sequence; reads only the block lengths."""
    return blocks.agg(F.sum("n").alias("n")).head().n or 0


def uniform(number: Column, seed: int, size: int) -> Column:
    """A number in ``[0, size)`` drawn from 60 bits of an MD5 digest of ``number`` and ``seed``."""
    digest = F.md5(F.concat_ws(":", number.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size))


def window_starts(
    spark: SparkSession, samples: int, tokens: int, context: int, seed: int
) -> DataFrame:
    """``(sample, start)``: starts drawn with replacement from all that leave a next token."""
    if tokens <= context:
        raise ValueError(f"{tokens} tokens are too few for windows of {context} and a target")
    return spark.range(samples).select(
        F.col("id").alias("sample"), uniform(F.col("id"), seed, tokens - context).alias("start")
    )


def window_slices(
    starts: DataFrame, blocks: DataFrame, context: int, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """``(sample, start, x, y)``: ``context`` tokens from each start, and the same shifted by one.

    A window touches one or two blocks (more if it is longer than a block) and finds them by an
    equi-join on the block number.
    """
    length = F.lit(block_tokens).cast("long")
    reach = F.expr(f"sequence(start div {block_tokens}, (start + {context}) div {block_tokens})")
    touched = starts.withColumn("block", F.explode(reach))
    begin = F.greatest(F.col("start"), F.col("block") * length)
    stop = F.least(F.col("start") + context + 1, (F.col("block") + 1) * length)
    pieces = touched.join(blocks.select("block", "ids"), "block").select(
        "sample",
        "start",
        begin.alias("at"),
        F.slice(
            "ids", (begin - F.col("block") * length + 1).cast("int"), (stop - begin).cast("int")
        ).alias("part"),
    )
    runs = pieces.groupBy("sample", "start").agg(_slices("part").alias("run"))
    return runs.select(
        "sample",
        "start",
        F.slice("run", 1, context).alias("x"),
        F.slice("run", 2, context).alias("y"),
    )


def sample_windows(
    blocks: DataFrame,
    samples: int,
    context: int,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Random training windows of a stored token sequence."""
    starts = window_starts(blocks.sparkSession, samples, token_total(blocks), context, seed)
    return window_slices(starts, blocks, context, block_tokens)
