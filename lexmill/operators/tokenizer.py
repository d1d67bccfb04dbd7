"""Vocabulary and merge tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

VOCAB_SCHEMA = "pos long, id int, bytes binary"
MERGES_SCHEMA = "rank int, left binary, right binary"

# Largest tables that are sent to every executor.  Larger ones are joined instead.  In a Python worker
# an entry takes about 250 bytes beside its own, so the tables stay below about 150 MB there.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True, eq=False)
class Tokenizer:
    """``vocab (pos, id, bytes)``, ``merges (rank, left, right)`` and the special tokens.

    ``pos`` and ``rank`` are positions in the source; a later entry replaces an equal earlier one.
    """

    vocab: DataFrame
    merges: DataFrame
    specials: tuple[str, ...] = ()

    @cached_property
    def broadcastable(self) -> bool:
        return fits_broadcast(self.vocab, self.merges)

    @cached_property
    def tables(self) -> Broadcast:
        """Ids by bytes, ranks by pair, and special tokens, on every executor."""
        if not self.broadcastable:
            raise ValueError("the tokenizer tables are too large to broadcast")
        ids = {bytes(row.bytes): row.id for row in reverse_vocab(self.vocab).collect()}
        ranks = {
            (bytes(row.left), bytes(row.right)): row.rank
            for row in merge_ranks(self.merges).collect()
        }
        context = self.vocab.sparkSession.sparkContext
        return context.broadcast((ids, ranks, frozenset(self.specials)))

    @cached_property
    def token_bytes(self) -> Broadcast:
        """Ids and their bytes, on every executor."""
        if not self.broadcastable:
            raise ValueError("the vocabulary is too large to broadcast")
        rows = self.vocab.select("id", "bytes").collect()
        return self.vocab.sparkSession.sparkContext.broadcast([(r.id, bytes(r.bytes)) for r in rows])


def base_vocab(spark: SparkSession, specials: Sequence[str] = ()) -> DataFrame:
    """The 256 bytes, then the special tokens in list order, repeated ones included."""
    rows = [(byte, byte, bytes([byte])) for byte in range(256)]
    rows += [(256 + i, 256 + i, token.encode()) for i, token in enumerate(specials)]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


def merge_table(spark: SparkSession, pairs: Sequence[tuple[bytes, bytes]]) -> DataFrame:
    rows = [(rank, left, right) for rank, (left, right) in enumerate(pairs)]
    return spark.createDataFrame(rows, MERGES_SCHEMA)


def merged_tokens(merges: DataFrame, first_id: int) -> DataFrame:
    """One token per merge, numbered in merge order."""
    number = (F.col("rank") + first_id).cast("int")
    return merges.select(
        number.cast("long").alias("pos"), number.alias("id"), F.concat("left", "right").alias("bytes")
    )


def tokenizer_from_merges(
    spark: SparkSession, pairs: Sequence[tuple[bytes, bytes]], specials: Sequence[str] = ()
) -> Tokenizer:
    """Tables as training numbers them: bytes, special tokens, merges."""
    merges = merge_table(spark, pairs)
    vocab = base_vocab(spark, specials).unionByName(merged_tokens(merges, 256 + len(specials)))
    return Tokenizer(vocab, merges, tuple(specials))


def with_specials(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Append the special tokens whose bytes are missing, from the highest id on."""
    if not specials:
        return vocab
    tokens = vocab.sparkSession.createDataFrame(
        [(i, token.encode()) for i, token in enumerate(dict.fromkeys(specials))],
        "ord int, bytes binary",
    )
    missing = tokens.join(vocab.select("bytes"), "bytes", "left_anti")
    # The window runs over the special tokens only, a handful of rows.
    number = F.row_number().over(W.orderBy("ord"))
    last = vocab.agg(F.max("id").alias("id"), F.max("pos").alias("pos"))
    added = missing.select(
        (F.coalesce(last.select("pos").scalar(), F.lit(-1)) + number).cast("long").alias("pos"),
        (F.coalesce(last.select("id").scalar(), F.lit(-1)) + number).cast("int").alias("id"),
        "bytes",
    )
    return vocab.unionByName(added)


def make_tokenizer(vocab: DataFrame, merges: DataFrame, specials: Sequence[str] = ()) -> Tokenizer:
    """A tokenizer from existing tables; missing special tokens get new ids."""
    return Tokenizer(with_specials(vocab, specials), merges, tuple(specials))


def reverse_vocab(vocab: DataFrame) -> DataFrame:
    """``(bytes, id)``; the last entry of equal bytes wins."""
    return vocab.groupBy("bytes").agg(F.max_by("id", "pos").alias("id"))


def merge_ranks(merges: DataFrame) -> DataFrame:
    """``(left, right, rank)``; the last position of a repeated pair wins."""
    return merges.groupBy("left", "right").agg(F.max("rank").alias("rank"))


def token_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(bytes, side)``: tokens that only one of two vocabularies has, as often as it has more."""
    mine, other = left.select("bytes"), right.select("bytes")
    only_left = mine.exceptAll(other).withColumn("side", F.lit("left"))
    return only_left.unionByName(other.exceptAll(mine).withColumn("side", F.lit("right")))


def fits_broadcast(
    *frames: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Whether the tables together are small enough to be held by every executor."""

    def measured(frame: DataFrame) -> DataFrame:
        binaries = [name for name, kind in frame.dtypes if kind == "binary"]
        length = sum((F.octet_length(name) for name in binaries), F.lit(0))
        return frame.select(length.alias("size"))

    entries = reduce(DataFrame.unionByName, map(measured, frames))
    found = entries.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).head()
    return found.n <= rows and (found.size or 0) <= size
