"""An index from pairs of symbols to the words that hold them, for rounds of training that touch few words.

The index is a set of written generations of postings ``(pair, word, round, sym, cnt)``: the base holds a
row for every pair of every word, each later round a row for every pair of every word it altered, with the
word as it is now, and a row without ``sym`` for every pair the word lost.  The newest posting of a
word among those of the pairs asked for so tells whether the word still holds one, and what it looks
like; nothing is looked up elsewhere.  The base lies in directories by a checksum of the pair and is
sorted by pair inside, so a lookup opens the directories of its pairs only and skips the row groups of
others.  After some rounds the generations are put together into a new base.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.operators.pairs import among, has_pair

SCHEMA = "pair string, word long, round int, sym string, cnt long, slot int"

# Postings a directory of the base is laid out for, and bounds of the number of directories.
ROWS_PER_SLOT = 500_000
LEAST_SLOTS, MOST_SLOTS = 16, 4096
# Generations beside the base before all are put together.
GENERATIONS = 24


def pairs_of(sym: Column) -> Column:
    """The distinct pairs of adjacent symbols of a symbol string."""
    parts = F.split(sym, r"\)")
    n = F.greatest(F.size(parts) - 2, F.lit(0))
    joined = F.zip_with(
        F.slice(parts, 1, n), F.slice(parts, 2, n), lambda a, b: F.concat(a, F.lit(")"), b, F.lit(")"))
    )
    return F.array_distinct(joined)


def slot_of(pair: Column, slots: int) -> Column:
    return (F.crc32(pair) % slots).cast("int")


@dataclass(frozen=True)
class PairIndex:
    """Generations of postings: the folder of the base, those of later rounds, and the last round."""

    spark: SparkSession
    folder: str
    slots: int
    round: int
    base: str
    later: tuple[str, ...] = ()

    def _postings(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.base)
        if self.later:
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(*self.later))
        return rows

    @staticmethod
    def _newest(postings: DataFrame) -> DataFrame:
        """Words as their newest posting has them, without those it says no longer hold a pair."""
        last = F.max(F.struct("round", "sym", "cnt")).alias("last")
        words = postings.groupBy("word").agg(last).where("last.sym is not null")
        return words.select("word", F.col("last.sym").alias("sym"), F.col("last.cnt").alias("cnt"))

    def postings(self, pairs: Sequence[str]) -> DataFrame:
        """The postings of some pairs, from the directories they lie in."""
        slots = sorted({zlib.crc32(pair.encode()) % self.slots for pair in pairs})
        return self._postings().where(F.col("slot").isin(slots)).where(f"pair in ({among(pairs)})")

    def holders(self, pairs: Sequence[str]) -> DataFrame:
        """``(word, sym, cnt)`` of the words that hold one of the pairs."""
        return self._newest(self.postings(pairs))

    def words(self) -> DataFrame:
        """``(word, sym, cnt)`` of all words that hold a pair."""
        return self._newest(self._postings())

    def appended(self, altered: DataFrame) -> PairIndex:
        """The index after a round that made ``before`` into ``sym`` in ``altered(word, before, sym, cnt)``."""
        number = self.round + 1
        now, gone = pairs_of(F.col("sym")), F.array_except(pairs_of(F.col("before")), pairs_of(F.col("sym")))
        rows = altered.select("word", "cnt", "sym", now.alias("now"), gone.alias("gone"))
        held = F.transform("now", lambda p: F.struct(p.alias("pair"), F.col("sym").alias("sym")))
        lost = F.transform("gone", lambda p: F.struct(p.alias("pair"), F.lit(None).cast("string").alias("sym")))
        rows = rows.select("word", "cnt", F.inline(F.concat(held, lost))).select(
            "pair", "word", F.lit(number).alias("round"), "sym", "cnt", slot_of(F.col("pair"), self.slots).alias("slot")
        )
        path = f"{self.folder}/postings-{number}"
        rows.sortWithinPartitions("slot", "pair").write.mode("overwrite").parquet(path)
        return replace(self, round=number, later=(*self.later, path))

    def rebased(self) -> PairIndex:
        """The same index with all generations put together."""
        return build(self.words(), self.folder, self.round)


def build(words: DataFrame, folder: str, number: int) -> PairIndex:
    """Writes the base of an index over ``words(word, sym, cnt)`` as they are after round ``number``."""
    spark = words.sparkSession
    rows = words.where(has_pair()).select("word", F.explode(pairs_of(F.col("sym"))).alias("pair"), "sym", "cnt")
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, rows.count() // ROWS_PER_SLOT))
    rows = rows.select(
        "pair", "word", F.lit(number).alias("round"), "sym", "cnt", slot_of(F.col("pair"), slots).alias("slot")
    )
    path = f"{folder}/base-{number}"
    # A frequent pair may make its directory large: adaptive execution splits it over several tasks.
    placed = rows.hint("rebalance", "slot").sortWithinPartitions("slot", "pair")
    placed.write.mode("overwrite").partitionBy("slot").parquet(path)
    return PairIndex(spark, folder, slots, number, path)
