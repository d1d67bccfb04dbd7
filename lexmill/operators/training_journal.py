"""What a training has settled, round by round, so that another driver can go on from there.

The journal is a folder of one-row tables that are only ever added: the merges since the row before, and
where the words or the index after them lie.  A row is written after the tables it names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from lexmill.operators.merge_choice import Pair
from lexmill.operators.pair_index import PairIndex

SCHEMA = "step int, merges array<string>, words string, round int, slots int, base string, later array<string>"


@dataclass(frozen=True)
class Settled:
    """Merges so far, and the words' folder or the index after them."""

    steps: int = 0
    merges: tuple[Pair, ...] = ()
    words: str | None = None
    index: PairIndex | None = None


class Journal:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self.steps = 0

    def read(self) -> Settled:
        """What is settled so far; new rows follow those that were found."""
        try:
            rows = self.spark.read.schema(SCHEMA).json(f"{self.folder}/journal/*").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        if not rows:
            return Settled()
        rows.sort(key=lambda row: row.step)
        self.steps = rows[-1].step
        last = rows[-1]
        merges = tuple(tuple(merge.split(" ")) for row in rows for merge in row.merges)
        index = None
        if last.base:
            index = PairIndex(self.spark, self.folder, last.slots, last.round, last.base, tuple(last.later))
        return Settled(self.steps, merges, last.words, index)

    def append(self, merges: Sequence[Pair], words: str | None = None, index: PairIndex | None = None) -> None:
        self.steps += 1
        row = {
            "step": self.steps,
            "merges": F.array(*(F.lit(" ".join(pair)) for pair in merges)),
            "words": words,
            "round": index.round if index else None,
            "slots": index.slots if index else None,
            "base": index.base if index else None,
            "later": F.array(*map(F.lit, index.later)) if index else None,
        }
        types = dict(part.split(" ") for part in SCHEMA.split(", "))
        columns = [F.lit(value).cast(types[name]).alias(name) for name, value in row.items()]
        table = self.spark.range(0, 1, 1, 1).select(columns)
        table.write.mode("overwrite").json(f"{self.folder}/journal/step-{self.steps:06d}")
