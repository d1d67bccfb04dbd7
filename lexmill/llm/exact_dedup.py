"""Exact duplicates against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text.  A batch is
reduced to one row per digest, anti-joined with the index by a sort-merge join that leaves the index
where it is, and what is new is appended.  Only built-in functions are used.

Defined results: a null text counts as empty; equal texts are those identical after lower-casing
A-Z; an empty table gives no rows; further columns of the input are ignored here (the caller joins
by key); a null key never stays beside another one, and a text that has null keys only is indexed with
a null ``keep_id``; rows that repeat key and text count as copies, share one verdict in ``deduplicate``
and leave one row in ``kept_rows``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.session import new_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Digests that one bucket of a new index is laid out for (about 100 MB).
ROWS_PER_BUCKET = 2_000_000
LEAST_BUCKETS = 8


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does the same, and faster, where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, digest)`` of every row."""
    return docs.select(F.col(key), text_digest(F.col(text)).alias("digest"))


@dataclass(frozen=True)
class DigestIndex:
    """Table of ``(digest, keep_id)``; ``name`` is known to the session's catalog."""

    spark: SparkSession
    name: str
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds the rows of ``groups(digest, keep_id, ...)`` whose digest the index lacks.

        Repeating it after a failure adds nothing twice: what was appended is then in the index.
        """
        known = self.rows().select("digest")
        fresh = groups.select("digest", "keep_id").join(known.hint("merge"), "digest", "left_anti")
        # One file a bucket and batch: rows go to the task that writes their bucket.
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def open_index(spark: SparkSession, folder: str, expected_rows: int = 0) -> DigestIndex:
    """Opens the index in ``folder`` or makes one there.

    The number of buckets is set once, from the rows expected, and kept beside the data.
    """
    try:
        buckets = spark.read.parquet(f"{folder}/layout").first()["buckets"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        buckets = max(LEAST_BUCKETS, -(-expected_rows // ROWS_PER_BUCKET))
        layout = spark.range(1).select(F.lit(buckets).alias("buckets"))
        layout.write.parquet(f"{folder}/layout")
    name = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
        f"LOCATION '{folder}/rows'"
    )
    return DigestIndex(spark, name, buckets)


def groups_of(rows: DataFrame, key: str) -> DataFrame:
    """One row per digest: largest key and number of rows; combined before the shuffle."""
    return rows.groupBy("digest").agg(
        F.max(key).cast("bigint").alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )


def deduplicate(
    index: DigestIndex, docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 1
) -> DataFrame:
    """Adds ``docs`` to the index and returns ``(key, digest, keep_id, group_size)`` per row.

    ``keep_id`` is the key of the row that stays: the indexed one, or for a text new to the index
    the largest key among its copies; adding a batch again so gives the same answer.  ``group_size`` counts the copies in ``docs``.  With several
    ``batches`` the key range is added in as many parts, largest keys first and null keys with the
    last; the result is the same.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, key, text), new_folder(spark, "digests"))
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if ends["low"] is not None and batches > 1:
        cuts = [ends["low"] + (ends["high"] - ends["low"]) * i // batches for i in range(batches)]
        for i in reversed(range(batches)):
            part = rows.where(F.col(key) > cuts[i]) if i else rows
            # Null keys are in no range; the last batch, which has no lower end, takes them.
            below = (F.col(key) <= cuts[i + 1]) | F.col(key).isNull() if i + 1 < batches else F.lit(True)
            part = part.where(below)
            index.append(groups_of(part, key))
    else:
        index.append(groups_of(rows, key))
    # One row per digest on both sides; written, so that the join below has plain sides, which
    # adaptive execution can split where one digest holds many rows.
    known = groups_of(rows, key).drop("keep_id").join(index.rows().hint("merge"), "digest")
    groups = stored(known, new_folder(spark, "digest-groups"))
    return rows.join(groups, "digest").select(
        key, "digest", "keep_id", F.col("copies").alias("group_size")
    )


def kept_rows(index: DigestIndex, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for every text that is new to the index, all columns as they are.

    Keys and digests settle which row stays; texts move once, to meet the keys that stay.  Rows that
    share key and text are copies too: one of them stays.
    """
    spark = docs.sparkSession
    found = deduplicate(index, docs, key, text)
    stay = found.where(F.col(key).eqNullSafe(F.col("keep_id"))).groupBy(key, "digest").count()
    stay = stored(stay, new_folder(spark, "kept-keys"))
    own = "_digest"
    while own in docs.columns:
        own += "_"
    marked = docs.withColumn(own, text_digest(F.col(text)))
    same = F.col(f"d.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col(f"d.{own}") == F.col("s.digest"))
    kept = marked.alias("d").join(stay.alias("s"), same, "left_semi")
    if stay.where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([key, own])
    return kept.drop(own)
