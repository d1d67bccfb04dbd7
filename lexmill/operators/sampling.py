"""Seeded document samples."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lexmill.operators.sequence import order_buckets, running_offsets

# Keys that a sample names in its scan; those of larger samples are joined.
LISTED_KEYS = 1000


def hashed_sample(df: DataFrame, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows without replacement: those with the smallest digest of key and seed.

    Each task keeps its own ``n`` smallest, so nothing is sorted as a whole.  Only the keys are read
    for that; the rows of the chosen ones, which must be unique, are fetched by a filter on the key.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    keys = df.select(key).orderBy(digest, key).limit(n)
    if n <= LISTED_KEYS:
        return df.where(F.col(key).isin([row[0] for row in keys.collect()]))
    return df.join(keys, key, "left_semi")


def drawn_sample(df: DataFrame, n: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``n`` rows without replacement, the ones Python's ``random.sample`` draws.

    ``random.sample`` picks positions that depend on the seed and the number of rows only, so the
    positions are drawn first and looked up among the keys.  ``order`` names the unique key in
    sort order: one numeric column, or columns of which all but the last make up natural buckets,
    such as file and split.
    """
    order = list(order)
    keys = df.select(*order)
    if len(order) == 1:
        keys, bucket, inside = order_buckets(keys, order[0]), ["bucket"], order
    else:
        bucket, inside = order[:-1], order[-1:]
    rows = df.count()
    positions = random.Random(seed).sample(range(rows), min(n, rows))
    if not positions:
        return df.limit(0)
    numbered = running_offsets(keys.withColumn("one", F.lit(1)), bucket, inside, "one", "position")
    wanted = df.sparkSession.createDataFrame([(p,) for p in positions], "position long")
    return df.join(numbered.join(wanted, "position").select(*order), order, "left_semi")
