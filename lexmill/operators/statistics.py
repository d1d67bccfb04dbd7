"""Token totals and compression ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.operators.pairs import pair_counts, symbol_words


def ratio(size: Column, tokens: Column) -> Column:
    """Bytes per token; infinite without tokens."""
    return F.when(tokens == 0, F.lit(float("inf"))).otherwise(size / F.nullif(tokens, F.lit(0)))


def bytes_per_token(
    encoded: DataFrame, by: Sequence[str] = (), text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Bytes, tokens and bytes per token of encoded texts, per group or over all."""
    sums = encoded.groupBy(*by).agg(
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("n_tokens"),
    )
    return sums.withColumn("bytes_per_token", ratio(F.col("n_bytes"), F.col("n_tokens")))


def token_totals(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """Corpus totals from distinct words: unique words, occurrences, tokens, distinct ids used.

    ``counts`` is ``(word, cnt)`` and ``ids`` ``(word, ids)``; occurrences are never expanded.
    """
    known = counts.join(ids, "word")
    return known.agg(
        F.count(F.lit(1)).alias("n_unique_words"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_words"),
        F.coalesce(F.sum(F.col("cnt") * F.size("ids")), F.lit(0)).alias("n_tokens"),
    )


def training_totals(counts: DataFrame) -> DataFrame:
    """What training starts from: unique words, occurrences, unique adjacent pairs."""
    n_pairs = pair_counts(symbol_words(counts)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_unique_words"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_words"),
    ).withColumn("n_unique_pairs", n_pairs.scalar())
