"""Counts of adjacent symbols and merging of pairs on a ``(sym, cnt)`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as T


def symbol_words(counts: DataFrame) -> DataFrame:
    """``(word, cnt)`` to ``(sym, cnt)``, leaving out words of one byte: they hold no pair.

    The filter looks at the word itself: it may be pushed below the count, where it is evaluated
    for each occurrence.
    """
    words = counts.where(F.octet_length("word") > 1)
    return words.select(T.symbols(F.col("word")).alias("sym"), "cnt")


def has_pair() -> Column:
    return F.instr(F.col("sym"), ")(") > 0


def neighbours(words: DataFrame, width: int) -> DataFrame:
    """One row per run of ``width`` adjacent symbols: ``s0, s1, …, cnt``, overlaps included.

    The symbols come out with their opening delimiter only, as in ``(74``.
    """
    cut = words.select(F.split("sym", r"\)").alias("s"), "cnt")
    n = F.greatest(F.size("s") - width, F.lit(0))
    runs = F.arrays_zip(*(F.slice("s", i + 1, n).alias(f"s{i}") for i in range(width)))
    return cut.select("cnt", F.inline(runs))


def joined(*names: str) -> Column:
    """The symbol string of adjacent symbols given as columns of ``neighbours``."""
    return F.concat(*(piece for name in names for piece in (F.col(name), F.lit(")"))))


def pair_rows(words: DataFrame) -> DataFrame:
    return neighbours(words, 2).select(joined("s0", "s1").alias("pair"), "cnt")


def pair_counts(words: DataFrame) -> DataFrame:
    """``(pair, cnt)``: how often each pair of symbols is adjacent, weighted by word count."""
    return pair_rows(words).groupBy("pair").agg(F.sum("cnt").alias("cnt"))


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The most frequent pairs; among equals the larger pair in byte order comes first."""
    return pairs.orderBy(F.desc("cnt"), F.desc("pair")).limit(n)


def pair_columns(pairs: DataFrame) -> DataFrame:
    """``(a, b, cnt)`` with the two symbols as plain hex."""
    sides = F.split(F.col("pair"), r"[()]+")
    return pairs.select(F.get(sides, F.lit(1)).alias("a"), F.get(sides, F.lit(2)).alias("b"), "cnt")


def among(pairs: Sequence[str]) -> str:
    """SQL list of symbol strings, which hold only hex digits and parentheses."""
    return ",".join(f"'{pair}'" for pair in pairs)


def triple_counts(words: DataFrame, pairs: Sequence[str]) -> DataFrame:
    """Counts of three adjacent symbols whose two pairs are both among ``pairs``."""
    listed = among(pairs)
    runs = neighbours(words, 3).select(
        joined("s0", "s1").alias("front"), joined("s1", "s2").alias("back"), "cnt"
    )
    return (
        runs.where(f"front in ({listed}) and back in ({listed})")
        .groupBy("front", "back")
        .agg(F.sum("cnt").alias("cnt"))
    )


def merge_pairs(sym: Column, merges: Sequence[tuple[str, str]]) -> Column:
    """Apply merges in order, each left to right without overlap.

    The merges travel as two array literals, so the plan has the same shape for any number.
    """
    found = F.split(F.lit(" ".join(f"({a})({b})" for a, b in merges)), " ")
    put = F.split(F.lit(" ".join(f"({a}{b})" for a, b in merges)), " ")
    rules = F.arrays_zip(found.alias("f"), put.alias("p"))
    return F.aggregate(rules, sym, lambda s, r: F.replace(s, r["f"], r["p"]))


def changed_words(words: DataFrame) -> DataFrame:
    """``(sym, cnt)`` whose counts are changes: altered words once as ``before``, negative, and
    once as they are now."""
    altered = words.where("before <> sym")
    return altered.select(
        F.inline(
            F.array(
                F.struct(F.col("before").alias("sym"), (-F.col("cnt")).alias("cnt")),
                F.struct("sym", "cnt"),
            )
        )
    )
