"""From texts to documents, segments, pre-tokens and pre-token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lexmill.functions import text as T


def split_documents(
    df: DataFrame, key: Sequence[str], text: str = "text", marker: str = T.END_OF_TEXT
) -> DataFrame:
    """Documents of each text: between markers if the text has any, else between blank lines.

    Documents are stripped and empty ones dropped; ``doc`` is the position among the parts.
    """
    column = F.col(text)
    parts = F.when(
        F.contains(column, F.lit(marker)), F.split(column, T.special_pattern([marker], True), -1)
    ).otherwise(F.split(column, "\n\n", -1))
    return (
        df.select(*key, F.posexplode(parts).alias("doc", "part"))
        .select(*key, "doc", T.strip(F.col("part")).alias("text"))
        .where("text <> ''")
    )


def segment_rows(
    df: DataFrame, key: Sequence[str], specials: Sequence[str], text: str = "text"
) -> DataFrame:
    """One row per segment: ``seg, is_special, text``, special tokens kept."""
    return df.select(*key, F.inline(T.segments(F.col(text), specials)))


def pretoken_rows(
    df: DataFrame, key: Sequence[str], specials: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """One row per pre-token: ``seg, pos, word``; special segments give none."""
    plain = segment_rows(df, key, specials, text).where("not is_special")
    return plain.select(*key, "seg", F.posexplode(T.pretokens(F.col("text"))).alias("pos", "word"))


def word_counts(
    df: DataFrame,
    specials: Sequence[str] = (),
    text: str = "text",
    by: Sequence[str] = (),
) -> DataFrame:
    """Occurrences of each distinct pre-token; special tokens are not counted.

    The count is combined in the scan tasks, so a very frequent word costs one row per task.
    """
    parts = df.select(
        *by, F.explode(T.plain_parts(F.col(text), specials, longest_first=False)).alias("part")
    )
    occurrences = parts.select(*by, F.explode(T.pretokens(F.col("part"))).alias("word"))
    return occurrences.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("cnt"))
