"""Evaluation over score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexmill.functions import scores as S


def with_loss(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    return df.withColumn("loss", S.cross_entropy(F.col(logits), F.col(target)))


def mean_loss(df: DataFrame, logits: str = "logits", target: str = "target") -> DataFrame:
    """Mean cross-entropy over all rows."""
    return with_loss(df, logits, target).agg(F.avg("loss").alias("loss"))


def mean_of_batches(losses: DataFrame, batch: Column, loss: str = "loss") -> DataFrame:
    """Mean of the per-batch means."""
    means = losses.groupBy(batch.alias("batch")).agg(F.avg(loss).alias("loss"))
    return means.agg(F.count(F.lit(1)).alias("batches"), F.avg("loss").alias("loss"))


def score_rows(df: DataFrame, key: Sequence[str], logits: str = "logits") -> DataFrame:
    """One row per score: ``item``, its position, and ``logit``."""
    return df.select(*key, F.posexplode(F.col(logits).cast("array<double>")).alias("item", "logit"))


def nucleus(
    scores: DataFrame, group: Sequence[str], temperature: float = 1.0, top_p: float = 1.0
) -> DataFrame:
    """Keep the likeliest items of each group up to a mass of ``top_p`` and renormalise.

    An item stays while the mass before it is at most ``top_p``, so the first always does; items
    of equal score go by ascending ``item``.  A temperature of zero or less leaves the scores as
    they are.  One shuffle on the group serves all windows.
    """
    logit = F.col("logit") / temperature if temperature > 0 else F.col("logit")
    whole = W.partitionBy(*group)
    ranked = whole.orderBy(F.desc("logit"), "item")
    weights = scores.withColumn("logit", logit).withColumn(
        "weight", F.exp(F.col("logit") - F.max("logit").over(whole))
    )
    if top_p < 1:
        ahead = F.sum("weight").over(ranked.rowsBetween(W.unboundedPreceding, -1))
        share = F.coalesce(ahead, F.lit(0.0)) / F.sum("weight").over(whole)
        first = F.row_number().over(ranked) == 1
        weights = weights.withColumn("kept", first | (share <= top_p)).where("kept").drop("kept")
    total = F.sum("weight").over(whole)
    return weights.withColumn("prob", F.col("weight") / total).drop("weight")
