"""Column functions on an array of scores (logits)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` puts it into a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _exp_sum(scores: Column, peak: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda total, x: total + F.exp(x - peak))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of scores; the largest score is subtracted before ``exp``."""

    def shares(scores: Column, peak: Column) -> Column:
        return _bound(
            _exp_sum(scores, peak),
            lambda total: F.transform(scores, lambda x: F.exp(x - peak) / total),
        )

    scores = logits.cast("array<double>")
    return _bound(F.array_max(scores), lambda peak: shares(scores, peak))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log probability of ``target``; an index outside the array is an error."""
    scores = logits.cast("array<double>")
    outside = F.assert_true((target >= 0) & (target < F.size(logits)), "target out of range")
    picked = F.when(outside.isNull(), F.get(logits, target)).cast("double")
    log_sum = _bound(F.array_max(scores), lambda peak: F.log(_exp_sum(scores, peak)) + peak)
    return log_sum - picked


def nucleus(logits: Column, temperature: float = 1.0, top_p: float = 1.0) -> Column:
    """Array of ``(item, prob)``: the likeliest items up to a mass of ``top_p``, renormalised.

    An item stays while the mass before it is at most ``top_p``, so the first always does; equal scores
    go by ascending item.  A temperature of zero or less leaves the scores as they are.  All of it
    happens in the row: one sort and two passes.
    """
    scale = temperature if temperature > 0 else 1.0
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def kept(ranked: Column) -> Column:
        total = F.aggregate(ranked, F.lit(0.0), lambda mass, s: mass + s.weight)
        start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))

        def step(total: Column) -> Column:
            return F.aggregate(
                ranked,
                start,
                lambda state, s: F.struct(
                    (state.mass + s.weight).alias("mass"),
                    F.when((state.n == 0) | (state.mass / total <= top_p), state.n + 1)
                    .otherwise(state.n)
                    .alias("n"),
                ),
                lambda state: state.n,
            )

        return F.slice(ranked, F.lit(1), once(total, step)) if top_p < 1 else ranked

    def shares(chosen: Column) -> Column:
        total = F.aggregate(chosen, F.lit(0.0), lambda mass, s: mass + s.weight)
        return once(
            total,
            lambda whole: F.transform(
                chosen, lambda s: F.struct(s.item.alias("item"), (s.weight / whole).alias("prob"))
            ),
        )

    def ranked(scores: Column) -> Column:
        top = F.array_max(scores)
        return F.sort_array(
            F.transform(
                scores,
                lambda x, i: F.struct(
                    (-x).alias("order"), i.alias("item"), F.exp(x - top).alias("weight")
                ),
            )
        )

    scaled = F.transform(logits.cast("array<double>"), lambda x: x / scale)
    return once(once(once(scaled, ranked), kept), shares)
