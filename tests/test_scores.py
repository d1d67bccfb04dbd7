import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.functions import scores as S
from lexmill.operators import evaluation

LOGITS = np.random.default_rng(0).normal(size=(8, 5)) * 3


def softmax(logits):
    weights = np.exp(logits - logits.max(-1, keepdims=True))
    return weights / weights.sum(-1, keepdims=True)


def score_frame(spark, logits, targets=None):
    targets = range(len(logits)) if targets is None else targets
    rows = [(i, [float(x) for x in row], int(t)) for i, (row, t) in enumerate(zip(logits, targets))]
    return spark.createDataFrame(rows, "row_id long, logits array<double>, target int")


@pytest.mark.parametrize("shift", [0, 100, -1000])
def test_softmax(spark, shift):
    rows = score_frame(spark, LOGITS + shift).select("row_id", S.softmax(F.col("logits")).alias("p"))
    for row in rows.collect():
        np.testing.assert_allclose(row.p, softmax(LOGITS)[row.row_id], rtol=1e-9)


@pytest.mark.parametrize("factor", [1, 1000])
def test_cross_entropy(spark, factor):
    targets = [1, 0, 2, 2, 4, 1, 4, 0]
    logits = LOGITS * factor
    shifted = logits - logits.max(-1, keepdims=True)
    losses = np.log(np.exp(shifted).sum(-1)) - shifted[np.arange(8), targets]
    df = score_frame(spark, logits, targets)
    for row in evaluation.with_loss(df).collect():
        np.testing.assert_allclose(row.loss, losses[row.row_id], rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(evaluation.mean_loss(df).head().loss, losses.mean(), rtol=1e-9)
    batches = evaluation.mean_of_batches(evaluation.with_loss(df), F.expr("row_id div 3")).head()
    means = [losses[0:3].mean(), losses[3:6].mean(), losses[6:].mean()]
    assert batches.batches == 3
    np.testing.assert_allclose(batches.loss, np.mean(means), rtol=1e-9)


@pytest.mark.parametrize("target", [-1, 5])
def test_target_out_of_range_is_an_error(spark, target):
    with pytest.raises(PySparkException):
        evaluation.with_loss(score_frame(spark, LOGITS[:1], [target])).collect()


@pytest.mark.parametrize("temperature", [1.0, 0.5, 0.0])
@pytest.mark.parametrize("top_p", [0.0, 0.3, 0.9, 1.0, 2.0])
def test_nucleus(spark, temperature, top_p):
    logits = np.vstack([LOGITS, np.zeros((1, 5))])
    scaled = logits / temperature if temperature > 0 else logits
    rows = evaluation.score_rows(score_frame(spark, logits), ["row_id"])
    found = {}
    for row in evaluation.nucleus(rows, ["row_id"], temperature, top_p).collect():
        found.setdefault(row.row_id, {})[row.item] = row.prob
    for i, row in enumerate(scaled):
        order = sorted(range(5), key=lambda item: (-row[item], item))
        probs, before, kept = softmax(row), 0.0, []
        for item in order:
            if top_p >= 1 or not kept or before <= top_p:
                kept.append(item)
            before += probs[item]
        total = sum(probs[item] for item in kept)
        assert set(found[i]) == set(kept)
        for item in kept:
            assert found[i][item] == pytest.approx(probs[item] / total)
