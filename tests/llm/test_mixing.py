"""The mix: held-out accuracy, optimality against a dense solver, and what is taken."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import mixing


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")


@pytest.fixture(scope="module")
def more(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")


def test_held_out_accuracy(more, labels):
    """Quality of documents the classifier has not seen, against always saying the usual."""
    known = labels.where("doc_id % 4 <> 0")
    model = mixing.labelled_classifier(more, known)
    held = more.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    f = mixing.features(pa.array([r["text"] for r in held]))
    posterior = model.posteriors(f)
    names = list(mixing.DOMAINS)
    good = posterior[:, names.index("clean")] + posterior[:, names.index("toxic")]
    truth = np.array([r["quality"] for r in held])
    accuracy = ((good > 0.5) == truth).mean()
    assert accuracy >= max(0.93, max(truth.mean(), 1 - truth.mean()) + 0.03)
    assert np.allclose(posterior.sum(axis=1), 1)


def dense_rates(tokens, posterior, target, steps=20_000):
    """The same objective by plain projected gradient on all rows."""
    share = tokens / tokens.sum()
    weight = mixing.metric((posterior * share[:, None]).T @ posterior)
    rate = np.ones(len(tokens))
    for _ in range(steps):
        off = weight @ (posterior.T @ (share * rate) - target)
        rate = np.maximum(rate - 0.5 * (posterior @ off + mixing.RIDGE * (rate - 1)), 0)
    return rate


def test_rates_equal_those_of_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    posterior = rng.dirichlet([0.3] * 4, 200)
    tokens = rng.integers(1, 500, 200)
    rows = spark.createDataFrame(
        [(int(n), p.tolist()) for n, p in zip(tokens, posterior)], "tokens long, posterior array<double>"
    ).repartition(4)
    target = [0.7, 0.2, 0.06, 0.04]
    steps, report = mixing.fit_rates(rows, target)
    rate = steps.rates(posterior)
    best = dense_rates(tokens.astype(float), posterior, np.array(target))
    assert (rate >= 0).all() and (best == 0).any()
    assert np.abs(rate - best).max() < 0.02
    totals = posterior.T @ (tokens / tokens.sum() * best)
    assert np.abs(report["reached"] - totals).max() < 0.005
    assert np.abs(totals - target).max() < np.abs(report["before"] - target).max() / 3


def solved(tokens, posterior, target):
    """The fit on rows in memory."""
    count = len(target)

    def totals(steps):
        sums = mixing.row_totals(steps, tokens, posterior) / tokens.sum()
        return mixing.Totals(sums[:count], sums[count:-4].reshape(count, count), *sums[-4:-1])

    return mixing.projected(totals, np.array(target))


@pytest.mark.parametrize("target", [[0.7, 0.2, 0.06, 0.04], [0.01, 0.01, 0.97, 0.01], [0.25, 0.25, 0.25, 0.25]])
def test_the_gap_bounds_the_error(target):
    rng = np.random.default_rng(9)
    posterior = rng.dirichlet([0.2] * 4, 300)
    tokens = rng.integers(1, 500, 300).astype(float)
    steps, report = solved(tokens, posterior, target)
    best = dense_rates(tokens, posterior, np.array(target), 60_000)
    error = tokens @ (steps.rates(posterior) - best) ** 2 / tokens.sum()
    assert report["settled"] or report["steps"] == mixing.MOST_STEPS
    assert error <= 2 * report["gap"] / mixing.RIDGE + 1e-7


def test_stored_rates_give_the_same_steps(spark, monkeypatch):
    """Steps over a table whose rates are stored often equal those on rows in memory."""
    monkeypatch.setattr(mixing, "REPLAYED", 2)
    monkeypatch.setattr(mixing, "MOST_STEPS", 9)
    rng = np.random.default_rng(4)
    posterior, tokens = rng.dirichlet([0.3] * 3, 50), rng.integers(1, 90, 50)
    table = [(int(n), p.tolist()) for n, p in zip(tokens, posterior)]
    rows = spark.createDataFrame(table, "tokens long, posterior array<double>").repartition(3)
    steps, _ = mixing.fit_rates(rows, [0.8, 0.1, 0.1])
    plain, _ = solved(tokens.astype(float), posterior, [0.8, 0.1, 0.1])
    assert len(steps.slopes) > 4 and np.allclose(steps.slopes, plain.slopes) and np.allclose(steps.momentum, plain.momentum)


def test_targets_out_of_reach_are_reported():
    """A domain that no row has: no error, and the rest of the mix is met."""
    posterior = np.array([[0.9, 0.1, 0.0]] * 5 + [[0.2, 0.8, 0.0]] * 5)
    _, report = solved(np.full(10, 7.0), posterior, [0.5, 0.3, 0.2])
    assert report["reached"][2] == 0 and np.abs(report["reached"][:2] - [0.5, 0.3]).max() < 0.01


def test_targets_are_met_on_real_posteriors(more, labels, caplog):
    with caplog.at_level("INFO", logger=mixing.__name__):
        mix, report = mixing.fit(more, labels)
    assert [r.levelname for r in caplog.records] == ["INFO"] * 5 and report["settled"]
    assert np.abs(report["before"] / report["target"] - 1).max() > 0.5
    assert np.abs(report["reached"] / report["target"] - 1).max() < 0.03


def test_an_absent_domain_does_not_stop_the_fit(spark):
    table = [(100, [0.9, 0.1, 0.0]), (50, [0.2, 0.8, 0.0]), (10, [0.0, 1.0, 0.0])]
    rows = spark.createDataFrame(table, "tokens long, posterior array<double>")
    steps, report = mixing.fit_rates(rows, [0.7, 0.2, 0.1])
    assert np.abs(report["reached"][:2] - report["target"][:2]).max() < 0.01
    assert report["reached"][2] == 0 and (steps.rates(np.eye(3)) >= 0).all()


def test_expected_copies_are_the_rates():
    keys = list(range(20_000))
    assert abs(mixing.copies(np.full(20_000, 1.3), keys).mean() - 1.3) < 0.02
    assert mixing.copies(np.array([0.0, 2.0]), [None, 1]).tolist() == [0, 2]


def test_rows_are_taken_as_often_as_reported(documents, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mix, _ = mixing.fit(documents, labels)
    taken = mixing.mixed_rows(documents, mix)
    assert taken.columns == documents.columns
    counts = {r["doc_id"]: r["n"] for r in taken.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    found = mixing.report(documents, labels).collect()
    assert {r["doc_id"]: r["copies"] for r in found if r["copies"]} == counts
    assert len(found) == documents.count()


def test_odd_and_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame(
        [(i, i % 2 if i % 5 else None, 0, "more") for i in range(12)],
        "doc_id long, quality int, toxic int, text string",
    )
    found = mixing.report(odd, none).collect()
    assert len(found) == odd.count() and len({r["p_clean"] for r in found}) == 1
    assert len(mixing.report(odd, some).collect()) == odd.count()
    assert mixing.report(empty, some).collect() == []
    mix, _ = mixing.fit(odd, some)
    assert mixing.mixed_rows(odd, mix).columns == odd.columns
