"""Whitening against a dense eigendecomposition and exact integer sums."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import whitening
from lexmill.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, count=16):
    """key -> deviation and whitened values, from rows of key and vector; shares, error of the identity."""
    kept = [(k, tuple(math.floor(64 * float(c)) + 1000000 for c in v)) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, size = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(size)]
    apart = np.array([[float(Fraction(n * x[i] - sums[i], n)) for i in range(size)] for x in fit])
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    out = {}
    for key, x in kept:
        row = np.array([float(Fraction(n * x[i] - sums[i], n)) for i in range(size)])
        with np.errstate(all="ignore"):
            out.setdefault(key, []).append(
                (sum((n * x[i] - sums[i]) ** 2 for i in range(size)), row @ vectors / np.sqrt(np.maximum(values, 0))))
    return n, out, values / np.trace(apart.T @ apart / n)


def compare(df, rows, exact=1e-9):
    n, expected, shares = plain(rows)
    found = {}
    for r in df.collect():
        found.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(found) == set(expected)
    wide = len(shares)
    flips = np.zeros(wide)
    for key, copies in expected.items():
        assert sorted(found[key]) == list(range(1, wide + 1))
        assert all(len(x) == len(copies) for x in found[key].values())
        if len(copies) > 1 and any(c[0] != copies[0][0] for c in copies):
            continue
        for j in range(wide):
            for r in found[key][j + 1]:
                assert (r["n"], r["deviation"]) == (n, copies[0][0] if copies[0][0] < 2**63 else None)
                assert abs(r["explained"] - shares[j]) <= 1e-9 * shares[j]
                assert r["identity_error"] <= 1e-9
                want = copies[0][1][j]
                if abs(want) > 0.05 and not flips[j]:
                    flips[j] = np.sign(want * r["whitened"])
                if flips[j]:
                    assert abs(r["whitened"] * flips[j] - want) < exact


def test_embeddings(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = QUERIES["op11_whitening"](spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found, rows)


def test_odd_vectors(spark):
    """Nulls, entries that are no numbers, off-grid ones, copies, other lengths, clashing columns."""
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * [9, 4, 2, 1, 700]]) for i in range(60)]
    good += [(60, good[0][1]), (None, good[1][1]), (7, good[7][1]), (61, [-0.0, 0.0, -0.001, 0.0, 2e3])]
    odd = [(70, None), (71, [1.0, None, 1.0, 1.0, 1.0]), (72, [1.0, float("nan"), 1.0, 1.0, 1.0]),
           (73, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (74, [3e38, 0.0, 0.0, 0.0, 0.0]), (75, []), (76, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in good + odd], SCHEMA + ", n int, grid string")
    compare(whitening.whitened(table.repartition(3)), good, 1e-6)


def test_no_rows_and_no_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], SCHEMA)
    found = whitening.whitened(same).collect()
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in found) == [
        (i, j, 1, 0, None) for i in (1, 2) for j in (1, 2, 3)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.5]) for i in range(9)], SCHEMA)
    found = whitening.whitened(line).orderBy("vec_id", "component").collect()
    assert [r["whitened"] is None for r in found[:3]] == [False, True, True]
    assert found[0]["identity_error"] < 1e-9 and abs(found[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("spectrum", ["even", "steep", "ties", "low rank", "flat"])
def test_solver(spectrum):
    """Eigenvalues and vectors of 80 dimensions against a dense solver; ties by their spaces."""
    rng = np.random.default_rng(6)
    size, count = 80, 8
    values = {
        "even": np.linspace(1, 2, size), "steep": 10.0 ** -np.linspace(0, 9, size),
        "ties": np.r_[np.ones(70), 2, 2, 3, 3, 3, 5, 8, 8, 9, 1000], "low rank": np.r_[np.zeros(75), 1, 2, 3, 4, 5],
        "flat": np.ones(size),
    }[spectrum]
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = turn * values @ turn.T
    found, vectors, residual = whitening.leading(lambda block: matrix @ block, size, count)
    assert residual <= 1e-12
    assert np.allclose(found, np.sort(values)[::-1][:count], rtol=0, atol=1e-11 * values.max())
    assert np.allclose(vectors.T @ vectors, np.eye(count), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-11 * values.max())


def test_exact_deviations():
    """Up to the largest long, also where a product leaves 64 bits; null beyond."""
    rng = np.random.default_rng(2)
    values = rng.integers(-300, 300, (40, 3))
    for count in (7, 10**6, 5 * 10**6, 3 * 10**7, 10**11):
        sums = tuple(int(x) * count // 40 + 1 for x in values.sum(axis=0))
        centre = whitening.Centre(count, sums)
        exact = [sum((count * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in values]
        assert centre.deviations(values).to_pylist() == [x if x < 2**63 else None for x in exact]


def test_widths():
    vectors = pa.array([[1.0], [600.0], [4e7], [float(2**46)], [-1.0], None], pa.list_(pa.float32()))
    kept, sizes, found = whitening._packed(vectors)
    assert list(map(len, found)) == [2, 4, 8, 8, 2] and list(kept) == [0, 1, 2, 3, 4]
    grid = whitening._values(pa.array(found, pa.binary()), 1).ravel()
    assert grid.tolist() == [64, 38400, 2560000000, 2**52, -64]


def test_copies_are_fitted_once(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.5 * (i % 5)]) for i in range(3000)]
    rows += [(i, [50.0, 1.0, 2.0]) for i in range(3000, 4500)]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found.count() == 3 * 4500 and found.select(F.max("n")).first()[0] == 106
    compare(found, rows)
