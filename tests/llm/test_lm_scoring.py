"""The log-bilinear scorer: counts, normalisation, and held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest

from lexmill.llm import lm_scoring
from lexmill.llm.words import words_of


def tokens(text):
    return [*plain.words((text or "").translate(plain.AZ)), None]


def base_rows(rows):
    held = {k: zlib.crc32(str("" if k is None else k).encode()) % 5 == 1 for k, _ in rows}
    counts = Counter(w for k, t in rows if not held[k] for w in tokens(t))
    total = sum(counts.values())
    below = total + 0.5 * (len(counts) + 1)
    out = {}
    for k, t in rows:
        found = tokens(t)
        score = sum(math.log10((counts[w] + 0.5) / below) for w in found)
        out[k] = (held[k], len(found), sum(counts[w] > 0 for w in found), total, score)
    return out


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_counts_and_base_scores(request, name):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = base_rows(rows)
    found = lm_scoring.scored(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        *counts, base = expected[r["doc_id"]]
        assert [r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]] == counts
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_held_out_texts_are_better_predicted_than_by_single_words(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = lm_scoring.scored(docs).where("held_out").collect()
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up(spark):
    """Over all classes after any context, and over a closed set of words with the unseen one."""
    texts = [(i, "a b c d e f " * (i % 3 + 1) + "g h") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    chunks = lm_scoring.chunk_table(docs, "doc_id", "text")
    counts = lm_scoring.counted_words(chunks)
    known = lm_scoring.unigrams(counts, 4)
    model = lm_scoring.trained(lm_scoring.coded_texts(chunks, counts, known), known)
    sums = lm_scoring.normalisers(model, spark)
    size = len(known.shares)
    assert size == 5 and known.types == 9
    for first in range(size):
        for second in range(size):
            query = model.predicted(np.array([first]), np.array([second]))
            p = np.exp(query @ model.target.T + model.bias - sums[first, second])
            assert abs(p.sum() - 1) < 1e-4
    outside = [c for w, c in Counter(w for k, t in texts if not lm_scoring.is_held(k) for w in tokens(t)).items()]
    shares = known.share(np.array([*outside, 0]))
    assert abs(shares.sum() - 1) < 1e-9


def test_training_finds_a_rule():
    """A class that always follows another two gets nearly all the mass."""
    shares = np.full(6, 1 / 6)
    model = lm_scoring.fresh_model(shares, 8)
    triples = np.array([(2 * 6 + 1) * 6 + 5, (1 * 6 + 2) * 6 + 3, (3 * 6 + 4) * 6 + 0])
    for seed in range(400):
        lm_scoring.train(model, triples, np.array([5, 5, 5]), shares, seed)
    score = model.predicted(np.array([1]), np.array([2])) @ model.target.T + model.bias
    assert score.argmax() == 5 and np.exp(score - score.max()).sum() < 1.5


def test_contexts_stop_at_texts():
    classes, ends = np.array([7, 8, 9, 1, 7, 1, 1, 5, 1]), np.array([0, 4, 6, 7, 9])
    first, second = lm_scoring.contexts(classes, ends, 1)
    assert first.tolist() == [1, 7, 8, 9, 1, 7, 1, 1, 5]
    assert second.tolist() == [1, 1, 7, 8, 1, 1, 1, 1, 1]


def test_words_of_arrow_are_those_of_the_pattern(odd_rows):
    texts = [r[1] for r in odd_rows]
    words = words_of(pa.array(texts, pa.string()))
    spelled = words.distinct.to_pylist()
    for i, text in enumerate(texts):
        found = [spelled[c] for c in words.codes[words.ends[i] : words.ends[i + 1]]]
        assert found == plain.words((text or "").translate(plain.AZ))


def test_nothing_to_learn_from(spark, empty):
    held = next(i for i in range(100) if lm_scoring.is_held(i))
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    row = lm_scoring.scored(docs).collect()[0]
    assert tuple(row)[1:] == (True, 3, 0, 0, 0.0, 0.0)
    assert lm_scoring.scored(empty).collect() == []
