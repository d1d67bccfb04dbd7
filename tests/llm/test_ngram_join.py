"""The n-gram join against a comparison of all pairs."""

import random
import tracemalloc
import zlib

import numpy as np
import plain
import pytest

from lexmill.llm import ngram_join
from lexmill.llm.components import connected


def result(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_documents(documents, document_rows, width, percent):
    found = result(ngram_join.grouped(documents, width=width, percent=percent))
    assert found == plain.components(document_rows, width, percent)


def test_odd_texts(odd, odd_rows):
    texts = [(r[0], r[1]) for r in odd_rows]
    assert result(ngram_join.grouped(odd, width=3, percent=90)) == plain.components(texts, 3, 90)


def test_near_copies_around_the_limit(spark):
    """Chains and groups whose members are linked in part, and a passage in every text."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(words)
    chain = [f"c{i}" for i in range(100)]
    for i in range(40):
        chain = [*chain[1:], f"d{i}"]
        texts.append(list(chain))
    texts += [[*(f"u{i}_{j}" for j in range(60)), *passage] for i in range(40)]
    rng.shuffle(texts)
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)] + [(500, rows_of(base)), (501, rows_of(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, percent in ((3, 90), (3, 80), (5, 80)):
        found = result(ngram_join.grouped(docs, width=width, percent=percent))
        assert found == plain.components(rows, width, percent)


def test_null_keys_are_linked(spark):
    base = [f"b{i}" for i in range(100)]
    other = [f"o{i}" for i in range(100)]
    table = [(7, rows_of(base)), *[(None, rows_of([*base[:-1], "end"]))] * 3]
    table += [(None, rows_of(other)), (None, rows_of([*other[:-1], "end"])), (8, "apart from all")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r) for r in ngram_join.grouped(docs, width=3, percent=90).collect()), key=repr)
    expected = [(7, 98, 7), *[(None, 98, 7)] * 3, *[(None, 98, None)] * 2, (8, 1, 8)]
    assert found == sorted(expected, key=repr)


def rows_of(words):
    return " ".join(words)


def test_one_of_each_group_stays(documents, document_rows):
    kept = ngram_join.kept_rows(documents)
    expected = {r[0] for r in plain.components(document_rows, 5, 80) if r[0] == r[2]}
    assert {r["doc_id"] for r in kept.collect()} == expected and kept.columns == documents.columns


def test_rows_stay_by_their_own_text(spark):
    base = [f"b{i}" for i in range(100)]
    table = [
        (1, rows_of(base)), (2, rows_of([*base[:-1], "end"])), (2, "a text of its own, not like the others"),
        (3, None), (3, ""), (None, rows_of(["new", *base[1:]])), (None, "one more text of six words"),
    ]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    kept = sorted((tuple(r) for r in ngram_join.kept_rows(docs).collect()), key=repr)
    # A null key comes before all others.
    assert kept == sorted([*table[2:5], *table[5:]], key=repr)


def test_sketches_never_refute_a_link():
    rng = random.Random(8)
    for _ in range(200):
        grams = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, 3000))], np.uint64))
        other = np.unique(np.concatenate(
            [grams[rng.randrange(len(grams)) // 5:], np.array([rng.getrandbits(64) for _ in range(40)], np.uint64)]
        ))
        differ = sum(
            bin(int(x) & (2**64 - 1)).count("1")
            for x in ngram_join._sketch(grams) ^ ngram_join._sketch(other)
        )
        assert differ <= len(np.setxor1d(grams, other))


def test_empty_and_unlinked_tables(spark, empty):
    assert result(ngram_join.grouped(empty)) == set()
    docs = spark.createDataFrame([(3, "a b c d e f"), (4, None)], "doc_id long, text string")
    assert result(ngram_join.grouped(docs)) == {(3, 2, 3), (4, 0, 4)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert result(found) == {(x, root(x)) for x in parent}


def test_order_of_cells_in_little_memory(spark):
    """Equals a stable sort of all counts, while the driver holds few copies of them."""
    rng = np.random.default_rng(3)
    size, piece = 1 << ngram_join.CELL_BITS, ngram_join.PIECE
    counts = np.zeros(size, np.int64)
    rows = []
    for i in (0, 1, 7, size // piece - 1, 7):
        part = rng.zipf(1.3, piece).clip(0, 2**32 - 1).astype("<u4")
        counts[i * piece : (i + 1) * piece] += part
        rows.append((i, bytearray(zlib.compress(part.tobytes()))))
    cells = spark.createDataFrame(rows, "piece int, counts binary")
    tracemalloc.start()
    rank, pivots = ngram_join.global_order(cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    order = np.argsort(counts, kind="stable")
    assert (rank[order] == np.arange(size)).all()
    mass = np.cumsum(counts[order])
    shares = mass[-1] * np.arange(1, ngram_join.FRAGMENTS) / ngram_join.FRAGMENTS
    assert pivots.tolist() == np.searchsorted(mass, shares).tolist()
    assert peak < 64 << 20
