"""SimHash fingerprints and their components against a comparison of all pairs."""

import random

import plain
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import simhash_join
from lexmill.llm.components import connected
from lexmill.llm.queries import QUERIES


def fingerprint(text, width=3):
    words = plain.words((text or "").translate(plain.AZ))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    shingles = shingles or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(rows, width=3):
    """Rows of key, text: key, fingerprint in hexadecimal, least key reachable."""
    prints = [(key, fingerprint(text, width)) for key, text in rows]
    distinct = sorted({p for _, p in prints})
    return joined(prints, classes(distinct))


def classes(distinct):
    """Component of each fingerprint, named by its least."""
    name = {p: p for p in distinct}

    def root(p):
        while name[p] != p:
            p = name[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= 2:
                x, y = sorted((root(p), root(q)))
                name[y] = x
    return {p: root(p) for p in distinct}


def joined(prints, roots):
    least = {}
    for key, p in prints:
        if key is not None:
            least[roots[p]] = min(key, least.get(roots[p], key))
    return sorted(((key, f"{p:016x}", least.get(roots[p])) for key, p in prints), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark, sf_dir, document_rows):
    found = QUERIES["op13_simhash_join"](spark, sf_dir)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert result(found) == components(document_rows)


@pytest.mark.parametrize("width", [1, 3])
def test_odd_texts(odd, odd_rows, width):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert result(simhash_join.grouped(odd, width=width)) == components(rows, width)


def test_long_texts_are_hashed_in_ranges(odd, odd_rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash_join, "RANGE", 7)
    found = simhash_join.fingerprint_array(pa.array([r[1] for r in odd_rows[:24]]), 3)
    assert [p % 2**64 for p in found.tolist()] == [fingerprint(r[1]) for r in odd_rows[:24]]


def signed(p):
    return p - 2**64 if p >= 2**63 else p


@pytest.mark.parametrize("many", [1, 4, 32])
def test_links_give_the_components_of_all_pairs(spark, many):
    """Clusters in one segment, in both, chains, and strangers that share a segment."""
    rng = random.Random(3)
    found = {0, 1, 3, 7, 2**63, 2**64 - 1, 2**64 - 8}
    for spread in (range(32), range(32, 64), range(64)):
        base = rng.getrandbits(64)
        for _ in range(150):
            found.add(base ^ sum(1 << b for b in rng.sample(spread, rng.randrange(5))))
    high = rng.getrandbits(32) << 32
    found |= {high | rng.getrandbits(32) for _ in range(100)}
    step = rng.getrandbits(64)
    for bit in rng.sample(range(64), 40):
        step ^= 1 << bit
        found.add(step)
    found = sorted(found)
    table = spark.createDataFrame([(signed(p),) for p in found], "fingerprint long").repartition(3)
    edges = simhash_join.links(table, many)
    assert all((signed(a) ^ signed(b)) % 2**64 and ((a ^ b) % 2**64).bit_count() <= 2
               for a, b in edges.collect())
    roots = classes(found)
    expected = {}
    for p in found:
        expected.setdefault(roots[p], set()).add(signed(p))
    groups = {}
    for node, component in connected(edges).collect():
        groups.setdefault(component, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_a_crowd_costs_no_square(spark):
    """Members of a crowded segment meet in keys of four at most."""
    rng = random.Random(8)
    found = sorted({0xABCDEF << 32 | rng.getrandbits(32) for _ in range(3000)})
    table = spark.createDataFrame([(p,) for p in found], "fingerprint long")
    assert simhash_join.links(table).count() < len(found)


def test_empty_tables_null_keys_and_other_columns(spark, empty):
    assert simhash_join.grouped(empty).collect() == []
    rows = [(None, "a b c d"), (4, "A b c d"), (3, "a b c d"), (None, "alone here now"), (3, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "doc_id long, text string, fingerprint int, key string, least int")
    assert result(simhash_join.grouped(docs)) == components(rows)
    named = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    expected = components([(None if k is None else str(k), t) for k, t in rows])
    assert result(simhash_join.grouped(named, key="name")) == expected
