"""Token ids and packing."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexmill.llm import packing
from lexmill.llm.token_ids import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_ids_equal_those_of_whole_texts(tokenizer, odd_rows, document_rows, monkeypatch):
    texts = [r[1] for r in odd_rows] + [t for _, t in document_rows[:60]]
    texts += ["a b c", "é ́x", "İstanbul İ", "tab\tsep\x1cfs \x85n", "'s 't x's"]
    monkeypatch.setattr("lexmill.llm.token_ids.REMEMBERED", 3_000)
    monkeypatch.setattr("lexmill.llm.token_ids.TOGETHER", 37)
    table = WordIds(PATH)
    for start in range(0, len(texts), 7):
        some = texts[start : start + 7]
        for text, ids in zip(some, table.encode(pa.array(some, pa.string()))):
            assert [*ids.tolist(), 1] == plain.token_ids(tokenizer, text)


MEMORY = """
import re
import sys
import threading
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

from lexmill.llm.token_ids import WordIds
from lexmill.llm.words import slices

def held():
    found = re.search(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())
    return int(found[1]) / 1024

def watch():
    while True:
        seen.append(held())
        time.sleep(0.01)

rng = np.random.default_rng(1)
vocabulary = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(20_000)])
batches = [
    pa.RecordBatch.from_pydict({"text": [" ".join(rng.choice(vocabulary, 400)) for _ in range(5_000)]})
    for _ in range(3)
]
table = WordIds(sys.argv[1])
table.encode(pa.array([" ".join(vocabulary)]))
pa.default_memory_pool().release_unused()
pa.system_memory_pool().release_unused()
seen, first = [], held()
threading.Thread(target=watch, daemon=True).start()
for part in slices(iter(batches)):
    found = table.encode(part["text"])
print("most", max(seen) - first)
"""


def test_memory_of_a_worker():
    """Beyond the table of words, a worker takes what one slice needs and no more."""
    run = subprocess.run(
        [sys.executable, "-c", MEMORY, PATH], cwd=Path(__file__).parents[2],
        capture_output=True, text=True, check=True,
    )
    assert float(re.search(r"most ([\d.]+)", run.stdout)[1]) < 95


def test_least_squares_and_plan():
    rng = np.random.default_rng(1)
    for _ in range(5):
        a, x = rng.integers(0, 3, (12, 9)).astype(float), rng.random(9) * (rng.random(9) > 0.4)
        assert np.allclose(a @ packing.nnls(a, a @ x), a @ x, atol=1e-6)
    a, b = np.eye(3), np.array([1.0, -2.0, 0.0])
    assert np.allclose(packing.nnls(a, b), [1, 0, 0])
    assert all(sum(some) == 64 and len(some) <= 3 for some in packing.strategies())
    counts = rng.integers(0, 5_000, 64)
    used = np.zeros(65, int)
    for some, repeats in packing.plan(counts):
        for b in some:
            used[b] += repeats
    assert (used[1:] <= counts).all() and used.sum() > 0.6 * counts.sum()
    assert packing.plan([0] * 64) == []


def check(found, texts, tokenizer, window=packing.WINDOW):
    """Every id in one piece, sequences gapless; returns the share of padding."""
    ids = {key: plain.token_ids(tokenizer, text) for key, text in texts}
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(part) > 0
        assert r["ids_crc32"] == plain.ids_crc(part)
    for key, all_ids in ids.items():
        at = 0
        for start, length in sorted(pieces[key]):
            assert start == at
            at += length
        assert at == len(all_ids)
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        total += at if at & (at - 1) == 0 else window
    return 1 - sum(map(len, ids.values())) / total


def test_packing(spark, documents, document_rows, tokenizer):
    padding = check(packing.report(documents, PATH).collect(), document_rows, tokenizer)
    assert padding < 0.01


def test_odd_texts(spark, odd, odd_rows, tokenizer):
    texts = [(r[0], r[1]) for r in odd_rows]
    check(packing.report(odd, PATH).collect(), texts, tokenizer)


def test_equal_lengths(spark, tokenizer):
    """One length holds nearly all rows."""
    texts = [(i, "word " * 700) for i in range(900)] + [(900 + i, "") for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert check(packing.report(docs, PATH).collect(), texts, tokenizer) < 0.01


def test_empty_table(empty):
    assert packing.report(empty, PATH).collect() == []
