import random
from collections import Counter

import pytest
from brute import (
    byte_words,
    merge_words,
    pair_counter,
    sequential_merges,
    triple_counter,
)
from pyspark.sql import functions as F

from lexmill.operators import bpe_training, corpus, pair_index, pairs, training_journal
from lexmill.operators.bpe_training import learn_merges, train_bpe
from lexmill.operators.merge_choice import choose_merges


def random_words(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh"[: rnd.randint(1, 8)]
    words = Counter()
    for _ in range(rnd.randint(1, 40)):
        words["".join(rnd.choices(letters, k=rnd.randint(1, 14)))] += rnd.randint(1, 9)
    return words


def chosen_merges(words, limit, candidates):
    """The round loop with counts from plain Python; returns the merges and the round sizes."""
    merges, sizes = [], []
    tokens = {f"{b:02X}" for b in range(256)}
    while len(merges) < limit:
        counted = pair_counter(words)
        if not counted:
            break
        ranked = sorted(counted, key=lambda p: (counted[p], p), reverse=True)[:candidates]
        listed = [(a.hex().upper(), b.hex().upper(), counted[a, b]) for a, b in ranked]
        unlisted = listed[-1][2] if len(ranked) == candidates else 0
        triples = {
            (x.hex().upper(), y.hex().upper(), z.hex().upper()): n
            for (x, y, z), n in triple_counter(words).items()
            if (x, y) in ranked and (y, z) in ranked
        }
        batch = choose_merges(listed, unlisted, triples, tokens, limit - len(merges))
        assert batch
        sizes.append(len(batch))
        for a, b in batch:
            tokens.add(a + b)
            pair = bytes.fromhex(a), bytes.fromhex(b)
            merges.append(pair)
            words = merge_words(words, pair)
    return merges, sizes


@pytest.mark.parametrize("candidates", [1, 2, 5, 20, 256])
def test_chosen_merges_equal_the_loop(candidates):
    for seed in range(120):
        words = byte_words(random_words(seed * 7 + candidates))
        expected = sequential_merges(words, 25)
        assert chosen_merges(words, 25, candidates)[0] == expected


def test_choice_takes_several_merges():
    counted = Counter({"the": 50, "cat": 30, "dog": 20, "sun": 10})
    merges, sizes = chosen_merges(byte_words(counted), 8, 256)
    assert merges == sequential_merges(byte_words(counted), 8)
    assert max(sizes) > 1


def test_choice_ends_at_a_token_that_exists():
    top = [("61", "62", 9), ("63", "64", 5)]
    assert choose_merges(top, 0, {}, set(), 10) == [("61", "62"), ("63", "64")]
    assert choose_merges(top, 0, {}, {"6162"}, 10) == [("61", "62")]


def test_choice_does_not_pass_unlisted_pairs():
    top = [("61", "62", 9), ("63", "64", 5)]
    assert choose_merges(top, 5, {}, set(), 10) == [("61", "62")]


def counts_frame(spark, counted):
    return spark.createDataFrame(list(counted.items()), "word string, cnt long")


@pytest.mark.parametrize("seed, candidates", [(3, 6), (11, 2), (12, 40), (13, 1), (14, 512)])
def test_training_equals_the_loop(spark, seed, candidates):
    counted = random_words(seed) + Counter({"aaaaaaa": 5, "ababab": 4, "éé": 3})
    found = learn_merges(counts_frame(spark, counted), 20, candidates, rounds_per_write=2)
    expected = sequential_merges(byte_words(counted), 20)
    assert [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in found] == expected


def test_training_on_documents_equals_the_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = corpus.word_counts(docs)
    counted = Counter({row.word: row.cnt for row in counts.collect()})
    expected = sequential_merges(byte_words(counted), 40)
    found = train_bpe(counts, 256 + 40).merges.orderBy("rank").collect()
    assert [(bytes(row.left), bytes(row.right)) for row in found] == expected


def test_vocabulary_numbers(spark):
    tok = train_bpe(counts_frame(spark, {"aab": 3}), 260, ["<s>", "<s>"])
    vocab = {row.id: bytes(row.bytes) for row in tok.vocab.collect()}
    assert vocab[97] == b"a" and vocab[256] == vocab[257] == b"<s>"
    assert [vocab[258], vocab[259]] == [b"ab", b"aab"]
    assert len(vocab) == 260


def test_small_vocabulary_has_no_merges(spark):
    tok = train_bpe(counts_frame(spark, {"aab": 3}), 100, ["<s>"])
    assert tok.vocab.count() == 257 and tok.merges.isEmpty()


def test_training_stops_without_pairs(spark):
    tok = train_bpe(counts_frame(spark, {"aab": 3, "c": 9}), 1000)
    assert tok.merges.count() == 2 and tok.vocab.count() == 258


def test_special_tokens_are_never_merged(spark):
    texts = spark.createDataFrame(
        [("one<|endoftext|>two<|endoftext|>",), ("<|endoftext|>three",)] * 9, "text string"
    )
    tok = train_bpe(corpus.word_counts(texts, ["<|endoftext|>"]), 300, ["<|endoftext|>"])
    others = [bytes(row.bytes) for row in tok.vocab.collect() if row.id != 256]
    assert others and not any(b"<|" in token for token in others)


def test_hot_word_is_counted_whole(spark):
    texts = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), "id")).alias("text")
    )
    counted = {row.word: row.cnt for row in corpus.word_counts(texts).collect()}
    assert counted["hot"] == 1667
    assert sum(counted.values()) == sum(2 if i % 3 else 1 for i in range(5000))


def test_changed_words(spark):
    words = spark.createDataFrame(
        [("(61)(62)(61)(62)", "(6162)(6162)", 2), ("(63)(64)", "(63)(64)", 7)],
        "before string, sym string, cnt long",
    )
    changes = pairs.pair_counts(pairs.changed_words(words))
    assert {row.pair: row.cnt for row in changes.collect()} == {
        "(61)(62)": -4, "(62)(61)": -2, "(6162)(6162)": 2,
    }


def test_merge_pairs_left_to_right(spark):
    df = spark.createDataFrame([("(61)(61)(61)(62)",)], "sym string")
    merged = pairs.merge_pairs(F.col("sym"), [("61", "61"), ("61", "62")])
    assert df.select(merged).head()[0] == "(6161)(6162)"


def test_a_vocabulary_of_useful_size(spark, sf_dir):
    """243 merges, as many as a vocabulary of 500 has, against one merge at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(12)
    counts = corpus.word_counts(docs)
    words = {tuple(bytes([b]) for b in row.word.encode()): row.cnt for row in counts.collect()}
    found = learn_merges(counts, 243)
    assert [tuple(map(bytes.fromhex, pair)) for pair in found] == sequential_merges(words, 243)


@pytest.mark.parametrize("seed, candidates", [(3, 6), (12, 40)])
def test_rounds_over_the_index_equal_the_loop(spark, monkeypatch, seed, candidates):
    """From the first round on, with generations put together often."""
    monkeypatch.setattr(pair_index, "GENERATIONS", 3)
    counted = random_words(seed) + Counter({"aaaaaaa": 5, "ababab": 4, "éé": 3, "abcabcabd": 7})
    found = learn_merges(counts_frame(spark, counted), 20, candidates, index_share=1.0)
    expected = sequential_merges(byte_words(counted), 20)
    assert [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in found] == expected


def test_a_lookup_opens_the_directories_of_its_pairs(spark, tmp_path):
    rows = [(i, "".join(f"({c:02X})" for c in range(i % 40, i % 40 + 6)), i) for i in range(400)]
    words = spark.createDataFrame(rows, "word long, sym string, cnt long")
    index = pair_index.build(words, str(tmp_path), 0)
    found = index.postings(["(07)(08)"])
    slots = {path.split("slot=")[1].split("/")[0] for path in
             (r[0] for r in found.select(F.input_file_name()).distinct().collect())}
    assert len(slots) == 1 < index.slots
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "slot" in plan.split("PartitionFilters")[1][:80]
    assert {r.word for r in index.holders(["(07)(08)"]).collect()} == {r[0] for r in rows if "(07)(08)" in r[1]}


def test_an_index_follows_its_words(spark, tmp_path):
    """Pairs that are lost, kept, and held again, over several rounds and put together."""
    rows = [(1, "(61)(62)(63)", 4), (2, "(62)(63)", 2), (3, "(64)(65)", 1)]
    index = pair_index.build(spark.createDataFrame(rows, "word long, sym string, cnt long"), str(tmp_path), 0)
    change = "word long, before string, sym string, cnt long"
    index = index.appended(spark.createDataFrame([(1, "(61)(62)(63)", "(6162)(63)", 4)], change))
    index = index.appended(spark.createDataFrame([(2, "(62)(63)", "(6263)", 2)], change))
    for index in (index, index.rebased()):
        assert index.holders(["(62)(63)"]).collect() == []
        assert [tuple(r) for r in index.holders(["(6162)(63)", "(62)(63)"]).collect()] == [(1, "(6162)(63)", 4)]
        assert {r.word for r in index.words().collect()} == {1, 3}


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_an_interrupted_training_goes_on(spark, tmp_path, monkeypatch, share):
    """A driver lost after some rounds; another one needs the folder only."""
    counted = random_words(5) + Counter({"abcabcabd": 7, "éé": 3})
    expected = [tuple(x.hex().upper() for x in pair) for pair in sequential_merges(byte_words(counted), 12)]
    counts, folder = counts_frame(spark, counted), str(tmp_path / "training")
    rounds, update = [], bpe_training.update_candidates

    def failing(*args):
        rounds.append(args)
        if len(rounds) == 4:
            raise KeyboardInterrupt
        return update(*args)

    monkeypatch.setattr(bpe_training, "update_candidates", failing)
    with pytest.raises(KeyboardInterrupt):
        learn_merges(counts, 12, 3, rounds_per_write=2, folder=folder, index_share=share)
    settled = training_journal.Journal(spark, folder).read()
    assert 0 < len(settled.merges) < 12 and list(settled.merges) == expected[: len(settled.merges)]
    monkeypatch.setattr(bpe_training, "update_candidates", update)
    none = spark.createDataFrame([], counts.schema)
    assert learn_merges(none, 12, 3, rounds_per_write=2, folder=folder, index_share=share) == expected
