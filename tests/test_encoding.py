import random

import pyarrow as pa
import pytest
from brute import encode as brute_encode
from pyspark.sql import functions as F

from lexmill.functions import merging
from lexmill.functions.merging import merge_symbols
from lexmill.operators import corpus, encoding, tokenizer
from lexmill.operators.bpe_training import train_bpe

SPECIALS = ("<|endoftext|>", "<|endoftext|><|endoftext|>")
TEXTS = [
    "",
    "q",
    "🦔",
    "Rain fell on 12 roofs, didn't it?",
    "Žluťoučký kůň, naïve coöperation 🦔",
    "Žluťoučký <|endoftext|><|endoftext|> kůň 🦔<|endoftext|>",
    "Rain fell <|endoftext|><|endoftext|> on roofs<|endoftext|>",
    "<|endoftext|>" * 3,
    "<|endoftext|>\n\n",
    "<|endoftext|>\n\nnext!",
    "spaces   at the end   ",
    "tabs\t\tand\n\n\nlines  \n x",
]


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tok = train_bpe(corpus.word_counts(docs), 256 + 1 + 60, SPECIALS[:1])
    return tokenizer.make_tokenizer(tok.vocab, tok.merges, SPECIALS)


def tables(tok):
    ids = {bytes(row.bytes): row.id for row in tokenizer.reverse_vocab(tok.vocab).collect()}
    ranks = {(bytes(r.left), bytes(r.right)): r.rank for r in tok.merges.collect()}
    return ids, ranks


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = docs.select("doc_id", F.replace("text", F.lit(". "), F.lit(".<|endoftext|>")))
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return marked.toDF("doc_id", "text").union(extra)


@pytest.mark.parametrize("way", [encoding.encode, encoding.encode_by_join])
def test_encode_and_decode(spark, trained, texts, way):
    ids, ranks = tables(trained)
    rows = way(texts, trained, ["doc_id"]).collect()
    assert len(rows) == texts.count()
    for row in rows:
        assert row.ids == brute_encode(row.text, ids, ranks, SPECIALS)
    encoded = spark.createDataFrame(
        [(row.doc_id, row.ids, row.text) for row in rows],
        "doc_id long, ids array<int>, expected string",
    )
    for back in (encoding.decode, encoding.decode_by_join):
        decoded = back(encoded, trained, ["doc_id"])
        assert decoded.where("text is null or text <> expected").isEmpty()


def test_overlapping_specials(spark, trained):
    df = spark.createDataFrame([(1, TEXTS[6])], "doc_id long, text string")
    ids = encoding.encode(df, trained, ["doc_id"]).head().ids
    by_id = {row.id: bytes(row.bytes).decode("utf-8", "replace") for row in trained.vocab.collect()}
    words = [by_id[i] for i in ids]
    assert words.count(SPECIALS[0]) == 1 and words.count(SPECIALS[1]) == 1


def test_null_and_missing(spark):
    """A vocabulary without some bytes gives NULL ids; unknown ids decode to nothing."""
    vocab = spark.createDataFrame([(0, 5, b"a"), (1, 9, b"ab"), (2, 7, b"a")], tokenizer.VOCAB_SCHEMA)
    tok = tokenizer.make_tokenizer(vocab, tokenizer.merge_table(spark, [(b"a", b"b")]))
    df = spark.createDataFrame([(1, "abac"), (2, None), (3, "")], "doc_id long, text string")
    for way in (encoding.encode, encoding.encode_by_join):
        found = {row.doc_id: row.ids for row in way(df, tok, ["doc_id"]).collect()}
        assert found == {1: [9, 7, None], 2: None, 3: []}
    ids = spark.createDataFrame(
        [(1, [9, None, 7, 1000, -3]), (2, None), (3, [])], "doc_id long, ids array<int>"
    )
    for back in (encoding.decode, encoding.decode_by_join):
        found = {row.doc_id: row.text for row in back(ids, tok, ["doc_id"]).collect()}
        assert found == {1: "aba", 2: None, 3: ""}


def test_decode_replaces_malformed_bytes(spark, trained):
    rnd = random.Random(5)
    rows = [(i, [rnd.randrange(256) for _ in range(rnd.randint(0, 12))]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    for back in (encoding.decode, encoding.decode_by_join):
        for row in back(df, trained, ["doc_id"]).collect():
            assert row.text == bytes(row.ids).decode("utf-8", errors="replace")


def test_joins_are_of_distinct_words_and_ids_by_chunk(spark, monkeypatch):
    """Copies of a text cost no more rows in a join; chunks of few rows give the same results."""
    merges = [(b"a", b"b"), (b"ab", b"c"), (b" ", b"a")]
    tok = tokenizer.tokenizer_from_merges(spark, merges, SPECIALS[:1])
    ids, ranks = tables(tok)
    texts = ["abc ab abcabc", None, "", "a b" + SPECIALS[0] + " abab"] + ["abc cab ab" * 5] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    joined, spread = [], encoding.join_spread
    monkeypatch.setattr(encoding, "join_spread", lambda rows, *more: joined.append(rows.count()) or spread(rows, *more))
    for most in (20, 10**6):
        for name in ("CHUNK_CHARS", "CHUNK_WORDS", "CHUNK_TOKENS"):
            monkeypatch.setattr(encoding, name, most)
        encoded = encoding.encode_by_join(df, tok, ["doc_id"])
        assert encoded.columns == ["doc_id", "text", "ids"]
        rows = encoded.collect()
        assert {r.doc_id: r.text for r in rows} == dict(enumerate(texts)) and len(rows) == len(texts)
        for row in rows:
            assert row.ids == (None if row.text is None else brute_encode(row.text, ids, ranks, SPECIALS[:1]))
        back = encoding.decode_by_join(encoded.select("doc_id", "ids"), tok, ["doc_id"]).collect()
        assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))
    # Three tasks, each with a few distinct words, stretches and ids.
    assert max(joined[-3:]) < 100


def test_word_ids_with_foreign_merges(spark):
    """Merge lists whose parts come later, repeat, or never occur."""
    rnd = random.Random(6)
    symbols = [b"a", b"b", b"c", b"ab", b"bc", b"aa", b"aab", b"ca"]
    merges = [(rnd.choice(symbols), rnd.choice(symbols)) for _ in range(60)]
    ranks = {pair: rank for rank, pair in enumerate(merges)}
    tokens = sorted({b"a", b"b", b"c"} | {a + b for a, b in merges})
    vocab = [(i, i, token) for i, token in enumerate(tokens)]
    ids = {token: i for i, _, token in vocab}
    tok = tokenizer.make_tokenizer(
        spark.createDataFrame(vocab, tokenizer.VOCAB_SCHEMA), tokenizer.merge_table(spark, merges)
    )
    words = list({"".join(rnd.choices("abc", k=rnd.randint(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for way in (encoding.word_ids, encoding.word_ids_by_join):
        for row in way(df, tok).collect():
            assert row.ids == brute_encode(row.word, ids, ranks)


def test_encoder_holds_a_bounded_number_of_words(monkeypatch):
    """Batches are laid out in slices of rows; the memo starts anew and keeps what was met lately."""
    rnd = random.Random(8)
    ids, ranks = {b"a": 1, b"b": 2, b"ab": 300, b"ba": 70_000}, {(b"a", b"b"): 0, (b"b", b"a"): 1}
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 8))) for _ in range(4000)] + ["ab" * 90]
    rows = [None, [], words[:1500], [], *([w] for w in words), None]
    expected = [None if r is None else [i for w in r for i in brute_encode(w, ids, ranks)] for r in rows]
    lists, sizes = pa.array(rows, pa.list_(pa.string())), []
    monkeypatch.setattr(merging, "SLICE_WORDS", 100)
    for most in (0, 50, merging.MEMO_WORDS):
        encoder = merging.WordEncoder(ids, ranks, frozenset(), most)
        plain = encoder.batch
        monkeypatch.setattr(encoder, "batch", lambda part: sizes.append(len(part.flatten())) or plain(part))
        (found,) = encoder.batches(iter([lists.slice(1)]))
        assert found.to_pylist() == expected[1:]
        assert len(encoder.memo) <= most and len(encoder.older) <= most and "ab" * 90 not in encoder.memo
    assert max(sizes) == 1500 and sorted(sizes)[-4] <= 100
    assert encoder.batches(iter([lists.slice(0, 0)])).__next__().to_pylist() == []


def test_long_word_is_merged_whole():
    ranks = {(b" " * 2**i, b" " * 2**i): i for i in range(12)}
    assert merge_symbols(b" " * 100_001, ranks) == [b" " * 4096] * 24 + [
        b" " * n for n in (1024, 512, 128, 32, 1)
    ]


def test_large_tables_are_joined(spark, trained, monkeypatch):
    ids, ranks = tables(trained)
    large = tokenizer.Tokenizer(trained.vocab, trained.merges, trained.specials)
    monkeypatch.setattr(tokenizer, "fits_broadcast", lambda *a, **k: False)
    with pytest.raises(ValueError):
        encoding.word_encoder(large)
    df = spark.createDataFrame([(1, TEXTS[5])], "doc_id long, text string")
    encoded = encoding.encode(df, large, ["doc_id"])
    assert encoded.head().ids == brute_encode(TEXTS[5], ids, ranks, SPECIALS)
    assert encoding.decode(encoded.drop("text"), large, ["doc_id"]).head().text == TEXTS[5]


def test_fits_broadcast(spark):
    merges = tokenizer.merge_table(spark, [(b"a", b"b"), (b"ab", b"c")])
    assert tokenizer.fits_broadcast(merges)
    assert not tokenizer.fits_broadcast(merges, rows=1)
    assert not tokenizer.fits_broadcast(merges, size=4)


def test_specials_are_appended_once(spark):
    vocab = spark.createDataFrame([(0, 3, b"<a>"), (1, 8, b"x")], tokenizer.VOCAB_SCHEMA)
    found = tokenizer.with_specials(vocab, ["<b>", "<a>", "<b>", "<c>"])
    assert {row.id: bytes(row.bytes) for row in found.collect()} == {
        3: b"<a>", 8: b"x", 9: b"<b>", 10: b"<c>",
    }
    empty = tokenizer.with_specials(vocab.limit(0), ["<b>"])
    assert [(row.id, bytes(row.bytes)) for row in empty.collect()] == [(0, b"<b>")]


@pytest.mark.parametrize("hot", [3, 2_000_000])
def test_long_and_frequent_words_by_join(spark, trained, monkeypatch, hot):
    """A word of 20,000 bytes, and one that makes up a third of all occurrences."""
    monkeypatch.setattr(encoding, "ROWS_OF_KEY", hot)
    ids, ranks = tables(trained)
    long = "".join("abcdefghij"[i * i % 10] for i in range(20_000))
    texts = [long, *(f"the {i} the cat the" for i in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = encoding.encode_by_join(docs, trained, ["doc_id"])
    by_broadcast = {r.doc_id: r.ids for r in encoding.encode(docs, trained, ["doc_id"]).collect()}
    assert {r.doc_id: r.ids for r in found.collect()} == by_broadcast
    assert by_broadcast[3] == brute_encode(texts[3], ids, ranks, SPECIALS)
    back = encoding.decode_by_join(found.drop("text"), trained, ["doc_id"])
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_tokens_are_gathered_for_whole_batches():
    """Sparse ids, unknown and null ones, null and empty rows, slices, and a vocabulary of nothing."""
    table = merging.TokenBytes(iter([(7, b"a"), (0, b""), (2**31 - 1, b"\xc3\xa9"), (7, b"bc")]))
    rows = [[7, 0, 7], None, [], [1, 2**31 - 1], [None, 7], [-1]]
    lists = pa.array(rows, pa.list_(pa.int32()))
    expected = [b"bcbc", None, b"", b"\xc3\xa9", b"bc", b""]
    assert table.texts(lists).to_pylist() == expected
    assert table.texts(lists.slice(2)).to_pylist() == expected[2:]
    assert table.texts(lists.slice(1, 2)).to_pylist() == [None, b""]
    nothing = merging.TokenBytes(iter([]))
    assert nothing.texts(lists).to_pylist() == [b"", None, b"", b"", b"", b""]
    assert nothing.texts(lists.slice(0, 0)).to_pylist() == []
