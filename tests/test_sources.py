import gzip
import json
import random
from collections import Counter
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.text import END_OF_TEXT
from lexmill.operators import tokenizer
from lexmill.sources import texts, token_store, tokenizer_files


def in_order(df, *order):
    return [row.text for row in df.orderBy(*order).collect()]


def test_lines_equal_python(spark, tmp_path):
    contents = ["a\nb\n", "a\r\nb\rc", "no end", "", "\n\n", "x\r", "y\r\n", "é\n \n\t"]
    for i, content in enumerate(contents):
        (tmp_path / f"{i}.txt").write_bytes(content.encode())
    found = texts.read_lines(spark, str(tmp_path))
    lines = in_order(found, "file", "split", "row", "part")
    expected = []
    for i in range(len(contents)):
        with open(tmp_path / f"{i}.txt", encoding="utf-8") as handle:
            expected += list(handle)
    assert lines == expected


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    content = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20000)) + "last"
    (tmp_path / "big.txt").write_text(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = texts.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({row.split for row in found}) > 10
    found.sort(key=lambda row: (row.file, row.split, row.row, row.part))
    assert "".join(row.text for row in found) == content


def test_marked_file_in_many_splits(spark, tmp_path):
    docs = [f"story {i}\n{'word ' * (i % 40)}\r\nend" for i in range(5000)]
    content = END_OF_TEXT.join(docs)
    (tmp_path / "big.txt").write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        whole = texts.read_marked(spark, str(tmp_path), keep_marker=True).collect()
        parts = texts.read_documents(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for rows in (whole, parts):
        assert len({row.split for row in rows}) > 10
        rows.sort(key=lambda row: (row.file, row.split, row.row))
    assert "".join(row.text for row in whole) == content.replace("\r\n", "\n")
    assert [row.text for row in parts] == [d.replace("\r\n", "\n").strip() for d in docs]


def test_documents_by_marker_or_blank_line(spark, tmp_path):
    marked = f" a\n\nb {END_OF_TEXT}\n{END_OF_TEXT}c\n"
    blank = "one\n\n\n two \n\n\n\nthree"
    (tmp_path / "1.txt").write_text(marked)
    (tmp_path / "2.txt").write_text(blank)
    found = texts.read_documents(spark, str(tmp_path))
    assert in_order(found, "file", "split", "row") == ["a\n\nb", "c", "one", "two", "three"]


def test_texts_of_large_files_come_in_rows(spark, tmp_path):
    """Files beyond the bound are cut, the others are not; texts, line ends and marks are the same."""
    large = {
        "a": "one\r\ntwo\r\n\n three " * 50, "b": "\ufeffx\ry\n" * 60, "c": "no line end " * 40, "d": "last\n" * 90,
    }
    small = {"e": "", "f": "\ufeff", "g": "short\r\n"}
    for name, text in {**large, **small}.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "h.txt.gz").write_bytes(gzip.compress(random.Random(3).randbytes(300).hex().encode()))
    expected = {row.file: row.text for row in texts.read_texts(spark, str(tmp_path)).collect()}
    rows = texts.read_texts(spark, str(tmp_path), 100).orderBy("file", "split", "row").collect()
    found, count = {}, Counter()
    for row in rows:
        found[row.file] = found.get(row.file, "") + row.text
        count[Path(row.file).name[0]] += 1
    assert found == expected and len(expected) == 7
    assert count == {"a": 151, "b": 60, "c": 1, "d": 90, "f": 1, "g": 1, "h": 1}


def test_malformed_text_is_an_error(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\n")
    for read in (texts.read_texts, texts.read_lines, texts.read_marked):
        with pytest.raises(PySparkException):
            read(spark, str(tmp_path)).collect()


def test_tokenizer_files(spark, tmp_path):
    pairs = [(b"t", b"h"), (b" ", b"\xc3"), (b"th", b"\n")]
    tok = tokenizer.tokenizer_from_merges(spark, pairs, ["<|endoftext|>"])
    vocab_path, merges_path = tokenizer_files.save_tokenizer(tok, str(tmp_path / "tok"))
    (vocab_file,) = Path(vocab_path).glob("part-*")
    vocab = json.loads(vocab_file.read_text())
    assert list(vocab) == [str(i) for i in range(260)]
    assert vocab["256"] == list(b"<|endoftext|>") and vocab["258"] == [0x20, 0xC3]
    (merges_file,) = Path(merges_path).glob("part-*")
    assert merges_file.read_text().split("\n") == ["74 68", "20 c3", "7468 0a", ""]
    again = tokenizer_files.load_tokenizer(spark, vocab_path, merges_path, ["<|endoftext|>"])
    for name in ("vocab", "merges"):
        mine, read = getattr(tok, name), getattr(again, name)
        assert mine.exceptAll(read).isEmpty() and read.exceptAll(mine).isEmpty()


def test_foreign_tokenizer_files(spark, tmp_path):
    (tmp_path / "vocab.json").write_text('{"7": [97], "1": [97], "3": [], "7": [98]}')
    (tmp_path / "merges.txt").write_text("61 62\n\n  63   64  \r\n61 62\n")
    vocab = tokenizer_files.read_vocab(spark, str(tmp_path / "vocab.json"))
    found = {row.id: bytes(row.bytes) for row in vocab.collect()}
    assert found == {7: b"b", 1: b"a", 3: b""}
    merges = tokenizer_files.read_merges(spark, str(tmp_path / "merges.txt"))
    rows = [(row.rank, bytes(row.left), bytes(row.right)) for row in merges.collect()]
    assert sorted(rows) == [(0, b"a", b"b"), (1, b"c", b"d"), (2, b"a", b"b")]
    ranks = tokenizer.merge_ranks(merges)
    assert {(bytes(r.left), bytes(r.right)): r.rank for r in ranks.collect()} == {
        (b"a", b"b"): 2, (b"c", b"d"): 1,
    }


def test_printable_alphabet(spark, tmp_path):
    alphabet = {row.byte: row.ch for row in tokenizer_files.byte_alphabet(spark).collect()}
    assert len(set(alphabet.values())) == 256 and alphabet[32] == "Ġ" and alphabet[10] == "Ċ"
    tokens = {"".join(alphabet[b] for b in data): i for i, data in enumerate([b" th", bytes(range(256))])}
    (tmp_path / "vocab.json").write_text(json.dumps(tokens))
    (tmp_path / "merges.txt").write_text(f"{alphabet[32]} t\n\n{alphabet[0xC3]} {alphabet[0xA9]}\n")
    vocab = tokenizer_files.read_printable_vocab(spark, str(tmp_path / "vocab.json"))
    assert {r.id: bytes(r.bytes) for r in vocab.collect()} == {0: b" th", 1: bytes(range(256))}
    merges = tokenizer_files.read_printable_merges(spark, str(tmp_path / "merges.txt"))
    rows = [(r.rank, bytes(r.left), bytes(r.right)) for r in merges.orderBy("rank").collect()]
    assert rows == [(0, b" ", b"t"), (1, b"\xc3", b"\xa9")]


def test_two_byte_profile(spark, tmp_path):
    schema = "doc_id long, ids array<int>"
    good = spark.createDataFrame([(1, [0, 65535]), (2, [])], schema)
    token_store.write_tokens(good, str(tmp_path / "good"))
    stored = spark.read.parquet(str(tmp_path / "good"))
    assert {row.doc_id: row.n for row in stored.collect()} == {1: 2, 2: 0}
    for ids in ([65536], [None], [-1]):
        bad = spark.createDataFrame([(1, ids)], schema)
        with pytest.raises(PySparkException):
            token_store.write_tokens(bad, str(tmp_path / "bad"))
    token_store.write_tokens(spark.createDataFrame([(1, [65536])], schema), str(tmp_path / "wide"), False)
    assert spark.read.parquet(str(tmp_path / "wide")).select(F.sum("n")).head()[0] == 1


def test_output_path():
    assert token_store.ids_path("/data/a.b/corpus.txt") == "/data/a.b/corpus_ids"
    assert token_store.ids_path("corpus.txt", "/x/y") == "/x/y"


def test_documents_with_windows_line_ends(spark, tmp_path):
    (tmp_path / "a file.txt").write_bytes(b"one\r\n\r\ntwo\r\n\r\n\r\nthree\rstill\n \nhere")
    (tmp_path / "b.txt").write_bytes(f"x{END_OF_TEXT} y\r\n\r\nz{END_OF_TEXT}{END_OF_TEXT}w".encode())
    found = texts.read_documents(spark, str(tmp_path))
    assert in_order(found, "file", "split", "row") == [
        "one", "two", "three\nstill\n \nhere", "x", "y\n\nz", "w"
    ]


def test_documents_of_files_in_many_splits(spark, tmp_path):
    docs = [f"story {i}\n{'word ' * (1 + i % 40)}\nend" for i in range(3000)]
    (tmp_path / "1 blank.txt").write_bytes("\r\n\r\n".join(docs).replace("\n", "\r\n").replace("\r\r", "\r").encode())
    (tmp_path / "2 marked.txt").write_text(END_OF_TEXT.join(docs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = texts.read_documents(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({(row.file, row.split) for row in found}) > 20
    found.sort(key=lambda row: (row.file, row.split, row.row))
    assert [row.text for row in found] == [d.strip() for d in docs] * 2


@pytest.mark.parametrize("content", ["\ufeffa\nb", "\ufeffa\nb\n", "\ufeff\n", "a\ufeff\n"])
def test_byte_order_marks_stay(spark, tmp_path, content):
    (tmp_path / "a.txt").write_bytes(content.encode())
    lines = in_order(texts.read_lines(spark, str(tmp_path)), "row", "part")
    assert "".join(lines) == content
    assert "".join(in_order(texts.read_pieces(spark, str(tmp_path)), "row")) == content


def test_compressed_files_are_refused(spark, tmp_path):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    with pytest.raises(PySparkException):
        texts.read_lines(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("end", ["", "\n", "\n\n", " \n", "\r\n", "\r"])
def test_pieces_keep_pretokens_and_specials_whole(spark, tmp_path, end):
    specials = [END_OF_TEXT, "<|pad|>"]
    parts = ["plain text", "ends in space ", "", " ", "\tx", f"a{END_OF_TEXT}b", "<|pad|>", "don't 12 3", "é\r", ""]
    content = "\n".join(parts[i * 7 % 10] + "y" * (i % 3) for i in range(1200)) + end
    (tmp_path / "a.txt").write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        pieces = texts.read_pieces(spark, str(tmp_path))
        rows = pieces.withColumn("words", T.words(F.col("text"), specials)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows.sort(key=lambda row: (row.split, row.row))
    assert len({row.split for row in rows}) > 5 and len(rows) > 300
    whole = content.replace("\r\n", "\n").replace("\r", "\n")
    assert "".join(row.text for row in rows) == whole
    one = spark.createDataFrame([(whole,)], "text string").select(T.words(F.col("text"), specials)).first()[0]
    assert [w for row in rows for w in row.words] == one


def test_pieces_of_several_files(spark, tmp_path):
    contents = ["a\nb\n", "a\n\n", "\n", "c", "", "x \ny\n \n", "\n\nz"]
    for i, content in enumerate(contents):
        (tmp_path / f"{i}.txt").write_bytes(content.encode())
    found = texts.read_pieces(spark, str(tmp_path)).collect()
    found.sort(key=lambda row: (row.file, row.split, row.row))
    joined = {}
    for row in found:
        joined[row.file[-5]] = joined.get(row.file[-5], "") + row.text
    assert joined == {str(i): content for i, content in enumerate(contents) if content}


@pytest.mark.parametrize(
    "content",
    ['{"0": [97], "1": [98', '{"0": [300]}', '{"0": [-1]}', '{"0": ["x"]}', '{"0": [null]}', '{"0": 5}',
     '{"0": null}', "[]", "", '{"x": [97]}'],
)
def test_corrupt_vocabularies_are_refused(spark, tmp_path, content):
    (tmp_path / "vocab.json").write_text(content)
    with pytest.raises((PySparkException, Py4JJavaError, ValueError)):
        tokenizer_files.read_vocab(spark, str(tmp_path / "vocab.json")).collect()


@pytest.mark.parametrize("line", ["61", "61 62 63", "6 62", "61 zz", "61 622", "0x61 62"])
def test_corrupt_merges_are_refused(spark, tmp_path, line):
    (tmp_path / "merges.txt").write_text(f"61 62\n{line}\n")
    with pytest.raises(PySparkException):
        tokenizer_files.read_merges(spark, str(tmp_path / "merges.txt")).collect()


def test_large_tokenizers_are_stored_as_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenizer_files, "FILE_ROWS", 2)
    tok = tokenizer.tokenizer_from_merges(spark, [(b"t", b"h"), (b"th", b"e")], ["<|endoftext|>"])
    paths = tokenizer_files.save_tokenizer(tok, str(tmp_path / "tok"))
    assert paths[0].endswith("_vocab.parquet") and paths[1].endswith("_merges.txt")
    again = tokenizer_files.load_tokenizer(spark, *paths, ["<|endoftext|>"])
    assert again.vocab.exceptAll(tok.vocab).isEmpty() and again.merges.exceptAll(tok.merges).isEmpty()


@pytest.mark.parametrize("content", ['{"Ġa": 0, "文": 1}', '{"a b": 0}'])
def test_characters_that_stand_for_no_byte_are_refused(spark, tmp_path, content):
    (tmp_path / "vocab.json").write_text(content)
    with pytest.raises(PySparkException):
        tokenizer_files.read_printable_vocab(spark, str(tmp_path / "vocab.json")).collect()


@pytest.mark.parametrize("line", ["a", "a b c", "a  b", "a 文", "a "])
def test_corrupt_printable_merges_are_refused(spark, tmp_path, line):
    (tmp_path / "merges.txt").write_text(f"#version: 0.2\na b\n\n{line}\n")
    with pytest.raises(PySparkException):
        tokenizer_files.read_printable_merges(spark, str(tmp_path / "merges.txt")).collect()


def test_printable_files_hold_every_byte(spark, tmp_path):
    pairs = [(bytes([i]), bytes([255 - i])) for i in range(256)]
    tok = tokenizer.tokenizer_from_merges(spark, pairs, ['<|"end"\\|>'])
    vocab, merges = tokenizer_files.write_printable(tok, str(tmp_path / "tok"))
    again = tokenizer_files.read_printable_vocab(spark, vocab).select("id", "bytes")
    expected = tok.vocab.groupBy("bytes").agg(F.max("id").alias("id")).select("id", "bytes")
    assert again.exceptAll(expected).isEmpty() and expected.exceptAll(again).isEmpty()
    found = tokenizer_files.read_printable_merges(spark, merges).orderBy("rank").collect()
    assert [(bytes(r.left), bytes(r.right)) for r in found] == pairs


@pytest.mark.parametrize("cut", [texts.PIECES, texts.EMPTY_LINES])
def test_only_the_ends_of_splits_are_moved(spark, tmp_path, cut):
    content = "".join(f"line {i}\n\n{'x ' * (i % 30)}\n" for i in range(4000))
    (tmp_path / "a.txt").write_text(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        found = texts.fragments(spark, str(tmp_path), cut)
        ends = found.groupBy("split").agg(F.count_if(F.col("kind") != texts.INNER).alias("ends")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(ends) > 10 and max(r.ends for r in ends) <= 2
    assert found.where(F.col("kind") == texts.INNER).count() > 2000


def test_a_document_over_many_splits(spark, tmp_path):
    """Splits without any place to cut, line ends cut in two, and marks at the very end."""
    words = "\r\n".join(" ".join(f"w{i * j}" for j in range(9)) + " " for i in range(2000))
    (tmp_path / "a.txt").write_bytes((words + "\r\n\r\n\r\n" + words + "\r").encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = in_order(texts.read_documents(spark, str(tmp_path)), "file", "split", "row")
        pieces = in_order(texts.read_pieces(spark, str(tmp_path)), "file", "split", "row")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plain = words.replace("\r\n", "\n")
    assert found == [plain.strip()] * 2
    assert "".join(pieces) == plain + "\n\n\n" + plain + "\n"
