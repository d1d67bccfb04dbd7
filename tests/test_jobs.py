import random

import numpy as np
import pytest
from brute import encode as brute_encode

from lexmill.__main__ import main
from lexmill.functions.text import END_OF_TEXT
from lexmill.operators import encoding, tokenizer
from lexmill.plans import jobs
from lexmill.session import stored
from lexmill.sources import texts
from lexmill.sources.tokenizer_files import load_tokenizer
from lexmill.streaming import encoding as streaming


@pytest.fixture(scope="module")
def dataset(spark, sf_dir, tmp_path_factory):
    """Text files with markers, and a tokenizer trained on them."""
    folder = tmp_path_factory.mktemp("dataset")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    text = "".join(f"{row.text}\n\n  {END_OF_TEXT}\n" for row in rows)
    (folder / "corpus.txt").write_text(text, newline="")
    jobs.train_tokenizer(spark, str(folder / "corpus.txt"), 300, output_dir=str(folder), prefix="t")
    paths = str(folder / "t_vocab.json"), str(folder / "t_merges.txt")
    tok = load_tokenizer(spark, *paths, [END_OF_TEXT])
    ids = {bytes(row.bytes): row.id for row in tokenizer.reverse_vocab(tok.vocab).collect()}
    ranks = {(bytes(r.left), bytes(r.right)): r.rank for r in tok.merges.collect()}
    return folder, text, paths, tok, lambda part: brute_encode(part, ids, ranks, [END_OF_TEXT])


def sequence_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/blocks").orderBy("block").collect()
    return [i for row in rows for i in row.ids]


def test_tokenize_lines(spark, dataset):
    folder, text, paths, _, encode = dataset
    out = jobs.tokenize_dataset(spark, str(folder / "corpus.txt"), *paths, block_tokens=100)
    assert out == str(folder / "corpus_ids")
    flat = sequence_of(spark, out)
    assert flat == [i for line in text.splitlines(keepends=True) for i in encode(line)]
    rows = jobs.training_windows(spark, out, 50, 16, seed=1, block_tokens=100).collect()
    assert len(rows) == 50
    for row in rows:
        assert row.x == flat[row.start : row.start + 16]
        assert row.y == flat[row.start + 1 : row.start + 17]


def test_tokenize_documents(spark, dataset):
    folder, text, paths, _, encode = dataset
    out = jobs.tokenize_dataset(
        spark, str(folder / "corpus.txt"), *paths, output=str(folder / "docs"), unit="document"
    )
    assert sequence_of(spark, out) == encode(text)


def test_compression_report(spark, dataset):
    folder, text, paths, _, encode = dataset
    (folder / "plain.txt").write_text("one two\n\n\nthree\n\n")
    corpora = [
        jobs.Corpus("marked", str(folder / "corpus.txt"), *paths),
        jobs.Corpus("plain", str(folder / "plain.txt"), *paths),
    ]
    found = {row.corpus: row for row in jobs.compression_report(spark, corpora).collect()}
    documents = [part.strip() for part in text.split(END_OF_TEXT) if part.strip()]
    sample = random.Random(42).sample(documents, 10)
    size = sum(len(part.encode()) for part in sample)
    tokens = sum(len(encode(part)) for part in sample)
    assert (found["marked"].n_bytes, found["marked"].n_tokens) == (size, tokens)
    assert found["marked"].bytes_per_token == round(size / tokens, 3)
    assert found["plain"].n_bytes == len("one two") + len("three")


def test_compression_of_nothing_is_infinite(spark, dataset):
    folder, _, paths, _, _ = dataset
    (folder / "empty.txt").write_text("\n\n")
    row = jobs.compression_report(spark, [jobs.Corpus("e", str(folder / "empty.txt"), *paths)]).head()
    assert row.bytes_per_token == float("inf")


@pytest.mark.parametrize("broadcast", [True, False])
def test_stream_equals_batch(spark, dataset, tmp_path, monkeypatch, broadcast):
    _, text, _, tok, encode = dataset
    if not broadcast:
        monkeypatch.setattr(tokenizer, "fits_broadcast", lambda *a: False)
        tok = tokenizer.Tokenizer(tok.vocab, tok.merges, tok.specials)
    source = tmp_path / "in"
    source.mkdir()
    files = {f"{i}.txt": part for i, part in enumerate([text[:3000], "no end", text[3000:4000]])}
    for name in list(files)[:2]:
        (source / name).write_text(files[name], newline="")

    def run():
        records = streaming.stream_records(spark, str(source), batch_bytes=1024)
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
        query = streaming.write_encoded_stream(records, tok, out, checkpoint)
        query.awaitTermination()
        return spark.read.parquet(out).collect()

    run()
    for name in list(files)[2:]:
        (source / name).write_text(files[name], newline="")
    rows = run()
    found = {}
    for row in sorted(rows, key=lambda row: (row.split, row.row, row.part)):
        found.setdefault(row.file.rsplit("/", 1)[1], []).append(row.ids)
    assert found == {
        name: [encode(line) for line in content.splitlines(keepends=True)]
        for name, content in files.items()
    }


def test_stream_of_a_file_in_many_splits(spark, dataset, tmp_path):
    """A file many times larger than what a task reads."""
    _, text, _, tok, encode = dataset
    source = tmp_path / "in"
    source.mkdir()
    (source / "big.txt").write_text(text[:60_000], newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        records = streaming.stream_records(spark, str(source))
        out = str(tmp_path / "out")
        streaming.write_encoded_stream(records, tok, out, str(tmp_path / "cp")).awaitTermination()
        rows = spark.read.parquet(out).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows.sort(key=lambda row: (row.split, row.row, row.part))
    assert len({row.split for row in rows}) > 10
    assert [row.ids for row in rows] == [encode(line) for line in text[:60_000].splitlines(True)]


def test_command_line(spark, dataset, tmp_path, capsys):
    folder, text, (vocab, merges), _, encode = dataset
    corpus = str(folder / "corpus.txt")
    assert main(["train", corpus, "-o", str(tmp_path), "-v", "280", "-p", "x"]) == 0
    assert "280 tokens, 23 merges" in capsys.readouterr().out
    out = str(tmp_path / "ids")
    assert main(["tokenize", "--input", corpus, "--vocab", vocab, "--merges", merges, "--output", out]) == 0
    assert len(sequence_of(spark, out)) == sum(len(encode(x)) for x in text.splitlines(True))
    wide = ["-s", END_OF_TEXT, "<|pad|>", "--wide", "--npy", str(tmp_path / "ids.npy")]
    assert main(["tokenize", "--input", corpus, "--vocab", vocab, "--merges", merges, "--output", out, *wide]) == 0
    found = np.load(tmp_path / "ids.npy")
    assert found.dtype == np.uint32 and found.tolist() == [i for x in text.splitlines(True) for i in encode(x)]
    assert main(["train", corpus, "-o", str(tmp_path), "-v", "270", "--journal", str(tmp_path / "rounds")]) == 0
    assert "270 tokens, 13 merges" in capsys.readouterr().out
    assert main(["report", "--corpus", "a", corpus, vocab, merges, "--n", "3"]) == 0
    assert "a bytes/token: " in capsys.readouterr().out
    assert main(["train", str(tmp_path / "missing.txt")]) == 1


def test_small_stream_batches_use_all_cores(spark, dataset, tmp_path, monkeypatch):
    """One split is encoded by as many tasks as there are cores, and its files are not counted by jobs."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_bytes(b"".join(b"line %d of some\r\nwords\n" % i for i in range(2000)) + b"end")
    records = spark.read.text(str(source), lineSep="\n").select("value", "_metadata")
    asked = []
    monkeypatch.setattr(texts, "stored", lambda df, path: asked.append(path) or stored(df, path))
    tok = tokenizer.tokenizer_from_merges(spark, [(b"i", b"n")])
    found = streaming.encode_lines(records, tok)
    assert len(asked) == 1
    monkeypatch.undo()
    assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    key = ["file", "split", "row", "part"]
    lines = texts.read_lines(spark, str(source))
    wanted = encoding.encode(lines, tok, key).select(*key, "ids")
    rows = [row.ids for row in found.orderBy(key).collect()]
    assert rows == [row.ids for row in wanted.orderBy(key).collect()]
    assert len(rows) == 4001 and rows[-1] == list(b"end")
