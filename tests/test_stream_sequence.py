"""A stream that appends to one token sequence: against the ids of the lines, and against the batch job."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import sequence as batch
from lexmill.operators.corpus import word_counts
from lexmill.operators.bpe_training import train_bpe
from lexmill.operators.encoding import encode
from lexmill.streaming import encoding, sequence

SIZE = 16


def flat(blocks, size=SIZE):
    """All ids in order; blocks must follow each other, be there once, and be full but for the last."""
    rows = blocks.orderBy("block").collect()
    assert [row.block for row in rows] == list(range(len(rows)))
    assert all(row.n == size for row in rows[:-1]) and all(row.n == len(row.ids) for row in rows)
    return [i for row in rows for i in row.ids]


def lines_of(spark, rnd, lengths):
    """Lines of two files in three splits, and their ids in order."""
    rows, ids = [], []
    for i, length in enumerate(lengths):
        part = [rnd.randrange(900) for _ in range(length)]
        rows.append((f"file {i * 2 // len(lengths)}", i * 3 // len(lengths), i, 0, part, length))
        ids += part
    rnd.shuffle(rows)
    shape = "file string, split long, row long, part int, ids array<int>, n int"
    return spark.createDataFrame(rows, shape), ids


EPOCHS = [[5, 3], [0, 1], [40, 0, 2, 9, 16, 1], [], [0, 0], [7], [16] * 3, [100]]


@pytest.mark.parametrize("size", [1, SIZE, 1000])
def test_epochs_make_one_sequence(spark, tmp_path, size):
    """Epochs that fill no block, several, or hold nothing; each is tried twice."""
    rnd, out, expected = random.Random(size), str(tmp_path / "out"), []
    for epoch, lengths in enumerate(EPOCHS):
        lines, ids = lines_of(spark, rnd, lengths)
        expected += ids
        for _ in range(2 if epoch % 3 == 2 else 1):
            sequence.append_epoch(lines, out, epoch, size)
        if epoch in (0, 3, 7):
            assert flat(sequence.read_sequence(spark, out, size), size) == expected
            assert sequence.settled_total(spark, out, epoch) == len(expected)


def test_an_epoch_counts_once_it_is_in_the_ledger(spark, tmp_path):
    rnd, out = random.Random(0), str(tmp_path / "out")
    first, ids = lines_of(spark, rnd, [20, 5])
    second, more = lines_of(spark, rnd, [30])
    sequence.append_epoch(first, out, 0, SIZE)
    sequence.append_epoch(second, out, 1, SIZE)
    ledger = tmp_path / "out" / "ledger" / "epoch=1"
    for file in ledger.iterdir():
        file.unlink()  # as if the driver was lost before it wrote the row
    assert flat(sequence.read_sequence(spark, out, SIZE)) == ids
    sequence.append_epoch(second, out, 1, SIZE)
    assert flat(sequence.read_sequence(spark, out, SIZE)) == ids + more


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    """Files that arrive in three turns, one of them with an empty file only."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(30).collect()
    texts = [row.text for row in rows]
    docs = spark.createDataFrame([(0, "\n".join(texts))], "doc_id long, text string")
    tok = train_bpe(word_counts(docs), 270, [])
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    written = []
    for turn in (texts[:10], [""], texts[10:]):
        for text in turn:
            (source / f"{len(written):03}.txt").write_text(text, newline="")
            written.append(text)
        records = encoding.stream_records(spark, str(source))
        sequence.write_sequence_stream(
            records, tok, out, str(tmp_path / "checkpoint"), SIZE
        ).awaitTermination()
    lines = [line for text in written for line in text.splitlines(keepends=True) if "\r" not in line]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    ids = encode(table, tok, ["doc_id"]).withColumn("n", F.size("ids"))
    expected = flat(batch.token_blocks(batch.token_offsets(ids), SIZE))
    blocks = sequence.read_sequence(spark, out, SIZE)
    assert flat(blocks) == expected
    windows = batch.sample_windows(blocks, 40, 9, 3, SIZE).collect()
    assert len(windows) == 40
    assert all(row.x == expected[row.start : row.start + 9] for row in windows)
