import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions.blocks import BlockCutter
from lexmill.operators import sampling, sequence
from lexmill.sources import token_store


def tokens_frame(spark, seed, docs):
    """Documents of very uneven length under uneven keys; one holds a third of all tokens."""
    rnd = random.Random(seed)
    keys = sorted(rnd.sample(range(1000), docs - 2) + [10**12, 10**12 + 1])
    lengths = [rnd.choice([0, 1, 2, 5, 30]) for _ in keys]
    lengths[docs // 2] = sum(lengths) // 2
    rows, flat = [], []
    for key, length in zip(keys, lengths):
        ids = [rnd.randrange(500) for _ in range(length)]
        rows.append((key, ids, length, len(flat)))
        flat += ids
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, n int, expected long"), flat


def test_offsets(spark):
    tokens, _ = tokens_frame(spark, 1, 200)
    offsets = sequence.token_offsets(tokens)
    assert offsets.count() == 200 and offsets.where("start <> expected").isEmpty()
    assert offsets.select("bucket").distinct().count() > 1


def test_prefix_sums_over_many_ranges(spark):
    """10**5 totals, in an order of two columns, are summed in several tasks."""
    rows = spark.range(100_000).select(
        F.concat(F.lit("file "), F.col("id") % 7).alias("file"), (F.col("id") * 37).alias("split"),
        (F.col("id") % 11).alias("n"),
    )
    found = sequence.prefix_sums(rows.repartition(5), ["file", "split"], "n", "start")
    assert found.columns == ["file", "split", "n", "start"]
    total = 0
    for row in found.orderBy("file", "split").collect():
        assert row.start == total
        total += row.n
    assert "SinglePartition" not in found.select("split", "start").where("split > 0")._jdf.queryExecution().toString().split("Broadcast")[0]
    assert sequence.prefix_sums(rows.limit(0), ["file", "split"], "n", "start").isEmpty()


@pytest.mark.parametrize("size", [1, 3, 8, 1000])
def test_blocks_are_cut_as_rows_come(size):
    """A task that holds a bucket's rows in order makes pieces of its ends alone, and of gaps."""
    rnd = random.Random(size)
    flat = [rnd.choice([*range(9), None]) for _ in range(400)]
    stretches, at = [], 5
    while at < 395:
        stop = min(395, at + rnd.choice([1, 2, 9, 40]))
        stretches.append((at, flat[at:stop]))
        at = stop
    shape = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def cut(stretches, rows):
        batches = (
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*stretches[i : i + rows]), shape.types)], shape.names)
            for i in range(0, len(stretches), rows)
        )
        return [row for batch in BlockCutter(size).batches(batches) for row in batch.to_pylist()]

    for rows in (1, 4, 1000):
        for some in (stretches, stretches[:3] + stretches[4:], rnd.sample(stretches, len(stretches))):
            found = cut(some, rows)
            ids = {row["at"] + i: x for row in found for i, x in enumerate(row["ids"])}
            assert ids == {start + i: x for start, part in some for i, x in enumerate(part)}
            assert sum(len(row["ids"]) for row in found) == len(ids)
            for row in found:
                assert row["at"] // size == row["block"] == (row["at"] + len(row["ids"]) - 1) // size
                assert row["whole"] == (len(row["ids"]) == size)
        assert sum(not row["whole"] for row in cut(stretches, rows)) <= 2


def test_missing_key_is_an_error(spark):
    rows = spark.createDataFrame([(1, 3), (None, 4)], "doc_id long, n int")
    with pytest.raises(ValueError):
        sequence.token_offsets(rows)


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_blocks(spark, size):
    tokens, flat = tokens_frame(spark, 2, 60)
    rows = sequence.token_blocks(sequence.token_offsets(tokens), size).orderBy("block").collect()
    assert [row.block for row in rows] == list(range(-(-len(flat) // size)))
    assert [row.n for row in rows[:-1]] == [size] * (len(rows) - 1)
    assert [i for row in rows for i in row.ids] == flat


@pytest.mark.parametrize("context", [1, 7, 40])
def test_windows(spark, tmp_path, context):
    tokens, flat = tokens_frame(spark, 3, 80)
    blocks = sequence.token_blocks(sequence.token_offsets(tokens), 16)
    token_store.write_blocks(blocks, str(tmp_path / "blocks"))
    stored = token_store.read_blocks(spark, str(tmp_path / "blocks"))
    assert sequence.token_total(stored) == len(flat)
    rows = sequence.sample_windows(stored, 300, context, 5, 16).collect()
    assert len(rows) == 300
    for row in rows:
        assert row.x == flat[row.start : row.start + context]
        assert row.y == flat[row.start + 1 : row.start + 1 + context]
        assert len(row.y) == context


def test_starts_are_uniform(spark):
    draws, tokens, context = 32_000, 100, 7
    starts = sequence.window_starts(spark, draws, tokens, context, 0)
    found = Counter(row.start for row in starts.collect())
    places = tokens - context
    assert min(found) == 0 and max(found) == places - 1 and len(found) == places
    spread = 5 * math.sqrt(draws * (1 / places) * (1 - 1 / places))
    assert all(abs(cnt - draws / places) <= spread for cnt in found.values())


def test_too_few_tokens(spark):
    with pytest.raises(ValueError):
        sequence.window_starts(spark, 1, 7, 7, 0)
    assert sequence.window_starts(spark, 1, 8, 7, 0).head().start == 0


def test_drawn_sample_equals_python(spark):
    keys = random.Random(4).sample(range(10**9), 500)
    df = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string")
    for n in (0, 1, 10, 400, 500, 900):
        found = sampling.drawn_sample(df, n, 42, ["doc_id"]).collect()
        expected = random.Random(42).sample(sorted(keys), min(n, len(keys)))
        assert sorted(row.doc_id for row in found) == sorted(expected)
    assert sampling.drawn_sample(df.limit(0), 5, 42, ["doc_id"]).isEmpty()


def test_hashed_sample(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"))
    first = {row.doc_id for row in sampling.hashed_sample(df, 20, 1).collect()}
    again = {row.doc_id for row in sampling.hashed_sample(df.repartition(7), 20, 1).collect()}
    other = {row.doc_id for row in sampling.hashed_sample(df, 20, 2).collect()}
    assert first == again and len(first) == 20 and first != other
    assert sampling.hashed_sample(df, 1000, 1).count() == 300
