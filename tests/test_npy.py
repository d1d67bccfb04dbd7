"""Numpy token files against numpy itself."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lexmill.operators import sequence
from lexmill.sources import npy


def blocks_of(spark, ids, size):
    rows = [(i // size, ids[i : i + size]) for i in range(0, len(ids), size)]
    return spark.createDataFrame(rows, "block long, ids array<int>").repartition(4)


@pytest.mark.parametrize("uint16", [True, False])
@pytest.mark.parametrize("count", [1, 64, 1000, 5001])
def test_numpy_reads_what_tasks_wrote(spark, tmp_path, count, uint16):
    ids = [i * 7919 % (65536 if uint16 else 2**31) for i in range(count)]
    path = str(tmp_path / "ids.npy")
    npy.write_npy(blocks_of(spark, ids, 64), path, 64, uint16)
    found = np.load(path, mmap_mode="r")
    assert found.dtype == (np.uint16 if uint16 else np.uint32) and found.tolist() == ids
    assert os.listdir(tmp_path) == ["ids.npy"]


@pytest.mark.parametrize("kind", ["<u2", ">i4", "<i8", "u1"])
def test_what_numpy_wrote_is_read_in_ranges(spark, tmp_path, kind):
    ids = np.arange(4321) % 200
    np.save(tmp_path / "ids.npy", ids.astype(kind))
    found = npy.read_npy(spark, f"file://{tmp_path}/ids.npy", 50, split_bytes=1000)
    rows = found.orderBy("block").collect()
    assert [r.block for r in rows] == list(range(87)) and [r.n for r in rows] == [50] * 86 + [21]
    assert [i for r in rows for i in r.ids] == ids.tolist()
    assert found.rdd.getNumPartitions() > 1


def test_windows_of_a_numpy_file(spark, tmp_path):
    ids = np.arange(3000, dtype="<u2") * 3
    np.save(tmp_path / "ids.npy", ids)
    windows = sequence.sample_windows(npy.read_npy(spark, str(tmp_path / "ids.npy"), 64), 100, 40, 5, 64)
    for row in windows.collect():
        assert row.x == ids[row.start : row.start + 40].tolist()
        assert row.y == ids[row.start + 1 : row.start + 41].tolist()


@pytest.mark.parametrize("ids", [[65536], [-1], [None]])
def test_ids_out_of_range_are_refused(spark, tmp_path, ids):
    path = tmp_path / "ids.npy"
    np.save(path, np.arange(5))
    with pytest.raises(PySparkException):
        npy.write_npy(blocks_of(spark, ids, 8), str(path), 8)
    assert np.load(path).tolist() == list(range(5)) and os.listdir(tmp_path) == ["ids.npy"]


@pytest.mark.parametrize("rows", [[(0, [1, 2]), (2, [3, 4])], [(0, [1]), (1, [2, 3])], [(0, [1, 2, 3])]])
def test_gaps_are_refused(spark, tmp_path, rows):
    with pytest.raises(PySparkException):
        npy.write_npy(spark.createDataFrame(rows, "block long, ids array<int>"), str(tmp_path / "ids.npy"), 2)
    assert not (tmp_path / "ids.npy").exists()


def test_empty_sequences_and_other_files(spark, tmp_path):
    empty = spark.createDataFrame([], "block long, ids array<int>")
    npy.write_npy(empty, str(tmp_path / "none.npy"), 8)
    assert np.load(tmp_path / "none.npy").shape == (0,)
    assert npy.read_npy(spark, str(tmp_path / "none.npy"), 8).collect() == []
    np.save(tmp_path / "two.npy", np.zeros((2, 2), int))
    np.save(tmp_path / "real.npy", np.zeros(3))
    (tmp_path / "cut.npy").write_bytes(npy.header("<u2", 100) + b"\0" * 50)
    for name in ("two", "real", "cut"):
        with pytest.raises(Exception):
            npy.read_npy(spark, str(tmp_path / f"{name}.npy"), 8).collect()
    with pytest.raises(ValueError):
        npy.local_path("s3a://bucket/ids.npy")
