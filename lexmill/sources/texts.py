"""Text files as documents, lines and pieces.

Files are read in parallel splits.  Lines and marked texts are written with their place in the file, and
whatever needs a second look at them (does the file end in a mark) reads that table.  Pieces and
documents are cut inside the tasks that scan the splits; only what is open at the ends of a split
goes into a small table in which neighbours meet.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

from lexmill.functions import text as T
from lexmill.session import new_folder, stored

# The code that runs in tasks travels with the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Paths = str | Sequence[str]

# Bytes up to which a file is read into one row where larger ones may come in several.
WHOLE_BYTES = 16 << 20
# Files whose ends are sent to every task; those of more files are joined.
MOST_FILES = 100_000
BYTE_ORDER_MARK = "\ufeff"
# The endings by which Spark's text reader chooses a decompressor.
COMPRESSED = r"\.(gz|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def read_texts(spark: SparkSession, path: Paths, whole_bytes: int | None = None) -> DataFrame:
    """``(file, text)``, one row per file, line ends as ``\\n``; malformed UTF-8 is an error.

    A row, and with it a file, must fit a task.  With ``whole_bytes`` only files up to that size, and
    compressed ones, are one row: the text of a larger file comes in rows of a line each, which many tasks
    read.  The columns are ``(file, split, row, text)`` then, and the texts of a file in this order,
    one after the other, are its text.
    """
    file = F.col("_metadata.file_path")
    text = T.normalize_newlines(F.validate_utf8("value")).alias("text")
    whole = spark.read.text(path, wholetext=True)
    if whole_bytes is None:
        return whole.select(file.alias("file"), text)
    # The condition is on the files alone, so neither scan opens those of the other.
    large = (F.col("_metadata.file_size") > whole_bytes) & ~F.rlike(file, F.lit(COMPRESSED))
    place = [F.lit(0).cast("long").alias(name) for name in ("split", "row")]
    whole = whole.where(~large).select(file.alias("file"), *place, text)
    records = with_ends(placed_records(spark.read.text(path, lineSep="\n").where(large)), "\n")
    lines = records.select("file", "split", "row", T.normalize_newlines(F.col("value")).alias("text"))
    return whole.unionByName(lines)


def placed_records(records: DataFrame, seen: Observation | None = None) -> DataFrame:
    """``(file, split, row, file_size, value)`` of a text scan, stored.

    Spark cuts large files into splits and moves each cut to the next mark.  Rows are ordered by
    ``(file, split, row)``.  ``seen`` gets about how many ``files`` had rows and in how many ``tasks``,
    without a job of its own.
    """
    file = F.col("_metadata.file_path")
    # The size of a compressed file says nothing about its text, and with it nothing about its end.
    plain = F.assert_true(~F.rlike(file, F.lit(COMPRESSED)), F.lit("compressed text files are not read"))
    placed = records.select(
        F.when(plain.isNull(), file).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.col("_metadata.file_size").alias("file_size"),
        F.validate_utf8("value").alias("value"),
    )
    if seen:
        # The upper bits of a row's number are those of its task.
        tasks = (F.max(F.shiftright("row", 33)) + 1).alias("tasks")
        placed = placed.observe(seen, F.approx_count_distinct("file").alias("files"), tasks)
    return stored(placed, new_folder(records.sparkSession, "records"))


def _records(spark: SparkSession, path: Paths, end: str) -> DataFrame:
    return placed_records(spark.read.text(path, lineSep=end))


def with_ends(records: DataFrame, end: str, few: bool = False) -> DataFrame:
    """Records with the mark that ended them and the byte order mark their file began with.

    The reader drops both.  With a mark for each, the records of a file are as long as the file, or
    longer by one mark where the last has none; a dropped byte order mark makes them three bytes
    shorter.  Any other length means that the file was changed while it was read.  A file of nothing
    but a byte order mark has no records.  With ``few`` the files are known to be ``MOST_FILES`` at most.
    """
    spark = records.sparkSession
    width = len(end.encode())
    off = F.sum(F.octet_length("value") + width) - F.first("file_size")
    place = F.struct("split", "row")
    files = records.groupBy("file").agg(
        off.alias("off"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    known = F.assert_true(
        F.col("off").isin(0, width, -3, width - 3), F.lit("a file does not have the length of its records")
    )
    files = files.select(
        F.when(known.isNull(), F.col("file")).alias("file"),
        "first",
        "last",
        F.col("off").isin(width, width - 3).alias("unended"),
        F.col("off").isin(-3, width - 3).alias("marked"),
    )
    if not few:
        files = stored(files, new_folder(spark, "file-ends"))
    if few or files.count() <= MOST_FILES:
        files = F.broadcast(files)
    here = F.struct("split", "row")
    start = F.when(F.col("marked") & (here == F.col("first")), F.lit(BYTE_ORDER_MARK)).otherwise("")
    stop = F.when(F.col("unended") & (here == F.col("last")), F.lit("")).otherwise(F.lit(end))
    joined = records.join(files, "file")
    return joined.withColumn("value", F.concat(start, "value", stop)).select(*records.columns)


def line_parts(records: DataFrame) -> DataFrame:
    """``(file, split, row, part, text)`` of ended records: universal line ends, each line with its own."""
    lines = F.regexp_extract_all(
        T.normalize_newlines(F.col("value")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)
    )
    return records.select("file", "split", "row", F.posexplode(lines).alias("part", "text"))


def read_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """``(file, split, row, part, text)``: lines with their ``\\n``, in this order.

    ``part`` counts the lines that lone ``\\r`` make out of one record.
    """
    return line_parts(with_ends(_records(spark, path, "\n"), "\n"))


# Where the text of a file may be cut, for Python and for Spark: before a line end after a character other
# than white space, and at an empty line.  Python knows a few more white space characters, and cuts less.
PIECES = (r"(?<=\S)(?=\n)", r"(?U)(?<=\S)(?=\n)")
EMPTY_LINES = (r"\n\n", r"\n\n")

# Fragments of a split: cut on both sides, its first, its last, or the whole split.
INNER, FIRST, LAST, WHOLE = range(4)
FRAGMENT = "file string, split long, row long, kind int, text string, bytes long, returned boolean, file_size long"
# Rows that one row of the scan may become where the fragments of several splits are put together.
ROOM = 1 << 24


class SplitText:
    """The text of one split as far as it has been read, cut where it may be."""

    def __init__(self, file: str, split: int, file_size: int, cut: re.Pattern) -> None:
        self.file, self.split, self.file_size, self.cut = file, split, file_size, cut
        self.open: list[str] = []
        self.row = self.bytes = 0
        self.returned = False

    def add(self, values: pa.Array) -> Iterator[tuple]:
        """The fragments that more records complete; each record brings the line end before it."""
        self.bytes += pc.sum(pc.binary_length(values)).as_py() + len(values)
        records = values.to_pylist()
        self.returned = records[-1].endswith("\r")
        text = "\n" + "\n".join(records)
        if "\r" in text:
            # The line end of the last record, which may make a pair with a carriage return, comes later.
            text = (text + "\n").replace("\r\n", "\n").replace("\r", "\n")[:-1]
        # A cut may lie between the last character so far and the new text.
        last = self.open.pop() if self.open else ""
        parts = self.cut.split(last[-1:] + text)
        self.open += [last[:-1], parts[0]]
        for part in parts[1:]:
            yield self._fragment(INNER if self.row else FIRST)
            self.open = [part]

    def _fragment(self, kind: int, *ends: object) -> tuple:
        self.row += 1
        return self.file, self.split, self.row - 1, kind, "".join(self.open), *(ends or (None, None, None))

    def closed(self) -> tuple:
        return self._fragment(LAST if self.row else WHOLE, self.bytes, self.returned, self.file_size)


def fragments(spark: SparkSession, path: Paths, cut: tuple[str, str]) -> DataFrame:
    """Files cut at all places inside their splits, in the tasks that scan them; stored.

    Only the first and the last fragment of a split are open to its neighbours.  The last one tells how
    many bytes the split's records had and whether the last of them ended in a carriage return.
    """
    file = F.col("_metadata.file_path")
    # The size of a compressed file says nothing about its text, and with it nothing about its end.
    plain = F.assert_true(~F.rlike(file, F.lit(COMPRESSED)), F.lit("compressed text files are not read"))
    records = spark.read.text(path, lineSep="\n").select(
        F.when(plain.isNull(), file).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_size"),
        F.validate_utf8("value").alias("value"),
    )
    names = [part.split(" ")[0] for part in FRAGMENT.split(", ")]
    pattern = re.compile(cut[0])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterable[tuple]]:
        now = None
        for batch in batches:
            splits = batch["split"].to_numpy()
            files = batch["file"].dictionary_encode().indices.to_numpy()
            # A task may hold several splits, one after the other.
            changes = (splits[1:] != splits[:-1]) | (files[1:] != files[:-1])
            ends = [0, *(np.flatnonzero(changes) + 1).tolist(), len(splits)]
            for start, stop in zip(ends[:-1], ends[1:]):
                if start == stop:
                    continue
                file, split = batch["file"][start].as_py(), int(splits[start])
                if now is None or (now.file, now.split) != (file, split):
                    if now is not None:
                        yield [now.closed()]
                    now = SplitText(file, split, batch["file_size"][start].as_py(), pattern)
                yield now.add(batch["value"].slice(start, stop - start))
        if now is not None:
            yield [now.closed()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        for rows in found(batches):
            columns = [*zip(*rows)] or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return stored(records.mapInArrow(run, FRAGMENT), new_folder(spark, "fragments"))


def _segmented(spark: SparkSession, path: Paths, cut: tuple[str, str]) -> DataFrame:
    """``(file, split, row, text)``: files of any size cut at all places, in this order.

    Text is moved only where splits meet: the fragments there, two of a split at most, are put
    together and cut again.  A stretch without a place to cut must fit a task.
    """
    found = fragments(spark, path, cut)
    # A file's records, with a line end each, are as long as the file, or one byte longer where the last
    # has none; a byte order mark, which the reader drops, makes them three bytes shorter.
    off = F.sum("bytes") - F.first("file_size", ignorenulls=True)
    files = found.where(F.col("kind") >= LAST).groupBy("file").agg(
        off.alias("off"), F.max_by("returned", "split").alias("returned"), F.max("split").alias("last_split")
    )
    known = F.assert_true(
        F.col("off").isin(0, 1, -3, -2), F.lit("a file does not have the length of its records")
    )
    files = files.select(
        F.when(known.isNull(), F.col("file")).alias("file"),
        F.col("off").isin(-3, -2).alias("marked"),
        (F.col("off").isin(0, -3) | F.col("returned")).alias("ended"),
        "last_split",
    )
    files = stored(files, new_folder(spark, "file-ends"))
    if files.count() <= MOST_FILES:
        files = F.broadcast(files)
    # The last fragment of a split is followed by the first, or the whole, of the next one.
    order = W.partitionBy("file").orderBy("split", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    number = F.sum(F.when(F.col("kind") == LAST, 1).otherwise(0)).over(order)
    outer = found.where(F.col("kind") != INNER).withColumn("number", number)
    part = F.struct("split", "row", "kind", "text")
    joined = outer.groupBy("file", "number").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    # The line end before a file's first record is not there; the one after its last may be.
    mark = F.when(F.col("marked"), F.lit(BYTE_ORDER_MARK)).otherwise("")
    text = F.when(F.col("number") == 0, F.concat(mark, F.expr("substring(whole, 2)"))).otherwise(F.col("whole"))
    ends = (last["split"] == F.col("last_split")) & (last["kind"] >= LAST) & F.col("ended")
    whole = joined.withColumn("whole", F.array_join("parts.text", "")).join(files, "file").select(
        "file",
        first["split"].alias("split"),
        first["row"].alias("row"),
        F.concat(text, F.when(ends, "\n").otherwise("")).alias("text"),
    )
    again = whole.select("file", "split", "row", F.posexplode(F.split("text", cut[1], -1)).alias("place", "text"))
    outer = again.select("file", "split", (F.col("row") * ROOM + F.col("place")).alias("row"), "text")
    inner = found.where(F.col("kind") == INNER)
    return inner.select("file", "split", (F.col("row") * ROOM).alias("row"), "text").unionByName(outer)


def read_pieces(spark: SparkSession, path: Paths) -> DataFrame:
    """``(file, split, row, text)``: the text of files of any size in pieces, in this order.

    A piece ends before a line end that follows a character other than white space.  No pre-token
    and no special token without a line end crosses such a place, so the pre-tokens, and the ids, of
    the pieces in turn are those of the undivided text.
    """
    return _segmented(spark, path, PIECES).where("text <> ''")


def read_marked(
    spark: SparkSession, path: Paths, marker: str = T.END_OF_TEXT, keep_marker: bool = False
) -> DataFrame:
    """``(file, split, row, text)``: the text between markers, in this order.

    ``keep_marker`` leaves at the end of each text the marker that ended it.  A text between two
    markers must fit a task.
    """
    records = with_ends(_records(spark, path, marker), marker)
    if not keep_marker:
        ended = F.endswith("value", F.lit(marker))
        width = len(marker)
        records = records.withColumn(
            "value", F.when(ended, F.expr(f"left(value, char_length(value) - {width})")).otherwise(F.col("value"))
        )
    text = T.normalize_newlines(F.col("value")).alias("text")
    return records.where("value <> ''").select("file", "split", "row", text)


def marked_files(spark: SparkSession, path: Paths, marker: str) -> tuple[list[str], list[str]]:
    """The files that hold the marker and those that do not; their number is that of the files listed.

    The marker is looked for in lines, so a line end inside it is never met.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), "value")
    found = lines.groupBy("file").agg(F.bool_or(F.contains("value", F.lit(marker))).alias("marked"))
    rows = found.collect()
    return [r.file for r in rows if r.marked], [r.file for r in rows if not r.marked]


def read_documents(spark: SparkSession, path: Paths, marker: str = T.END_OF_TEXT) -> DataFrame:
    """``(file, split, row, text)``: documents between markers, or between empty lines in files
    without a marker; stripped, empty ones dropped.

    Markers and empty lines are found in the scan, after line ends have become ``\n`` for the latter, and
    no text is moved but where two splits meet at a document without an empty line between.
    """
    if "\n" in marker or "\r" in marker:
        raise ValueError("a marker cannot hold a line end")
    marked, others = marked_files(spark, path, marker)
    parts = []
    if marked:
        parts.append(read_marked(spark, _literal(marked), marker))
    if others or not marked:
        parts.append(_segmented(spark, _literal(others) or path, EMPTY_LINES))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.withColumn("text", T.strip("text")).where("text <> ''")


def _literal(files: Sequence[str]) -> list[str]:
    """Paths of files as a reader takes them, without the meaning of pattern characters."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file)) for file in files]
