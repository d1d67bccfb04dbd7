"""Packing of token ids into fixed windows by non-negative least squares over length histograms.

Every document is its ids and an end id.  Whole windows are cut off its front; what is left falls in
a bin by length.  All shallow combinations of bins that fill a window are enumerated (at most
``DEPTH`` pieces), and the repeat counts that come nearest to the histogram are found by
non-negative least squares.  Rounded down and lowered by ``HELD_BACK``, they place most remainders
uncut.  The residual remainders are laid end to end and poured greedily into the gaps that rounding up
to bins has left, then into further windows; only these are cut.

The histogram has ``BINS`` entries whatever the input, so the solver's work is fixed; ranks and
running offsets are two-level sums over range partitions, so a length that a third of the documents
share is spread over tasks.

Defined results: a null or empty text is its end id alone; rows with equal keys are packed by
themselves; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexmill.llm.token_ids import word_ids
from lexmill.llm.words import slices
from lexmill.session import new_folder, stored

WINDOW = 2048
END_ID = 1
BINS = 64
DEPTH = 3
# Share of every repeat count that is left to the residuals, so that they can fill the gaps.
HELD_BACK = 0.04
# Tokens of the residual stream that are matched with gaps together.
STRETCH = 8192


def tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_row, key, n, ids)`` of every row, stored; ``ids`` are little-endian 32-bit numbers.

    The table is kept with two bytes an id where the file's ids allow it.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).alias("_key"),
        F.col(text).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(path)
        kind = "<u2" if table.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in slices(batches):
            found = [np.append(ids, END_ID).astype(kind) for ids in table.encode(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_row"],
                    batch["_key"],
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([ids.tobytes() for ids in found], pa.binary()),
                ],
                ["_row", "_key", "n", "ids"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"_row long, _key {kind}, n long, ids binary")
    return stored(found, new_folder(docs.sparkSession, "token-ids"))


def strategies(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` bins from 1 to ``bins`` that add up to ``bins``."""
    found = []
    for size in range(1, depth + 1):
        for some in combinations_with_replacement(range(1, bins + 1), size - 1):
            last = bins - sum(some)
            if last >= (some[-1] if some else 1):
                found.append((*some, last))
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by the active-set method."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    limit = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        slope = np.where(free, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(slope))
        if slope[best] <= limit:
            break
        free[best] = True
        while True:
            step = np.zeros_like(x)
            step[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (step <= 0)
            if not low.any():
                x = step
                break
            # Go towards the solution until the first variable reaches zero.
            share = np.min(x[low] / np.maximum(x[low] - step[low], 1e-300))
            x = x + share * (step - x)
            free &= x > limit * 1e-3
            x[~free] = 0
            if not free[best] and not free.any():
                break
    return x


def plan(counts: Sequence[int], held_back: float = HELD_BACK) -> list[tuple[tuple[int, ...], int]]:
    """``(bins, repeats)`` for a histogram; ``counts[i]`` remainders lie in bin ``i + 1``."""
    bins = len(counts)
    every = strategies(bins)
    a = np.zeros((bins, len(every)))
    for j, some in enumerate(every):
        for i in some:
            a[i - 1, j] += 1
    scale = max(1.0, float(max(counts, default=0)))
    repeats = np.floor(nnls(a, np.asarray(counts, float) / scale) * scale * (1 - held_back) + 1e-6)
    left = np.asarray(counts, np.int64).copy()
    out = []
    for j in np.argsort(-repeats, kind="stable"):
        need = a[:, j].astype(np.int64)
        most = min(int(left[i] // need[i]) for i in np.flatnonzero(need))
        n = min(int(repeats[j]), most)
        if n > 0:
            left -= n * need
            out.append((every[j], n))
    return out


def slot_rows(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(bin, low, high, repeats, sequence, slot)``: ranks of a bin that go to a combination."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for some, repeats in chosen:
        slot = 0
        for b in sorted(set(some)):
            copies, low = some.count(b), used.get(b, 0)
            used[b] = low + copies * repeats
            out.append((b, low, used[b], repeats, sequence, slot))
            slot += copies
        sequence += repeats
    return out


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row, in the order of ``_part, _order``.

    Rows are summed inside their range partition and range totals in turn: one row per partition.
    """
    spark = rows.sparkSession
    own = W.partitionBy("_part").orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = stored(
        parts.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")),
        new_folder(spark, "range-totals"),
    )
    joined = inside.join(parts, "_part")
    return joined.withColumn(name, F.col(name) + F.col("_base")).drop("_base")


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with the number of their range partition and an order inside it, stored."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Stored first: the ranges are drawn from a sample of the rows, which must not change.
    rows = stored(rows, new_folder(spark, "rows"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    return stored(
        ranged.withColumn("_order", F.struct(*order)), new_folder(spark, "ranges")
    )


def _poured(residual: DataFrame, gaps: DataFrame) -> DataFrame:
    """Pieces where the intervals of the residual stream meet the gaps.

    ``residual`` has ``(_row, start, length, at)``, ``gaps`` has ``(sequence_id, offset, room, at)``.
    """

    def stretches(at: str, length: str) -> F.Column:
        first = F.floor(F.col(at) / STRETCH)
        last = F.floor((F.col(at) + F.col(length) - 1) / STRETCH)
        return F.explode(F.sequence(first, last)).alias("stretch")

    left = residual.select("*", stretches("at", "length")).alias("d")
    right = gaps.select("*", stretches("at", "room")).alias("g")
    begin = F.greatest("d.at", "g.at")
    end = F.least(F.col("d.at") + F.col("d.length"), F.col("g.at") + F.col("g.room"))
    meet = (
        (F.col("d.stretch") == F.col("g.stretch"))
        & (begin < end)
        # An overlap over several stretches is taken where it begins.
        & (F.floor(begin / STRETCH) == F.col("d.stretch"))
    )
    return left.join(right, meet).select(
        "_row",
        (F.col("start") + begin - F.col("d.at")).alias("start"),
        (end - begin).alias("length"),
        "sequence_id",
        (F.col("offset") + begin - F.col("g.at")).alias("offset"),
    )


def pieces(lengths: DataFrame, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """``(_row, start, length, sequence_id, offset)`` for rows ``(_row, n)`` with ``n`` above zero."""
    spark: SparkSession = lengths.sparkSession
    width = window // bins
    rest = (F.col("n") % window).alias("rest")
    rows = lengths.select(
        "_row", F.floor(F.col("n") / window).alias("whole"), rest,
        F.ceil(rest / width).cast("int").alias("bin"),
    )
    rows = _ranged(rows, "bin", "_row")
    counts = {
        r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    # Ranks in a bin: all rows before, less the rows of lower bins.
    lower = np.cumsum([0, *(counts.get(b, 0) for b in range(bins + 1))])
    first_rank = F.get(F.lit([int(x) for x in lower]), F.col("bin")).cast("long")
    ranked = _running(rows.withColumn("_one", F.lit(1)), "_one", "_rank")
    ranked = ranked.withColumn("rank", F.col("_rank") - first_rank).drop("_one", "_rank")
    ranked = stored(_running(ranked, "whole", "wholes"), new_folder(spark, "ranked"))

    chosen = plan([counts.get(b, 0) for b in range(1, bins + 1)])
    planned = sum(repeats for _, repeats in chosen)
    # At most DEPTH rows for each of at most BINS combinations with a positive count.
    slots = spark.createDataFrame(
        slot_rows(chosen) or [(0, 0, 0, 1, 0, 0)],
        "bin int, low long, high long, repeats long, sequence long, slot long",
    )
    place = F.col("rank") - F.col("low")
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.where("rest > 0").alias("r").join(
        F.broadcast(slots).alias("s"), (F.col("r.bin") == F.col("s.bin")) & inside, "left"
    ).select(
        "_row", "whole", "rest", "_part", "_order",
        (F.col("sequence") + place % F.col("repeats")).alias("sequence_id"),
        (F.col("slot") + F.floor(place / F.col("repeats"))).alias("slot"),
    )
    placed = stored(placed, new_folder(spark, "placed"))
    begin = F.col("whole") * window

    own = W.partitionBy("sequence_id")
    before = own.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    fitted = stored(
        placed.where("sequence_id IS NOT NULL").select(
            "_row",
            begin.alias("start"),
            F.col("rest").alias("length"),
            "sequence_id",
            F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("offset"),
            F.sum("rest").over(own).alias("used"),
        ),
        new_folder(spark, "fitted"),
    )
    gaps = fitted.where((F.col("offset") == 0) & (F.col("used") < window)).select(
        "sequence_id", F.col("used").alias("offset"), (F.lit(window) - F.col("used")).alias("room")
    )
    gaps = _running(_ranged(gaps, "sequence_id"), "room", "at").select(
        "sequence_id", "offset", "room", "at"
    )
    residual = placed.where("sequence_id IS NULL")
    room = gaps.agg(F.sum("room").alias("n")).first()["n"] or 0
    over = (residual.agg(F.sum("rest").alias("n")).first()["n"] or 0) - room
    further = max(0, -(-over // window))
    fresh = spark.range(further).select(
        (F.col("id") + planned).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(window).cast("long").alias("room"),
        (F.col("id") * window + room).alias("at"),
    )
    stream = _running(residual, "rest", "at").select(
        "_row", begin.alias("start"), F.col("rest").alias("length"), "at"
    )
    poured = _poured(stream, gaps.unionByName(fresh))
    whole = ranked.where("whole > 0").select(
        "_row", "wholes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("i")
    ).select(
        "_row",
        (F.col("i") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        (F.col("wholes") + F.col("i") + planned + further).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    fitted = fitted.drop("used")
    return fitted.unionByName(poured).unionByName(whole)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["start", "length", "sequence_id", "offset"]
    for batch in batches:
        rows, columns, ids = [], {name: [] for name in names}, []
        for i in range(batch.num_rows):
            data = batch["ids"][i].as_buffer()
            n = batch["n"][i].as_py()
            every = np.frombuffer(data, f"<u{data.size // n}").astype("<u4")
            for piece in batch["pieces"][i].as_py():
                rows.append(i)
                for name in names:
                    columns[name].append(piece[name])
                ids.append(every[piece["start"] : piece["start"] + piece["length"]].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch["_key"].take(pa.array(rows, pa.int64())),
                batch["n"].take(pa.array(rows, pa.int64())),
                *(pa.array(columns[name], pa.int64()) for name in names),
                pa.array(ids, pa.binary()),
            ],
            ["_key", "n", *names, "ids"],
        )


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Pieces ``(key, start, length, doc_tokens, sequence_id, offset, ids)``.

    ``ids`` are little-endian 32-bit numbers.  A sequence is its pieces by ``offset``; it is padded
    to ``window``, unless its length is a power of two.
    """
    spark = docs.sparkSession
    found = tokens(docs, path, key, text)
    cut = pieces(found.select("_row", "n"), window)
    piece = F.struct("start", "length", "sequence_id", "offset")
    by_row = stored(
        cut.groupBy("_row").agg(F.collect_list(piece).alias("pieces")), new_folder(spark, "pieces")
    )
    joined = found.join(by_row, "_row").select("_key", "n", "ids", "pieces")
    kind = found.schema["_key"].dataType.simpleString()
    out = joined.mapInArrow(
        _cut,
        f"_key {kind}, n long, start long, length long, sequence_id long, offset long, ids binary",
    )
    return out.select(
        F.col("_key").alias(key), "start", "length", F.col("n").alias("doc_tokens"),
        "sequence_id", "offset", "ids",
    )


def report(docs: DataFrame, path: str) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    found = pack(docs, path)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
