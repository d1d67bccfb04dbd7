"""Exact similarity join of word n-gram sets by vertical partitioning.

1.  Documents with equal n-gram sets form a class; from here on a class counts once.
2.  N-grams get a global order, rarest first, from a table of ``2 ** CELL_BITS`` counts over the whole
    corpus (an n-gram's count is that of its cell; a fixed size, whatever the corpus).  Any order
    gives the same result; this one keeps shared passages out of what follows.  Pivots cut the order
    into ``FRAGMENTS`` fragments of equal mass.
3.  Two sets as alike as asked share ``MEETINGS`` n-grams, or all they must share if fewer, among the
    first ``n - ceil(p n) + MEETINGS`` of each.  Classes that meet so often there, within the length
    and position bounds, are candidates.
    Every class has a sketch, the parities of its n-grams by bit: two sets differ in at least as many
    n-grams as their sketches in bits, which refutes most pairs below the limit inside the join.
4.  For each pair the overlap is counted in every fragment separately, and summed per pair.
5.  Linked classes are tied into components.

Only components are wanted, so pairs inside one need no count.  Where more than ``MANY`` classes have
an n-gram, each is first compared with one of them, drawn anew for every n-gram and round: as many
pairs as rows, which ties groups of near copies together.  Then come all candidates between classes
that are still in different components; none of these is left out.

Defined results: a text with fewer words than ``width`` is one n-gram, one without words (or null) is
empty and linked with nothing; equal sets are always linked; further columns are ignored or, in
``kept_rows``, passed through; rows with equal keys are compared by themselves and share a key in the
result; rows with a null key are linked like others, and where a component has null keys only its id is
null; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexmill.llm.components import connected
from lexmill.llm.words import shingle_sets, slices
from lexmill.session import new_folder, stored

CELL_BITS = 22
SHIFT = np.uint64(64 - CELL_BITS)
PIECE = 1 << 14
FRAGMENTS = 4
MEETINGS = 3
# Longs of a sketch; 1,024 bits tell sets of up to some thousands of n-grams apart.
SKETCH = 16
# Classes with a common n-gram from which on they are first compared with one of them, and rounds of it.
MANY, ROUNDS = 16, 2
# Keys that are sent to every task to pick texts by; more are met by a shuffle of the texts.
MOST_SENT = 300_000
# Classes that a task remembers, to send the n-grams of copies once.
REMEMBERED = 1_000_000


def _class_of(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Bit ``i`` tells whether an odd number of the n-grams falls on it."""
    bits = np.bincount((grams & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8)).view("<i8")


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows, rows.schema["key"].dataType.simpleString()


def _numbers(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def _class_table(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """``(key, n, class, sketch)`` of every row and ``(piece, counts)`` of the cells a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        key_type = None
        for batch in slices(batches):
            sets = shingle_sets(batch["text"], width)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((every >> SHIFT).astype(np.int64), minlength=1 << CELL_BITS)
            key_type = batch["key"].type
            yield table(
                batch["key"], [len(s) for s in sets], [_class_of(s) for s in sets],
                [_sketch(s) for s in sets], [None] * len(sets), [None] * len(sets),
            )
        if key_type is not None:
            parts = counts.reshape(-1, PIECE)
            found = [i for i in range(len(parts)) if parts[i].any()]
            blobs = [zlib.compress(parts[i].astype("<u4").tobytes(), 1) for i in found]
            none = [None] * len(found)
            yield table(pa.nulls(len(found), key_type), none, none, none, found, blobs)

    def table(
        keys: pa.Array, n: list, classes: list, sketches: list, pieces: list, blobs: list
    ) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(n, pa.int64()), pa.array(classes, pa.binary()),
             pa.array(sketches, pa.list_(pa.int64())),
             pa.array(pieces, pa.int32()), pa.array(blobs, pa.binary())],
            ["key", "n", "class", "sketch", "piece", "counts"],
        )

    schema = f"key {kind}, n long, class binary, sketch array<long>, piece int, counts binary"
    found = rows.mapInArrow(run, schema)
    return stored(found, new_folder(rows.sparkSession, "ngram-classes"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, blob in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist()):
            part = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
            total[piece] = total[piece] + part if piece in total else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()),
         pa.array([zlib.compress(x.astype("<i8").tobytes(), 1) for x in total.values()], pa.binary())],
        ["piece", "counts"],
    )


def global_order(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every cell, least counted first, and the ranks at which fragments begin.

    ``2 ** CELL_BITS`` counts reach the driver in compressed pieces that were summed in tasks.  It holds
    12 bytes for each cell: the count above the cell's number, sorted in place, and the rank.
    """
    size, low = 1 << CELL_BITS, np.uint64((1 << CELL_BITS) - 1)
    order = np.arange(size, dtype=np.uint64)
    parts = cells.repartition("piece").mapInArrow(_summed, "piece int, counts binary")
    for row in parts.collect():
        at = row["piece"] * PIECE
        counts = np.frombuffer(zlib.decompress(row["counts"]), "<u8")
        order[at : at + PIECE] |= counts << np.uint64(CELL_BITS)
    order.sort()
    rank = np.empty(size, np.uint32)
    sums = []
    for at in range(0, size, PIECE):
        part = order[at : at + PIECE]
        rank[(part & low).astype(np.int64)] = np.arange(at, at + PIECE, dtype=np.uint32)
        sums.append(int((part >> np.uint64(CELL_BITS)).sum()))
    # The pivots lie in the pieces in which the mass passes their share.
    ends = np.cumsum(sums)
    pivots = []
    for share in ends[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS:
        i = int(np.searchsorted(ends, share))
        part = order[i * PIECE : (i + 1) * PIECE] >> np.uint64(CELL_BITS)
        mass = np.cumsum(part.astype(np.int64)) + (ends[i] - sums[i])
        pivots.append(i * PIECE + int(np.searchsorted(mass, share)))
    return rank, np.array(pivots, np.uint64)


def in_order(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The numbers with their cell replaced by its rank: ascending, they are in global order."""
    cell = rank[(grams >> SHIFT).astype(np.int64)].astype(np.uint64)
    low = grams & ((np.uint64(1) << SHIFT) - np.uint64(1))
    return np.sort((cell << SHIFT) | low)


def least_overlap(n: int, percent: int) -> int:
    """N-grams that a set of ``n`` shares at least with any set as alike as asked."""
    return -(-percent * n // 100)


def _prefixes(rows: DataFrame, width: int, percent: int, rank) -> DataFrame:
    """``(gram, class, n, pos)``: the first n-grams of each class, once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            grams, classes, sizes, places = [], [], [], []
            for found in shingle_sets(batch["text"], width):
                name = _class_of(found)
                if name is None or name in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                count = len(found) - least_overlap(len(found), percent) + MEETINGS
                grams.append(in_order(found, rank.value)[:count])
                classes.append(name)
                sizes.append(len(found))
            lengths = [len(g) for g in grams]
            which = np.repeat(np.arange(len(grams)), lengths)
            places = [np.arange(n) for n in lengths] or [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [
                    _numbers(np.concatenate(grams) if grams else np.zeros(0, np.uint64)),
                    pa.array(classes, pa.binary()).take(pa.array(which, pa.int64())),
                    pa.array(np.array(sizes, np.int32)[which] if sizes else [], pa.int32()),
                    pa.array(np.concatenate(places).astype(np.int32), pa.int32()),
                ],
                ["gram", "class", "n", "pos"],
            )

    return rows.mapInArrow(run, "gram long, class binary, n int, pos int")


def _segments(rows: DataFrame, width: int, rank, pivots) -> DataFrame:
    """``(class, fragment, grams)``: the n-grams of each row by fragment, as sorted numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            classes, fragments, grams = [], [], []
            for found in shingle_sets(batch["text"], width):
                ordered = in_order(found, rank.value)
                cuts = np.searchsorted(ordered >> SHIFT, pivots.value)
                for i, part in enumerate(np.split(ordered, cuts)):
                    if len(part):
                        classes.append(_class_of(found))
                        fragments.append(i)
                        grams.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes, pa.binary()), pa.array(fragments, pa.int32()),
                 pa.array(grams, pa.binary())],
                ["class", "fragment", "grams"],
            )

    return rows.mapInArrow(run, "class binary, fragment int, grams binary")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes that are as alike as asked."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def _sketches_allow(percent: int, x: str, y: str, nx: str, ny: str) -> Column:
    """Whether the bits in which two sketches differ leave two sets as alike as asked."""
    words = (F.col(x)[i].bitwiseXOR(F.col(y)[i]) for i in range(SKETCH))
    differ = reduce(operator.add, (F.bit_count(word) for word in words))
    return differ <= F.col(nx) + F.col(ny) - 2 * _needed(F.col(nx), F.col(ny), percent)


def _may_link(percent: int) -> Column:
    """Length and position bounds on two rows ``x`` and ``y`` of one n-gram.

    At the first n-gram that two sets share, all they can share lies from there on, at the next all
    but one.
    """
    rest = lambda s: F.col(f"{s}.n") - F.col(f"{s}.pos")
    needed = _needed(F.col("x.n"), F.col("y.n"), percent)
    return F.least(rest("x"), rest("y")) > needed - MEETINGS


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [
            len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())
        ]
        kept = [name for name in batch.schema.names if name not in ("x", "y")]
        yield pa.RecordBatch.from_arrays(
            [*(batch[name] for name in kept), pa.array(both, pa.int64())], [*kept, "both"]
        )


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows that have one of ``keys``, a table of one column; few keys are sent to every task."""
    keys = stored(keys.distinct(), new_folder(rows.sparkSession, "wanted"))
    if keys.count() <= MOST_SENT:
        keys = F.broadcast(keys)
    return rows.join(keys, keys.columns, "left_semi")


def segments_of(
    pairs: DataFrame, rows: DataFrame, least_key: DataFrame, width: int, rank, pivots
) -> DataFrame:
    """Segments of the classes in ``pairs``, cut from the text of one row of each, stored."""
    classes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    named = classes.join(least_key, "class")
    keys = named.where("least IS NOT NULL").select(F.col("least").alias("key"))
    found = _segments(only(rows, keys), width, rank, pivots)
    # A class without any key is found by its n-grams, once however many rows have it.
    bare = least_key.where("least IS NULL")
    if not bare.isEmpty():
        cut = _segments(rows.where("key IS NULL"), width, rank, pivots)
        wanted = named.where("least IS NULL").select("class")
        found = found.unionByName(only(cut, wanted).dropDuplicates(["class", "fragment"]))
    return stored(found, new_folder(rows.sparkSession, "segments"))


def links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b, na, nb)`` whose sets are as alike as asked, as ``(a, b)``.

    Overlaps are counted per fragment and summed per pair.  The largest count per fragment is taken,
    as a class may have been cut more than once where keys repeat.
    """
    side = lambda name, grams: only(
        segments.select(F.col("class").alias(name), "fragment", F.col("grams").alias(grams)),
        pairs.select(name),
    )
    one, other = pairs.join(side("a", "x"), "a"), side("b", "y")
    counted = one.join(other, ["b", "fragment"]).mapInArrow(
        _overlaps, "b binary, fragment int, a binary, na int, nb int, both long"
    )
    total = (
        counted.groupBy("a", "b", "na", "nb", "fragment")
        .agg(F.max("both").alias("both"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("both").alias("both"))
    )
    union = F.col("na") + F.col("nb") - F.col("both")
    return total.where(100 * F.col("both") >= percent * union).select("a", "b")


def _pair(percent: int) -> list[Column]:
    first = F.col("x.class") < F.col("y.class")
    pick = lambda name, yes, no: F.when(first, F.col(f"{yes}.{name}")).otherwise(
        F.col(f"{no}.{name}")
    )
    return [
        pick("class", "x", "y").alias("a"), pick("class", "y", "x").alias("b"),
        pick("n", "x", "y").alias("na"), pick("n", "y", "x").alias("nb"),
    ]


def grouped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """``(key, n_shingles, component_id)`` per row.

    Sets are linked when ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    key that links reach.
    """
    spark = docs.sparkSession
    rows, kind = _keyed(docs, key, text)
    table = _class_table(rows, kind, width)
    members = table.where("piece IS NULL").select("key", "n", "class")
    rank, pivots = global_order(table.where("piece IS NOT NULL").select("piece", "counts"))
    rank, pivots = spark.sparkContext.broadcast(rank), spark.sparkContext.broadcast(pivots)

    # N-grams at which classes meet.  A class that is too far in size from its neighbours among those
    # that have the n-gram is too far from all of them.
    own = W.partitionBy("gram")
    by_size = own.orderBy("n", "class")
    near = lambda small, large: 100 * small >= percent * large
    meets = near(F.lag("n").over(by_size), F.col("n")) | near(F.col("n"), F.lead("n").over(by_size))
    shared = _prefixes(rows, width, percent, rank).repartition("gram").distinct()
    shared = shared.withColumn("meets", meets).where("meets").drop("meets")
    shared = stored(
        shared.withColumn("many", F.count(F.lit(1)).over(own)), new_folder(spark, "shared-grams")
    )
    least_key = stored(
        members.where("class IS NOT NULL").groupBy("class").agg(F.min("key").alias("least")),
        new_folder(spark, "classes"),
    )

    sketches = table.where("class IS NOT NULL").groupBy("class").agg(F.any_value("sketch").alias("sketch"))
    sketches = stored(sketches, new_folder(spark, "sketches"))

    none = spark.createDataFrame([], "a binary, b binary")
    edges, compared = none, none

    def linked(pairs: DataFrame, step: str) -> bool:
        """Compares the pairs that are new, and whether any were."""
        nonlocal edges, compared
        fresh = pairs.join(compared, ["a", "b"], "left_anti")
        fresh = stored(fresh, new_folder(spark, f"pairs-{step}"))
        if fresh.isEmpty():
            return False
        cut = segments_of(fresh, rows, least_key, width, rank, pivots)
        found = stored(links(fresh, cut, percent), new_folder(spark, f"links-{step}"))
        edges, compared = edges.unionByName(found), compared.unionByName(fresh.select("a", "b"))
        return True

    def allowed(pairs: DataFrame) -> DataFrame:
        """The pairs that the sketches of both sides do not refute."""
        of = lambda s: sketches.select(F.col("class").alias(s), F.col("sketch").alias(f"s{s}"))
        found = pairs.join(of("a"), "a").join(of("b"), "b")
        return found.where(_sketches_allow(percent, "sa", "sb", "na", "nb")).drop("sa", "sb")

    def placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """Rows of n-grams that classes of different components have."""
        found = rows.join(parts.withColumnRenamed("node", "class"), "class", "left")
        found = found.withColumn("component", F.coalesce("component", "class"))
        mixed = F.min("component").over(own) < F.max("component").over(own)
        return found.withColumn("mixed", mixed).where("mixed").drop("mixed")

    many = stored(shared.where(F.col("many") > MANY), new_folder(spark, "large-grams"))
    parts = spark.createDataFrame([], "node binary, component binary")
    for i in range(ROUNDS):
        draw = F.xxhash64("class", "gram", F.lit(i)).alias("draw")
        first = F.min(F.struct(draw, "class", "n", "pos", "component")).over(own)
        drawn = placed(many, parts).withColumn("y", first)
        pairs = drawn.select(F.struct("class", "n", "pos").alias("x"), "y", "component")
        pairs = pairs.where((F.col("component") != F.col("y.component")) & _may_link(percent))
        if not linked(allowed(pairs.select(*_pair(percent)).distinct()), f"drawn-{i}"):
            break
        parts = stored(connected(edges), new_folder(spark, "components"))

    rest = placed(shared.join(sketches, "class"), parts)
    rest = stored(rest, new_folder(spark, "placed"))
    apart = F.col("x.component") != F.col("y.component")
    meet = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.class") < F.col("y.class"))
    # Up to a common n-gram two sets share as many as come before it in either, at most.
    before = F.least("x.pos", "y.pos")
    after = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    enough = before + after >= _needed(F.col("x.n"), F.col("y.n"), percent)
    close = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    alike = _sketches_allow(percent, "x.sketch", "y.sketch", "x.n", "y.n")
    pairs = rest.alias("x").join(rest.alias("y"), meet & apart & close & enough & alike)
    pairs = pairs.select(*_pair(percent), F.least(
        F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")
    ).alias("left")).groupBy("a", "b", "na", "nb")
    pairs = pairs.agg(F.count(F.lit(1)).alias("common"), F.min("left").alias("left"))
    # All common n-grams among the first are known; what else is common lies after the last of them.
    needed = _needed(F.col("na"), F.col("nb"), percent)
    often = (F.col("common") >= F.least(F.lit(MEETINGS), needed)) & (
        F.col("common") + F.col("left") - 1 >= needed
    )
    if linked(pairs.where(often).select("a", "b", "na", "nb"), "rest"):
        parts = connected(edges)

    found = parts.withColumnRenamed("node", "class").join(least_key, "class")
    smallest = found.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(
        least_key.join(
            found.join(smallest, "component").select("class", "component_id"), "class", "left"
        ).select("class", F.coalesce("component_id", "least").alias("component_id")),
        new_folder(spark, "named-classes"),
    )
    return members.join(named, "class", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "key").alias("component_id"),
    )


def kept_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The row with the smallest key of every component, all columns as they are.

    Rows are told apart by key and text, so a row goes or stays by its own text where keys repeat; rows
    equal in both stay together.
    """

    def name() -> Column:
        return F.struct(F.col(key).alias("key"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))

    found = grouped(docs.select(name().alias("row"), F.col(text).alias("text")), "row", "text", width, percent)
    stay = found.where("row = component_id").select("row").distinct()
    own = "_stays"
    while own in docs.columns:
        own += "_"
    stay = stored(stay.select(F.col("row").alias(own)), new_folder(docs.sparkSession, "kept-keys"))
    return docs.join(stay, name() == F.col(own), "left_semi")
