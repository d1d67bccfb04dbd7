"""Near duplicates by SimHash fingerprints that differ in two bits at most.

A fingerprint has 64 bits, cut into two segments.  Two bits of difference leave one segment that
differs in one bit at most, so every distinct fingerprint is indexed under its segments as they are
and under each segment with one bit wild.  Fingerprints that meet under a key are compared: under a
whole segment all with each other, under a wild bit only those where it is set with those where it
is not.  Keys that many fingerprints share are not paired: there the other segment is indexed with
its bits wild too (two of them below a whole segment, one below a wild bit).  Fingerprints that share
such a key differ in two bits at most by construction, no more than four distinct ones can, and they
are tied to the least of them.  So no link is lost and no group costs the square of its size.

Defined results: null and empty texts, and texts without words, have fingerprint zero; of fewer words
than a shingle's the whole sequence is the shingle; texts of any length are read whole, a range of
shingles at a time; repeated rows are rows of one fingerprint; null keys are never a component's name
unless it has no other, then the name is null; an empty table gives no rows; further columns of the
input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.llm.components import connected
from lexmill.llm.words import Words, slices, words_of
from lexmill.session import new_folder, stored

SEED = 42
BITS, HALF = 64, 32
LOW = (1 << HALF) - 1

# Shingles hashed at once in a task, and bytes of text cut into words at once.
RANGE = 1 << 17
SLICE_BYTES = 4 << 20

# Fingerprints under one key up to which they are paired.
MANY = 32


def _hashes(shingles: pa.Array) -> np.ndarray:
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    found = shingles.cast(pa.binary()).to_pylist()
    return np.fromiter(map(digest, found), np.uint64, len(found))


def _set_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each bit is set, highest first, in the runs of hashes that begin at ``starts``."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def _counted(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text its number of shingles and how often each bit is set in their hashes."""
    sizes = np.diff(words.ends)
    shingles = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    counts = np.zeros((len(sizes), BITS), np.int64)
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        whole = words.distinct.take(pa.array(words.codes[words.ends[i] : words.ends[i + 1]]))
        counts[i] = _set_bits(_hashes(pa.array([" ".join(whole.to_pylist())])), np.zeros(1, int))[0]
    long = np.flatnonzero(sizes >= width)
    # Shingles of the long texts are numbered through; ``first`` has the number of each text's first.
    first = np.r_[0, np.cumsum(shingles[long])]
    for start in range(0, int(first[-1]), RANGE):
        stop = min(start + RANGE, int(first[-1]))
        owner = np.searchsorted(first, np.arange(start, stop), side="right") - 1
        place = words.ends[long[owner]] + np.arange(start, stop) - first[owner]
        parts = [words.distinct.take(pa.array(words.codes[place + j])) for j in range(width)]
        texts = pc.binary_join_element_wise(*parts, " ") if width > 1 else parts[0]
        texts_of, starts = np.unique(owner, return_index=True)
        counts[long[texts_of]] += _set_bits(_hashes(texts), starts)
    return shingles, counts


def fingerprint_array(texts: pa.Array, width: int) -> np.ndarray:
    """Fingerprints of texts as signed numbers: a bit is set if it is in over half the hashes."""
    shingles, counts = _counted(words_of(texts), width)
    most = np.packbits(2 * counts > shingles[:, None], axis=1)
    return most.view(">i8").reshape(-1).astype(np.int64)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3
) -> DataFrame:
    """``(key, fingerprint long)`` of every row, the key's column named ``key``."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE_BYTES):
            found = pa.array(fingerprint_array(part["text"], width))
            yield pa.RecordBatch.from_arrays([part["key"], found], ["key", "fingerprint"])

    shape = StructType([rows.schema["key"], StructField("fingerprint", LongType())])
    return rows.mapInArrow(run, shape)


def _halves(number: Column) -> tuple[Column, Column]:
    return number.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(number, HALF)


def _variants(classes: DataFrame) -> DataFrame:
    """``(key, fingerprint, side)``: each segment whole (tags 0 and 33) and with one bit wild.

    A key holds the tag above the segment; ``side`` is the wild bit, zero for whole segments.
    """
    low, high = _halves(F.col("fingerprint"))
    tags = F.explode(F.sequence(F.lit(0), F.lit(2 * HALF + 1))).alias("tag")
    tagged = classes.select("fingerprint", tags).withColumn(
        "segment", F.when(F.col("tag") <= HALF, low).otherwise(high)
    )
    place = F.col("tag") % (HALF + 1) - 1
    tagged = tagged.withColumn("place", place).withColumn(
        "bit", F.when(F.col("place") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, place)"))
    )
    rest = F.col("segment").bitwiseAND(F.bitwise_not("bit"))
    return tagged.select(
        F.shiftleft(F.col("tag").cast("long"), HALF).bitwiseOR(rest).alias("key"),
        "fingerprint",
        (F.col("segment").bitwiseAND(F.col("bit")) != 0).cast("int").alias("side"),
    )


def _tag(key: Column) -> Column:
    return F.shiftrightunsigned(key, HALF)


def _whole(key: Column) -> Column:
    return _tag(key) % (HALF + 1) == 0


def _tied(crowded: DataFrame) -> DataFrame:
    """Links under the crowded keys: the other segment with one or two bits wild, at most four a key."""
    low, high = _halves(F.col("fingerprint"))
    other = F.when(_tag(F.col("key")) <= HALF, high).otherwise(low)
    single = [1 << i for i in range(HALF)]
    double = [a | b for a, b in combinations(single, 2)]
    parts = []
    for wild, here in ((double, _whole(F.col("key"))), (single, ~_whole(F.col("key")))):
        masks = F.explode(F.array(*(F.lit(m).cast("long") for m in wild))).alias("mask")
        rows = crowded.where(here).select("key", "fingerprint", other.alias("other"), masks)
        parts.append(
            rows.groupBy("key", "mask", F.col("other").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
            .agg(F.collect_set("fingerprint").alias("members"))
            .where(F.size("members") > 1)
        )
    least = F.array_min("members")
    return (
        parts[0].unionByName(parts[1])
        .select(F.explode("members").alias("a"), least.alias("b"))
        .where("a <> b")
    )


def links(classes: DataFrame, many: int = MANY) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that give the components of all links.

    ``classes`` has one row per ``fingerprint``.  Pairs under uncrowded keys are all there; under
    crowded keys each fingerprint is tied to the least of those that differ in the same places.
    """
    spark = classes.sparkSession
    variants = _variants(classes)
    counted = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.sum("side").alias("ones")
    )
    whole = _whole(F.col("key"))
    meet = F.when(whole, F.col("members") > 1).otherwise(
        (F.col("ones") > 0) & (F.col("ones") < F.col("members"))
    )
    shared = stored(counted.where(meet).select("key", "members"), new_folder(spark, "simhash-keys"))
    met = stored(variants.join(shared, "key"), new_folder(spark, "simhash-members"))
    few = met.where(F.col("members") <= many).drop("members")
    a, b = few.alias("a"), few.alias("b")
    apart = F.when(
        _whole(F.col("a.key")), F.col("a.fingerprint") < F.col("b.fingerprint")
    ).otherwise(F.col("a.side") < F.col("b.side"))
    differ = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & (differ <= 2))
    pairs = pairs.select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))
    return pairs.unionByName(_tied(met.where(F.col("members") > many)))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row, the fingerprint as 16 hexadecimal digits.

    ``component_id`` is the smallest key reachable by links, the row's own included.  Copies are one
    row per fingerprint until the end, where the rows meet the name of their fingerprint's component.
    """
    spark = docs.sparkSession
    rows = stored(fingerprints(docs, key, text, width), new_folder(spark, "simhash"))
    classes = stored(
        rows.groupBy("fingerprint").agg(F.min("key").alias("least")),
        new_folder(spark, "simhash-classes"),
    )
    nodes = connected(links(classes)).withColumnRenamed("node", "fingerprint")
    nodes = stored(classes.join(nodes, "fingerprint"), new_folder(spark, "simhash-nodes"))
    names = nodes.groupBy("component").agg(F.min("least").alias("name"))
    names = nodes.join(names, "component").select("fingerprint", "name")
    labels = classes.join(names.withColumn("linked", F.lit(True)), "fingerprint", "left").select(
        "fingerprint", F.when(F.col("linked"), F.col("name")).otherwise(F.col("least")).alias("component_id")
    )
    labels = stored(labels, new_folder(spark, "simhash-labels"))
    return rows.join(labels, "fingerprint").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
