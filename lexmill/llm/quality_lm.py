"""A quality classifier by the perplexity of a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney model of character n-grams: characters keep the
number of different n-grams of a chunk of texts small, so that counts, not texts, travel.

1.  Texts become chunks.  Every distinct n-gram of a chunk is one row with its count in trusted
    training texts; the texts of a chunk are one compressed row.  Both are written once, in buckets.
2.  Counts are summed over chunks by n-gram.  Lower orders count the different characters before an
    n-gram; histories get their totals and the weight of what discounting leaves, and every n-gram
    that occurs anywhere is given its probability by joins with these tables, order by order.
3.  Probabilities go back to the buckets of the chunks that asked for them, where the texts stayed,
    and are summed per text.
4.  Of every language, the trusted texts that were kept out of training give the quantile of
    perplexity above which a text is rejected; languages without such texts take the one over all.
    The mean over ``n`` characters strays by about one in the root of ``n``, so the limit of a text is
    ``10 ** (SPREAD / sqrt(n))`` times that of its language.

Defined results: a null or empty text is its end alone; null and unknown languages are languages of
their own; a null flag is not trusted; rows with equal keys are scored by themselves, and ``kept_rows`` lets
each go or stay by its own text (null keys too; a row equal to a rejected one in key, text and language goes
with it); a very long text is a chunk of its own; without trusted text all n-grams are equally likely and nothing is
rejected; NUL characters count as U+FFFD; further columns pass through ``kept_rows``; an empty table
gives no rows; a text at the limit stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.llm.chunks import bucketed, buckets_for, joined_parts, packed
from lexmill.llm.words import slices
from lexmill.session import new_folder, stored

ORDER = 4
# One in FOLDS trusted texts, by a hash of its key, sets limits and is not learned from.
FOLDS = 5
QUANTILE, SPREAD = 0.99, 1.5
# Accuracy of the quantile: ranks are off by one in so many at most.
ACCURACY = 10_000
CHUNK_BYTES = 6 << 20
COMPRESSION = 12
# Trusted keys that are sent to every task; more are met by a shuffle of the texts.
MOST_SENT = 300_000

# Numpy types of the answers to a chunk.
ANSWERS = {"pos": "<i4", "score": "<f4"}

# Noncharacters, which text does not hold, before and after every text.
START, END = "\uffff", "\ufffe"


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code of every n-gram in order of position, the distinct n-grams, and the ends of texts.

    A text of ``c`` characters has ``c + 1`` n-grams, one for each character and its end.
    """
    pad = START * (order - 1)
    joined = "".join(f"{pad}{text}{END}" for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    if not points.all():
        points = np.where(points == 0, np.uint32(0xFFFD), points)
    # Places in a chunk fit four bytes; half the memory of the arrays below.
    whole = np.int32 if len(points) < 2**31 else np.int64
    present = np.zeros(0x110000, bool)
    present[points] = True
    alphabet = np.flatnonzero(present)
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    local, size = place[points], max(len(alphabet), 2)
    sizes = np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts))
    ends = np.r_[0, np.cumsum(sizes)]
    # Where each text's n-grams begin among all windows, which also run over the ends of texts.
    starts = ends[:-1] + (order - 1) * np.arange(len(texts))
    at = np.repeat((starts - ends[:-1]).astype(whole), sizes)
    at += np.arange(ends[-1], dtype=whole)
    if size**order < 2**63:
        key = local[at].astype(np.int64)
        for j in range(1, order):
            key *= size
            key += local[at + whole(j)]
        del local
        codes, first = pd.factorize(key)
    else:  # an alphabet of tens of thousands of characters
        codes = local[at]
        for j in range(1, order):
            codes, first = pd.factorize(codes.astype(np.int64) * size + local[at + whole(j)])
    key = None
    codes = codes.astype(whole)
    where = np.zeros(len(first), np.int64)
    where[codes[::-1]] = at[::-1]
    del at
    spelled = np.stack([points[where + j] for j in range(order)], axis=1).astype("<u4")
    return codes, _strings(spelled, order), ends


def _strings(points: np.ndarray, order: int) -> list[str]:
    if not len(points):
        return []
    every = points.tobytes().decode("utf-32-le", "surrogatepass")
    return [every[i : i + order] for i in range(0, len(every), order)]


def chunk_table(
    docs: DataFrame, key: str, text: str, lang: str, trusted: str, order: int, fold: str
) -> DataFrame:
    """Rows of n-grams ``(chunk, pos, gram, n)`` and rows of chunks with keys and compressed texts.

    The hash of column ``fold`` tells which trusted texts are not learned from.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"),
        F.coalesce(F.col(trusted), F.lit(False)).alias("trusted"),
        (F.pmod(F.xxhash64(F.col(fold)), F.lit(FOLDS)) == 0).alias("apart"),
        F.col(text).alias("text"),
    )
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, most=CHUNK_BYTES)):
            # Nothing of a chunk is held while the next one is coded.
            yield chunk_rows(batch, first + i)

    def chunk_rows(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
        texts = [t or "" for t in batch["text"].to_pylist()]
        codes, names, ends = _grams(texts, order)
        flags = batch["trusted"].to_numpy(zero_copy_only=False).astype(bool)
        learned = flags & ~batch["apart"].to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(codes[np.repeat(learned, np.diff(ends))], minlength=len(names))
        del codes
        data = "".join(texts).encode("utf-8", "surrogatepass")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        many, none, rows_here = len(names), pa.nulls, [0, batch.num_rows]
        lists = [
            pa.concat_arrays([none(many, pa.list_(c.type)), pa.ListArray.from_arrays(rows_here, c)])
            for c in (batch["key"], batch["lang"], pa.array(flags & ~learned), pa.array(lengths))
        ]
        codec = pa.Codec("zstd", compression_level=COMPRESSION)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(many + 1, chunk), pa.int64()),
                pa.concat_arrays([pa.array(np.arange(many), pa.int32()), none(1, pa.int32())]),
                pa.array([*names, None], pa.string()),
                pa.concat_arrays([pa.array(counts, pa.int64()), none(1, pa.int64())]),
                *lists,
                pa.concat_arrays([none(many, pa.int64()), pa.array([len(data)], pa.int64())]),
                pa.concat_arrays(
                    [none(many, pa.binary()), pa.array([codec.compress(data, asbytes=True)], pa.binary())]
                ),
            ],
            ["chunk", "pos", "gram", "n", "keys", "langs", "apart", "lengths", "size", "texts"],
        )

    return rows.mapInArrow(
        run,
        f"chunk long, pos int, gram string, n long, keys array<{kind}>, langs array<string>, "
        "apart array<boolean>, lengths array<long>, size long, texts binary",
    )


def _tail(gram: Column, order: int) -> Column:
    return F.substring(gram, 2, order - 1)


def _history(gram: Column, order: int) -> Column:
    return F.substring(gram, 1, order - 1)


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of counts of 1 to 4."""
    row = counts.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).first()
    ones, found = [row[f"n{i}"] for i in range(1, 5)], []
    share = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] else 0.0
    for i in range(1, 4):
        usual = i - (i + 1) * share * ones[i] / ones[i - 1] if ones[i - 1] else 0.0
        # Half of a count where the numbers are too few to tell: something must be left to others.
        found.append(usual if 0 < usual <= i else 0.5 * i)
    return found


def _left(n: Column, taken: list[float]) -> Column:
    """What a count keeps of itself."""
    off = F.when(n == 1, taken[0]).when(n == 2, taken[1]).otherwise(taken[2])
    return F.greatest(n - off, F.lit(0.0))


def probabilities(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, p)`` for every row of ``grams(gram, n)``, distinct n-grams with training counts.

    N-grams without a count in training get what their histories leave to lower orders.
    """
    spark = grams.sparkSession
    asked = [grams.select("gram")]
    counts = [grams.where("n > 0")]
    for k in range(order, 1, -1):
        asked.append(asked[-1].select(_tail(F.col("gram"), k).alias("gram")).distinct())
        lower = counts[-1].groupBy(_tail(F.col("gram"), k).alias("gram"))
        counts.append(
            stored(lower.agg(F.count(F.lit(1)).alias("n")), new_folder(spark, f"counts-{k - 1}"))
        )
    # Order by order from single characters, which fall back on equal shares.
    letters = counts[-1].count()
    found = asked[-1].withColumn("p", F.lit(1.0 / (letters + 1)))
    for k in range(1, order + 1):
        here = counts[order - k]
        taken = discounts(here)
        kept = here.withColumn("kept", _left(F.col("n"), taken))
        # Of single characters the history is empty: one row that all share.
        totals = kept.groupBy(_history(F.col("gram"), k).alias("history")).agg(
            F.sum("n").alias("total"), F.sum("kept").alias("kept_total")
        )
        totals = stored(totals, new_folder(spark, f"histories-{k}"))
        rows = asked[order - k].withColumn("history", _history(F.col("gram"), k))
        rows = rows.withColumn("tail", F.col("gram") if k == 1 else _tail(F.col("gram"), k))
        rows = rows.join(kept.select("gram", "kept"), "gram", "left").join(totals, "history", "left")
        rows = rows.join(found.withColumnRenamed("gram", "tail"), "tail")
        total = F.col("total")
        p = F.when(total.isNull(), F.col("p")).otherwise(
            (F.coalesce("kept", F.lit(0.0)) + (total - F.col("kept_total")) * F.col("p")) / total
        )
        found = stored(rows.select("gram", p.alias("p")), new_folder(spark, f"probabilities-{k}"))
    return found


def perplexities(
    docs: DataFrame, trusted: str, key: str = "doc_id", text: str = "text", lang: str = "lang",
    order: int = ORDER, fold: str | None = None,
) -> DataFrame:
    """``(key, lang, apart, n_chars, perplexity)`` of every row, stored.

    ``apart`` marks trusted texts that were not learned from, by the hash of ``fold`` or else the key;
    ends count as characters.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = buckets_for(size)
    table = chunk_table(docs, key, text, lang, trusted, order, fold or key)
    kind = docs.schema[key].dataType.simpleString()
    with bucketed(table, new_folder(spark, "ngram-chunks"), buckets) as chunks:
        asked = chunks.where("pos IS NOT NULL").select("chunk", "pos", "gram", "n")
        grams = stored(
            asked.groupBy("gram").agg(F.sum("n").alias("n")), new_folder(spark, "ngram-counts")
        )
        known = probabilities(grams, order)
        answers = asked.select("chunk", "pos", "gram").join(known, "gram")
        answers = answers.select("chunk", "pos", F.log10("p").cast("float").alias("score"))
        answers = packed(answers, ANSWERS).repartition(buckets, "chunk").groupBy("chunk")
        texts = chunks.where("pos IS NULL").drop("pos", "gram", "n").groupBy("chunk")
        shape = f"key {kind}, lang string, apart boolean, n_chars long, perplexity double"
        found = texts.cogroup(answers).applyInArrow(partial(_finished, order), shape)
        found = stored(found, new_folder(spark, "perplexities"))
    return found.withColumnRenamed("key", key)


def _finished(order: int, texts: pa.Table, answers: pa.Table) -> pa.Table:
    """The perplexity of each text of a chunk, from the answers to its distinct n-grams."""
    row = texts.combine_chunks().to_batches()[0]
    parts = joined_parts(answers.to_batches(), ANSWERS)
    scores = np.empty(len(parts["pos"]))
    scores[parts["pos"]] = parts["score"]
    data = pa.Codec("zstd").decompress(row["texts"][0].as_py(), row["size"][0].as_py(), asbytes=True)
    every = data.decode("utf-8", "surrogatepass")
    cuts = np.r_[0, np.cumsum(row["lengths"].flatten().to_numpy())]
    codes, _, ends = _grams([every[a:b] for a, b in zip(cuts[:-1], cuts[1:])], order)
    total = np.r_[0, np.cumsum(scores[codes])]
    mean = (total[ends[1:]] - total[ends[:-1]]) / np.diff(ends)
    return pa.Table.from_arrays(
        [row["keys"].flatten(), row["langs"].flatten(), row["apart"].flatten(),
         pa.array(np.diff(ends), pa.int64()), pa.array(10.0**-mean, pa.float64())],
        ["key", "lang", "apart", "n_chars", "perplexity"],
    )


def classified(
    docs: DataFrame, trusted: str, key: str = "doc_id", text: str = "text", lang: str = "lang",
    quantile: float = QUANTILE, fold: str | None = None,
) -> DataFrame:
    """``(key, lang, n_chars, perplexity, limit, kept)`` of every row."""
    found = perplexities(docs, trusted, key, text, lang, fold=fold)
    room = F.pow(F.lit(10.0), SPREAD / F.sqrt("n_chars"))
    found = found.withColumn("_room", room)
    level = F.col("perplexity") / F.col("_room")
    limit = F.percentile_approx(level, quantile, ACCURACY).alias("limit")
    apart = found.where("apart")
    limits = apart.groupBy("lang").agg(limit)  # one row per language
    limits = stored(limits, new_folder(docs.sparkSession, "limits"))
    usual = apart.agg(limit).first()["limit"]
    same = F.col("d.lang").eqNullSafe(F.col("l.lang"))
    joined = found.alias("d").join(limits.alias("l"), same, "left")
    limit = F.coalesce(F.col("l.limit"), F.lit(usual).cast("double")) * F.col("_room")
    return joined.select(
        key, F.col("d.lang").alias("lang"), "n_chars", "perplexity", limit.alias("limit"),
        F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"),
    )


def with_trust(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``trusted``: labelled as of good quality and not toxic."""
    good = labels.where("quality = 1 AND toxic = 0").select(key).distinct()
    good = stored(good.withColumn("trusted", F.lit(True)), new_folder(docs.sparkSession, "trusted"))
    if good.count() <= MOST_SENT:
        good = F.broadcast(good)
    return docs.drop("trusted").join(good, key, "left")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classified(with_trust(docs.select("doc_id", "text", "lang"), labels), "trusted")


def kept_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose perplexity is within the limit of their language, all columns as they are."""

    def name() -> Column:
        digest = F.md5(F.coalesce("text", F.lit("")))
        language = F.col("lang").cast("string")
        return F.struct(F.col(key).alias("key"), digest.alias("digest"), language.alias("lang"))

    own = "_gone"
    while own in docs.columns:
        own += "_"
    marked = with_trust(docs.select(key, "text", "lang"), labels, key)
    rows = marked.select(name().alias("row"), "text", "lang", "trusted", F.col(key).alias("fold"))
    gone = classified(rows, "trusted", "row", fold="fold").where("NOT kept")
    gone = stored(gone.select(F.col("row").alias(own)).distinct(), new_folder(docs.sparkSession, "rejected"))
    return docs.join(gone, name() == F.col(own), "left_anti")
