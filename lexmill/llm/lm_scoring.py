"""Scores of whole texts by a log-bilinear neural model trained on the corpus.

1.  Texts become chunks: word codes with the chunk's list of distinct words.  Every distinct word of
    every chunk is one row of a shuffle by word, which sums its training count and hands it back.
2.  The ``SHORTLIST`` most frequent words are classes of their own, all others share one class.  Chunks
    meet the counts of their words and are kept as class sequences.
3.  A log-bilinear model predicts a class from the two before it: the weighted sum of their vectors is
    compared with a vector per class.  It is trained in numpy by noise-contrastive estimation: each
    round, tasks start from the same parameters, learn from all their training tokens, and the
    parameters are averaged by tokens.
4.  Batched matrix products give the normaliser of every pair of context classes, so token
    probabilities are exact.  Inside the shared class words have their smoothed unigram shares, which
    makes the model a distribution over all words.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end per text.  Texts whose key
hash leaves ``HELD`` are held out: they add to no count and are learned from nowhere.

Defined results: a null or empty text is its end alone; a null key is hashed as empty text; rows with
equal keys are scored by themselves; without any training text all scores are zero; further columns
are ignored; an empty table gives no rows.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lexmill.llm.chunks import by_chunk, met, packed
from lexmill.llm.words import slices, words_of
from lexmill.session import new_folder, stored

FOLDS, HELD = 5, 1
# Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
# A word cannot hold a blank, so this names the end of a text.
END = xxhash.xxh3_64_intdigest(b" ")

SHORTLIST = 1000
WIDTH = 32
ROUNDS = 2
NOISE = 64
BATCH = 4096
RATE = 0.05
SEED = 11
# Tokens scored at once.
BLOCK = 1 << 16
PIECE = 1 << 12


def is_held(key: object) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS == HELD


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _read(data: bytes, kind: str, count: int) -> np.ndarray:
    size = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends[1:]] - total[ends[:-1]]


def chunk_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of words ``(chunk, pos, word, n)`` and rows of chunks ``(chunk, keys, held, ends, codes)``.

    ``n`` counts a word's training tokens in the chunk; ``codes`` are positions ``pos``.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, most=CHUNK_BYTES)):
            words = words_of(batch["text"])
            found = words.distinct.cast(pa.binary()).to_pylist()
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
            names = np.append(names, np.uint64(END))
            codes = np.insert(words.codes.astype(np.int32), words.ends[1:], len(found))
            ends = words.ends + np.arange(len(words.ends))
            held = np.array([is_held(k) for k in batch["key"].to_pylist()])
            learned = ~np.repeat(held, np.diff(ends))
            counts = np.bincount(codes[learned], minlength=len(names))
            many, none = len(names), pa.nulls
            key_type = batch["key"].type
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(many + 1, first + i), pa.int64()),
                    pa.concat_arrays([pa.array(np.arange(many), pa.int32()), none(1, pa.int32())]),
                    pa.concat_arrays([pa.array(_signed(names), pa.int64()), none(1, pa.int64())]),
                    pa.concat_arrays([pa.array(counts, pa.int64()), none(1, pa.int64())]),
                    pa.concat_arrays([
                        none(many, pa.list_(key_type)),
                        pa.ListArray.from_arrays([0, batch.num_rows], batch["key"]),
                    ]),
                    *(
                        pa.concat_arrays([none(many, pa.binary()), pa.array([x], pa.binary())])
                        for x in (
                            held.tobytes(), ends.astype("<i8").tobytes(), _squeezed(codes)
                        )
                    ),
                ],
                ["chunk", "pos", "word", "n", "keys", "held", "ends", "codes"],
            )

    found = rows.mapInArrow(
        run,
        f"chunk long, pos int, word long, n long, keys array<{kind}>, held binary, ends binary, "
        "codes binary",
    )
    return stored(found, new_folder(docs.sparkSession, "word-chunks"))


@dataclass(frozen=True)
class Unigrams:
    """Training totals and the shortlist; class 0 is shared by the words outside it."""

    tokens: int
    types: int
    words: np.ndarray
    counts: np.ndarray

    def share(self, counts: np.ndarray) -> np.ndarray:
        """Smoothed probability of words with these counts."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    @property
    def shares(self) -> np.ndarray:
        """Smoothed probability of each class."""
        own = self.share(self.counts)
        return np.concatenate([[max(1 - own.sum(), 1e-300)], own])

    @property
    def end(self) -> int:
        return 1 + int(np.flatnonzero(self.words == _signed(np.array([END], np.uint64))[0])[0])


def counted_words(chunks: DataFrame) -> DataFrame:
    """``(chunk, pos, count, word)``: training counts over all chunks, stored.

    ``word`` is set in one row of each word that has a count.
    """
    own = W.partitionBy("word")
    here = F.struct("chunk", "pos")
    words = chunks.where("pos IS NOT NULL").select("chunk", "pos", "word", "n")
    words = words.withColumn("count", F.sum("n").over(own)).withColumn("first", F.min(here).over(own))
    first = (F.col("first") == here) & (F.col("count") > 0)
    found = words.select("chunk", "pos", "count", F.when(first, F.col("word")).alias("word"))
    return stored(found, new_folder(chunks.sparkSession, "word-counts"))


def unigrams(counts: DataFrame, shortlist: int = SHORTLIST) -> Unigrams:
    named = counts.where("word IS NOT NULL")
    total = named.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = int(_signed(np.array([END], np.uint64))[0])
    rows = named.where(F.col("word") != end).orderBy(F.desc("count"), "word").limit(shortlist - 1)
    chosen = [(r["word"], r["count"]) for r in rows.collect()]
    chosen += [(r["word"], r["count"]) for r in named.where(F.col("word") == end).collect()]
    chosen.sort()
    words = np.array([w for w, _ in chosen], np.int64)
    return Unigrams(total["n"] or 0, total["v"], words, np.array([n for _, n in chosen], np.int64))


def coded_texts(chunks: DataFrame, counts: DataFrame, known: Unigrams) -> DataFrame:
    """Per chunk its keys, class sequences and what the counts say of each text, stored.

    The counts of a chunk's words arrive before its texts, so a task holds one chunk.
    """
    spark = chunks.sparkSession
    classes = spark.createDataFrame(  # SHORTLIST rows at most
        [(int(w), i + 1) for i, w in enumerate(known.words)], "word long, class int"
    )
    kind = chunks.schema["keys"].dataType.simpleString()
    texts = chunks.where("pos IS NULL").select("chunk", "keys", "held", "ends", "codes")
    named = chunks.where("pos IS NOT NULL").select("chunk", "pos", "word")
    short = named.join(F.broadcast(classes), "word").select("chunk", "pos", "class")
    # Few rows: a shortlist per chunk at most.
    words = counts.select("chunk", "pos", "count", F.lit(-1).alias("class")).unionByName(
        short.select("chunk", "pos", F.lit(-1).cast("long").alias("count"), "class")
    )
    kinds = {"pos": "<i4", "count": "<i8", "class": "<i4"}
    rows = met(packed(words, kinds), texts)
    shares = known.shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, row in by_chunk(batches, kinds):
            yield finished(words, row)

    def finished(words: dict[str, np.ndarray], row: pa.RecordBatch) -> pa.RecordBatch:
        pos, count = words["pos"], words["count"]
        size = int(pos.max()) + 1
        counts, classes = np.zeros(size, np.int64), np.zeros(size, np.uint16)
        stated = count >= 0
        counts[pos[stated]] = count[stated]
        classes[pos[~stated]] = words["class"][~stated]
        ends = np.frombuffer(row["ends"][0].as_py(), "<i8")
        codes = _read(row["codes"][0].as_py(), "<i4", int(ends[-1]))
        share = np.log10(known.share(counts))
        rest = np.where(classes == 0, share - np.log10(shares[0]), 0)
        columns = [
            pa.array([ends.astype("<i8").tobytes()], pa.binary()),
            pa.array([_squeezed(classes[codes])], pa.binary()),
            *(
                pa.array([_sums(values[codes], ends).tolist()], pa.list_(kind))
                for values, kind in (
                    ((counts > 0).astype(np.int64), pa.int64()),
                    (share, pa.float64()),
                    (rest, pa.float64()),
                )
            ),
        ]
        return pa.RecordBatch.from_arrays(
            [row["keys"], row["held"], *columns],
            ["keys", "held", "ends", "classes", "n_known", "base", "rest"],
        )

    found = rows.mapInArrow(
        run,
        f"keys {kind}, held binary, ends binary, classes binary, n_known array<long>, "
        "base array<double>, rest array<double>",
    )
    return stored(found, new_folder(spark, "class-texts"))


@dataclass
class Model:
    """Context vectors with their weights by distance, class vectors and biases."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.near, self.far, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.context[first] * self.near + self.context[second] * self.far


def fresh_model(shares: np.ndarray, width: int = WIDTH) -> Model:
    """Small random vectors; the biases are the unigram model."""
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
    size = len(shares)
    weight = np.ones(width, np.float32)
    return Model(
        draw(size, width), weight, weight * np.float32(0.5), draw(size, width),
        np.log(shares).astype(np.float32),
    )


def contexts(classes: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each token; ends stand before a text."""
    first = np.concatenate([[end], classes[:-1]]).astype(np.int64)
    second = np.concatenate([[end], first[:-1]])
    starts = ends[:-1][ends[:-1] < len(classes)]
    first[starts] = second[starts] = end
    after = starts[(starts + 1 < len(classes)) & ~np.isin(starts + 1, starts)] + 1
    second[after] = end
    return first, second


def train(model: Model, triples: np.ndarray, counts: np.ndarray, shares: np.ndarray, seed: int) -> None:
    """One pass of noise-contrastive steps over distinct ``(second, first, class)`` numbers.

    A batch shares its ``NOISE`` draws, so that scores of noise are one matrix product.
    """
    rng = np.random.default_rng(seed)
    size = len(shares)
    expected = np.log(NOISE * shares).astype(np.float32)
    steps = [np.full(p.shape, 1e-8, np.float32) for p in model.parts()]
    order = rng.permutation(len(triples))
    usual = counts.mean()
    for at in range(0, len(order), BATCH):
        some = order[at : at + BATCH]
        word = triples[some] % size
        first = triples[some] // size % size
        second = triples[some] // (size * size)
        weight = (counts[some] / usual).astype(np.float32)
        noise = rng.choice(size, NOISE, p=shares / shares.sum())
        near, far = model.context[first], model.context[second]
        query = near * model.near + far * model.far
        good = model.target[word]
        score = np.einsum("ij,ij->i", query, good) + model.bias[word] - expected[word]
        pull = weight * (1 / (1 + np.exp(-score)) - 1)
        bad = model.target[noise]
        push = query @ bad.T + (model.bias[noise] - expected[noise])
        push = weight[:, None] / (1 + np.exp(-push))
        back = pull[:, None] * good + push @ bad
        slopes = [np.zeros_like(p) for p in model.parts()]
        np.add.at(slopes[0], first, back * model.near)
        np.add.at(slopes[0], second, back * model.far)
        slopes[1], slopes[2] = (back * near).sum(axis=0), (back * far).sum(axis=0)
        np.add.at(slopes[3], word, pull[:, None] * query)
        np.add.at(slopes[3], noise, push.T @ query)
        np.add.at(slopes[4], word, pull)
        np.add.at(slopes[4], noise, push.sum(axis=0))
        for part, slope, past in zip(model.parts(), slopes, steps):
            slope /= len(some)
            past += slope * slope
            part -= RATE * slope / np.sqrt(past)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[np.ndarray, float]] = {}
    for batch in batches:
        for piece, weight, data in zip(*(batch[c].to_pylist() for c in ("piece", "weight", "data"))):
            old, seen = total.get(piece, (0.0, 0.0))
            total[piece] = old + weight * np.frombuffer(data, "<f4").astype(float), seen + weight
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(total), pa.int32()),
            pa.array([w for _, w in total.values()], pa.float64()),
            pa.array([(x / w).astype("<f4").tobytes() for x, w in total.values()], pa.binary()),
        ],
        ["piece", "weight", "data"],
    )


def trained(coded: DataFrame, known: Unigrams, rounds: int = ROUNDS) -> Model:
    """Rounds of training in tasks and averaging; the parameters have a fixed size."""
    spark = coded.sparkSession
    shares, end = known.shares, known.end
    model = fresh_model(shares)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], turn: int = i) -> Iterator[pa.RecordBatch]:
            own = shared.value.filled(shared.value.flat())
            seen, size = 0.0, len(shares)
            for batch in batches:
                for row in range(batch.num_rows):
                    ends = np.frombuffer(batch["ends"][row].as_py(), "<i8")
                    classes = _read(batch["classes"][row].as_py(), "<u2", int(ends[-1]))
                    held = np.frombuffer(batch["held"][row].as_py(), bool)
                    learned = ~np.repeat(held, np.diff(ends))
                    first, second = contexts(classes, ends, end)
                    triples = (second * size + first) * size + classes
                    triples, counts = np.unique(triples[learned], return_counts=True)
                    if len(triples):
                        train(own, triples, counts, shares, SEED + turn)
                        seen += counts.sum()
            if seen:
                flat = own.flat()
                cuts = range(0, len(flat), PIECE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(len(cuts)), pa.int32()),
                        pa.array([seen] * len(cuts), pa.float64()),
                        pa.array(
                            [flat[a : a + PIECE].astype("<f4").tobytes() for a in cuts], pa.binary()
                        ),
                    ],
                    ["piece", "weight", "data"],
                )

        shape = "piece int, weight double, data binary"
        parts = coded.select("held", "ends", "classes").mapInArrow(run, shape)
        rows = parts.repartition("piece").mapInArrow(_added, shape).collect()
        if rows:
            flat = [np.frombuffer(r["data"], "<f4") for r in sorted(rows, key=lambda r: r["piece"])]
            model = model.filled(np.concatenate(flat))
    return model


def normalisers(model: Model, spark) -> np.ndarray:
    """Log of the sum of exponentials for every ``(first, second)``, by one product per second."""
    size = len(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(size)
        for batch in batches:
            rows = batch["id"].to_pylist()
            out = []
            for second in rows:
                score = model.predicted(every, np.full(size, second)) @ model.target.T + model.bias
                top = score.max(axis=1)
                out.append((top + np.log(np.exp(score - top[:, None]).sum(axis=1))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(out, pa.binary())], ["second", "sums"]
            )

    rows = spark.range(size).mapInArrow(run, "second long, sums binary").collect()
    found = np.empty((size, size), np.float32)
    for r in rows:
        found[:, r["second"]] = np.frombuffer(r["sums"], "<f4")
    return found


def class_scores(
    model: Model, sums: np.ndarray, classes: np.ndarray, ends: np.ndarray, end: int
) -> np.ndarray:
    """Log10 probability of every token's class, given the two before it."""
    first, second = contexts(classes, ends, end)
    out = np.empty(len(classes))
    for a in range(0, len(classes), BLOCK):
        b = a + BLOCK
        query = model.predicted(first[a:b], second[a:b])
        score = np.einsum("ij,ij->i", query, model.target[classes[a:b]]) + model.bias[classes[a:b]]
        out[a:b] = (score - sums[first[a:b], second[a:b]]) / np.log(10)
    return out


def scored(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shortlist: int = SHORTLIST
) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    spark = docs.sparkSession
    chunks = chunk_table(docs, key, text)
    counts = counted_words(chunks)
    known = unigrams(counts, shortlist)
    kind = docs.schema[key].dataType.simpleString()
    shape = (
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    coded = coded_texts(chunks, counts, known)
    model, sums = None, None
    if known.tokens:
        model = trained(coded, known)
        sums = normalisers(model, spark)
    # A thousand vectors and a million normalisers: of one size whatever the corpus.
    shared = spark.sparkContext.broadcast((model, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ends = np.frombuffer(batch["ends"][i].as_py(), "<i8")
                base = np.array(batch["base"][i].as_py())
                score = base
                if model is not None:
                    classes = _read(batch["classes"][i].as_py(), "<u2", int(ends[-1]))
                    own = class_scores(model, sums, classes, ends, known.end)
                    score = _sums(own, ends) + np.array(batch["rest"][i].as_py())
                keys = batch["keys"][i].values
                yield pa.RecordBatch.from_arrays(
                    [
                        keys,
                        pa.array(np.frombuffer(batch["held"][i].as_py(), bool)),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(batch["n_known"][i].as_py(), pa.int64()),
                        pa.array(np.full(len(keys), known.tokens), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(score, pa.float64()),
                    ],
                    ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(run, shape).withColumnRenamed("key", key)
