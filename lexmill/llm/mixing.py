"""Mixing a corpus to target weights by soft membership.

A softmax regression, fitted on at most ``LABELLED_ROWS`` labelled documents, gives every document a
posterior over domains.  Document rates are then fitted: non-negative numbers ``r`` for which the
expected tokens of each domain, the sum of ``r * tokens * posterior``, come to the targets.  Among such
numbers those nearest one are taken; the objective is

    (expected - target) W (expected - target) + RIDGE * sum_d tokens_d * (r_d - 1) ** 2

in shares of all tokens, with a ridge so small that it only breaks ties.  W is the inverse of the domains'
second moments.  The fit is projected gradient descent on the rates: a step moves every rate against its
slope, ``posterior @ W (expected - target)`` and the ridge's, and puts it back at zero where it fell below;
momentum speeds it up.  A step needs the few domain totals only: tasks replay the latest steps on their
rows in numpy and return partial totals; every ``REPLAYED`` steps the rates are stored beside the
posteriors, so nothing is moved and a lost executor costs its tasks.  The steps end when the duality gap shows the rates to lie within
``RATE_ERROR`` of the optimal ones, or after ``MOST_STEPS``, which is reported; targets that cannot be
reached are so missed and not an error.  The rate is a function of the text and the steps, so applying it
needs no join.  A document is taken ``floor(rate)`` times, and once more where a hash of its key is below
the rest.

Defined results: a null or empty text has no tokens, the prior as posterior and no say in the totals; a
null key counts as an empty one in the hash; null labels and unlabelled documents are not learned from;
without labels all posteriors are equal; equal rows get equal rates; an empty table gives no rows; further
columns pass through ``mixed_rows`` and are ignored elsewhere.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.words import slices, words_of
from lexmill.session import new_folder, stored

LOG = logging.getLogger(__name__)

# Domains by (quality, toxic), and the shares of tokens they should have.
DOMAINS = {"clean": (1, 0), "poor": (0, 0), "toxic": (1, 1), "poor_toxic": (0, 1)}
TARGETS = {"clean": 0.92, "poor": 0.06, "toxic": 0.015, "poor_toxic": 0.005}

# Bound on the labelled documents a classifier is fitted on.
LABELLED_ROWS = 3_000
FEATURE_BITS = 16
STYLE = 5
LEAST_ROWS = 4
FIT_STEPS, FIT_RATE, FIT_DECAY = 150, 0.1, 2e-4

RIDGE = 1e-3
# Share of tokens below which a domain loses weight.  Under the small ridge that leaves the targets of
# other domains as they are; a domain nearly absent misses its own instead of taking all rates with it.
LEAST_SHARE = 0.01
# Root mean square error of the rates at which the steps end, and the most of them.
RATE_ERROR, MOST_STEPS = 0.004, 100
# Rows whose steps a task replays at once, and steps that are replayed before the rates are stored.
TOGETHER, REPLAYED = 4096, 12
# Relative error of a total from which the fit is reported as a miss.
MISS = 0.05


@dataclass(frozen=True)
class Features:
    """Features of a batch: word buckets present in each row, style values, tokens."""

    ends: np.ndarray
    buckets: np.ndarray
    style: np.ndarray
    tokens: np.ndarray


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    found = pc.count_substring_regex(texts, pattern)
    return found.to_numpy(zero_copy_only=False).astype(float)


def features(texts: pa.Array) -> Features:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    words = words_of(texts)
    tokens = np.diff(words.ends)
    rows = np.repeat(np.arange(len(tokens)), tokens)
    bucket = (words.numbers() >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    present = np.sort(rows << FEATURE_BITS | bucket)
    if len(present):
        present = present[np.r_[True, present[1:] != present[:-1]]]
    counts = np.bincount(present >> FEATURE_BITS, minlength=len(tokens))
    n = np.maximum(tokens, 1)
    chars = np.maximum(pc.binary_length(texts).to_numpy(zero_copy_only=False), 1)
    style = np.stack(
        [
            np.ones(len(tokens)),
            np.minimum(_count(texts, "[#*$%&|<>]") / n, 3),
            np.minimum(_count(texts, "[A-Z]") / chars, 1) * 3,
            np.minimum(_count(texts, "[0-9!?]") / n, 3),
            counts / n * 3,
        ],
        axis=1,
    )
    return Features(
        np.r_[0, np.cumsum(counts)], present & ((1 << FEATURE_BITS) - 1), style, tokens
    )


def _row_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[ends[i] : ends[i + 1]]``."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[ends[1:]] - total[ends[:-1]]


@dataclass(frozen=True)
class Classifier:
    """Weights of word buckets and style values for each domain."""

    buckets: np.ndarray
    style: np.ndarray

    def posteriors(self, f: Features) -> np.ndarray:
        score = _row_sums(self.buckets[f.buckets], f.ends) + f.style @ self.style
        score = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
        return score / score.sum(axis=1, keepdims=True)


def fit_classifier(f: Features, labels: np.ndarray, domains: int) -> Classifier:
    """Softmax regression by Adam; buckets that fewer than ``LEAST_ROWS`` rows have stay at zero."""
    size = 1 << FEATURE_BITS
    words, style = np.zeros((size, domains)), np.zeros((STYLE, domains))
    if not len(labels):
        return Classifier(words, style)
    usual = np.bincount(f.buckets, minlength=size) >= LEAST_ROWS
    kept = usual[f.buckets]
    rows = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(f.ends))[kept]
    # Places by a table of all buckets: sorting the features would hold them several times over.
    names = np.flatnonzero(usual)
    table = np.zeros(size, np.int32)
    table[names] = np.arange(len(names))
    place = table[f.buckets[kept]]
    wanted = np.eye(domains)[labels]
    params = [np.zeros((len(names), domains)), np.zeros((STYLE, domains))]
    # The prior: without words a text gets the shares of the labels.
    params[1][0] = np.log((wanted.sum(axis=0) + 0.5) / (len(labels) + 0.5 * domains))
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]

    def added(values: np.ndarray, at: np.ndarray, to: np.ndarray, count: int) -> np.ndarray:
        """Row sums of ``values[at]`` by ``to``, a domain at a time, which bounds the copies."""
        sums = [np.bincount(to, values[:, i][at], count) for i in range(domains)]
        return np.stack(sums, axis=1) if len(at) else np.zeros((count, domains))

    for step in range(1, FIT_STEPS + 1):
        score = added(params[0], place, rows, len(labels)) + f.style @ params[1]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        error = (score / score.sum(axis=1, keepdims=True) - wanted) / len(labels)
        slopes = [
            added(error, rows, place, len(names)) + FIT_DECAY * params[0],
            f.style.T @ error + FIT_DECAY * params[1],
        ]
        for p, slope, m, v in zip(params, slopes, first, second):
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            p -= FIT_RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    words[names] = params[0]
    return Classifier(words, params[1])


def labelled_classifier(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    domains: dict[str, tuple[int, int]] = DOMAINS, most: int = LABELLED_ROWS,
) -> Classifier:
    """Fits on the ``most`` labelled documents whose key hashes come first; others are not moved."""
    kinds = list(domains.values())
    domain = F.lit(None).cast("int")
    for i, (quality, toxic) in enumerate(kinds):
        here = (F.col("quality") == quality) & (F.col("toxic") == toxic)
        domain = F.when(here, F.lit(i)).otherwise(domain)
    known = labels.select(F.col(key), domain.alias("_domain")).where("_domain IS NOT NULL")
    known = known.join(docs.select(key).distinct(), key, "left_semi")
    chosen = known.orderBy(F.xxhash64(key), key, "_domain").limit(most)
    # At most ``most`` keys, whatever the tables hold.
    picked = docs.select(key, F.col(text).alias("text")).join(
        F.broadcast(stored(chosen, new_folder(docs.sparkSession, "labelled-keys"))), key
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = features(batch["text"])
            cut = [f.buckets[a:b].astype("<i4").tobytes() for a, b in zip(f.ends[:-1], f.ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["_domain"], pa.array(cut, pa.binary()),
                 pa.array([x.astype("<f8").tobytes() for x in f.style], pa.binary())],
                ["domain", "buckets", "style"],
            )

    rows = picked.mapInArrow(run, "domain int, buckets binary, style binary")
    # Repeated keys can make more rows than keys; which of them stay is no matter of domains.
    rows = rows.orderBy(F.xxhash64("buckets", "style"), "domain").limit(most).collect()
    if not rows:
        empty = Features(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros((0, STYLE)), None)
        return fit_classifier(empty, np.zeros(0, np.int64), len(kinds))
    ends = np.r_[0, np.cumsum([len(r["buckets"]) // 4 for r in rows])]
    buckets = np.frombuffer(b"".join(r["buckets"] for r in rows), "<i4")
    style = np.frombuffer(b"".join(r["style"] for r in rows), "<f8").reshape(len(rows), STYLE)
    return fit_classifier(
        Features(ends, buckets, style, None), np.array([r["domain"] for r in rows]), len(kinds)
    )


@dataclass(frozen=True)
class Steps:
    """Projected gradient steps: what each took from a rate per posterior, and its momentum."""

    slopes: np.ndarray
    momentum: np.ndarray

    def replay(
        self, posterior: np.ndarray, now: np.ndarray | None = None, before: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates after the last step and before it, and the point the last step was taken from.

        Starts from rates of one, or from rates that earlier steps left.
        """
        if now is None or before is None:
            now = before = np.ones(len(posterior))
        ahead = now
        pulls = posterior @ self.slopes.T
        for pull, part in zip(pulls.T, self.momentum):
            ahead = now + part * (now - before)
            moved = ahead - (pull + RIDGE * (ahead - 1)) / (1 + RIDGE)
            before, now = now, np.maximum(moved, 0)
        return now, before, ahead

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        return self.replay(posterior)[0]

    def since(self, first: int) -> Steps:
        return Steps(self.slopes[first:], self.momentum[first:])

    def but_last(self) -> Steps:
        return Steps(self.slopes[:-1], self.momentum[:-1])

    def then(self, slope: np.ndarray, part: float) -> Steps:
        return Steps(np.vstack([self.slopes, slope]), np.append(self.momentum, part))


@dataclass(frozen=True)
class Totals:
    """Sums over all rows, in shares of all tokens, after some steps."""

    reached: np.ndarray  # by domain
    moments: np.ndarray  # second moments of the posteriors
    far: float  # squared distance of the rates from one
    turn: float  # positive where the last step went against the momentum
    dual: float  # the rows' part of the dual at the last slope


def row_totals(
    steps: Steps, tokens: np.ndarray, posterior: np.ndarray, *left: np.ndarray
) -> np.ndarray:
    """What rows add to ``Totals``, flat, and their tokens; ``left`` are rates that earlier steps left."""
    now, before, ahead = steps.replay(posterior, *left)
    weighted = posterior * tokens[:, None]
    pull = posterior @ steps.slopes[-1] if len(steps.slopes) else np.zeros(len(tokens))
    best = np.maximum(1 - pull / RIDGE, 0)
    return np.r_[
        now @ weighted,
        (weighted.T @ posterior).ravel(),
        tokens @ (now - 1) ** 2,
        tokens @ ((ahead - now) * (now - before)),
        tokens @ (pull * best + RIDGE / 2 * (best - 1) ** 2),
        tokens.sum(),
    ]


def metric(moments: np.ndarray) -> np.ndarray:
    """Inverse of the second moments of the posteriors; a domain nearly absent has little weight.

    In this metric the domain totals have curvature one, so a step of length one settles them as far as
    no rate is held at zero.
    """
    return np.linalg.inv(moments + LEAST_SHARE * np.eye(len(moments)))


def projected(totals: Callable[[Steps], Totals], target: np.ndarray) -> tuple[Steps, dict]:
    """Accelerated projected gradient steps until the duality gap bounds the error of the rates.

    The gap is at least ``RIDGE / 2`` times the mean squared distance from the optimal rates.  Momentum
    starts anew where a step turns against it.
    """
    count = len(target)
    steps = Steps(np.zeros((0, count)), np.zeros(0))
    found = totals(steps)
    weight = metric(found.moments)
    last, before, heat = found.reached, found.reached, 1.0
    start, gap = found.reached, np.inf
    while True:
        # The rates' totals are linear, so are those of the point that momentum leads to.
        part = 0.0
        if len(steps.momentum) and found.turn <= 0:
            following = (1 + np.sqrt(1 + 4 * heat * heat)) / 2
            part, heat = (heat - 1) / following, following
        else:
            heat = 1.0
        slope = weight @ (last + part * (last - before) - target)
        ahead = steps.then(slope, part)
        found = totals(ahead)
        before, last, steps = last, found.reached, ahead
        off = last - target
        height = off @ weight @ off / 2 + RIDGE / 2 * found.far
        floor = found.dual - slope @ np.linalg.solve(weight, slope) / 2 - target @ slope
        gap = min(gap, height - floor)
        settled = gap <= RIDGE / 2 * RATE_ERROR**2
        if settled or len(steps.slopes) == MOST_STEPS:
            break
    return steps, {
        "before": start, "target": target, "reached": last, "gap": gap, "settled": settled,
        "steps": len(steps.slopes),
    }


def fit_rates(rows: DataFrame, targets: list[float]) -> tuple[Steps, dict]:
    """Steps for rows ``(tokens, posterior)`` and a report of totals reached."""
    count = len(targets)
    size = count + count * count + 4
    target = np.array(targets) / sum(targets)

    ones = F.lit(1.0)
    table, done = rows.withColumns({"now": ones, "before": ones}), 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                posterior = part["posterior"].flatten().to_numpy().reshape(-1, count)
                yield part, posterior, [part[name].to_numpy() for name in ("now", "before")]

    def moved(steps: Steps) -> DataFrame:
        """The table after more steps, stored, so that later passes replay the steps since."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, posterior, left in read(batches):
                now, before, _ = steps.replay(posterior, *left)
                columns = [part["tokens"], part["posterior"], pa.array(now), pa.array(before)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

        return stored(table.mapInArrow(run, table.schema), new_folder(rows.sparkSession, "rates"))

    def totals(steps: Steps) -> Totals:
        nonlocal table, done
        if len(steps.slopes) - done > REPLAYED:
            # All steps but the last, whose gradient the totals below are asked for.
            table, done = moved(steps.since(done).but_last()), len(steps.slopes) - 1
        fresh = steps.since(done)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for part, posterior, left in read(batches):
                sums += row_totals(fresh, part["tokens"].to_numpy().astype(float), posterior, *left)
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["sums"])

        # A row for each task, summed here: a step is one stage without a shuffle.
        sums = np.zeros(size)
        for part in table.mapInArrow(run, "sums array<double>").collect():
            sums += part["sums"]
        sums /= max(sums[-1], 1.0)
        return Totals(sums[:count], sums[count:-4].reshape(count, count), *sums[-4:-1])

    if not rows.agg(F.sum("tokens")).first()[0]:
        none, zeros = Steps(np.zeros((0, count)), np.zeros(0)), np.zeros(count)
        return none, {"before": zeros, "target": target, "reached": zeros, "gap": 0.0, "settled": True, "steps": 0}
    return projected(totals, target)


@dataclass(frozen=True)
class Mix:
    """A fitted mix: a rate for any text."""

    classifier: Classifier
    steps: Steps

    def rates(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        posterior = self.classifier.posteriors(f)
        return posterior, self.steps.rates(posterior)


def copies(rates: np.ndarray, keys: list) -> np.ndarray:
    """Whole numbers whose mean over keys is the rate."""
    whole = np.floor(rates)
    draw = np.array(
        [zlib.crc32(b"mix" + str("" if k is None else k).encode()) / 2**32 for k in keys]
    )
    return (whole + (draw.reshape(len(rates)) < rates - whole)).astype(np.int64)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    targets: dict[str, float] = TARGETS,
) -> tuple[Mix, dict]:
    spark = docs.sparkSession
    classifier = labelled_classifier(docs, labels, key, text)
    shared = spark.sparkContext.broadcast(classifier)  # 2 ** FEATURE_BITS weights per domain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = features(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.tokens, pa.int64()),
                 pa.array(list(shared.value.posteriors(f)), pa.list_(pa.float64()))],
                ["tokens", "posterior"],
            )

    rows = docs.select(F.col(text).alias("text")).mapInArrow(
        run, "tokens long, posterior array<double>"
    )
    # What the steps read: a few numbers per document.
    rows = stored(rows, new_folder(spark, "posteriors"))
    steps, report = fit_rates(rows, [targets[name] for name in DOMAINS])
    LOG.log(
        logging.INFO if report["settled"] else logging.WARNING,
        "mix: %d steps, duality gap %.3g", report["steps"], report["gap"],
    )
    for name, *values in zip(DOMAINS, report["before"], report["target"], report["reached"]):
        line = "%s tokens: %.5f before, %.5f wanted, %.5f reached"
        far = abs(values[2] - values[1]) > MISS * values[1]
        LOG.log(logging.WARNING if far else logging.INFO, line, name, *values)
    return Mix(classifier, steps), report


def mixed_rows(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, each as often as its rate says; one that is taken never is left out."""
    shared = docs.sparkSession.sparkContext.broadcast(mix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            _, rates = shared.value.rates(features(batch[text]))
            times = copies(rates, batch[key].to_pylist())
            yield batch.take(pa.array(np.repeat(np.arange(len(times)), times), pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``(doc_id, n_tokens, one posterior per domain, rate, copies)`` of every document."""
    mix, _ = fit(docs, labels, targets=targets)
    shared = docs.sparkSession.sparkContext.broadcast(mix)
    names = [f"p_{name}" for name in DOMAINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = features(batch["text"])
            posterior, rates = shared.value.rates(f)
            times = copies(rates, batch["doc_id"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(f.tokens, pa.int64()),
                 *(pa.array(column, pa.float64()) for column in posterior.T),
                 pa.array(rates, pa.float64()), pa.array(times, pa.int64())],
                ["doc_id", "n_tokens", *names, "rate", "copies"],
            )

    shape = ", ".join(f"{name} double" for name in names)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, n_tokens long, {shape}, rate double, copies long"
    )
