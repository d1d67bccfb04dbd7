"""Training a byte-pair vocabulary from pre-token counts."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexmill.operators import pair_index
from lexmill.operators.merge_choice import Pair, choose_merges
from lexmill.operators.pair_index import PairIndex
from lexmill.operators.pairs import (
    among,
    changed_words,
    has_pair,
    merge_pairs,
    pair_counts,
    symbol_words,
    top_pairs,
    triple_counts,
)
from lexmill.operators.tokenizer import Tokenizer, tokenizer_from_merges
from lexmill.operators.training_journal import Journal, Settled
from lexmill.session import new_folder, stored

# Pairs a full count hands to the driver.  Updates may let the list grow to a multiple of it.
CANDIDATES = 512
GROWTH = 4
# Rounds between two writes of the state, the most a lost executor can make Spark repeat.
ROUNDS_PER_WRITE = 8
# A round that alters no more than this share of the words is followed by rounds over the index.
INDEX_SHARE = 0.05

_log = logging.getLogger(__name__)

Triple = tuple[str, str, str]


@dataclass(frozen=True)
class Candidates:
    """Exact counts of the most frequent pairs and of the triples made of two of them.

    Every pair that is not listed occurs at most ``unlisted`` times.
    """

    pairs: dict[Pair, int]
    triples: dict[Triple, int]
    unlisted: int


def symbols_of(run: str) -> tuple[str, ...]:
    """``(61)(62)`` to ``("61", "62")``."""
    return tuple(run[1:-1].split(")("))


def run_of(pair: Pair) -> str:
    return f"({pair[0]})({pair[1]})"


def count_triples(words: DataFrame, pairs: Sequence[Pair]) -> dict[Triple, int]:
    rows = triple_counts(words, [run_of(pair) for pair in pairs]).collect() if pairs else []
    return {(*symbols_of(row.front), symbols_of(row.back)[1]): row.cnt for row in rows}


def count_candidates(words: DataFrame, size: int) -> Candidates:
    """Candidates from a count over all words."""
    top = {symbols_of(row.pair): row.cnt for row in top_pairs(pair_counts(words), size).collect()}
    unlisted = min(top.values()) if len(top) == size else 0
    return Candidates(top, count_triples(words, list(top)), unlisted)


def update_candidates(known: Candidates, words: DataFrame, size: int) -> Candidates | None:
    """Candidates after a round, from the altered words only.

    Merging takes from the pairs there are, so a pair that gains is new and occurs in altered
    words only: its change is its count.  Unlisted pairs never gain.  Gives nothing when the list
    has become too short or too long, which calls for a new count.
    """
    changed = changed_words(words)
    listed = among([run_of(pair) for pair in known.pairs])
    most = GROWTH * size + len(known.pairs)
    rows = (
        pair_counts(changed)
        .where(f"pair in ({listed}) or cnt > {known.unlisted}")
        .limit(most + 1)
        .collect()
    )
    if len(rows) > most:
        return None
    pairs = dict(known.pairs)
    for row in rows:
        pair = symbols_of(row.pair)
        pairs[pair] = pairs.get(pair, 0) + row.cnt
    pairs = {pair: cnt for pair, cnt in pairs.items() if cnt > known.unlisted}
    short = known.unlisted > 0 and len(pairs) < max(1, size // 8)
    if short or len(pairs) > GROWTH * size:
        return None
    triples = {
        triple: cnt
        for triple, cnt in known.triples.items()
        if triple[:2] in pairs and triple[1:] in pairs
    }
    for triple, cnt in count_triples(changed, list(pairs)).items():
        triples[triple] = triples.get(triple, 0) + cnt
    return Candidates(pairs, triples, known.unlisted)


def next_merges(known: Candidates, tokens: set[str], limit: int) -> list[Pair]:
    """The merges that certainly come next, in order."""
    ranked = sorted(known.pairs.items(), key=lambda item: (item[1], item[0]), reverse=True)
    top = [(a, b, cnt) for (a, b), cnt in ranked]
    return choose_merges(top, known.unlisted, known.triples, tokens, limit) if top else []


class _Scanned:
    """The words as a table that every round reads whole, while a round alters many of them.

    Between writes they are persisted; every few rounds they are written, which cuts the lineage.
    """

    def __init__(self, words: DataFrame, journal: Journal, rounds_per_write: int, index_share: float):
        self.table = words.persist()
        self.journal, self.rounds_per_write, self.index_share = journal, rounds_per_write, index_share
        self.rounds, self.open = 0, []

    def words(self) -> DataFrame:
        return self.table

    def merged(self, batch: Sequence[Pair]) -> DataFrame:
        """The words as ``before`` and ``sym``, in turn for those before the round."""
        previous = self.table
        rows = previous.where(has_pair())
        sym = merge_pairs(F.col("sym"), batch).alias("sym")
        self.table = rows.select(F.col("sym").alias("before"), sym, "cnt").persist()
        self.previous = previous
        self.open += batch
        return self.table

    def settled(self) -> _Scanned | _Indexed:
        """Lets go of the words before the round; writes them now and then, and the index once few are altered."""
        total, altered = self.table.agg(F.count("cnt"), F.count_if(F.expr("before <> sym"))).first()
        self.previous.unpersist()
        self.rounds += 1
        _log.info("round over all words: %d altered of %d read", altered, total)
        if altered <= self.index_share * total:
            numbered = self.table.select(F.monotonically_increasing_id().alias("word"), "sym", "cnt")
            index = pair_index.build(numbered, self.journal.folder, 0)
            self.table.unpersist()
            self.journal.append(self.open, index=index)
            return _Indexed(index, self.journal, total)
        if self.rounds % self.rounds_per_write == 0:
            previous, path = self.table, f"{self.journal.folder}/words-{self.journal.steps + 1}"
            self.table = stored(previous.select("sym", "cnt").where(has_pair()), path).persist()
            previous.unpersist()
            self.journal.append(self.open, words=path)
            self.open = []
        return self

    def closed(self) -> None:
        self.table.unpersist()


class _Indexed:
    """The words behind an index by pair: a round reads those that hold one of its pairs."""

    def __init__(self, index: PairIndex, journal: Journal, total: int | None = None):
        self.index, self.journal, self.total = index, journal, total
        self.altered: DataFrame | None = None

    def words(self) -> DataFrame:
        return self.index.words()

    def merged(self, batch: Sequence[Pair]) -> DataFrame:
        """The words that the round alters, as ``before`` and ``sym``; the index holds them at once."""
        rows = self.index.holders([run_of(pair) for pair in batch])
        sym = merge_pairs(F.col("sym"), batch).alias("sym")
        self.closed()
        self.altered = rows.select("word", F.col("sym").alias("before"), sym, "cnt").persist()
        self.index = self.index.appended(self.altered)
        self.batch = batch
        return self.altered

    def settled(self) -> _Indexed:
        if _log.isEnabledFor(logging.INFO):
            _log.info("round by the index: %d read and altered of %s", self.altered.count(), self.total)
        if len(self.index.later) >= pair_index.GENERATIONS:
            self.index = self.index.rebased()
        self.journal.append(self.batch, index=self.index)
        return self

    def closed(self) -> None:
        if self.altered is not None:
            self.altered.unpersist()


def learn_merges(
    counts: DataFrame,
    limit: int,
    candidates: int = CANDIDATES,
    rounds_per_write: int = ROUNDS_PER_WRITE,
    folder: str | None = None,
    index_share: float = INDEX_SHARE,
) -> list[Pair]:
    """The first ``limit`` merges of a ``(word, cnt)`` table, fewer if no pair is left.

    The state is the table of words as symbol strings.  A round applies its merges to the words
    and sums the changes of the altered ones; only now and then are all words counted again.  The first
    rounds alter many words and read them all.  Once a round alters no more than ``index_share`` of them,
    they go behind an index by pair, and every round from then on reads only the words that hold one of
    its pairs.

    ``folder`` keeps a journal of what is settled, every few rounds at first and every round with the
    index.  A training that finds a journal there goes on from it and does not look at ``counts``; the
    folder belongs to one corpus.  Without one a fresh folder in the work folder is used.
    """
    if limit <= 0:
        return []
    spark = counts.sparkSession
    journal = Journal(spark, folder or new_folder(spark, "bpe"))
    found = journal.read()
    merges = list(found.merges)[:limit]
    if len(merges) >= limit:
        return merges
    if not found.steps:
        path = f"{journal.folder}/words-0"
        stored(symbol_words(counts), path)
        found = Settled(words=path)
    if found.index:
        state = _Indexed(found.index, journal)
    else:
        words = spark.read.schema("sym string, cnt long").parquet(found.words)
        state = _Scanned(words, journal, rounds_per_write, index_share)
    tokens = {f"{byte:02X}" for byte in range(256)} | {"".join(pair) for pair in merges}
    known = count_candidates(state.words(), candidates)
    while True:
        batch = next_merges(known, tokens, limit - len(merges))
        made = ["".join(pair) for pair in batch]
        fresh = len(set(made) - tokens) == len(made)
        merges += batch
        tokens.update(made)
        if not batch or len(merges) >= limit:
            break
        altered = state.merged(batch)
        updated = update_candidates(known, altered, candidates) if fresh else None
        known = updated or count_candidates(state.words(), candidates)
        state = state.settled()
    state.closed()
    return merges


def train_bpe(
    counts: DataFrame,
    vocab_size: int,
    specials: Sequence[str] = (),
    candidates: int = CANDIDATES,
    rounds_per_write: int = ROUNDS_PER_WRITE,
    folder: str | None = None,
) -> Tokenizer:
    """Vocabulary of up to ``vocab_size`` tokens: 256 bytes, the special tokens, the merges.

    The next merge is always the most frequent pair, among equals the larger one in byte order.
    A size below the base vocabulary gives the base vocabulary without merges.  ``folder`` keeps the
    journal of an interrupted training, as in ``learn_merges``.
    """
    wanted = vocab_size - 256 - len(specials)
    merges = learn_merges(counts, wanted, candidates, rounds_per_write, folder)
    pairs = [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in merges]
    return tokenizer_from_merges(counts.sparkSession, pairs, specials)
