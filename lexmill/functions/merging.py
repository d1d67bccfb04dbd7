"""The per-batch part of encoding: words of an Arrow batch to token ids."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Ranks = dict[tuple[bytes, bytes], int]

# Words a task remembers, and twice as many at most, and their greatest length.
MEMO_WORDS = 400_000
MEMO_LENGTH = 100
# Words whose ids are laid out at once, unless one row has more.
SLICE_WORDS = 1 << 19
# Stands for a token that is not in the vocabulary until it becomes NULL.
NO_ID = -1


def merge_symbols(word: bytes, ranks: Ranks) -> list[bytes]:
    """Merge the adjacent pair of lowest rank everywhere, until no pair has a rank.

    The places of each pair are kept by rank, so a word of n bytes takes O(n log n) steps.
    """
    symbols: list[bytes] = [word[i : i + 1] for i in range(len(word))]
    end = len(symbols)
    after = list(range(1, end + 1))
    before = list(range(-1, end))
    places: dict[int, list[int]] = {}
    for i in range(end - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            places.setdefault(rank, []).append(i)
    waiting = list(places)
    heapify(waiting)
    while waiting:
        current = heappop(waiting)
        for i in sorted(places.pop(current)):
            j = after[i]
            if j >= end or ranks.get((symbols[i], symbols[j])) != current:
                continue  # one of the two was merged away meanwhile
            symbols[i] += symbols[j]
            symbols[j] = b""
            after[i] = after[j]
            before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end:
                    rank = ranks.get((symbols[k], symbols[after[k]]))
                    if rank is not None:
                        if rank not in places:
                            places[rank] = []
                            heappush(waiting, rank)
                        places[rank].append(k)
    return [symbol for symbol in symbols if symbol]


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column of a table in one piece."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class WordEncoder:
    """Token ids of words, remembered as packed integers for the words met lately."""

    def __init__(
        self, ids: dict[bytes, int], ranks: Ranks, specials: frozenset[str], memo_words: int = MEMO_WORDS
    ):
        self.ids = ids
        self.memo_words = memo_words
        self.ranks = ranks
        self.specials = specials
        # Words since the memo was last full, and those of the time before.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                data = word.encode()
                symbols = [data] if word in self.specials else merge_symbols(data, self.ranks)
                found = array("i", [self.ids.get(symbol, NO_ID) for symbol in symbols]).tobytes()
            if self.memo_words and len(word) <= MEMO_LENGTH:
                if len(self.memo) >= self.memo_words:
                    self.memo, self.older = {}, self.memo
                self.memo[word] = found
        return found

    def batch(self, lists: pa.ListArray) -> pa.ListArray:
        """Each distinct word of the batch is encoded once; ids are laid out by numpy."""
        words = lists.flatten().dictionary_encode()
        pieces = [self.word(word) for word in words.dictionary.to_pylist()]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(pieces), np.int32)
        codes = words.indices.to_numpy(zero_copy_only=False)
        per_word = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        place = np.repeat(starts[codes] - ends[:-1], per_word)
        place += np.arange(ends[-1])
        values = flat[place]
        words_per_row = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        rows = ends[np.concatenate(([0], np.cumsum(words_per_row)))]
        return pa.ListArray.from_arrays(
            pa.array(rows, pa.int32()),
            pa.array(values, pa.int32(), mask=values == NO_ID),
            mask=lists.is_null(),
        )

    def in_slices(self, lists: pa.ListArray) -> pa.ListArray:
        """``batch`` over as many rows at a time as hold ``SLICE_WORDS`` words, or one row."""
        stops = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)
        found, start, before = [], 0, 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(stops, before + SLICE_WORDS, side="right")))
            found.append(self.batch(lists.slice(start, stop - start)))
            start, before = stop, stops[stop - 1]
        return pa.concat_arrays(found) if found else self.batch(lists)

    def batches(self, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield self.in_slices(lists)


class KnownWords(WordEncoder):
    """Ids of words that were all encoded before, by their word."""

    def __init__(self, known: Iterator[tuple[str, list[int | None]]]):
        packed = {w: array("i", [NO_ID if i is None else i for i in ids]).tobytes() for w, ids in known}
        self.word = packed.__getitem__


class TokenBytes:
    """The tokens of a vocabulary in one buffer, to be gathered for a whole batch of ids at once."""

    def __init__(self, rows: Iterator[tuple[int, bytes]]):
        found = sorted(dict(rows).items())
        self.ids = np.array([i for i, _ in found], np.int64)
        # One more entry, of no bytes, stands for ids that are not in the vocabulary.
        self.tokens = pa.array([*(token for _, token in found), b""], pa.large_binary())

    def places(self, ids: pa.Array) -> np.ndarray:
        """Where the token of each id lies; null and unknown ids lie at the last entry."""
        wanted = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(self.ids):
            return np.zeros(len(wanted), np.int64)
        place = np.searchsorted(self.ids, wanted)
        known = self.ids[np.minimum(place, len(self.ids) - 1)] == wanted
        if ids.null_count:
            known &= ids.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, place, len(self.ids))

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """Bytes of every array of ids; unknown ids give nothing, a null array null.

        The gathered tokens lie one after the other, so a row's bytes are a stretch of them.
        """
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        rows = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        found = self.tokens.take(pa.array(self.places(lists.flatten())))
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, np.int64, len(found) + 1)[rows] if len(found) else 0 * rows
        whole = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lists), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")]
        )
        return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())

    def batches(self, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield self.texts(lists)
