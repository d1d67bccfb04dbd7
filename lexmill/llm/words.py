"""Words and word shingles of whole texts, in Arrow and numpy, for use inside tasks.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``.  A word's number is a 64-bit hash; a
shingle's number mixes those of its words.  Two given shingles share a number with a chance of
about one in 10**19.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# Bytes of text that are cut into words at once.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Returns freed memory of Arrow and numpy to the system.

    Workers live from task to task and share the executor's memory with the JVM; what allocators keep
    after a slice, a batch or another operator would add up to more than the tables in use.
    """
    pa.default_memory_pool().release_unused()
    # That of the C library, which numpy and Python's large objects use.
    pa.system_memory_pool().release_unused()


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, or one row where it is longer.

    Memory freed since the slice before is given back first, and after the last one.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            give_back()
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


@dataclass(frozen=True)
class Words:
    """Words of several texts: those of text ``i`` are ``codes[ends[i] : ends[i + 1]]``."""

    ends: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    def numbers(self) -> np.ndarray:
        """The 64-bit number of every word."""
        found = self.distinct.cast(pa.binary()).to_pylist()
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        return table[self.codes]


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Words of an array of texts (null: none); ``lower`` folds A-Z only."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts) if lower else texts)
    parts = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    found = parts.flatten()
    blank = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)
    if blank.any():  # a text without words is one empty word to Arrow
        counts[blank] = 0
        found = found.filter(pc.not_equal(found, ""))
    coded = found.dictionary_encode()
    return Words(
        np.r_[0, np.cumsum(counts)],
        coded.indices.to_numpy(zero_copy_only=False),
        coded.dictionary,
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def windows(numbers: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all windows of ``width`` words, in order of position."""
    count = max(0, len(numbers) - width + 1)
    out = numbers[:count].copy()
    for j in range(1, width):
        out ^= out >> np.uint64(32)
        out *= _STEP
        out += numbers[j : j + count]
    return mixed(out)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Distinct numbers in ascending order."""
    found = np.sort(numbers)
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text its distinct shingles in ascending order.

    A text of fewer words is one shingle, a text without words has none.
    """
    words = words_of(texts)
    numbers = words.numbers()
    every = windows(numbers, width)
    out = []
    for start, stop in zip(words.ends[:-1], words.ends[1:]):
        if stop - start >= width:
            out.append(distinct(every[start : stop - width + 1]))
        else:
            out.append(windows(numbers[start:stop], max(1, int(stop - start))))
    return out
