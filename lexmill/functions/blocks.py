"""The per-task part of token blocks: ids that follow each other, cut at multiples of a length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Ids that are put together at once, unless one row has more.
SLICE_IDS = 1 << 22


class BlockCutter:
    """Cuts rows into blocks as they come by.

    Rows that follow each other in the sequence make a run, of which no more is held than has not
    reached the end of its block.  Blocks that lie in a run are whole; the ends of a run are pieces,
    which have to meet those of other runs.  Rows in any order give blocks and pieces that make up the
    same sequence; the more of them follow each other, the fewer pieces there are.
    """

    def __init__(self, block_tokens: int) -> None:
        self.length = block_tokens
        self.open: list[pa.Array] = []
        self.at = self.stop = 0

    def add(self, start: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if start != self.stop:
            yield from self.closed()
        if not self.open:
            self.at = self.stop = start
        self.open.append(ids)
        self.stop += len(ids)
        end = self.stop // self.length * self.length
        if end > self.at:
            run = pa.concat_arrays(self.open)
            yield self._rows(run, end)
            # A copy, as a slice would keep all of the run.
            rest = run.slice(end - self.at)
            self.open, self.at = [rest.take(pa.array(np.arange(len(rest))))] if len(rest) else [], end

    def closed(self) -> Iterator[pa.RecordBatch]:
        """What is open, as a piece."""
        if self.open:
            yield self._rows(pa.concat_arrays(self.open), self.stop)
        self.open = []

    def _rows(self, run: pa.Array, end: int) -> pa.RecordBatch:
        """The ids from the first one of ``run`` to ``end``, a row for each block."""
        blocks = np.arange(self.at // self.length, -(-end // self.length))
        begins = np.maximum(blocks * self.length, self.at)
        cuts = np.append(begins, end) - self.at
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), run.slice(0, end - self.at))
        columns = [pa.array(blocks), pa.array(begins), pa.array(np.diff(cuts) == self.length), lists]
        return pa.RecordBatch.from_arrays(columns, ["block", "at", "whole", "ids"])

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``(block, at, whole, ids)`` of rows ``(start, ids)``, none of them empty."""
        for batch in batches:
            starts, lists = batch["start"].to_numpy(), batch["ids"]
            sizes = lists.value_lengths().to_numpy()
            breaks = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
            slices = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_IDS)) + 1
            cuts = [0, *np.union1d(breaks, slices).tolist(), batch.num_rows]
            for first, stop in zip(cuts[:-1], cuts[1:]):
                if first < stop:
                    yield from self.add(int(starts[first]), lists.slice(first, stop - first).flatten())
        yield from self.closed()
