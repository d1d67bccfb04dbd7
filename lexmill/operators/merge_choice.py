"""Choosing several merges at once that equal the one-by-one choice.

One merge per pass over the words would need a Spark job for each token of the vocabulary.  From
the counts of the most frequent pairs and of the triples made of two of them, the choice of the
next merges can often be foretold: for every pair a lower and an upper bound of its count is
kept, and a merge is accepted while its lower bound beats the upper bound of every other pair.

Merging ``(a, b)`` takes occurrences from the pairs ``(b, z)`` and ``(x, a)``, at most as many
as the triples ``(a, b, z)`` and ``(x, a, b)`` count, and makes the pairs ``(ab, z)`` and
``(x, ab)``, at most that often.  Both are exact while no earlier merge of the round touched the
triple.  A run of more than three symbols occurs at most as often as its rarest triple.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence, Set

Pair = tuple[str, str]


class PairBounds:
    """Bounds of the pair counts while merges are applied to the counts of one pass."""

    def __init__(
        self,
        top: Sequence[tuple[str, str, int]],
        unlisted: int,
        triples: Mapping[tuple[str, str, str], int],
    ):
        self.low: dict[Pair, int] = {(a, b): cnt for a, b, cnt in top}
        self.high = dict(self.low)
        self.listed = set(self.low)
        self.unlisted = unlisted
        self.triples = triples
        self.parts = {symbol: (symbol,) for pair in self.low for symbol in pair}
        self.merged: list[Pair] = []

    def best(self) -> Pair | None:
        """The pair that is certainly the next one to merge, if any."""
        if not self.low:
            return None
        pair = max(self.low, key=lambda p: (self.low[p], p))
        floor = self.unlisted if self.merged else 0
        if self.low[pair] <= floor:
            return None
        mark = (self.low[pair], pair)
        if any((cnt, other) > mark for other, cnt in self.high.items() if other != pair):
            return None
        return pair

    def merge(self, pair: Pair) -> None:
        a, b = pair
        token = a + b
        self.parts[token] = self.parts[a] + self.parts[b]
        del self.low[pair], self.high[pair]
        for x, y in list(self.low):
            if x == b:
                self._move((x, y), (token, y), (a, b, y), overlap=a == b or y == a)
            if y == a:
                self._move((x, y), (x, token), (x, a, b), overlap=a == b or x == b)
        self._add((token, token), 0, self._at_most((a, b, a, b)))
        self.merged.append(pair)

    def _move(self, old: Pair, new: Pair, run: tuple[str, str, str], overlap: bool) -> None:
        moved = self._at_most(run)
        self.low[old] -= moved
        if not overlap and self._untouched(run):
            self.high[old] -= moved
            self._add(new, moved, moved)
        else:
            self._add(new, 0, moved)

    def _add(self, pair: Pair, low: int, high: int) -> None:
        if high > 0:
            self.low[pair], self.high[pair] = low, high

    def _at_most(self, run: Sequence[str]) -> int:
        atoms = [atom for symbol in run for atom in self.parts[symbol]]
        return min(self._triple(*atoms[i : i + 3]) for i in range(len(atoms) - 2))

    def _triple(self, x: str, y: str, z: str) -> int:
        if (x, y) in self.listed and (y, z) in self.listed:
            return self.triples.get((x, y, z), 0)
        return self.unlisted

    def _untouched(self, run: tuple[str, str, str]) -> bool:
        x, y, z = run
        if any(len(self.parts[symbol]) > 1 for symbol in run):
            return False
        if (x, y) not in self.listed or (y, z) not in self.listed:
            return False
        return not any(
            q == x or p == z or (p, q) in ((x, y), (y, z)) for p, q in self.merged
        )


def choose_merges(
    top: Sequence[tuple[str, str, int]],
    unlisted: int,
    triples: Mapping[tuple[str, str, str], int],
    tokens: Set[str],
    limit: int,
) -> list[Pair]:
    """The next merges, at least one, at most ``limit``, in the order of the one-by-one loop.

    ``top`` holds the most frequent pairs ``(a, b, cnt)``, ``unlisted`` the largest count a pair
    outside of it can have, ``triples`` the counts of all triples of two listed pairs.  Symbols
    are hex.  A merge that makes an existing token ends the choice, as its new pairs would add to
    counts that exist already.
    """
    bounds = PairBounds(top, unlisted, triples)
    while len(bounds.merged) < limit:
        pair = bounds.best()
        if pair is None:
            break
        token = "".join(pair)
        known = token in tokens or token in bounds.parts
        bounds.merge(pair)
        if known:
            break
    return bounds.merged
