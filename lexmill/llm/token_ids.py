"""Token ids of whole texts by a public tokenizer file, remembered by word, for use inside tasks."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexmill.llm.words import words_of

# Pieces remembered by a Python worker before its table starts anew, and encoded together when new.
REMEMBERED = 500_000
TOGETHER = 2_000

# Punctuation that is cut off the end of a word, after a letter or digit.
CLOSING = ".,!?;:"
# Small letters of Latin alphabets.
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x180)) if chr(c).islower()]


class WordIds:
    """Ids of words by a tokenizer that drops white space, folds case and cuts at punctuation.

    The ids of a text are those of its words in turn, as nothing is looked at beyond white space.
    Before a word is looked up it is folded (A-Z only) and freed of closing punctuation, which the
    tokenizer treats alike and which leaves far fewer pieces to remember; words that may hold a
    special token are left as they are.  New pieces of Latin letters that the normaliser leaves alone
    go straight to the model, spelled as the tokenizer spells each letter; others are encoded
    together, joined by spaces, and the offsets of the ids tell which piece each belongs to.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        spelled = {
            c: cut.pre_tokenize_str(c)[0][0] for c in LETTERS if normal.normalize_str(c) == c
        }
        self.letters = str.maketrans(spelled)
        self.lettered = re.compile(f"[{''.join(spelled)}]+").fullmatch
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ends = [np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.uint32)]
        self.total = 0

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces))))
        self.ids.append(ids)
        self.ends.append(self.total + np.cumsum(counts))
        self.total += len(ids)

    def _learn(self, pieces: list[str]) -> None:
        plain, others = [], []
        for piece in pieces:
            (plain if self.lettered(piece) else others).append(piece)
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        found = [
            [token.id for token in tokenize(piece if piece.isascii() else piece.translate(letters))]
            for piece in plain
        ]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        self._add(plain, ids, counts)
        for start in range(0, len(others), TOGETHER):
            some = others[start : start + TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            begins = np.cumsum([0, *(len(piece) + 1 for piece in some[:-1])])
            counts = np.bincount(
                np.searchsorted(begins, at, side="right") - 1, minlength=len(some)
            )
            self._add(some, np.array(found.ids, np.uint32), counts)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text (null: none)."""
        words = words_of(texts, lower=False)
        folded = pc.if_else(
            pc.match_substring(words.distinct, "<|"), words.distinct, pc.ascii_lower(words.distinct)
        )
        stems = pc.ascii_rtrim(folded, characters=CLOSING)
        cut = pc.and_(
            pc.not_equal(stems, folded), pc.match_substring_regex(stems, "[A-Za-z0-9]$")
        )
        tails = [
            word[len(stem) :]
            for word, stem in zip(folded.filter(cut).to_pylist(), stems.filter(cut).to_pylist())
        ]
        every = pa.concat_arrays([pc.if_else(cut, stems, folded), pa.array(tails, pa.string())])
        every = every.dictionary_encode()
        code = every.indices.to_numpy(zero_copy_only=False)
        many = len(words.distinct)
        has_tail = cut.to_numpy(zero_copy_only=False)
        tail = np.full(many, -1, np.int32)
        tail[has_tail] = code[many:]

        spelled = every.dictionary.to_pylist()
        if len(self.place) + len(spelled) > REMEMBERED:
            self._forget()
        self._learn([piece for piece in spelled if piece not in self.place])
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        self.ids, self.ends = [ids], [ends]
        places = np.fromiter(map(self.place.__getitem__, spelled), np.int64, len(spelled))

        # The pieces of all texts in order: a stem, and its tail where there is one.
        sizes = 1 + has_tail[words.codes].astype(np.int8)
        stops = np.cumsum(sizes, dtype=np.int64)
        pieces = np.repeat(code[:many][words.codes], sizes)
        with_tail = np.flatnonzero(sizes == 2)
        pieces[stops[with_tail] - 1] = tail[words.codes[with_tail]]
        piece_ends = np.r_[0, stops][words.ends]
        # An array as long as the words or ids goes as soon as the next one is made of it.
        del sizes, with_tail

        starts = ends[places].astype(np.int32)
        counts = (ends[places + 1] - ends[places]).astype(np.int32)[pieces]
        stops = np.cumsum(counts, dtype=np.int64)
        total = int(stops[-1]) if len(stops) else 0
        # Position in ``ids`` of each id: the piece's first place plus the steps since it began.
        first = (starts[pieces] - (stops - counts)).astype(np.int32)
        del pieces
        at = np.repeat(first, counts)
        del first, counts
        at += np.arange(total, dtype=np.int32)
        flat = ids[at]
        del at
        cuts = np.r_[0, stops][piece_ends]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The table of a worker, kept from task to task."""
    return WordIds(path)
