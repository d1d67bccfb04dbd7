"""Column functions on text: splitting, pre-tokenization, byte symbols."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lexmill.functions.letters import LETTER, NUMBER

END_OF_TEXT = "<|endoftext|>"

# The GPT-2 pre-token pattern.  (?U) makes \s cover all Unicode white space.
PRETOKEN_PATTERN = (
    r"(?U)'(?:[sdmt]|ll|ve|re)"
    rf"| ?[{LETTER}]+"
    rf"| ?[{NUMBER}]+"
    rf"| ?[^\s{LETTER}{NUMBER}]+"
    r"|\s+(?!\S)"
    r"|\s+"
)

# The 29 characters Python's str.strip() removes.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n`` (universal newlines)."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def special_pattern(specials: Sequence[str], longest_first: bool) -> str:
    """Alternation over quoted special tokens.

    Encoding tries longer tokens first; training keeps the order of the list.
    """
    if any(not token for token in specials):
        raise ValueError("a special token cannot be empty")
    ordered = sorted(specials, key=len, reverse=True) if longest_first else list(specials)
    return "|".join(re.escape(token) for token in ordered)


def plain_parts(text: Column, specials: Sequence[str], longest_first: bool) -> Column:
    """Array of the text between special tokens."""
    if not specials:
        return F.array(text)
    return F.split(text, special_pattern(specials, longest_first), -1)


def segments(text: Column, specials: Sequence[str]) -> Column:
    """Array of ``(seg, is_special, text)``, specials kept, empty parts dropped."""

    def part(is_special: bool, value: Column) -> Column:
        return F.struct(F.lit(is_special).alias("is_special"), value.alias("text"))

    if specials:
        pattern = special_pattern(specials, longest_first=True)
        # Every plain part is followed by a special token, but for the last.
        rounds = F.arrays_zip(
            F.split(text, pattern, -1).alias("plain"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("special"),
        )
        parts = F.flatten(
            F.transform(rounds, lambda r: F.array(part(False, r["plain"]), part(True, r["special"])))
        )
    else:
        parts = F.array(part(False, text))
    kept = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.transform(
        kept,
        lambda p, i: F.struct(
            i.alias("seg"), p["is_special"].alias("is_special"), p["text"].alias("text")
        ),
    )


def pretokens(text: Column) -> Column:
    """Array of the GPT-2 pre-tokens of a text without special tokens."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN_PATTERN), F.lit(0))


def words(text: Column, specials: Sequence[str] = ()) -> Column:
    """Pre-tokens of a whole text in order; each special token is one element."""
    if not specials:
        return pretokens(text)
    return F.flatten(
        F.transform(
            segments(text, specials),
            lambda s: F.when(s["is_special"], F.array(s["text"])).otherwise(pretokens(s["text"])),
        )
    )


def symbols(word: Column) -> Column:
    """A word as its byte symbols: ``the`` is ``(74)(68)(65)``.

    A symbol is the hex of its bytes between own delimiters, so merging the pair ``(a)(b)`` is a
    plain string replacement by ``(ab)``.  ``)`` sorts below every hex digit, so ordering such
    strings orders the byte sequences, prefixes first.
    """
    return F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "($1)")

