"""Quality rules as a short-circuit cascade of built-in expressions.

Every rule is a Boolean column that is true where it rejects a document.  ``measured_rules`` runs
each rule by itself on a bounded sample, takes its seconds and the share it rejects, and orders the
rules by rejections per second.  ``verdict`` then is one CASE expression in that order: a document
is tested up to the first rule that rejects it.  The order changes the cost and which rule is named,
never which documents are kept, as a document is kept when no rule rejects it.

Defined results: a null or empty text has no words and falls under ``few_words``; null values in
other columns do not matter; further columns pass through ``kept_rows`` as they are; equal rows get
equal verdicts; an empty table gives no rows (its rules keep the given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.session import new_folder, stored

# Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000
SEED = 17

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``; none for null."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    return found


def word_chars(found: Column) -> Column:
    return F.char_length(F.array_join(found, "")).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    every = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(every, lambda x: F.btrim(x, F.lit(SPACES)) != "")


def dup_lines(found: Column) -> Column:
    return let(found, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeat_words(found: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Sorting one number per window, its hash with the lowest bits replaced by its position, brings
    equal windows side by side.  Windows met that way are compared by their words, so the result is
    exact; it takes n log n steps for n words however often a window repeats.
    """

    def repeated(w: Column) -> Column:
        count = F.size(w) - 2
        # Minus a power of two above every position: as a mask it clears the position's bits.
        mask = F.negate(F.pow(F.lit(2.0), F.ceil(F.log2(count + 1))).cast("long"))
        return let(mask, lambda m: covered(w, m, count))

    def covered(w: Column, mask: Column, count: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(mask) + i,
        )
        sure = let(F.sort_array(keys), lambda s: alike(s, w, mask))
        return F.size(
            F.array_distinct(F.flatten(F.transform(sure, lambda p: F.array(p, p + 1, p + 2))))
        )

    def alike(keys: Column, w: Column, mask: Column) -> Column:
        part = lambda key: key.bitwiseAND(mask)
        met = F.filter(
            keys,
            lambda key, j: (part(key) == part(F.get(keys, j - 1)))
            | (part(key) == part(F.get(keys, j + 1))),
        )
        spelled = F.transform(
            F.transform(met, lambda key: (key - part(key)).cast("int")),
            lambda p: F.struct(F.concat_ws(" ", w[p], w[p + 1], w[p + 2]).alias("x"), p.alias("p")),
        )
        return let(
            F.sort_array(spelled),
            lambda s: F.transform(
                F.filter(
                    s, lambda e, j: (e.x == F.get(s, j - 1).x) | (e.x == F.get(s, j + 1).x)
                ),
                lambda e: e.p,
            ),
        )

    value = let(found, lambda w: F.when(F.size(w) > 3, repeated(w)).otherwise(0))
    return value.cast("long")


@dataclass(frozen=True)
class Features:
    """What rules look at; each is an expression until a caller stores it as a column."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


def features(text: Column, found: Column) -> Features:
    """Features of a text with its array of words."""
    return Features(
        text,
        F.size(found).cast("long"),
        word_chars(found),
        count_of(text, SYMBOLS),
        dup_lines(lines(text)),
        repeat_words(found),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], Column]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < MIN_WORDS),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule(
        "word_length",
        lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words),
    ),
    Rule("same_lines", lambda f: 100 * f.n_dup_lines > 30 * F.size(lines(f.text))),
    Rule("capitals", lambda f: 100 * count_of(f.text, "[A-Z]") > 50 * f.word_chars),
    Rule("digits", lambda f: 100 * count_of(f.text, "[0-9]") > 30 * f.word_chars),
    Rule("brackets", lambda f: 100 * count_of(f.text, r"[{}\[\]\\=;]") > 10 * f.word_chars),
)


def verdict(rules: Sequence[Rule], f: Features) -> Column:
    """Name of the first rule that rejects, null where none does."""
    case = F.lit(None).cast("string")
    for rule in reversed(rules):
        case = F.when(rule.rejects(f), F.lit(rule.name)).otherwise(case)
    return case


def rejected_by(rules: Sequence[Rule], text: str = "text") -> Column:
    """``verdict`` over a text column; features are computed when a rule asks for them."""
    column = F.col(text)
    return let(words(column), lambda w: verdict(rules, features(column, w)))


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def measured_rules(
    docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Measured]:
    """The rules with seconds and rejected share on the sample, best first.

    The sample is spread over the whole table and written once; each rule reads it by itself.
    """
    total = docs.count()
    sample = docs.select(text)
    if total > sample_rows:
        sample = sample.sample(sample_rows / total, SEED)
    sample = stored(sample, new_folder(docs.sparkSession, "rule-sample"))

    def run(rejects: Column) -> tuple[float, float]:
        start = time.perf_counter()
        row = sample.agg(F.count_if(rejects).alias("n"), F.count(F.lit(1)).alias("all")).first()
        return time.perf_counter() - start, row["n"] / max(1, row["all"])

    run(F.char_length(text) < 0)
    idle, _ = run(F.char_length(text) < 0)
    found = []
    for rule in rules:
        seconds, share = run(rejected_by([rule], text).isNotNull())
        found.append(Measured(rule, max(seconds - idle, 1e-3), share))
    return sorted(found, key=lambda m: -m.gain)


def ordered(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> list[Rule]:
    return [m.rule for m in measured_rules(docs, rules, text)]


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows that no rule rejects, base rules included."""
    rules = ordered(docs, BASE_RULES + RULES, text)
    return docs.where(rejected_by(rules, text).isNull())


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``."""
    rules = ordered(docs, RULES, text)
    column = F.col(text)

    def row(w: Column) -> Column:
        f = features(column, w)
        return F.struct(
            *(
                getattr(f, name).alias(name)
                for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            )
        )

    measured = docs.select(key, text, F.inline(F.array(let(words(column), row))))
    f = Features(column, *(F.col(name) for name in measured.columns[2:]))
    failed = F.coalesce(*(F.when(rule.rejects(f), True) for rule in BASE_RULES), F.lit(False))
    return measured.select(
        key,
        *measured.columns[2:],
        failed.alias("base_failed"),
        (~failed & verdict(rules, f).isNull()).alias("kept"),
    )
