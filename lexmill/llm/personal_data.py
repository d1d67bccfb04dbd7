"""Personal data by plain patterns, and by contexts that those patterns teach.

The plain patterns find e-mail addresses, IP addresses, card and phone numbers.  What they find are
seeds.  The word before a mention, with whether the mention has letters, is its lexical pattern; its
runs of digits and letters are its shape.  Patterns, shapes and instances form a graph over the whole
corpus.  In each round a pattern is scored by the share of its occurrences that hold trusted instances,
a shape likewise, whatever stands before it.  Patterns of enough score with enough different trusted
instances place instances that no plain pattern matches, words with a digit or several groups of digits.
An instance of which half the occurrences are so placed, and whose pattern and shape scores together
reach the limit, is trusted from the next round on and counts for other patterns, as seeds do.  So a
shape that no seed has needs a pattern of high score, a known shape a fair one, and what one pattern
taught qualifies the next.  Trusted instances are reported wherever such a pattern introduces them.
All of it is built-in functions, grouped sums and joins.

Defined results: a null or empty text has no findings, a very long one is searched whole; rows with equal
or null keys are handled by themselves; a mention that begins its text has no pattern; further columns
are ignored; an empty table gives no rows; equal scores at the limit count as reached.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.llm.quality_rules import let
from lexmill.session import new_folder, stored

# The plain patterns, with possessive runs.  A match can only begin where a run begins
# or the last match ended (\G), which keeps long runs without a match linear.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|)"
IP_PARTS = rf"^{PART}(?:\.{PART}){{3}}$"
KINDS = ("email", "ip", "card", "phone", "context")

# Groups of digits with blanks between, or a word with a digit up to its last letter or digit.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:"
    r"[+(]?[0-9][0-9().-]*+(?:\x20[(]?[0-9][0-9().-]*[0-9])++(?![^\x20\x09-\x0D,;:.!?])"
    r"|[^\x20\x09-\x0D0-9]*+[0-9](?:[^\x20\x09-\x0D]*[\p{L}0-9])?)"
)

# Characters before a match that are looked at for its context word.
CONTEXT_CHARS = 100
ROUNDS = 3
# Least score of a pattern, and of pattern and shape together, and different trusted instances of a pattern.
LEAST_CONTEXT, LEAST_SCORE = 0.5, 0.8
LEAST_SEEDS = 5
# Shortest token that a pattern may add.
LEAST_CHARS = 6

SPAN = "struct<kind:int,start:int,stop:int,text:string,before:string>"


def _matches(text: Column, pattern: str, kind: int, passes: Callable[[Column], Column]) -> Column:
    """Array of ``SPAN`` for the matches of a pattern that pass.

    Cutting the text at the matches gives the pieces between them, whose lengths give the offsets.
    """

    def spans(found: Column, pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(state: Column, i: Column) -> Column:
            piece, match = pieces[i], found[i]
            begin = state.at + F.char_length(piece)
            stop = begin + F.char_length(match)
            span = F.struct(
                F.lit(kind).alias("kind"),
                begin.alias("start"),
                stop.alias("stop"),
                match.alias("text"),
                F.right(piece, F.lit(CONTEXT_CHARS)).alias("before"),
            )
            out = F.when(passes(match), F.array_append(state.out, span)).otherwise(state.out)
            return F.struct(stop.alias("at"), out.alias("out"))

        return F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda state: state.out
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(
            F.size(found) > 0,
            let(F.split(text, pattern, -1), lambda pieces: spans(found, pieces)),
        ),
    )


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second one from the right doubled, ends in 0."""

    def weight(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.when(i % 2 == 1, doubled).otherwise(digit)

    total = F.aggregate(
        F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda sum_, i: sum_ + weight(i)
    )
    return total % 10 == 0


def _is_card(match: Column) -> Column:
    def test(digits: Column) -> Column:
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)

    # Nineteen digits and as many gaps are the longest that can pass.
    return F.when(
        F.char_length(match) <= 37, let(F.translate(match, " -", ""), test)
    ).otherwise(False)


def _is_phone(match: Column) -> Column:
    return F.char_length(F.translate(match, "+ ().-", "")).between(8, 15)


def _all(text: Column, *parts: Column) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*(F.coalesce(part, none) for part in parts))


def base_spans(text: Column) -> Column:
    """Spans of the plain patterns, by kind and start."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    return _all(
        text,
        F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, 0, lambda m: m.isNotNull())),
        F.when(digit, _matches(text, IP, 1, lambda m: F.regexp_like(m, F.lit(IP_PARTS)))),
        F.when(digit, _matches(text, CARD, 2, _is_card)),
        F.when(F.contains(text, F.lit("+")), _matches(text, PHONE, 3, _is_phone)),
    )


def token_spans(text: Column) -> Column:
    """Groups of digits and words with a digit, less closing punctuation, that may be identifiers."""
    long_enough = lambda m: F.char_length(m) >= LEAST_CHARS
    return F.when(
        F.regexp_like(text, F.lit("[0-9]")), _matches(text, TOKEN, 4, long_enough)
    )


def _context(before: Column) -> Column:
    """Last word before a match, in lower case without punctuation at its ends; null for none."""
    words = F.split(F.rtrim(F.translate(before, "\t\n\x0b\f\r", "     ")), " ")
    word = F.regexp_replace(F.lower(F.get(words, F.size(words) - 1)), r"^\p{P}+|[\p{P}&&[^:=#]]+$", "")
    return F.nullif(word, F.lit(""))


def _shape(match: Column) -> Column:
    """Runs of digits as 9, of letters as a, other characters as they are."""
    digits = F.regexp_replace(match, "[0-9]+", "9")
    return F.regexp_replace(digits, r"\p{L}+", "a")


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(_row, key, base, tokens)`` of every document, stored; tokens overlap no base span."""
    spark = docs.sparkSession
    column = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).alias(key),
        base_spans(column).alias("base"),
        token_spans(column).alias("tokens"),
    )
    found = stored(found, new_folder(spark, "personal-data"))
    free = F.filter(
        "tokens", lambda t: ~F.exists("base", lambda b: (b.start < t.stop) & (t.start < b.stop))
    )
    return found.withColumn("tokens", free)


def bootstrapped(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns ``(pattern, context)`` and instances ``(instance)`` that all rounds have taught.

    ``graph`` has ``(pattern, shape, instance, seed, n)``, one row for each pattern and instance.
    """
    spark = graph.sparkSession
    trusted = graph.withColumn("trust", F.col("seed"))
    share = F.sum(F.col("trust") * F.col("n")) / F.sum("n")
    for i in range(ROUNDS):
        patterns = trusted.groupBy("pattern").agg(
            share.alias("context"), F.sum("trust").alias("support")
        )
        good = (F.col("context") >= LEAST_CONTEXT) & (F.col("support") >= LEAST_SEEDS)
        patterns = patterns.where(good).select("pattern", "context")
        patterns = stored(patterns, new_folder(spark, f"patterns-{i}"))
        shapes = trusted.groupBy("shape").agg(share.alias("alike")).where("alike > 0")
        shapes = stored(shapes, new_folder(spark, f"shapes-{i}"))
        placed = F.when(F.col("context").isNotNull(), F.col("n"))
        instances = (
            graph.where("seed = 0")
            .join(patterns, "pattern", "left")
            .groupBy("instance", "shape")
            .agg(
                F.sum("n").alias("n"),
                F.sum(placed).alias("placed"),
                (F.sum(F.col("context") * F.col("n")) / F.sum(placed)).alias("context"),
            )
            .where("2 * placed >= n")
            .join(shapes, "shape", "left")
        )
        # One of the two speaks for the instance: 1 - (1 - context) * (1 - alike).
        score = F.col("context") + F.coalesce("alike", F.lit(0)) * (1 - F.col("context"))
        instances = instances.where(score >= LEAST_SCORE - 1e-9).select("instance")
        instances = stored(instances, new_folder(spark, f"instances-{i}"))
        promoted = instances.withColumn("promoted", F.lit(1))
        trusted = graph.join(promoted, "instance", "left").withColumn(
            "trust", F.greatest("seed", F.coalesce("promoted", F.lit(0)))
        )
    return patterns, instances


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, spans)``: arrays of ``(kind, start, stop)``, kinds as positions in ``KINDS``.

    ``spans`` holds the base and the instances that learned patterns introduce.
    """
    spark = docs.sparkSession
    found = occurrences(docs, key, text)

    def mentions(spans: str, seed: int) -> DataFrame:
        rows = found.select("_row", F.inline(spans))
        letters = F.when(F.regexp_like("text", F.lit(r"\p{L}")), "a").otherwise("9")
        context = _context(F.col("before"))
        return rows.select(
            "_row", "start", "stop", F.lit(seed).alias("seed"),
            F.concat_ws("\x01", context, letters).alias("pattern"),
            _shape(F.col("text")).alias("shape"),
            F.sha2("text", 256).alias("instance"),
        ).where(context.isNotNull())

    seeds, tokens = mentions("base", 1), mentions("tokens", 0)
    graph = stored(
        seeds.unionByName(tokens)
        .groupBy("pattern", "shape", "instance")
        .agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")),
        new_folder(spark, "pattern-graph"),
    )
    patterns, instances = bootstrapped(graph)
    added = (
        tokens.join(patterns, "pattern", "left_semi")
        .join(instances, "instance", "left_semi")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "stop"))).alias("added"))
    )
    base = F.transform("base", lambda s: F.struct(s.kind, s.start, s.stop))
    none = F.array().cast("array<struct<kind:int,start:int,stop:int>>")
    return found.join(added, "_row", "left").select(
        key, base.alias("base"), F.concat(base, F.coalesce("added", none)).alias("spans")
    )


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(name) for name in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string")
            ),
        ),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans, per document."""
    found = findings(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
