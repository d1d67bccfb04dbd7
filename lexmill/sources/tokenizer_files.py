"""Vocabulary JSON and merges text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.operators.tokenizer import Tokenizer, fits_broadcast, make_tokenizer


# Largest tables that are also written as one text file.
FILE_ROWS = 4_000_000
FILE_BYTES = 128 * 1024 * 1024


def _bytes(numbers: Column) -> Column:
    return F.unhex(F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0")), ""))


def _numbers(data: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("int"))


def _checked(value: Column, good: Column, message: str) -> Column:
    """``value`` where ``good`` holds; anything else ends the query."""
    refused = F.assert_true(F.coalesce(good, F.lit(False)), F.lit(message))
    return F.when(refused.isNull(), value)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """The text of a small file; one without any is refused."""
    found = spark.read.text(path, wholetext=True)
    if found.where(F.trim("value") != "").isEmpty():
        raise ValueError(f"{path} is empty")
    return found


def _parsed(value: Column, kind: str) -> Column:
    """A JSON object; malformed text and entries of another kind end the query."""
    found = F.from_json(value, kind, {"mode": "FAILFAST"})
    return _checked(found, found.isNotNull(), "the vocabulary is not a JSON object")


def _latest(vocab: DataFrame) -> DataFrame:
    """An id given twice keeps its first place and its last bytes."""
    return vocab.groupBy("id").agg(
        F.min("pos").alias("pos"), F.max_by("bytes", "pos").alias("bytes")
    ).select("pos", "id", "bytes")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, id, bytes)`` from ``{"id": [byte, …], …}``; ``pos`` is the place in the file.

    A path that ends in ``.parquet`` is read as the table itself.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    kind = "map<string,array<int>>"
    entries = _whole(spark, path).select(
        F.posexplode(F.map_entries(_parsed(F.col("value"), kind))).alias("pos", "entry")
    )
    numbers = F.col("entry.value")
    numbers = _checked(
        numbers,
        numbers.isNotNull() & F.forall(numbers, lambda n: F.coalesce(n.between(0, 255), F.lit(False))),
        "a token holds something other than bytes",
    )
    return _latest(
        entries.select(
            F.col("pos").cast("long").alias("pos"),
            F.col("entry.key").cast("int").alias("id"),
            _bytes(numbers).alias("bytes"),
        )
    )


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, left, right)`` from lines of two hex strings; blank lines are skipped.

    A path that ends in ``.parquet`` is read as the table itself.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r\n?|\n"), lambda line: F.trim(line) != "")
    sides = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    good = (F.size("sides") == 2) & F.forall("sides", lambda side: F.rlike(side, F.lit("^([0-9A-Fa-f]{2})+$")))
    rows = whole.select(F.posexplode(lines).alias("rank", "line")).withColumn("sides", sides)
    rows = rows.withColumn("sides", _checked(F.col("sides"), good, "a merge is not two hex strings"))
    return rows.select(
        "rank", F.unhex(F.col("sides")[0]).alias("left"), F.unhex(F.col("sides")[1]).alias("right")
    )


def load_tokenizer(
    spark: SparkSession, vocab_path: str, merges_path: str, specials: Sequence[str] = ()
) -> Tokenizer:
    return make_tokenizer(read_vocab(spark, vocab_path), read_merges(spark, merges_path), specials)


def _write_lines(df: DataFrame, order: str, line: Column, start: str, sep: str, end: str, path: str):
    """One text of all lines in order.  The tables are checked to be small before."""
    rows = df.select(F.struct(order, line.alias("line")).alias("row"))
    body = F.array_join(F.array_sort(F.collect_list("row"))["line"], sep)
    value = F.concat(F.lit(start), body, F.lit(end))
    rows.agg(value.alias("value")).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One JSON object ``{"id": [byte, …], …}`` in file order, in a single part file."""
    entry = F.concat(F.lit('  "'), F.col("id"), F.lit('": '), F.to_json(_numbers(F.col("bytes"))))
    _write_lines(vocab, "pos", entry, "{\n", ",\n", "\n}", path)


def write_merges(merges: DataFrame, path: str) -> None:
    """Lines of two hex strings in rank order, in a single part file."""
    line = F.concat_ws(" ", F.lower(F.hex("left")), F.lower(F.hex("right")))
    _write_lines(merges, "rank", line, "", "\n", "", path)


def save_tokenizer(tok: Tokenizer, prefix: str) -> tuple[str, str]:
    """Write ``<prefix>_vocab.parquet`` and ``<prefix>_merges.parquet``, and beside them
    ``<prefix>_vocab.json`` and ``<prefix>_merges.txt`` where each fits a single file.

    Returns the paths to load from.
    """
    paths = []
    for df, name, write, ending in (
        (tok.vocab, "vocab", write_vocab, "json"),
        (tok.merges, "merges", write_merges, "txt"),
    ):
        table, text = f"{prefix}_{name}.parquet", f"{prefix}_{name}.{ending}"
        df.write.mode("overwrite").parquet(table)
        stored = df.sparkSession.read.parquet(table)
        if fits_broadcast(stored, rows=FILE_ROWS, size=FILE_BYTES):
            write(stored, text)
            paths.append(text)
        else:
            paths.append(table)
    return paths[0], paths[1]


def byte_alphabet(spark: SparkSession) -> DataFrame:
    """``(byte, ch)``: the printable character that stands for each byte in GPT-2 files.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 in byte order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    rows = [(byte, chr(byte)) for byte in sorted(printable)]
    rows += [(byte, chr(0x100 + i)) for i, byte in enumerate(others)]
    return spark.createDataFrame(rows, "byte int, ch string")


def from_printable(token: Column, alphabet: DataFrame) -> Column:
    """Bytes of a token written in the printable alphabet."""
    rows = alphabet.collect()
    table = F.split(F.lit(",".join(f"{row.byte:02X}" for row in rows)), ",")
    chars = F.lit("".join(row.ch for row in rows))
    marks = F.transform(
        F.filter(F.split(token, ""), lambda ch: ch != ""), lambda ch: F.get(table, F.instr(chars, ch) - 1)
    )
    marks = _checked(
        marks, ~F.exists(marks, lambda mark: mark.isNull()), "a token holds a character that stands for no byte"
    )
    return F.unhex(F.array_join(marks, ""))


def to_printable(data: Column, alphabet: DataFrame) -> Column:
    """A token's bytes in the printable alphabet."""
    chars = {row.byte: row.ch for row in alphabet.collect()}
    table = F.array(*(F.lit(chars[byte]) for byte in range(256)))
    return F.array_join(F.transform(_numbers(data), lambda byte: F.get(table, byte)), "")


def write_printable(tok: Tokenizer, prefix: str) -> tuple[str, str]:
    """Write ``<prefix>_vocab.json`` as ``{"token": id, …}`` and ``<prefix>_merges.txt`` in the printable alphabet.

    Returns the two paths.  Larger tables than a single file holds are refused.
    """
    if not fits_broadcast(tok.vocab, tok.merges, rows=FILE_ROWS, size=FILE_BYTES):
        raise ValueError("the tokenizer tables are too large for single files")
    alphabet = byte_alphabet(tok.vocab.sparkSession)
    vocab_path, merges_path = f"{prefix}_vocab.json", f"{prefix}_merges.txt"
    # Of ids with equal bytes a file of this form can hold one, the one that encoding uses.
    last = tok.vocab.groupBy("bytes").agg(F.max_by("id", "pos").alias("id"), F.max("pos").alias("pos"))
    name = F.to_json(F.array(to_printable(F.col("bytes"), alphabet)))
    entry = F.concat(F.lit("  "), F.expr("substring(name, 2, char_length(name) - 2)"), F.lit(": "), F.col("id"))
    _write_lines(last.withColumn("name", name), "pos", entry, "{\n", ",\n", "\n}", vocab_path)
    sides = F.concat_ws(" ", to_printable(F.col("left"), alphabet), to_printable(F.col("right"), alphabet))
    _write_lines(tok.merges, "rank", sides, "", "\n", "", merges_path)
    return vocab_path, merges_path


def read_printable_merges(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, left, right)`` from lines of two tokens in the printable alphabet.

    Empty lines and a first line that begins with ``#version`` are skipped; other lines are errors.
    """
    alphabet = byte_alphabet(spark)
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(
        F.split("value", r"\r\n?|\n"),
        lambda line, i: (line != "") & ~((i == 0) & F.startswith(line, F.lit("#version"))),
    )
    rows = whole.select(F.posexplode(lines).alias("rank", "line")).withColumn("sides", F.split("line", " "))
    good = (F.size("sides") == 2) & ~F.array_contains("sides", "")
    rows = rows.withColumn("sides", _checked(F.col("sides"), good, "a merge is not two tokens"))
    return rows.select(
        "rank",
        from_printable(F.col("sides")[0], alphabet).alias("left"),
        from_printable(F.col("sides")[1], alphabet).alias("right"),
    )


def read_printable_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, id, bytes)`` from ``{"token": id, …}`` in the printable alphabet."""
    alphabet = byte_alphabet(spark)
    entries = _whole(spark, path).select(
        F.posexplode(F.map_entries(_parsed(F.col("value"), "map<string,int>"))).alias("pos", "entry")
    )
    return _latest(
        entries.select(
            F.col("pos").cast("long").alias("pos"),
            F.col("entry.value").alias("id"),
            from_printable(F.col("entry.key"), alphabet).alias("bytes"),
        )
    )
