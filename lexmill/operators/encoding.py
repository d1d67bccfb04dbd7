"""Encoding texts to token ids and decoding them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from lexmill.functions import merging, text as T
from lexmill.operators.tokenizer import Tokenizer, merge_ranks, reverse_vocab
from lexmill.session import new_folder, stored

# The code of the word encoder travels with the query, so executors need not have this package.
cloudpickle.register_pickle_by_value(merging)

# Rows of one key that a task of a skewed join may hold.
ROWS_OF_KEY = 2_000_000
# Characters, distinct words and tokens of the rows that meet a table of their own.
CHUNK_CHARS = 8_000_000
CHUNK_WORDS = 50_000
CHUNK_TOKENS = 4_000_000


def word_encoder(tok: Tokenizer, memo_words: int = merging.MEMO_WORDS):
    """A column function from an array of words to an array of token ids.

    ``memo_words`` bounds what a task remembers; words that are distinct anyway need none of it.
    """
    tables = tok.tables

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return merging.WordEncoder(*tables.value, memo_words).batches(batches)

    return encode_words


def word_ids(words: DataFrame, tok: Tokenizer) -> DataFrame:
    """``(word, ids)`` for a table of distinct words."""
    if tok.broadcastable:
        return words.select("word", word_encoder(tok, 0)(F.array("word")).alias("ids"))
    return word_ids_by_join(words, tok)


def encode(
    df: DataFrame, tok: Tokenizer, key: Sequence[str], text: str = "text", output: str = "ids"
) -> DataFrame:
    """Add the token ids of each text.

    With tables small enough to broadcast this needs no shuffle: words are cut by built-in
    functions and looked up batch by batch where the text is.  Otherwise the distinct words are
    encoded by joins and the ids brought back by ``key``, which must be unique.
    """
    words = T.words(F.col(text), tok.specials)
    if tok.broadcastable:
        return df.withColumn(output, word_encoder(tok)(words))
    return encode_by_join(df, tok, key, text, output)


def join_spread(
    rows: DataFrame, table: DataFrame, key: str, by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join many ``rows`` to a ``table`` of few rows per ``key``, also when keys are skewed.

    The keys are counted first.  Rows of a key with more than ``ROWS_OF_KEY`` are spread by the
    columns ``by`` over as many groups as it takes, and the key's rows of the table are copied to each.
    """
    groups = F.ceil(F.col("count") / ROWS_OF_KEY).cast("int")
    hot = rows.groupBy(key).count().where(F.col("count") > ROWS_OF_KEY)
    hot = stored(hot.select(key, groups.alias("groups")), new_folder(rows.sparkSession, "hot-keys"))
    if hot.isEmpty():
        return rows.join(table, key, how)
    # Less than one key in ROWS_OF_KEY rows.
    groups = F.coalesce("groups", F.lit(1))
    spread = rows.join(hot, key, "left").withColumn("copy", F.pmod(F.hash(*by), groups))
    copies = table.join(hot, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), groups - 1)))
    return spread.drop("groups").join(copies.drop("groups"), [key, "copy"], how).drop("copy")


def chunked(df: DataFrame, size: Column, most: int) -> DataFrame:
    """``df`` stored with ``_chunk``, a number for neighbouring rows that hold about ``most`` of ``size``.

    The order of a row is stored with it, so its chunk is the same in every later job.
    """
    numbered = df.withColumn("_order", F.monotonically_increasing_id())
    kept = stored(numbered, new_folder(df.sparkSession, "chunked-rows"))
    found = kept.agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("total")).head()
    rows = max(1, found.rows * most // max(found.total or 0, 1))
    return kept.withColumn("_chunk", F.expr(f"_order div {rows}")).drop("_order")


def with_chunk_table(
    rows: DataFrame, table: DataFrame, added: Callable[[pa.Table, pa.Table], pa.Array], kind: str, output: str
) -> DataFrame:
    """``rows`` with the column that ``added`` makes of the rows of a chunk and the chunk's own ``table``.

    ``_chunk`` and ``_words`` are left out of the result.
    """
    names = [name for name in rows.columns if name not in ("_chunk", "_words", output)]
    shape = rows.select(*names, F.lit(None).cast(kind).alias(output)).schema

    def run(here: pa.Table, own: pa.Table) -> pa.Table:
        return here.select(names).append_column(output, added(here, own))

    return rows.groupBy("_chunk").cogroup(table.groupBy("_chunk")).applyInArrow(run, shape)


def encode_by_join(
    df: DataFrame, tok: Tokenizer, key: Sequence[str], text: str = "text", output: str = "ids"
) -> DataFrame:
    """``encode`` for tables too large to broadcast.

    Distinct words, of all texts and of each chunk of them, are joined, not occurrences: a chunk meets the
    ids of its own words, and its texts are encoded by these where they are.
    """
    folder = new_folder(df.sparkSession, "chunk-words")
    rows = chunked(df, F.char_length(text), CHUNK_CHARS)
    words = T.words(F.col(text), tok.specials)
    pairs = stored(rows.select("_chunk", F.explode(words).alias("word")).distinct(), folder)
    dictionary = word_ids_by_join(pairs.select("word").distinct(), tok)
    table = join_spread(pairs, dictionary, "word", ["_chunk"])

    def added(here: pa.Table, own: pa.Table) -> pa.Array:
        known = zip(own["word"].to_pylist(), own["ids"].to_pylist())
        return merging.KnownWords(known).in_slices(merging.one_array(here["_words"]))

    # Words are cut after the texts have moved.
    rows = rows.repartition("_chunk").withColumn("_words", words)
    return with_chunk_table(rows, table, added, "array<int>", output)


def word_ids_by_join(words: DataFrame, tok: Tokenizer) -> DataFrame:
    """``word_ids`` without broadcast.

    The merges that can play a part in a word are those whose token occurs in it, and the ids those of
    such tokens and of single bytes.  The distinct stretches of a chunk of words that are as long as some
    token are joined to both, which gives every chunk its own short tables.
    """
    rows = chunked(words.select("word"), F.lit(1), CHUNK_WORDS)
    merges = merge_ranks(tok.merges).withColumn("token", F.concat("left", "right"))
    # One number per length of a token, of which there are at most as many as bytes in the longest.
    lengths = sorted({1, *merges.agg(F.collect_set(F.octet_length("token"))).head()[0]})
    specials = frozenset(tok.specials)
    data = F.encode("word", "UTF-8")
    stretches = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.octet_length(data)),
            lambda first: F.transform(
                F.filter(F.lit(lengths), lambda n: n <= F.octet_length(data) - first + 1),
                lambda n: F.substring(data, first, n),
            ),
        )
    )
    parts = F.when(F.col("word").isin(list(specials)), F.array(data)).when(F.col("word") != "", stretches)
    tokens = rows.select("_chunk", F.explode(parts).alias("token")).distinct()
    tokens = stored(tokens, new_folder(words.sparkSession, "chunk-tokens"))
    rules = merges.groupBy("token").agg(F.collect_list(F.struct("left", "right", "rank")).alias("rules"))
    ids = reverse_vocab(tok.vocab).select(F.col("bytes").alias("token"), "id")
    table = join_spread(tokens, ids.join(rules, "token", "full"), "token", ["_chunk"])

    def added(here: pa.Table, own: pa.Table) -> pa.Array:
        known = own.select(["token", "id", "rules"]).to_pylist()
        numbers = {row["token"]: row["id"] for row in known if row["id"] is not None}
        ranks = {(r["left"], r["right"]): r["rank"] for row in known for r in row["rules"] or ()}
        found = merging.one_array(here["word"])
        single = pa.ListArray.from_arrays(pa.array(range(len(found) + 1), pa.int32()), found)
        return merging.WordEncoder(numbers, ranks, specials, 0).in_slices(single)

    return with_chunk_table(rows, table, added, "array<int>", "ids")


def decode(
    df: DataFrame, tok: Tokenizer, key: Sequence[str], ids: str = "ids", output: str = "text"
) -> DataFrame:
    """Add the text of each id array.

    Unknown ids give nothing, malformed UTF-8 gives U+FFFD.  A vocabulary that is small enough is
    sent to every executor, so decoding needs no shuffle; others are joined.
    """
    if not tok.broadcastable:
        return decode_by_join(df, tok, key, ids, output)
    table = tok.token_bytes

    @F.arrow_udf(BinaryType())
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return merging.TokenBytes(table.value).batches(batches)

    return df.withColumn(output, F.make_valid_utf8(decoded(F.col(ids)).cast("string")))


def decode_by_join(
    df: DataFrame, tok: Tokenizer, key: Sequence[str], ids: str = "ids", output: str = "text"
) -> DataFrame:
    """``decode`` for large or sparse vocabularies.

    The distinct ids of each chunk of rows are joined to the vocabulary, not every token.
    """
    rows = chunked(df, F.size(ids), CHUNK_TOKENS)
    pairs = rows.select("_chunk", F.explode(F.array_distinct(ids)).alias("id")).distinct()
    pairs = stored(pairs, new_folder(df.sparkSession, "chunk-ids"))
    table = join_spread(pairs, tok.vocab.select("id", "bytes"), "id", ["_chunk"])

    def added(here: pa.Table, own: pa.Table) -> pa.Array:
        known = zip(own["id"].to_pylist(), own["bytes"].to_pylist())
        return merging.TokenBytes(known).texts(merging.one_array(here[ids]))

    found = with_chunk_table(rows, table, added, "binary", output)
    return found.withColumn(output, F.make_valid_utf8(F.col(output).cast("string")))
