"""The batch jobs: train a tokenizer, tokenize a dataset, report compression, sample windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.functions.text import END_OF_TEXT
from lexmill.operators.bpe_training import train_bpe
from lexmill.operators.corpus import word_counts
from lexmill.operators.encoding import encode
from lexmill.operators.sampling import drawn_sample
from lexmill.operators.sequence import (
    BLOCK_TOKENS,
    GROUP_ROWS,
    running_offsets,
    split_groups,
    token_blocks,
    token_total,
    window_slices,
    window_starts,
)
from lexmill.operators.statistics import bytes_per_token
from lexmill.operators.tokenizer import Tokenizer
from lexmill.sources.npy import write_npy
from lexmill.sources.texts import ROOM, Paths, read_documents, read_lines, read_pieces, read_texts
from lexmill.sources.token_store import (
    SHARD_BLOCKS,
    ids_path,
    read_blocks,
    write_blocks,
    write_tokens,
)
from lexmill.sources.tokenizer_files import load_tokenizer, save_tokenizer

# Most directories a window sample names in its scan; larger samples read the whole sequence.
LISTED_SHARDS = 10_000


def train_tokenizer(
    spark: SparkSession,
    input_path: Paths,
    vocab_size: int = 5000,
    specials: Sequence[str] = (END_OF_TEXT,),
    output_dir: str = "bpe_tokenizer",
    prefix: str = "tokenizer",
    journal: str | None = None,
) -> Tokenizer:
    """Train on text files and write the vocabulary and the merges.

    With a ``journal`` folder a training that was stopped goes on where it was.
    """
    counts = word_counts(training_texts(spark, input_path, specials), specials)
    tok = train_bpe(counts, vocab_size, specials, folder=journal)
    save_tokenizer(tok, f"{output_dir.rstrip('/')}/{prefix}")
    return tok


def training_texts(spark: SparkSession, input_path: Paths, specials: Sequence[str]) -> DataFrame:
    """Texts to count, read in parallel; pre-tokens and special tokens stay whole."""
    if any("\n" in token or "\r" in token for token in specials):
        # Such a token may lie across the places where files are cut.
        return read_texts(spark, input_path)
    return read_pieces(spark, input_path)


def tokenize_dataset(
    spark: SparkSession,
    input_path: str,
    vocab_path: str,
    merges_path: str,
    output: str | None = None,
    specials: Sequence[str] = (END_OF_TEXT,),
    unit: str = "line",
    uint16: bool = True,
    block_tokens: int = BLOCK_TOKENS,
    npy_path: str | None = None,
) -> str:
    """Encode text files into one stored token sequence and return its folder.

    ``npy_path`` gets the sequence as one numpy file besides.

    ``unit="line"`` encodes line by line, so white space never joins across a line end;
    ``unit="document"`` gives the ids of the undivided text.
    """
    tok = load_tokenizer(spark, vocab_path, merges_path, specials)
    if unit == "line":
        rows, inside, group = read_lines(spark, input_path), ["row", "part"], GROUP_ROWS
    elif unit == "document":
        if any("\n" in token or "\r" in token for token in specials):
            raise ValueError("special tokens with line ends cannot be encoded in pieces")
        rows, inside, group = read_pieces(spark, input_path), ["row"], GROUP_ROWS * ROOM
    else:
        raise ValueError(f"unknown unit {unit!r}")
    bucket = ["file", "split"]
    folder = ids_path(input_path, output)
    encoded = encode(rows, tok, [*bucket, *inside]).drop("text")
    write_tokens(encoded, f"{folder}/tokens", uint16)
    tokens = split_groups(spark.read.parquet(f"{folder}/tokens"), rows=group)
    offsets = running_offsets(tokens, [*bucket, "group"], inside, "n")
    write_blocks(token_blocks(offsets, block_tokens), f"{folder}/blocks")
    if npy_path:
        write_npy(read_blocks(spark, f"{folder}/blocks"), npy_path, block_tokens, uint16)
    return folder


def training_windows(
    spark: SparkSession,
    folder: str,
    samples: int,
    context: int,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Random windows of a stored sequence; a small sample reads only the directories it needs."""
    blocks = read_blocks(spark, f"{folder}/blocks")
    starts = window_starts(spark, samples, token_total(blocks), context, seed)
    if samples <= LISTED_SHARDS:
        tokens = SHARD_BLOCKS * block_tokens
        ends = F.expr(f"sequence(start div {tokens}, (start + {context}) div {tokens})")
        shards = starts.select(F.explode(ends).alias("shard")).distinct().collect()
        blocks = blocks.where(F.col("shard").isin([row.shard for row in shards]))
    return window_slices(starts, blocks, context, block_tokens)


@dataclass(frozen=True)
class Corpus:
    """A named corpus and the tokenizer files it is measured with."""

    name: str
    text_path: str
    vocab_path: str
    merges_path: str


def compression(name: str, sample: DataFrame, tok: Tokenizer, key: Sequence[str]) -> DataFrame:
    """Bytes per token over sampled documents of one corpus, three decimals."""
    return bytes_per_token(encode(sample, tok, key)).select(
        F.lit(name).alias("corpus"),
        "n_bytes",
        "n_tokens",
        F.round("bytes_per_token", 3).alias("bytes_per_token"),
    )


def compression_report(
    spark: SparkSession, corpora: Sequence[Corpus], n: int = 10, seed: int = 42
) -> DataFrame:
    """Bytes per token over ``n`` sampled documents of each corpus, three decimals."""
    reports = []
    for corpus in corpora:
        tok = load_tokenizer(spark, corpus.vocab_path, corpus.merges_path, (END_OF_TEXT,))
        documents = read_documents(spark, corpus.text_path)
        order = ["file", "split", "row"]
        sample = drawn_sample(documents, n, seed, order)
        reports.append(compression(corpus.name, sample, tok, order))
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result
