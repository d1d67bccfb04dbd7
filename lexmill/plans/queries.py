"""The registered queries: each operator over whole tables of a data folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import scores as S, text as T
from lexmill.operators import (
    bpe_training,
    corpus,
    encoding,
    evaluation,
    pairs,
    sampling,
    sequence,
    statistics,
    tokenizer,
)
from lexmill.plans import jobs
from lexmill.session import new_folder, stored
from lexmill.sources import npy, texts, token_store, tokenizer_files
from lexmill.streaming import encoding as streaming, sequence as stream_sequence

Query = Callable[[SparkSession, str], DataFrame]

MERGES = 24
VOCAB_SIZE = 256 + 1 + MERGES
SPECIALS = (T.END_OF_TEXT,)
DOUBLE_SPECIALS = (T.END_OF_TEXT, T.END_OF_TEXT * 2)
BLOCK_TOKENS = 1024
CONTEXT = 64
SAMPLES = 256
SAMPLE_SIZE = 10
SEED = 42
TEMPERATURE = 0.7
TOP_P = 0.9

# Tokenizers by application and data folder.
_trained: dict[tuple[str, str], tokenizer.Tokenizer] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def marked_text(text: str = "text") -> Column:
    """The text with a marker after each sentence and two after each clause."""
    sentences = F.replace(F.col(text), F.lit(". "), F.lit("." + T.END_OF_TEXT))
    return F.replace(sentences, F.lit(", "), F.lit("," + T.END_OF_TEXT * 2))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", marked_text().alias("text"))


def train(spark: SparkSession, sf_dir: str) -> tokenizer.Tokenizer:
    counts = corpus.word_counts(documents(spark, sf_dir))
    return bpe_training.train_bpe(counts, VOCAB_SIZE, SPECIALS)


def trained(spark: SparkSession, sf_dir: str) -> tokenizer.Tokenizer:
    """The tokenizer of the documents, trained once per application and read from its files."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _trained:
        prefix = f"{new_folder(spark, 'tokenizer')}/documents"
        files = tokenizer_files.save_tokenizer(train(spark, sf_dir), prefix)
        _trained[place] = tokenizer_files.load_tokenizer(spark, *files, SPECIALS)
    return _trained[place]


def ids_text(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


def long(*names: str) -> list[Column]:
    return [F.col(name).cast("long").alias(name) for name in names]


# Corpus


def doc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts are cut at markers, the others at blank lines."""
    blank = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    source = documents(spark, sf_dir).select(
        "doc_id", F.when(F.col("lang") == "en", marked_text()).otherwise(blank).alias("text")
    )
    return corpus.split_documents(source, ["doc_id"]).select(*long("doc_id", "doc"), "text")


def segment_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.segment_rows(marked_documents(spark, sf_dir), ["doc_id"], DOUBLE_SPECIALS)
    return rows.select(*long("doc_id", "seg"), "is_special", "text")


def pretokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("words"))
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_pretokens"),
        F.md5(F.array_join("words", "|").cast("binary")).alias("digest"),
    )


def pretoken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.pretoken_rows(marked_documents(spark, sf_dir), ["doc_id"], SPECIALS)
    return rows.select(*long("doc_id", "seg", "pos"), "word")


def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_counts(documents(spark, sf_dir))


def pretoken_counts_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_counts(marked_documents(spark, sf_dir), DOUBLE_SPECIALS)


def pretoken_counts_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return corpus.word_counts(turns, by=["role"])


def pretoken_counts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_counts(table(spark, sf_dir, "pages"), text="html")


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and read line by line."""
    folder = new_folder(spark, "lines")
    documents(spark, sf_dir).select("text").write.text(folder)
    lines = texts.read_lines(spark, folder)
    return lines.groupBy("text").agg(F.count(F.lit(1)).alias("cnt"))


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one text file per language and read file by file."""
    folder = new_folder(spark, "whole")
    rows = documents(spark, sf_dir).select("lang", "text").repartition("lang")
    rows.write.partitionBy("lang").text(folder)
    found = texts.read_texts(spark, f"{folder}/*", texts.WHOLE_BYTES)
    lang = F.regexp_extract("file", "lang=([^/]+)", 1)
    lines = F.split("text", "\n")
    return found.groupBy(lang.alias("lang")).agg(
        F.sum(F.char_length("text")).alias("n_chars"), F.sum(F.size(lines) - 1).alias("n_lines")
    )


def marked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with markers between them and split by the reader."""
    folder = new_folder(spark, "marked")
    documents(spark, sf_dir).select("text").write.option("lineSep", T.END_OF_TEXT).text(folder)
    found = texts.read_documents(spark, folder)
    return found.groupBy("text").agg(F.count(F.lit(1)).alias("cnt"))


def piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and read in pieces, without the line ends pieces begin with."""
    folder = new_folder(spark, "pieces")
    documents(spark, sf_dir).select(F.rtrim("text", F.lit(" \n")).alias("text")).write.text(folder)
    found = texts.read_pieces(spark, folder).select(F.ltrim("text", F.lit("\n")).alias("text"))
    return found.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("cnt"))


# Pairs and training


def byte_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pretoken_counts(spark, sf_dir)
    return counts.select("word", T.symbols(F.col("word")).alias("sym"))


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.symbol_words(pretoken_counts(spark, sf_dir))


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_columns(pairs.pair_counts(symbol_counts(spark, sf_dir)))


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_columns(pairs.top_pairs(pairs.pair_counts(symbol_counts(spark, sf_dir)), 20))


def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_columns(pairs.top_pairs(pairs.pair_counts(symbol_counts(spark, sf_dir)), 1))


def merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words after the first merges, as training leaves them."""
    counts = stored(pretoken_counts(spark, sf_dir), new_folder(spark, "counts"))
    merges = bpe_training.learn_merges(counts, MERGES)
    sym = pairs.merge_pairs(T.symbols(F.col("word")), merges)
    return counts.select("word", sym.alias("sym"), "cnt")


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(spark, sf_dir).merges.select(
        *long("rank"), F.hex("left").alias("left_hex"), F.hex("right").alias("right_hex")
    )


def bpe_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(spark, sf_dir).vocab.select(*long("id"), F.hex("bytes").alias("token_hex"))


def tokenizer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary read back from its files, with a further special token added."""
    tok = trained(spark, sf_dir)
    more = tokenizer.make_tokenizer(tok.vocab, tok.merges, DOUBLE_SPECIALS)
    return more.vocab.select(*long("id"), F.hex("bytes").alias("token_hex"))


def printable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary and merges written in the printable alphabet and read back."""
    prefix = f"{new_folder(spark, 'printable')}/documents"
    vocab, merges = tokenizer_files.write_printable(trained(spark, sf_dir), prefix)
    vocab = tokenizer_files.read_printable_vocab(spark, vocab).select(
        *long("id"), F.hex("bytes").alias("token_hex")
    )
    rules = tokenizer_files.read_printable_merges(spark, merges).select(
        (-1 - F.col("rank").cast("long")).alias("id"),
        F.concat_ws(" ", F.hex("left"), F.hex("right")).alias("token_hex"),
    )
    return vocab.unionByName(rules)


def token_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trained vocabulary against the base vocabulary."""
    tok = train(spark, sf_dir)
    found = tokenizer.token_difference(tok.vocab, tokenizer.base_vocab(spark, DOUBLE_SPECIALS))
    return found.select(F.hex("bytes").alias("token_hex"), "side")


def reverse_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary in which many ids share their bytes."""
    vocab = documents(spark, sf_dir).select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").alias("id"),
        F.encode(F.col("source"), "UTF-8").alias("bytes"),
    )
    found = tokenizer.reverse_vocab(vocab)
    return found.select(F.hex("bytes").alias("token_hex"), *long("id"))


def merge_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge list in which pairs repeat."""
    merges = documents(spark, sf_dir).select(
        F.col("doc_id").alias("rank"),
        F.encode(F.col("lang"), "UTF-8").alias("left"),
        F.encode(F.col("source"), "UTF-8").alias("right"),
    )
    found = tokenizer.merge_ranks(merges)
    return found.select(
        F.hex("left").alias("left_hex"), F.hex("right").alias("right_hex"), *long("rank")
    )


# Encoding


def word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pretoken_counts(spark, sf_dir).select("word")
    found = encoding.word_ids(words, trained(spark, sf_dir))
    return found.select("word", ids_text("ids").alias("ids"))


def word_ids_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pretoken_counts(spark, sf_dir).select("word")
    found = encoding.word_ids_by_join(words, trained(spark, sf_dir))
    return found.select("word", ids_text("ids").alias("ids"))


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(documents(spark, sf_dir), trained(spark, sf_dir), ["doc_id"])


def stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded documents as the dataset job stores them."""
    folder = new_folder(spark, "tokens")
    token_store.write_tokens(encoded(spark, sf_dir).select("doc_id", "ids"), folder)
    return spark.read.parquet(folder)


def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select(
        "doc_id", F.size("ids").cast("long").alias("n"), ids_text("ids").alias("ids")
    )


def encode_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that contain the special token."""
    marked = marked_documents(spark, sf_dir)
    ids = encoding.encode(marked, trained(spark, sf_dir), ["doc_id"])
    return ids.select("doc_id", ids_text("ids").alias("ids"))


def encode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = marked_documents(spark, sf_dir)
    ids = encoding.encode_by_join(marked, trained(spark, sf_dir), ["doc_id"])
    return ids.select("doc_id", ids_text("ids").alias("ids"))


def encode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and encoded line by line; occurrences of each line."""
    folder = new_folder(spark, "lines")
    documents(spark, sf_dir).select("text").write.text(folder)
    lines = texts.read_lines(spark, folder)
    ids = encoding.encode(lines, trained(spark, sf_dir), ["file", "split", "row", "part"])
    return ids.groupBy("text", ids_text("ids").alias("ids")).agg(F.count(F.lit(1)).alias("cnt"))


def encode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of the documents encoded as a stream; occurrences of each line's ids."""
    folder = new_folder(spark, "stream")
    documents(spark, sf_dir).select("text").write.text(f"{folder}/in")
    records = streaming.stream_records(spark, f"{folder}/in", batch_bytes=8 << 20)
    query = streaming.write_encoded_stream(
        records, trained(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint"
    )
    query.awaitTermination()
    lines_out = spark.read.parquet(f"{folder}/out")
    return lines_out.groupBy(ids_text("ids").alias("ids")).agg(F.count(F.lit(1)).alias("cnt"))


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files that arrive in two parts, appended to one token sequence by a stream."""
    folder = new_folder(spark, "stream-blocks")
    rows = documents(spark, sf_dir).select("doc_id", "text")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    for part in (rows.where(F.col("doc_id") <= middle), rows.where(F.col("doc_id") > middle)):
        ordered = part.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        ordered.select("text").write.mode("append").text(f"{folder}/in")
        stream_sequence.write_sequence_stream(
            streaming.stream_records(spark, f"{folder}/in"), trained(spark, sf_dir),
            f"{folder}/out", f"{folder}/checkpoint", BLOCK_TOKENS,
        ).awaitTermination()
    blocks = stream_sequence.read_sequence(spark, f"{folder}/out", BLOCK_TOKENS)
    return blocks.select(*long("block", "n"), ids_text("ids").alias("ids"))


def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(spark, sf_dir).select("doc_id", "ids")
    return encoding.decode(ids, trained(spark, sf_dir), ["doc_id"]).select("doc_id", "text")


def decode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(spark, sf_dir).select("doc_id", "ids")
    return encoding.decode_by_join(ids, trained(spark, sf_dir), ["doc_id"]).select("doc_id", "text")


# Statistics and samples


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(pretoken_counts(spark, sf_dir), new_folder(spark, "counts"))
    ids = encoding.word_ids(counts.select("word"), trained(spark, sf_dir))
    return statistics.token_totals(counts, ids)


def training_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(pretoken_counts(spark, sf_dir), new_folder(spark, "counts"))
    return statistics.training_totals(counts)


def bytes_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.bytes_per_token(encoded(spark, sf_dir), by=["lang", "source"])
    return found.withColumn("bytes_per_token", F.round("bytes_per_token", 3))


def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled documents of two corpora measured with the same tokenizer."""
    tok = trained(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    rows = []
    for name, corpus_rows in (("documents", documents(spark, sf_dir)), ("benchmark", items)):
        sample = sampling.hashed_sample(corpus_rows, SAMPLE_SIZE, SEED)
        rows.append(jobs.compression(name, sample, tok, ["doc_id"]))
    return rows[0].unionByName(rows[1])


def drawn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that Python's generator draws for a seed."""
    return sampling.drawn_sample(documents(spark, sf_dir), SAMPLE_SIZE, SEED, ["doc_id"]).select("doc_id", "text")


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hashed_sample(documents(spark, sf_dir), SAMPLE_SIZE, SEED).select("doc_id", "text")


# Token sequence


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = sequence.token_offsets(stored_tokens(spark, sf_dir))
    return offsets.select("doc_id", *long("n", "start"))


def dataset_folder(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a stored token sequence, as the dataset job lays it out."""
    offsets = sequence.token_offsets(stored_tokens(spark, sf_dir))
    folder = new_folder(spark, "dataset")
    token_store.write_blocks(sequence.token_blocks(offsets, BLOCK_TOKENS), f"{folder}/blocks")
    return folder


def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_store.read_blocks(spark, f"{dataset_folder(spark, sf_dir)}/blocks")
    return blocks.select(*long("block", "n"), ids_text("ids").alias("ids"))


def tokenized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset job over text files of the documents: how often each id is in the sequence."""
    folder = new_folder(spark, "job")
    documents(spark, sf_dir).select("text").write.text(f"{folder}/in")
    prefix = f"{folder}/tokenizer"
    files = tokenizer_files.save_tokenizer(trained(spark, sf_dir), prefix)
    out = jobs.tokenize_dataset(spark, f"{folder}/in", *files, f"{folder}/out", block_tokens=BLOCK_TOKENS)
    ids = token_store.read_blocks(spark, f"{out}/blocks").select(F.explode("ids").alias("id"))
    return ids.groupBy(*long("id")).agg(F.count(F.lit(1)).alias("cnt"))


def npy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sequence written as one numpy file and read back in blocks."""
    stored_blocks = token_store.read_blocks(spark, f"{dataset_folder(spark, sf_dir)}/blocks")
    folder = npy.local_path(new_folder(spark, "npy"))
    os.makedirs(folder)
    npy.write_npy(stored_blocks, f"{folder}/ids.npy", BLOCK_TOKENS)
    blocks = npy.read_npy(spark, f"{folder}/ids.npy", BLOCK_TOKENS)
    return blocks.select(*long("block", "n"), ids_text("ids").alias("ids"))


def train_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = dataset_folder(spark, sf_dir)
    windows = jobs.training_windows(spark, folder, SAMPLES, CONTEXT, SEED, BLOCK_TOKENS)
    return windows.select("sample", "start", ids_text("x").alias("x"), ids_text("y").alias("y"))


# Scores


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.col("embedding").alias("logits"), F.col("label").alias("target"))


def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_table(spark, sf_dir).select(
        "vec_id", F.posexplode(S.softmax(F.col("logits"))).alias("item", "prob")
    )
    return rows.select("vec_id", *long("item"), F.round("prob", 9).alias("prob"))


def cross_entropy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.with_loss(score_table(spark, sf_dir))
    return rows.select("vec_id", F.round("loss", 6).alias("loss"))


def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_loss(score_table(spark, sf_dir)).select(F.round("loss", 6).alias("loss"))


def eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the mean losses of batches of 48 consecutive rows."""
    losses = evaluation.with_loss(score_table(spark, sf_dir))
    found = evaluation.mean_of_batches(losses, F.expr("vec_id div 48"))
    return found.select("batches", F.round("loss", 6).alias("loss"))


def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = S.nucleus(F.col("logits"), TEMPERATURE, TOP_P)
    rows = score_table(spark, sf_dir).select("vec_id", F.inline(kept))
    return rows.select("vec_id", *long("item"), F.round("prob", 9).alias("prob"))


def nucleus_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table with a row for each score."""
    rows = evaluation.score_rows(score_table(spark, sf_dir), ["vec_id"])
    kept = evaluation.nucleus(rows, ["vec_id"], TEMPERATURE, TOP_P)
    return kept.select("vec_id", *long("item"), F.round("prob", 9).alias("prob"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        doc_split,
        segment_specials,
        pretokens_per_doc,
        pretoken_rows,
        pretoken_counts,
        pretoken_counts_marked,
        pretoken_counts_by_role,
        pretoken_counts_pages,
        line_scan,
        whole_texts,
        marked_scan,
        piece_scan,
        byte_symbols,
        pair_counts,
        top_pairs,
        best_pair,
        merged_words,
        bpe_merges,
        bpe_vocab,
        tokenizer_roundtrip,
        printable_roundtrip,
        token_difference,
        reverse_vocab,
        merge_ranks,
        word_ids,
        word_ids_by_join,
        encode_documents,
        encode_specials,
        encode_by_join,
        encode_lines,
        encode_stream,
        stream_blocks,
        decode_documents,
        decode_by_join,
        token_totals,
        training_totals,
        bytes_per_token,
        compression_report,
        drawn_documents,
        sample_documents,
        token_offsets,
        token_blocks,
        tokenized_lines,
        npy_blocks,
        train_windows,
        softmax_rows,
        cross_entropy_rows,
        mean_loss,
        eval_loss,
        nucleus_filter,
        nucleus_of_rows,
    )
}
