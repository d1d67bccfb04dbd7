"""Text corpora to token datasets as Spark jobs."""

from lexmill.operators.bpe_training import train_bpe
from lexmill.operators.corpus import split_documents, word_counts
from lexmill.operators.encoding import decode, encode, word_ids
from lexmill.operators.sequence import sample_windows, token_blocks, token_offsets
from lexmill.operators.tokenizer import Tokenizer, make_tokenizer
from lexmill.session import build_session
from lexmill.sources.tokenizer_files import load_tokenizer, save_tokenizer

__all__ = [
    "Tokenizer",
    "build_session",
    "decode",
    "encode",
    "load_tokenizer",
    "make_tokenizer",
    "sample_windows",
    "save_tokenizer",
    "split_documents",
    "token_blocks",
    "token_offsets",
    "train_bpe",
    "word_counts",
    "word_ids",
]
