"""Command line: ``python -m lexmill {train,tokenize,report}``."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException

from lexmill.functions.text import END_OF_TEXT
from lexmill.plans import jobs
from lexmill.session import build_session


# The names and defaults of the options are the interface.
def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    train = commands.add_parser("train", help="learn a vocabulary and merges from text files")
    train.add_argument("input_path")
    train.add_argument("--output_dir", "-o", default="bpe_tokenizer")
    train.add_argument("--vocab_size", "-v", type=int, default=5000)
    train.add_argument("--prefix", "-p", default="tokenizer")
    train.add_argument("--special_tokens", "-s", nargs="*", default=[END_OF_TEXT])

    train.add_argument("--journal", help="folder of rounds; a training that was stopped goes on from it")

    tokenize = commands.add_parser("tokenize", help="encode text files into a token sequence")
    tokenize.add_argument("--input", required=True)
    tokenize.add_argument("--vocab", required=True)
    tokenize.add_argument("--merges", required=True)
    tokenize.add_argument("--output")
    tokenize.add_argument("--unit", choices=["line", "document"], default="line")
    tokenize.add_argument("--special_tokens", "-s", nargs="*", default=[END_OF_TEXT])
    tokenize.add_argument("--wide", action="store_true", help="allow ids above 65535")
    tokenize.add_argument("--npy", help="numpy file to write besides")

    report = commands.add_parser("report", help="bytes per token of sampled documents")
    report.add_argument(
        "--corpus",
        nargs=4,
        action="append",
        required=True,
        metavar=("NAME", "TEXT", "VOCAB", "MERGES"),
    )
    report.add_argument("--n", type=int, default=10)
    report.add_argument("--seed", type=int, default=42)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("lexmill")
    try:
        if args.command == "train":
            tok = jobs.train_tokenizer(
                spark, args.input_path, args.vocab_size, args.special_tokens, args.output_dir, args.prefix,
                args.journal,
            )
            print(f"vocabulary: {tok.vocab.count()} tokens, {tok.merges.count()} merges")
        elif args.command == "tokenize":
            folder = jobs.tokenize_dataset(
                spark, args.input, args.vocab, args.merges, args.output, args.special_tokens, args.unit,
                uint16=not args.wide, npy_path=args.npy,
            )
            print(f"token ids: {folder}")
        else:
            corpora = [jobs.Corpus(*names) for names in args.corpus]
            for row in jobs.compression_report(spark, corpora, args.n, args.seed).collect():
                print(f"{row.corpus} bytes/token: {row.bytes_per_token:.3f}")
    except AnalysisException as problem:
        print(problem, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
