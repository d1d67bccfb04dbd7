"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from lexmill.plans.queries import QUERIES, trained
from lexmill.session import build_session

HEADLINE = (
    "pretoken_counts",
    "pretoken_counts_pages",
    "pretokens_per_doc",
    "segment_specials",
    "doc_split",
    "pair_counts",
    "top_pairs",
    "bpe_merges",
    "word_ids",
    "encode_documents",
    "encode_lines",
    "encode_stream",
    "decode_documents",
    "bytes_per_token",
    "token_totals",
    "token_blocks",
    "train_windows",
    "softmax_rows",
    "eval_loss",
    "nucleus_filter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small job brings up the executor threads before anything is timed.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        if name == "word_ids":
            # Encoding starts from stored tokenizer files; making them is timed by itself.
            start = time.perf_counter()
            trained(spark, sf_dir)
            seconds["train_and_save"] = round(time.perf_counter() - start, 3)
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
