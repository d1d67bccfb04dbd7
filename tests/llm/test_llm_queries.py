"""The registered queries against their SQL, the pipeline, and the guard around this part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_packing import check
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from lexmill.llm import mixing, quality_rules
from lexmill.llm.queries import QUERIES, SQL

ROOT = Path(__file__).resolve().parents[2]


def test_all_are_registered():
    names = sorted(QUERIES)
    assert sorted(n.split("_")[0] for n in names) == sorted(f"op{i}" for i in range(1, 14))
    assert set(names) | {"pipeline"} <= set(spark_entry.queries())
    assert set(SQL) <= set(names) and set(SQL) <= set(spark_entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "n-gram join", "mixing", "packing"
    ]


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(row) for row in df.select(columns).collect()]
    expected = connection.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert found and sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", ["op1_quality_lm", "op6_mixing"])
def test_one_row_for_each_document(spark, sf_dir, documents, name):
    keys = [r["doc_id"] for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()]
    assert sorted(keys) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())


def passes(text):
    """The rules of the first stage in plain Python."""
    n, chars, symbols, dup_lines, _, failed = plain.quality(text)
    count = lambda cs: sum(c in cs for c in text or "")
    lines = sum(bool(plain.words(x)) for x in (text or "").split("\n"))
    return not (
        failed or 100 * symbols > 10 * n or not 2 * n <= chars <= 20 * n or 100 * dup_lines > 30 * lines
        or 100 * count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 50 * chars
        or 100 * count("0123456789") > 30 * chars or 100 * count("{}[]\\=;") > 10 * chars
    )


def test_pipeline_stages(spark, sf_dir, documents, tmp_path):
    """Each stage against a plain version on what its predecessor kept."""
    docs, kept = documents, [tuple(r) for r in documents.select("doc_id", "text").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            break
        assert out.columns == documents.columns
        found = sorted((r["doc_id"], r["text"]) for r in out.collect())
        if name == "quality rules":
            kept = [r for r in kept if passes(r[1])]
        elif name == "exact dedup":
            stay = {r[0] for r in plain.copies(kept) if r[3]}
            kept = [r for r in kept if r[0] in stay]
        elif name == "n-gram join":
            stay = {r[0] for r in plain.components(kept, 5, 80) if r[0] == r[2]}
            kept = [r for r in kept if r[0] in stay]
        else:
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            times = {r["doc_id"]: r["copies"] for r in mixing.report(docs, labels, corpus_pipeline.TARGETS).collect()}
            kept = [r for r in kept for _ in range(times[r[0]])]
        assert found == sorted(kept)
        docs = out
    assert 0.5 * documents.count() < len(kept) < 1.1 * documents.count()
    # A document that comes more than once is packed each time: its pieces are told apart by sequence.
    once = docs.dropDuplicates(["doc_id"])
    pieces = corpus_pipeline.packed(spark, once, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check(pieces, [(r["doc_id"], r["text"]) for r in once.collect()], tokenizer)
    total = out.agg(F.sum("length")).first()[0]
    assert total == sum(len(plain.token_ids(tokenizer, text)) for _, text in kept)


def test_clean_documents_pass_the_rules(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    clean = documents.where(F.length("text") > 500).join(labels, "doc_id", "left_semi")
    kept = quality_rules.kept_rows(clean).count()
    assert kept >= 0.97 * clean.count()


def test_the_rest_works_without_this_part(tmp_path):
    code = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "lexmill.llm") or name.startswith("lexmill.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert "pretoken_counts" in e.queries() and "pipeline" not in e.queries()
assert not any(n.startswith("op1_") for n in e.queries()), e.queries()
"""
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
