"""Operators that look at each document by itself, and exact copies."""

import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import (
    exact_dedup,
    mixing,
    ngram_join,
    personal_data,
    quality_lm,
    quality_rules,
    secret_scan,
    warc,
)
from lexmill.session import new_folder


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(params=["odd", "documents"])
def docs(request):
    return request.getfixturevalue(request.param)


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_quality_counts(docs):
    found = {r[0]: r[1:7] for r in rows(quality_rules.scored(docs))}
    assert found == {key: plain.quality(text) for key, text in pairs(docs)}


def test_quality_order_changes_nothing(docs):
    every = quality_rules.BASE_RULES + quality_rules.RULES
    one = docs.where(quality_rules.rejected_by(every).isNull())
    other = docs.where(quality_rules.rejected_by(every[::-1]).isNull())
    chosen = quality_rules.kept_rows(docs)
    keys = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert keys(one) == keys(other) == keys(chosen)
    assert chosen.columns == docs.columns
    kept = quality_rules.scored(docs).where("kept")
    assert keys(kept) == keys(one)


def test_rules_are_ordered_by_rejections_per_second(documents):
    measured = quality_rules.measured_rules(documents, quality_rules.RULES)
    gains = [m.gain for m in measured]
    assert gains == sorted(gains, reverse=True) and len(gains) == len(quality_rules.RULES)


def test_exact_copies(spark, docs):
    index = exact_dedup.open_index(spark, new_folder(spark, "index"), docs.count())
    found = exact_dedup.deduplicate(index, docs, batches=3)
    got = {
        (r["doc_id"], r["keep_id"], r["group_size"], r["doc_id"] == r["keep_id"], r["digest"].hex())
        for r in found.collect()
    }
    assert got == plain.copies(pairs(docs))


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_rows_with_null_keys_are_kept(spark, batches):
    table = [(1, "a"), (9, "B"), (None, "b"), (None, "alone"), (None, "Alone"), (None, None), (5, "a")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    index = exact_dedup.open_index(spark, new_folder(spark, "index"), len(table))
    found = exact_dedup.deduplicate(index, docs, batches=batches)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found.collect()), key=repr)
    assert got == sorted(
        [(1, 5, 2), (5, 5, 2), (9, 9, 2), (None, 9, 2), (None, None, 2), (None, None, 2), (None, None, 1)],
        key=repr,
    )
    assert index.rows().count() == 4


def test_index_is_kept_and_reopened(spark, documents):
    folder = new_folder(spark, "index")
    old, new = documents.where("doc_id < 120"), documents.where("doc_id >= 120")
    first = exact_dedup.kept_rows(exact_dedup.open_index(spark, folder, 10), old)
    keys = {r["doc_id"] for r in first.collect()}
    index = exact_dedup.open_index(spark, folder)
    second = exact_dedup.kept_rows(index, new)
    keys2 = {r["doc_id"] for r in second.collect()}
    texts = dict(pairs(documents))
    norm = lambda k: (texts[k] or "").translate(plain.AZ)
    assert {norm(k) for k in keys} == {norm(k) for k in texts if k < 120}
    assert not {norm(k) for k in keys2} & {norm(k) for k in texts if k < 120}
    assert {norm(k) for k in keys | keys2} == {norm(k) for k in texts}
    before = index.rows().count()
    exact_dedup.deduplicate(index, new).count()
    assert index.rows().count() == before == len({norm(k) for k in texts})
    plan = exact_dedup.digests(documents).select("digest").distinct().join(
        index.rows().hint("merge"), "digest", "left_anti"
    )._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_one_of_repeated_rows_stays(spark, odd):
    index = exact_dedup.open_index(spark, new_folder(spark, "index"))
    kept = exact_dedup.kept_rows(index, odd.unionByName(odd))
    assert kept.columns == odd.columns
    index = exact_dedup.open_index(spark, new_folder(spark, "index"))
    once = exact_dedup.kept_rows(index, odd)
    assert sorted(rows(kept), key=repr) == sorted(rows(once), key=repr)


def test_columns_with_clashing_names_pass_through(spark, odd):
    names = ["_digest", "digest", "keep_id", "key", "class", "component_id", "trusted", "_row", "copies", "n"]
    docs = odd.select("*", *(F.lit(i).alias(name) for i, name in enumerate(names)))
    index = exact_dedup.open_index(spark, new_folder(spark, "index"))
    labels = spark.createDataFrame([(4, 1, 0, 5)], "doc_id long, quality int, toxic int, text int")
    mix, _ = mixing.fit(docs, labels)
    for kept in (
        quality_rules.kept_rows(docs), exact_dedup.kept_rows(index, docs), ngram_join.kept_rows(docs),
        mixing.mixed_rows(docs, mix), quality_lm.kept_rows(docs, labels),
    ):
        assert kept.columns == docs.columns
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in kept.collect())


def test_secrets(docs):
    for r in secret_scan.report(docs).collect():
        text = dict(pairs(docs))[r["doc_id"]]
        *counts, base = plain.secrets(text)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(counts)
        assert r["base_sha256"] == plain.sha(plain.joined(base))
        assert set(plain.joined(base).split(",")) <= set(r["spans"].split(",")) | {""}


def test_owners_tell_live_values_from_examples(spark):
    live, example = "Zx9Qw7Lm3Kp1Vt5Rb2Yn8", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    table = [(i, f"see {example} here", "en", f"s{i % 6}", 1) for i in range(12)]
    table += [(20, f"see {live} here", "en", "mine", 1), (21, f"{live}", "en", "mine", 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n int")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.report(docs).collect()}
    assert spans[20] == "live:4:25" and spans[21] == "live:0:21" and spans[0] == ""
    _, values = secret_scan.scan(docs)
    assert {r["label"] for r in values.collect()} == {"live", "example"}


def test_repositories_and_owners_decide_together(spark):
    """owners, repositories of each -> label, one value a case."""
    cases = {
        (1, 1): "live", (1, 5): "live", (2, 1): "live", (2, 2): "live", (2, 3): "shared", (1, 6): "shared",
        (1, 19): "shared", (1, 20): "example", (1, 500): "example", (2, 10): "example", (3, 1): "example",
    }
    table, expected = [], {}
    for i, ((owners, repositories), label) in enumerate(cases.items()):
        value = f"Zx9Qw7Lm3Kp1Vt5Rb2Y{chr(97 + i)}"
        for owner in range(owners):
            for _ in range(repositories):
                table.append((len(table), f"see {value} here", f"s{owner}"))
                expected[len(table) - 1] = "live:4:24" if label == "live" else ""
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3)
    assert {r["doc_id"]: r["spans"] for r in secret_scan.report(docs).collect()} == expected


def test_candidates_are_whole_values():
    values = [
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzZ83qLT0aB", "3f2b8c1e-9d47-4a6b-8e01-7c5d2f9a6b34",
        "eyJhbGciOi1.Zx9Qw7Lm3Kp1-Vt5Rb2Yn8_k", "Zx9Qw7Lm3Kp1Vt5Rb2Yn8aQ==",
    ]
    for value in values:
        for text, at in ((f"see {value}. More", 4), (f"auth={value},", 5), (value, 0)):
            assert [s[:2] for s in secret_scan.candidate_spans(text)] == [(at, at + len(value))]
    for text in ("docs/guides/2024/section-12/page-3.html", "a-long-name-of-words-joined-1-2-3", "-" * 50):
        assert secret_scan.candidate_spans(text) == []
    part = "Zx9Qw7Lm3Kp1Vt5Rb2Yn8"
    assert secret_scan.candidate_spans(f"lower/path/{part.lower()}/x")[0][:2] == (11, 11 + len(part))


def test_personal_data(docs):
    texts = dict(pairs(docs))
    for r in personal_data.report(docs).collect():
        counts, base = plain.personal(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == plain.sha(plain.joined(base))


def test_contexts_find_unseen_identifiers(spark):
    names = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"clear prose mobile: +1 555 010 {i:04d}" for i in range(12)]
    texts += [f"reach host: 10.0.{i}.7 soon" for i in range(12)]
    # Same place and shape as an address, but a part too large for the plain pattern.
    texts += ["reach host: 10.0.999.7 soon", "the year: 10.0.999.8 soon", "plain words 123456 here"]
    docs = spark.createDataFrame(
        [(i, t, names[i % 26]) for i, t in enumerate(texts)], "doc_id long, text string, lang string"
    )
    spans = {r["doc_id"]: r["spans"] for r in personal_data.report(docs).collect()}
    assert spans[24] == "context:12:22"
    assert spans[25] == spans[26] == ""
    assert spans[0].startswith("phone:") and spans[12].startswith("ip:")


def test_found_identifiers_teach_further_contexts(spark):
    """Shapes that no seed has, found by a context of seeds, then by a context that only found ones have."""
    new = ["555-0199", "0305550199", "030 555 0198", "(030) 5550-197", "555.0196", "AB-5550195"[3:]]
    texts = [f"clear prose mobile: +1 555 010 {i:04d}" for i in range(40)]
    texts += [f"my mobile: {number}, please" for number in new]
    texts += [f"or cell: {number} today" for number in [*new, "0441/2345"]]
    texts += [f"the year 2{i:03d}-04 was good, item: 77{i:04d}" for i in range(30)] + ["item: 0305550199"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["spans"] for r in personal_data.report(docs).collect()}
    for i, number in enumerate(new):
        assert found[40 + i] == f"context:11:{11 + len(number)}"
        assert found[46 + i] == f"context:9:{9 + len(number)}"
    assert found[52] == "context:9:18"
    assert {found[i] for i in range(53, 84)} == {""}


def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {tuple(r) for r in warc.roundtrip(pages).collect()}
    assert got == plain.archive_rows([tuple(r) for r in pages.select("page_id", "html").collect()])


@pytest.mark.parametrize("size", [7, 1000, 1 << 18])
def test_odd_archives(spark, size):
    fake = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "ä\r\n" * 40_000
    html = [None, "", "x" * 1000, "x" * 1000, "x" * 999, "x" * 999, long, long, fake, fake * 60,
            "\r\n" * 700, "\r\n", "tail\r", "\x00\x01", "é" * 500, "é" * 500]
    table = [(i, None if i % 3 else f"http://h/{i}\r\nx", h, "more") for i, h in enumerate(html)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, header string")
    folder = new_folder(spark, "archives")
    warc.write_archives(pages.repartition(3), folder, size=size)
    found = warc.read_archives(spark, folder)
    got = [
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        for r in found.collect()
    ]
    assert set(got) == plain.archive_rows(enumerate(html)) and len(got) == len(html)
    assert found.where("NOT intact").count() == 0


def test_damaged_archive_is_noticed(spark):
    lines = pa.array([b"WARC/1.1", b"WARC-Type: response", b"Content-Length: 20", b"", b"cut"])
    batch = pa.RecordBatch.from_arrays([lines], ["value"])
    with pytest.raises(ValueError):
        list(warc._read_lines(iter([batch])))


def test_empty_tables(spark, empty):
    assert rows(quality_rules.scored(empty)) == rows(quality_rules.kept_rows(empty)) == []
    index = exact_dedup.open_index(spark, new_folder(spark, "index"))
    assert rows(exact_dedup.deduplicate(index, empty, batches=2)) == []
    assert rows(exact_dedup.kept_rows(index, empty)) == []
    assert rows(secret_scan.report(empty)) == rows(personal_data.report(empty)) == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows(warc.roundtrip(pages)) == []
