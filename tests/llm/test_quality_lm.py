"""The Kneser-Ney classifier against the formulas on plain counters, and on labelled texts."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import quality_lm

PAD, END = quality_lm.START, quality_lm.END


def grams(text, order):
    padded = PAD * (order - 1) + (text or "").replace("\0", "�") + END
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def plain_model(texts, order):
    """Probability of any n-gram by interpolated modified Kneser-Ney."""
    counts = {order: Counter(g for t in texts for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    taken, totals, left = {}, {}, {}
    for k, here in counts.items():
        n = [sum(c == i for c in here.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        taken[k] = []
        for i in range(1, 4):
            d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0
            taken[k].append(d if 0 < d <= i else 0.5 * i)
        totals[k], left[k] = defaultdict(int), defaultdict(float)
        for g, c in here.items():
            totals[k][g[:-1]] += c
            left[k][g[:-1]] += min(c, taken[k][min(c, 3) - 1])
    letters = len(counts[1])

    def probability(g):
        if not g:
            return 1 / (letters + 1)
        k, h = len(g), g[:-1]
        below = probability(g[1:])
        if h not in totals[k]:
            return below
        c = counts[k][g]
        kept = max(c - taken[k][min(c, 3) - 1], 0) if c else 0
        return (kept + left[k][h] * below) / totals[k][h]

    return probability


def marked(docs, labels):
    return quality_lm.with_trust(docs, labels)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_perplexities(request, spark, name):
    docs = request.getfixturevalue(name)
    if name == "documents":
        docs = docs.where(F.length("text") < 3000)
    docs = docs.withColumn("trusted", F.expr("CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END"))
    found = quality_lm.perplexities(docs, "trusted").collect()
    rows = docs.select("doc_id", "text", "trusted", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)).collect()
    probability = plain_model([t for _, t, trusted, apart in rows if trusted and not apart], quality_lm.ORDER)
    texts = {k: (t, bool(trusted and apart)) for k, t, trusted, apart in rows}
    assert len(found) == len(rows)
    cache = {}
    for r in found:
        text, apart = texts[r["doc_id"]]
        every = grams(text, quality_lm.ORDER)
        if len(every) > 60_000:
            continue
        for g in set(every) - set(cache):
            cache[g] = math.log10(probability(g))
        mean = sum(cache[g] for g in every) / len(every)
        assert (r["n_chars"], r["apart"]) == (len(every), apart)
        assert math.isclose(r["perplexity"], 10**-mean, rel_tol=1e-4)


def test_probabilities_add_up(spark):
    texts = ["abab", "abc", "cab", "bca", "aab"] * 3
    docs = spark.createDataFrame(
        [(i, t, "en", True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, trusted boolean"
    )
    learned = [r["text"] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0).collect()]
    seen = Counter(g for t in learned for g in grams(t, 3))
    letters = sorted({c for g in seen for c in g[-1]})
    every = {h + c for h in ("ab", "bc", PAD + "a", PAD * 2, "zz") for c in [*letters, "?"]}
    rows = spark.createDataFrame([(g, seen.get(g, 0)) for g in every | set(seen)], "gram string, n long")
    found = {r["gram"]: r["p"] for r in quality_lm.probabilities(rows, 3).collect()}
    for h in ("ab", "bc", PAD + "a", PAD * 2, "zz"):
        assert math.isclose(sum(found[h + c] for c in [*letters, "?"]), 1, rel_tol=1e-9)


def test_clean_texts_stay_and_junk_goes(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_lm.report(docs, labels).join(labels, "doc_id").collect()
    share = lambda rows: sum(r["kept"] for r in rows) / len(rows)
    assert share([r for r in found if r["quality"] == 1 and not r["toxic"]]) > 0.98
    assert share([r for r in found if r["quality"] == 0]) < 0.1
    assert share([r for r in found if r["quality"] == 1 and r["toxic"]]) < 0.5
    kept = quality_lm.kept_rows(docs, labels)
    assert kept.columns == docs.columns
    expected = {r["doc_id"] for r in quality_lm.report(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == expected


def test_large_alphabets_and_empty_tables(spark, odd, empty, monkeypatch):
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 9000)) + "abc" * 50
    codes, names, ends = quality_lm._grams([text, "", "abcabc"], 5)
    expected = grams(text, 5) + grams("", 5) + grams("abcabc", 5)
    assert [names[c] for c in codes] == expected and ends.tolist() == [0, len(text) + 1, len(text) + 2, len(text) + 9]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality_lm.report(odd, none).collect())
    assert quality_lm.report(empty, none).collect() == []
    assert quality_lm.kept_rows(empty, none).collect() == []


def test_rows_are_judged_by_their_own_text(spark, sf_dir):
    """A good text that shares its key with a poor one stays; null keys and further columns as well."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality_lm.report(docs, labels)
    bad = found.where("NOT kept").orderBy("doc_id").join(docs.select("doc_id", "text"), "doc_id").first()
    good = found.where("kept AND n_chars > 300").join(docs.select("doc_id", "text"), "doc_id").orderBy("doc_id").first()
    added = [(k, t, lang, note) for k in (None, bad["doc_id"], good["doc_id"])
             for t, lang, note in ((bad["text"], bad["lang"], "bad"), (good["text"], good["lang"], "good"))]
    rows = spark.createDataFrame(added, "doc_id long, text string, lang string, _gone string")
    kept = quality_lm.kept_rows(docs.withColumn("_gone", F.lit("given")).unionByName(rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "_gone"]
    here = [(r["doc_id"], r["_gone"]) for r in kept.where("_gone <> 'given'").collect()]
    assert sorted(here, key=repr) == sorted([(k, "good") for k in (None, bad["doc_id"], good["doc_id"])], key=repr)


def test_texts_stay_in_their_buckets(spark, documents, capsys):
    """The texts are not shuffled to meet the answers."""
    from lexmill.llm import chunks

    rows = documents.select(F.col("doc_id").alias("chunk"), F.col("text").alias("texts"))
    folder = quality_lm.new_folder(spark, "buckets")
    with chunks.bucketed(rows, folder, 8) as table:
        small = spark.range(50).select(F.col("id").alias("chunk")).repartition(8, "chunk")
        both = table.groupBy("chunk").cogroup(small.groupBy("chunk"))
        both.applyInArrow(lambda left, right: left.select(["chunk"]), "chunk long").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
