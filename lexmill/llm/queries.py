"""Registered queries of the operators for training-data pipelines."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import (
    exact_dedup,
    lm_scoring,
    mixing,
    ngram_join,
    packing,
    personal_data,
    quality_lm,
    quality_rules,
    secret_scan,
    simhash_join,
    turn_repair,
    warc,
    whitening,
)
from lexmill.session import new_folder

# A vocabulary file among the installed public tokenizers.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = exact_dedup.open_index(spark, new_folder(spark, "digest-index"), docs.count())
    found = exact_dedup.deduplicate(index, docs, batches=2)
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(documents(spark, sf_dir), width=3, percent=90)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(documents(spark, sf_dir))


def op1_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_simhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_join.grouped(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_quality_lm": op1_quality_lm,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_secret_scan": op5_secret_scan,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_personal_data": op10_personal_data,
    "op11_whitening": op11_whitening,
    "op12_turn_repair": op12_turn_repair,
    "op13_simhash_join": op13_simhash_join,
}

# Lower-cases A-Z only.
_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op12_turn_repair": r"""
        WITH RECURSIVE n AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
            FROM conversations),
        c AS (
            SELECT *, xor(4294967295::BIGINT, list_reduce(
                       list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(name) + 1),
                           lambda i: [ord(substr(name, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1
                                         THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)) % 20 AS num
            FROM n),
        d AS (
            SELECT conv_id, turn, CASE WHEN num = 4 THEN 'user' ELSE role END AS role,
                   CASE num WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE num WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM c),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                   regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said
            FROM d),
        f AS (
            SELECT conv_id, place, turn, role, text, left(role, 1) AS initial,
                   coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1)
                       NOT IN ('su', 'ua', 'au'), false) AS illegal,
                   CASE WHEN said = '' THEN 'b' WHEN seen > 1 THEN 'd'
                        WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
            FROM o),
        -- State after the rows so far: 0 nothing, 1 system, 2 user, 3 assistant.
        i(s, s2, price, kinds, lines) AS (
            VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
                   (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'),
                   (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
                   (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
                   (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        e(s, kind, initial, s2, price, role) AS (
            VALUES (0, 'D', NULL, 0, 2, NULL), (1, 'D', NULL, 1, 2, NULL), (2, 'D', NULL, 2, 2, NULL),
                   (3, 'D', NULL, 3, 2, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL),
                   (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
                   (0, 'R', NULL, 2, 1, 'user'), (1, 'R', NULL, 2, 1, 'user'), (3, 'R', NULL, 2, 1, 'user'),
                   (2, 'R', NULL, 3, 1, 'assistant')),
        b AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS place, 0 AS state, 0 AS cost, '' AS audit, '' AS lines
            FROM conversations
            UNION ALL
            SELECT * FROM (
                SELECT b.conv_id, f.place, e.s2 AS state,
                       b.cost + i.price + e.price
                           + CASE WHEN e.kind <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END AS cost,
                       b.audit || i.kinds || e.kind AS audit,
                       b.lines || i.lines || CASE WHEN e.kind = 'D' THEN ''
                           ELSE chr(10) || coalesce(e.role, f.role) || ':' || f.text END AS lines
                FROM b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.place = b.place + 1
                JOIN i ON i.s = b.state
                JOIN e ON e.s = i.s2 AND (e.kind = 'D' OR f.fault NOT IN ('b', 'd'))
                      AND (e.initial IS NULL OR e.initial = f.initial))
            QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
        w AS (
            SELECT conv_id, b.cost + i.price AS cost, b.audit || i.kinds AS audit, b.lines || i.lines AS lines
            FROM b JOIN i ON i.s = b.state AND i.s2 IN (0, 3)
            WHERE b.place = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM b.conv_id)
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY b.cost + i.price, b.audit || i.kinds) = 1),
        g AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
            FROM f GROUP BY conv_id)
        SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit,
               sha256(substr(lines, 2)) AS repaired_sha256
        FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        g AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
        FROM g
    """,
    "op3_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        w AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
        t AS (
            SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS x
            FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        r AS (
            SELECT doc_id, pos FROM t WHERE x IS NOT NULL
            QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
        c AS (
            SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (VALUES (0), (1), (2)) v(k)
            GROUP BY doc_id),
        s AS (
            SELECT d.doc_id, d.text, len(words) AS n_words,
                   length(array_to_string(words, '')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
                   length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
                   length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
                   length(text) - length(regexp_replace(text, '[{}\[\]\\=;]', '', 'g')) AS n_brackets
            FROM d LEFT JOIN c USING (doc_id)),
        b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 100 * n_symbols <= 10 * n_words
               AND word_chars BETWEEN 2 * n_words AND 20 * n_words
               AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_capitals <= 50 * word_chars
               AND 100 * n_digits <= 30 * word_chars AND 100 * n_brackets <= 10 * word_chars AS kept
        FROM b
    """,
    "op7_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256({_LOWER_AZ.format("coalesce(text, '')")}) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
}
