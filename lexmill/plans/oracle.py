"""The registered queries as SQL for a plain relational engine."""

from __future__ import annotations

import random

from lexmill.functions.text import END_OF_TEXT
from lexmill.plans import queries as Q

# The pre-token pattern without look-ahead: a separator is put before the last white space
# character of a run that precedes a word, and ends the run there.
SEPARATED = r"regexp_replace({text}, '(\s+)(\s\S)', E'\\1\x1f\\2', 'g')"
PRETOKENS = (
    rf"regexp_extract_all({SEPARATED}, "
    r"E'\'(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}\x1f]+|\\s+')"
)
FIRST_ID = 256 + len(Q.SPECIALS)




def drawn(rows: int) -> str:
    """Places that Python's generator draws among so many rows."""
    places = random.Random(Q.SEED).sample(range(rows), Q.SAMPLE_SIZE)
    return f"(n_rows = {rows} AND place IN ({', '.join(map(str, places))}))"


def pretokens(text: str) -> str:
    return PRETOKENS.format(text=text)


def marked(text: str = "text") -> str:
    return (
        f"replace(replace({text}, '. ', '.{END_OF_TEXT}'), ', ', ',{END_OF_TEXT}{END_OF_TEXT}')"
    )


def counts(source: str, text: str = "text", by: str = "") -> str:
    return (
        f"SELECT {by} word, count(*) AS cnt "
        f"FROM (SELECT {by} unnest({pretokens(text)}) AS word FROM {source}) GROUP BY ALL"
    )


SYMBOLS = r"regexp_replace(hex(encode(word)), '(..)', '(\1)', 'g')"
SYMBOL_LIST = "string_split(sym[2:-2], ')(')"


def pair_rows(words: str) -> str:
    return (
        "SELECT s[i] AS a, s[i + 1] AS b, cnt FROM (SELECT s, cnt, unnest(range(1, len(s))) AS i "
        f"FROM (SELECT {SYMBOL_LIST} AS s, cnt FROM {words}))"
    )


def pair_sums(words: str) -> str:
    return f"SELECT a, b, sum(cnt)::BIGINT AS cnt FROM ({pair_rows(words)}) GROUP BY a, b"


PAIRS = f"""
WITH words AS ({counts('documents')}),
w0 AS (SELECT {SYMBOLS} AS sym, cnt FROM words)
{pair_sums('w0')}
"""


def training(merges: int = Q.MERGES) -> str:
    """CTEs of one merge after the other; ``trained`` has the words, ``merges`` the merges."""
    steps = [
        f"WITH words AS MATERIALIZED ({counts('documents')})",
        f"w0 AS MATERIALIZED (SELECT word, {SYMBOLS} AS sym, cnt FROM words)",
    ]
    for i in range(merges):
        steps.append(
            f"m{i} AS MATERIALIZED (SELECT {i} AS rank, a, b FROM ({pair_sums(f'w{i}')}) "
            "ORDER BY cnt DESC, a DESC, b DESC LIMIT 1)"
        )
        steps.append(
            f"w{i + 1} AS MATERIALIZED (SELECT word, "
            "replace(sym, '(' || a || ')(' || b || ')', '(' || a || b || ')') AS sym, cnt "
            f"FROM w{i}, m{i})"
        )
    steps.append(f"trained AS (SELECT * FROM w{merges})")
    union = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(merges))
    steps.append(f"merges AS ({union})")
    return ",\n".join(steps)


TRAINING = training()
SPECIAL_ROWS = " UNION ALL ".join(
    f"SELECT {256 + i}::BIGINT AS id, hex(encode('{token}')) AS token_hex"
    for i, token in enumerate(Q.SPECIALS)
)
VOCAB = (
    "SELECT i::BIGINT AS id, printf('%02X', i) AS token_hex FROM range(256) t(i) "
    f"UNION ALL {SPECIAL_ROWS} "
    f"UNION ALL SELECT ({FIRST_ID} + rank)::BIGINT AS id, a || b AS token_hex FROM merges"
)


def with_ids(words: str) -> str:
    """CTEs up to ``word_ids (word, n, ids)`` for distinct words, by all merges in order."""
    steps = [f"c0 AS (SELECT word, {SYMBOLS} AS sym FROM ({words}))"]
    for i in range(Q.MERGES):
        steps.append(
            f"c{i + 1} AS (SELECT word, "
            "replace(sym, '(' || a || ')(' || b || ')', '(' || a || b || ')') AS sym "
            f"FROM c{i}, m{i})"
        )
    chain = ",\n".join(steps)
    return f"""{TRAINING},
vocab AS MATERIALIZED ({VOCAB}),
{chain},
word_ids AS MATERIALIZED (
    SELECT word, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS ids
    FROM (
        SELECT word, generate_subscripts(s, 1) AS i, unnest(s) AS token_hex
        FROM (SELECT word, {SYMBOL_LIST} AS s FROM c{Q.MERGES})
    ) JOIN vocab USING (token_hex)
    GROUP BY word
)"""


WORD_IDS = with_ids("SELECT word FROM words")


def encoded(source: str, key: str, text: str = "text") -> str:
    """CTE ``encoded (key, n, ids)`` of whole texts."""
    return f"""occurrences AS (
    SELECT {key}, generate_subscripts(w, 1) AS pos, unnest(w) AS word
    FROM (SELECT {key}, {pretokens(text)} AS w FROM {source})
),
encoded AS MATERIALIZED (
    SELECT {key}, sum(n)::BIGINT AS n, string_agg(ids, ' ' ORDER BY pos) AS ids
    FROM occurrences JOIN word_ids USING (word) GROUP BY {key}
)"""


def segments(specials: tuple[str, ...]) -> str:
    """Segments of the marked documents; the specials stand for the codes 1, 2, … meanwhile."""
    text = marked()
    codes = sorted(enumerate(specials, start=1), key=lambda item: -len(item[1]))
    for code, token in codes:
        text = f"replace({text}, '{token}', chr(1) || '{code}' || chr(1))"
    token = "CASE part " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in codes) + " END"
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seg,
    i % 2 = 0 AS is_special, CASE WHEN i % 2 = 0 THEN {token} ELSE part END AS text
FROM (
    SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part
    FROM (SELECT doc_id, string_split({text}, chr(1)) AS p FROM documents)
) WHERE part <> ''"""


SEGMENTS = segments(Q.SPECIALS)
PLAIN_SEGMENTS = f"(SELECT text FROM ({SEGMENTS}) WHERE NOT is_special)"
ENCODED_MARKED = f"""{with_ids(f"SELECT DISTINCT unnest({pretokens('text')}) AS word FROM {PLAIN_SEGMENTS}")},
segs AS ({SEGMENTS}),
marked_words AS (
    SELECT doc_id, seg, generate_subscripts(w, 1) AS pos, unnest(w) AS word
    FROM (
        SELECT doc_id, seg, CASE WHEN is_special THEN [text] ELSE {pretokens('text')} END AS w
        FROM segs
    )
),
all_ids AS (
    SELECT word, ids FROM word_ids UNION ALL SELECT '{Q.SPECIALS[0]}' AS word, '256' AS ids
)
SELECT doc_id, string_agg(ids, ' ' ORDER BY seg, pos) AS ids
FROM marked_words JOIN all_ids USING (word) GROUP BY doc_id"""

LINES = (
    "SELECT line || E'\\n' AS text FROM "
    "(SELECT unnest(string_split(text, E'\\n')) AS line FROM documents)"
)

LINE_WORDS = f"SELECT DISTINCT unnest({pretokens('text')}) AS word FROM ({LINES})"
ENCODED_LINES = f"""{with_ids(LINE_WORDS)},
line_counts AS (SELECT text, count(*) AS cnt FROM ({LINES}) GROUP BY text),
{encoded('line_counts', 'text')}"""

# The logits of each row and their log-sum-exp.
SCORES = """
WITH scores AS (
    SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS item,
        unnest(embedding)::DOUBLE AS logit FROM embeddings
)"""
LOSSES = f"""{SCORES},
peaks AS (SELECT vec_id, max(logit) AS peak FROM scores GROUP BY vec_id),
losses AS (
    SELECT vec_id, ln(sum(exp(logit - peak))) + any_value(peak)
        - max(CASE WHEN item = label THEN logit END) AS loss
    FROM scores JOIN peaks USING (vec_id) GROUP BY vec_id
)"""

DIGEST = "('0x' || substr(md5({value} || ':{seed}'), 1, 15))::BIGINT"
OFFSETS = (
    "SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start, ids FROM encoded"
)
# The whole sequence, one row per token.
TOKENS = f"""{WORD_IDS},
{encoded('documents', 'doc_id')},
offsets AS ({OFFSETS}),
tokens AS MATERIALIZED (
    SELECT start + generate_subscripts(s, 1) - 1 AS place, unnest(s) AS id
    FROM (SELECT start, string_split(ids, ' ') AS s FROM offsets)
)"""


def sampled(source: str, key: str) -> str:
    return (
        f"SELECT {key} AS doc_id, text FROM {source} "
        f"ORDER BY md5({key} || ':{Q.SEED}'), {key} LIMIT {Q.SAMPLE_SIZE}"
    )


def ratio(n_bytes: str, n_tokens: str) -> str:
    return f"round({n_bytes} / {n_tokens}, 3)"


REPORT = " UNION ALL ".join(
    f"""SELECT '{name}' AS corpus, sum(size)::BIGINT AS n_bytes, sum(n)::BIGINT AS n_tokens,
    {ratio('sum(size)', 'sum(n)')} AS bytes_per_token
FROM (
    SELECT doc_id, any_value(size) AS size, sum(n) AS n
    FROM (
        SELECT doc_id, strlen(text) AS size, unnest({pretokens('text')}) AS word
        FROM ({sampled(source, key)})
    ) JOIN word_ids USING (word) GROUP BY doc_id
)"""
    for name, source, key in (
        ("documents", "documents", "doc_id"),
        ("benchmark", "benchmark", "item_id"),
    )
)


BOTH_WORDS = (
    f"SELECT DISTINCT word FROM (SELECT unnest({pretokens('text')}) AS word FROM documents "
    f"UNION ALL SELECT unnest({pretokens('text')}) AS word FROM benchmark)"
)

SQL: dict[str, str] = {
    "doc_split": f"""
SELECT doc_id, i - 1 AS doc, trim(part, E' \\n') AS text
FROM (
    SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part
    FROM (
        SELECT doc_id, CASE WHEN lang = 'en' AND contains({marked()}, '{END_OF_TEXT}')
            THEN string_split({marked()}, '{END_OF_TEXT}')
            WHEN lang = 'en' THEN string_split(text, E'\\n\\n')
            ELSE string_split(replace(text, E'\\n', E'\\n\\n'), E'\\n\\n') END AS p
        FROM documents
    )
) WHERE trim(part, E' \\n') <> ''""",
    "segment_specials": segments(Q.DOUBLE_SPECIALS),
    "pretokens_per_doc": f"""
SELECT doc_id, len(w) AS n_pretokens, md5(array_to_string(w, '|')) AS digest
FROM (SELECT doc_id, {pretokens('text')} AS w FROM documents)""",
    "pretoken_rows": f"""
WITH segs AS ({segments(Q.SPECIALS)})
SELECT doc_id, seg, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
FROM (SELECT doc_id, seg, {pretokens('text')} AS w FROM segs WHERE NOT is_special)""",
    "pretoken_counts": counts("documents"),
    "pretoken_counts_marked": counts(f"({segments(Q.SPECIALS)}) WHERE NOT is_special"),
    "pretoken_counts_by_role": counts("conversations", by="role,"),
    "pretoken_counts_pages": counts("pages", text="html"),
    "line_scan": f"SELECT text, count(*) AS cnt FROM ({LINES}) GROUP BY text",
    "whole_texts": """
        SELECT lang, sum(length(text) + 1) AS n_chars,
               sum(length(text) - length(replace(text, chr(10), '')) + 1) AS n_lines
        FROM documents GROUP BY lang
    """,
    "marked_scan": """
SELECT trim(text, E' \\n') AS text, count(*) AS cnt FROM documents
WHERE trim(text, E' \\n') <> '' GROUP BY ALL""",
    "piece_scan": r"""
WITH pieces AS (
    SELECT ltrim(unnest(string_split(regexp_replace(rtrim(text, ' ' || chr(10)), '(\S)\n',
        '\1' || chr(31) || chr(10), 'g'), chr(31))), chr(10)) AS text
    FROM documents)
SELECT text, count(*) AS cnt FROM pieces WHERE text <> '' GROUP BY text""",
    "byte_symbols": f"SELECT word, {SYMBOLS} AS sym FROM ({counts('documents')})",
    "pair_counts": PAIRS,
    "top_pairs": f"{PAIRS} ORDER BY cnt DESC, a DESC, b DESC LIMIT 20",
    "best_pair": f"{PAIRS} ORDER BY cnt DESC, a DESC, b DESC LIMIT 1",
    "merged_words": f"{TRAINING} SELECT word, sym, cnt FROM trained",
    "bpe_merges": f"{TRAINING} SELECT rank::BIGINT AS rank, a AS left_hex, b AS right_hex FROM merges",
    "bpe_vocab": f"{TRAINING} SELECT id, token_hex FROM ({VOCAB})",
    "tokenizer_roundtrip": f"""{TRAINING} SELECT id, token_hex FROM ({VOCAB})
UNION ALL SELECT {FIRST_ID + Q.MERGES}::BIGINT, hex(encode('{Q.DOUBLE_SPECIALS[1]}'))""",
    "printable_roundtrip": f"""{TRAINING} SELECT id, token_hex FROM ({VOCAB})
UNION ALL SELECT -1 - rank::BIGINT AS id, a || ' ' || b AS token_hex FROM merges""",
    "drawn_documents": f"""
SELECT doc_id, text FROM (
    SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n_rows
    FROM documents)
WHERE {' OR '.join(map(drawn, (200, 1_000, 10_000)))}""",
    "token_difference": f"""{TRAINING} SELECT a || b AS token_hex, 'left' AS side FROM merges
UNION ALL SELECT hex(encode('{Q.DOUBLE_SPECIALS[1]}')) AS token_hex, 'right' AS side""",
    "reverse_vocab": """
SELECT hex(encode(source)) AS token_hex, max(doc_id) AS id FROM documents GROUP BY source""",
    "merge_ranks": """
SELECT hex(encode(lang)) AS left_hex, hex(encode(source)) AS right_hex, max(doc_id) AS rank
FROM documents GROUP BY lang, source""",
    "word_ids": f"{WORD_IDS} SELECT word, ids FROM word_ids",
    "word_ids_by_join": f"{WORD_IDS} SELECT word, ids FROM word_ids",
    "encode_documents": f"""{WORD_IDS},
{encoded('documents', 'doc_id')}
SELECT doc_id, n, ids FROM encoded""",
    "encode_specials": ENCODED_MARKED,
    "encode_by_join": ENCODED_MARKED,
    "encode_lines": f"{ENCODED_LINES} SELECT text, ids, cnt FROM encoded JOIN line_counts USING (text)",
    "encode_stream": f"""{ENCODED_LINES}
SELECT ids, sum(cnt)::BIGINT AS cnt FROM encoded JOIN line_counts USING (text) GROUP BY ids""",
    "stream_blocks": f"""{ENCODED_LINES},
document_lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) || E'\\n' AS text
    FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents)
),
offsets AS (
    SELECT ids, (sum(n) OVER (ORDER BY doc_id, pos) - n)::BIGINT AS start
    FROM document_lines JOIN encoded USING (text)
),
tokens AS MATERIALIZED (
    SELECT start + generate_subscripts(s, 1) - 1 AS place, unnest(s) AS id
    FROM (SELECT start, string_split(ids, ' ') AS s FROM offsets)
)
SELECT (place // {Q.BLOCK_TOKENS})::BIGINT AS block, count(*) AS n,
    string_agg(id, ' ' ORDER BY place) AS ids FROM tokens GROUP BY ALL""",
    "token_totals": f"""{WORD_IDS}
SELECT count(*) AS n_unique_words, sum(cnt)::BIGINT AS n_words, sum(cnt * n)::BIGINT AS n_tokens
FROM words JOIN word_ids USING (word)""",
    "training_totals": f"""
SELECT (SELECT count(*) FROM ({counts('documents')})) AS n_unique_words,
    (SELECT sum(cnt)::BIGINT FROM ({counts('documents')})) AS n_words,
    (SELECT count(*) FROM ({PAIRS})) AS n_unique_pairs""",
    "bytes_per_token": f"""{WORD_IDS},
{encoded('documents', 'doc_id')}
SELECT lang, source, sum(strlen(text))::BIGINT AS n_bytes, sum(n)::BIGINT AS n_tokens,
    {ratio('sum(strlen(text))', 'sum(n)')} AS bytes_per_token
FROM documents JOIN encoded USING (doc_id) GROUP BY lang, source""",
    "compression_report": f"{with_ids(BOTH_WORDS)}\n{REPORT}",
    "sample_documents": sampled("documents", "doc_id"),
    "decode_documents": "SELECT doc_id, text FROM documents",
    "decode_by_join": "SELECT doc_id, text FROM documents",
    "token_offsets": f"""{WORD_IDS},
{encoded('documents', 'doc_id')}
SELECT doc_id, n, start FROM ({OFFSETS})""",
    "token_blocks": f"""{TOKENS}
SELECT (place // {Q.BLOCK_TOKENS})::BIGINT AS block, count(*) AS n,
    string_agg(id, ' ' ORDER BY place) AS ids FROM tokens GROUP BY ALL""",
    "tokenized_lines": f"""{ENCODED_LINES}
SELECT id::BIGINT AS id, sum(cnt)::BIGINT AS cnt
FROM (SELECT unnest(string_split(ids, ' ')) AS id, cnt FROM encoded JOIN line_counts USING (text)) GROUP BY id""",
    "npy_blocks": f"""{TOKENS}
SELECT (place // {Q.BLOCK_TOKENS})::BIGINT AS block, count(*) AS n,
    string_agg(id, ' ' ORDER BY place) AS ids FROM tokens GROUP BY ALL""",
    "train_windows": f"""{TOKENS},
starts AS (
    SELECT sample, {DIGEST.format(value='sample', seed=Q.SEED)}
        % ((SELECT count(*) FROM tokens) - {Q.CONTEXT}) AS start
    FROM range({Q.SAMPLES}) t(sample)
),
places AS (SELECT sample, start, unnest(range(start, start + {Q.CONTEXT + 1})) AS place FROM starts)
SELECT sample, start,
    string_agg(id, ' ' ORDER BY place) FILTER (place < start + {Q.CONTEXT}) AS x,
    string_agg(id, ' ' ORDER BY place) FILTER (place > start) AS y
FROM places JOIN tokens USING (place) GROUP BY sample, start""",
    "softmax_rows": f"""{SCORES},
peaks AS (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS peak FROM scores)
SELECT vec_id, item, round(exp(logit - peak)
    / sum(exp(logit - peak)) OVER (PARTITION BY vec_id), 9) AS prob FROM peaks""",
    "cross_entropy_rows": f"{LOSSES} SELECT vec_id, round(loss, 6) AS loss FROM losses",
    "mean_loss": f"{LOSSES} SELECT round(avg(loss), 6) AS loss FROM losses",
    "eval_loss": f"""{LOSSES}
SELECT count(*) AS batches, round(avg(loss), 6) AS loss
FROM (SELECT vec_id // 48 AS batch, avg(loss) AS loss FROM losses GROUP BY ALL)""",
    "nucleus_filter": f"""{SCORES},
scaled AS (SELECT vec_id, item, logit / {Q.TEMPERATURE} AS logit FROM scores),
weights AS (
    SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS weight FROM scaled
),
ahead AS (
    SELECT *, coalesce(sum(weight) OVER (PARTITION BY vec_id ORDER BY logit DESC, item
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        / sum(weight) OVER (PARTITION BY vec_id) AS share,
        row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, item) AS place
    FROM weights
)
SELECT vec_id, item, round(weight / sum(weight) OVER (PARTITION BY vec_id), 9) AS prob
FROM ahead WHERE share <= {Q.TOP_P} OR place = 1""",
}
SQL["nucleus_of_rows"] = SQL["nucleus_filter"]
