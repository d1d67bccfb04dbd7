"""Secrets, told from widely copied examples by how many owners and repositories hold them.

Each text is scanned once.  Besides the plain rules (assignments, access keys, long hex runs) the scan
collects candidates: long runs of the characters of values, of high entropy, whatever stands before them.
Candidate digests are then counted over the whole corpus by distinct owners and by distinct
repositories.  A digest that ``EXAMPLE_OWNERS`` or more owners hold, or that lies in
``EXAMPLE_REPOSITORIES`` or more repositories, be they of one owner, is a copied example; one of
``LIVE_OWNERS`` owners and ``LIVE_REPOSITORIES`` repositories at most is a credential that looks live, and
its occurrences are added to the findings where no plain rule has found them.  What lies between is shared.

Defined results: a null or empty text has no findings, a very long one is scanned whole; a null owner
counts as one owner of its own, and rows with null keys as one repository of their owner;
rows with equal keys are scanned and reported by themselves; further columns are ignored; an empty
table gives no rows.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.session import new_folder, stored

# The plain rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "live")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS = 8, 16

# The characters of assigned values, `=` as padding only.  A run with one of `/.-` (paths and names have
# them too) counts whole if it is a UUID or has digits, letters of both cases and more entropy; otherwise
# the runs between such characters are looked at.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{20,}={0,2}")
PLAIN = re.compile(r"[A-Za-z0-9_+]{20,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
LEAST_DIGITS, LEAST_LETTERS, LEAST_ENTROPY, MIXED_ENTROPY = 3, 3, 3.0, 4.0

# Owners, or repositories, from which a value is a widely copied example; up to the LIVE ones of both it
# belongs to its owner and looks live, also where another owner holds a copy.
LIVE_OWNERS, EXAMPLE_OWNERS = 2, 3
LIVE_REPOSITORIES, EXAMPLE_REPOSITORIES = 5, 20

BASE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
CANDIDATE_TYPE = pa.list_(
    pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())])
)
FOUND = (
    "base array<struct<kind:int,start:long,stop:long>>, "
    "candidates array<struct<start:long,stop:long,digest:binary>>"
)


def entropy(value: str) -> float:
    """Bits per character."""
    total = len(value)
    return -sum(n / total * math.log2(n / total) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, stop)`` of the plain rules, by start and kind."""
    found = []
    folded = text.encode("utf-8", "surrogatepass").lower()
    if any(word in folded for word in KEYWORDS):
        found += [
            (0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    # Runs are maximal either way, so asking for 32 at once finds the same as filtering runs.
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def _random(value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    return digits >= LEAST_DIGITS and letters >= LEAST_LETTERS and entropy(value) >= LEAST_ENTROPY


def _whole(value: str) -> bool:
    """Whether a run with ``/``, ``.`` or ``-`` in it is one value."""
    cases = value != value.lower() and value != value.upper()
    return bool(UUID.fullmatch(value)) or (cases and _random(value) and entropy(value) >= MIXED_ENTROPY)


def candidate_spans(text: str) -> list[tuple[int, int, bytes]]:
    """``(start, stop, digest)`` of runs that look random, without ``/``, ``.`` and ``-`` at their ends."""
    found = []
    for m in CANDIDATE.finditer(text):
        start = m.end() - len(m[0].lstrip("/.-"))
        stop = max(start, m.start() + len(m[0].rstrip("/.-")))
        value = text[start:stop]
        if any(c in value for c in "/.-"):
            if len(value) >= 20 and _whole(value):
                found.append((start, stop))
                continue
            found += [p.span() for p in PLAIN.finditer(text, start, stop) if _random(p[0])]
        elif len(value) >= 20 and _random(value):
            found.append((start, stop))
    digest = lambda v: blake2b(v.encode(), digest_size=16).digest()
    return [(start, stop, digest(text[start:stop])) for start, stop in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text or "" for text in batch["text"].to_pylist()]
        base = [[dict(zip(("kind", "start", "stop"), s)) for s in base_spans(t)] for t in texts]
        found = [
            [dict(zip(("start", "stop", "digest"), s)) for s in candidate_spans(t)] for t in texts
        ]
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(base, BASE_TYPE), pa.array(found, CANDIDATE_TYPE)],
            [*kept.schema.names, "base", "candidates"],
        )


def owner_counts(occurrences: DataFrame) -> DataFrame:
    """``(digest, owners, repositories)`` of ``(digest, owner, repository)`` rows.

    Rows are reduced to distinct ones before each shuffle, so a value on every page costs a row per
    task, not per page.
    """
    repositories = occurrences.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = repositories.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return owners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")
    )


def scan(
    docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Scanned rows and candidate occurrences, both stored.

    The first has ``(_row, key, base)``; the second ``(_row, start, stop, digest, owners,
    repositories, label)`` with label ``live``, ``shared`` or ``example``.  A repository is a
    document here, an owner its source.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).alias("_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.col(text).alias("text"),
    )

    kind = rows.schema["_key"].dataType.simpleString()
    # The row numbers are read back from the written table, so every later step sees the same ones.
    found = stored(
        rows.mapInArrow(_scan, f"_row long, _key {kind}, _owner string, {FOUND}"),
        new_folder(spark, "secret-scan"),
    )
    seen = found.select("_row", "_key", "_owner", F.inline("candidates"))
    counts = stored(
        owner_counts(
            seen.select("digest", F.col("_owner").alias("owner"), F.col("_key").alias("repository"))
        ),
        new_folder(spark, "secret-owners"),
    )
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    own = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    label = F.when(copied, "example").when(own, "live").otherwise("shared")
    labelled = seen.drop("_key", "_owner").join(counts, "digest").withColumn("label", label)
    occurrences = stored(labelled, new_folder(spark, "secret-values"))
    return found.select("_row", F.col("_key").alias(key), "base"), occurrences


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of ``(start, kind, stop)`` structs, joined by commas."""
    names = F.array(*(F.lit(name) for name in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string")
            ),
        ),
        ",",
    )


def findings(
    docs: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text"
) -> DataFrame:
    """``(key, base, spans)``: arrays of ``(start, kind, stop)``, kinds as positions in ``KINDS``.

    ``spans`` holds the base and what ownership adds: live-looking values outside every base span.
    """
    rows, occurrences = scan(docs, key, owner, text)
    live = occurrences.where("label = 'live'").groupBy("_row").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("kind"), "stop")).alias("live")
    )
    joined = rows.join(live, "_row", "left")
    base = F.transform("base", lambda s: F.struct(s.start, s.kind, s.stop))
    fresh = F.filter(
        F.coalesce("live", F.array().cast("array<struct<start:long,kind:int,stop:long>>")),
        lambda s: ~F.exists("base", lambda b: (b.start < s.stop) & (s.start < b.stop)),
    )
    return joined.select(
        key, base.alias("base"), F.sort_array(F.concat(base, fresh)).alias("spans")
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans, per document."""
    found = findings(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
