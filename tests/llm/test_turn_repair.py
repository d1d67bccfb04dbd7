"""Repair of conversations against a plain search for the cheapest edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import plain
import pytest

from lexmill.llm import turn_repair
from lexmill.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SAID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """conv -> rows after damage in order of turn."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        number = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if number == 1:
            text = ""
        if number == 2:
            text = re.sub("[.!?]", "", text)
        if number == 4:
            role = "user"
        out[conv] += {0: [], 3: [(turn, role, text)] * 2}.get(number, [(turn, role, text)])
    order = lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(f"{len(r[1])}\0{r[1]}\0{r[2]}".encode()).digest())
    return {conv: sorted(kept, key=order) for conv, kept in out.items()}


def cheapest(rows):
    """cost, audit and repaired rows: least (cost, audit) for each state, row by row."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def offer(table, state, *value):
        table[state] = min(table.get(state, value), value)

    def grown(table):
        for _ in range(3):
            for state, (cost, audit, done) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[state]:
                        offer(table, role[0], cost + 5, audit + "I", (*done, f"{role}:"))
        return table

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, done) in grown(best).items():
            offer(after, state, cost + 2, audit + "D", done)
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            if role[:1] and role[:1] in follows[state]:
                offer(after, role[:1], cost, audit + "K", (*done, f"{role}:{text}"))
            for other in ("user", "assistant"):
                if other[0] in follows[state]:
                    offer(after, other[0], cost + 1, audit + "R", (*done, f"{other}:{text}"))
        best = after
    return min(value for state, value in grown(best).items() if state in ("", "a"))


def repair(rows):
    out = []
    for conv, kept in damage(rows).items():
        counts, seen, marked = defaultdict(int), set(), []
        for turn, role, text in kept:
            last = SAID.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [role[:1] for role, _, _ in marked]
        cost, audit, done = cheapest(marked)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"],
            counts["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, plain.sha("\n".join(done))))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_turn_repair"](spark, sf_dir)) == repair(rows)


def made(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randrange(most)):
            turn += rng.choice([0, 1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s", None, "User"])
            text = rng.choice(["Yes.", "Oh!", "cut off", "", " \n", "a. b", "Is it? \t", " ", "ü.", None, f"n {rng.randrange(10**6)}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows,partitions", [(1 << 16, 3), (3, 7), (1, 4)])
def test_blocks_of_any_size(spark, monkeypatch, block_rows, partitions):
    """The result does not depend on where conversations are cut: into tasks and into blocks."""
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block_rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made(block_rows, 40, 14) + [(99, i // 3, *r[2:]) for i, r in enumerate(made(7, 1, 400) * 3)]
        found = result(turn_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == repair(rows)


def test_long_runs_and_long_texts(spark):
    rows = [(1, i, "user", f"line {i}.") for i in range(5000)]
    rows += [(2, 0, "user", "x" * 3_000_000), (2, 1, "assistant", "y" * 3_000_000 + ".")]
    rows += [(3, None, "assistant", "the same.")] * 2000
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", kind int, conv string").repartition(3)
    assert result(turn_repair.repair(docs)) == repair(rows)


def test_empty_table_and_all_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(empty).collect() == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = result(turn_repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)))
    assert found == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_powers_advance_runs():
    for symbol in range(9):
        one = turn_repair.row_matrix(symbol)
        stepped = turn_repair.IDENTITY
        for length in range(1, 12):
            stepped = turn_repair.product(stepped, one)
            assert turn_repair.run_matrix(symbol, length) == stepped
            costs = (3, 9, 1, 4)
            assert turn_repair.before_run(symbol, length, costs) == turn_repair.costs_before(stepped, costs)
