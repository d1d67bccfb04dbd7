"""Repair of the role structure of conversations by cheapest edits.

A repaired conversation's roles read ``(s?(ua)+)?`` in initials.  A row is kept (cost 0), reroled to user
or assistant (1) or deleted (2); an empty row of user or assistant is inserted anywhere (5).  Blank rows and
copies of earlier rows must go, a truncated row that stays costs 5 more.  Which edits come next
depends on the last role only, so a row is a 4 by 4 matrix over (min, +), and rows of equal role initial
and fault are equal matrices: a run of them is advanced by cached binary powers.  Costs to the end are
taken backwards run by run, then the edits are unrolled forwards, the ASCII-least of the cheapest.

Conversations may be longer than a task should hold.  Rows are dealt by ranges of (conversation, turn),
so a long one is spread over tasks, and each task cuts what it meets into blocks.  A conversation that
lies inside one block is finished there.  Of the others the blocks' matrices are streamed backwards for
the costs behind every block, the blocks are unrolled in parallel from each role they may start after,
and a stream in order picks the one that fits and feeds the hash, holding one block at a time; SHA-256
has to be fed in order.  Of a finished conversation only the audit is as long as itself.
Copies are found by a grouped minimum over (conversation, role, text digest), combined before it is
shuffled; the first row of each group comes back as a marker in the sort that deals the rows, so no
group is joined or collected.

Defined results: null roles and texts are one space, null conversations are one conversation, null turns
come first; rows of one turn are in order of role, then of a digest of role and text; repeated rows are copies; a
conversation all of whose rows were dropped has zeros, an empty audit and the hash of the empty string;
very long texts are rows of a block of their own; an empty table gives no rows; further columns
are left out, whatever their names.  Turns are read as long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lexmill.session import new_folder, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
CLOSING = ".!?"

# A block of a conversation ends at so many rows or characters.
BLOCK_ROWS = 1 << 16
BLOCK_CHARS = 1 << 20

# What the last row of the repaired conversation is: nothing yet, system, user, assistant.
STATES = range(4)
NEXT_ROLE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
INITIALS = "sua"
# A symbol is a role's place in INITIALS or 3, plus 4 if truncated; or the row must go.
MUST_GO = 8
NEVER = 1 << 60

Costs = tuple[int, int, int, int]
Matrix = tuple[Costs, Costs, Costs, Costs]


# ---- the matrices ---------------------------------------------------------------------------


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(min(NEVER, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES
    )


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)


def _inserts() -> Matrix:
    once = [[NEVER] * 4 for _ in STATES]
    for state, (after, _) in NEXT_ROLE.items():
        once[state][after] = INSERT
    once = tuple(tuple(min(x, y) for x, y in zip(p, q)) for p, q in zip(once, IDENTITY))
    return product(product(once, once), product(once, once))


# Costs of any number of insertions; three reach whatever can be reached.
INSERTS = _inserts()


def edits_of(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a row after ``state``: initial, cost and state after it."""
    yield "D", DELETE, state
    if symbol == MUST_GO:
        return
    extra = TRUNCATED if symbol >= 4 else 0
    if symbol % 4 == 0 and state == 0:
        yield "K", KEEP + extra, 1
    after, role = NEXT_ROLE[state]
    if INITIALS[symbol % 4 :][:1] == role[0]:
        yield "K", KEEP + extra, after
    yield "R", REROLE + extra, after


def row_matrix(symbol: int) -> Matrix:
    """Costs from state to state of a row and the insertions before it."""
    out = [[NEVER] * 4 for _ in STATES]
    for state in STATES:
        for _, cost, after in edits_of(symbol, state):
            out[state][after] = min(out[state][after], cost)
    return product(INSERTS, tuple(map(tuple, out)))


@lru_cache(None)
def power(symbol: int, exponent: int) -> Matrix:
    """The matrix of ``2 ** exponent`` rows."""
    if not exponent:
        return row_matrix(symbol)
    half = power(symbol, exponent - 1)
    return product(half, half)


def run_matrix(symbol: int, length: int) -> Matrix:
    out = IDENTITY
    for exponent in range(length.bit_length()):
        if length >> exponent & 1:
            out = product(out, power(symbol, exponent))
    return out


def costs_before(matrix: Matrix, after: Costs) -> Costs:
    return tuple(min(NEVER, *(row[k] + after[k] for k in STATES)) for row in matrix)


# Costs where nothing follows: whole pairs and the empty conversation may end, others by insertions.
AT_END: Costs = costs_before(INSERTS, (0, NEVER, NEVER, 0))


@lru_cache(1 << 16)
def _before_run(symbol: int, length: int, after: Costs) -> Costs:
    """Costs before a run; ``after`` has its least cost taken off."""
    for exponent in range(length.bit_length()):
        if length >> exponent & 1:
            after = costs_before(power(symbol, exponent), after)
    return after


def before_run(symbol: int, length: int, after: Costs) -> Costs:
    least = min(after)
    found = _before_run(symbol, length, tuple(x - least for x in after))
    return tuple(x + least for x in found)


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def block_matrix(symbols: bytes) -> Matrix:
    out = IDENTITY
    for symbol, length in runs_of(symbols):
        out = product(out, run_matrix(symbol, length))
    return out


# ---- the choices ----------------------------------------------------------------------------


@lru_cache(1 << 16)
def _choice(symbol: int, state: int, after: Costs) -> tuple[str, int]:
    """Edits up to and with a row, the ASCII-least of the cheapest, and the state after them."""
    here, done = _before_run(symbol, 1, after), ""
    while True:
        cost = here[state]
        moves = {kind: (price, end) for kind, price, end in edits_of(symbol, state)}
        if DELETE + after[state] == cost:
            return done + "D", state
        inserted = NEXT_ROLE[state][0]
        if INSERT + here[inserted] == cost:
            done, state = done + "I", inserted
            continue
        for kind in "KR":
            if kind in moves and moves[kind][0] + after[moves[kind][1]] == cost:
                return done + kind, moves[kind][1]


def unrolled(symbols: bytes, states: tuple[int, ...], after: Costs) -> list[tuple[str, int]]:
    """For each state to start after: the edits of the rows, and the state they end in."""
    runs = runs_of(symbols)
    behind = [after]
    for symbol, length in reversed(runs[1:]):
        behind.append(before_run(symbol, length, behind[-1]))
    parts, now = [[] for _ in states], list(states)
    for (symbol, length), costs in zip(runs, reversed(behind)):
        steps = [costs]
        for _ in range(length - 1):
            steps.append(before_run(symbol, 1, steps[-1]))
        for costs in reversed(steps):
            least = min(costs)
            costs = tuple(x - least for x in costs)
            for i, state in enumerate(now):
                edits, now[i] = _choice(symbol, state, costs)
                parts[i].append(edits)
    return [("".join(part), state) for part, state in zip(parts, now)]


def closing(state: int) -> str:
    """Insertions that end a conversation; they are the only way on."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def repaired(edits: str, state: int, symbols: bytes, roles: list[str], texts: list[str]) -> Iterator[str]:
    """Rows of the repaired conversation as ``role:text``; rows that must go have no role and text."""
    place, rows = 0, zip(roles, texts)
    for edit in edits:
        after, role = NEXT_ROLE[state]
        if edit == "I":
            yield f"{role}:"
            state = after
            continue
        symbol, place = symbols[place], place + 1
        own = None if symbol == MUST_GO else next(rows)
        if edit == "R":
            yield f"{role}:{own[1]}"
            state = after
        elif edit == "K":
            yield f"{own[0]}:{own[1]}"
            state = 1 if symbol % 4 == 0 else after


# ---- damage and order -----------------------------------------------------------------------


def damaged(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turn, role, text, kind)``: dropped rows stay as ``kind`` 2, without role and text."""
    named = rows.select(
        F.col(key).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(F.col(turn).cast("string"), F.lit(" ")).alias("place"),
    )
    name = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), "place")
    number = F.col("number")
    kept = F.when(number == 0, "").otherwise(F.col("text"))
    times = F.when(number == 3, F.array(F.lit(1), F.lit(1))).otherwise(
        F.array(F.when(number == 0, 2).otherwise(1))
    )
    return named.withColumn("number", F.crc32(name) % 20).select(
        "conv",
        "turn",
        F.when(number == 0, "").when(number == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(number == 1, "").when(number == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(kept).alias("text"),
        F.explode(times).alias("kind"),
    )


ORDER = ["conv", "turn", "role", "digest", "id"]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in ranges of their order, after each first one of its role and text a marker's row (kind 0).

    A marker has the order of its row and so meets it in the same task, right before it.
    """
    spark = rows.sparkSession
    digest = F.unhex(F.md5(F.concat_ws("\0", F.length("role").cast("string"), "role", "text")))
    rows = rows.withColumn("digest", digest).withColumn("id", F.monotonically_increasing_id())
    rows = stored(rows, new_folder(spark, "turns"))
    first = rows.where("kind = 1").groupBy("conv", "role", "digest").agg(
        F.min(F.struct("turn", "id")).alias("first")
    )
    markers = first.select("conv", "first.*", "role", "digest", F.lit(0).alias("kind"))
    every = rows.unionByName(markers, allowMissingColumns=True)
    return every.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, "kind")


# ---- blocks ---------------------------------------------------------------------------------


class _Block:
    """Rows of one conversation, as far as a task has met them."""

    def __init__(self, conv: object) -> None:
        self.conv = conv
        self.symbols = bytearray()
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.turns: list[int] | None = None
        self.initials: list[str] | None = None

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        initial, said = role[:1], text.strip(SPACES)
        if self.initials is None:
            self.initials = [initial, initial]
        else:
            self.illegal += self.initials[1] + initial not in ("su", "ua", "au")
            self.initials[1] = initial
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn]
                self.distinct = 1
            elif turn != self.turns[1]:
                self.turns[1] = turn
                self.distinct += 1
        if not said or not first:
            self.blank += not said
            self.duplicate += bool(said)
            self.symbols.append(MUST_GO)
            return
        cut = said[-1] not in CLOSING
        self.truncated += cut
        kind = INITIALS.find(initial) if initial else 3
        self.symbols.append((kind if kind >= 0 else 3) + 4 * cut)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(role) + len(text)

    @property
    def full(self) -> bool:
        return len(self.symbols) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def row(self) -> dict:
        counts = [self.blank, self.duplicate, self.truncated, self.illegal, self.distinct]
        return {"conv": self.conv, "counts": counts, "turns": self.turns}

    def finished(self) -> dict:
        symbols = bytes(self.symbols)
        costs = AT_END
        for symbol, length in reversed(runs_of(symbols)):
            costs = before_run(symbol, length, costs)
        [(edits, state)] = unrolled(symbols, (0,), AT_END)
        edits += closing(state)
        lines = "\n".join(repaired(edits, 0, symbols, self.roles, self.texts))
        return self.row() | {
            "closed": True, "cost": costs[0], "audit": edits,
            "sha": hashlib.sha256(lines.encode()).hexdigest(),
        }

    def opened(self, part: int, block: int) -> dict:
        symbols = bytes(self.symbols)
        return self.row() | {
            "closed": False, "part": part, "block": block, "initials": self.initials,
            "matrix": [x for line in block_matrix(symbols) for x in line],
            "symbols": symbols, "roles": self.roles, "texts": self.texts,
        }


LONGS, STRINGS = ArrayType(LongType()), ArrayType(StringType())
RESULT = {"closed": BooleanType(), "counts": LONGS, "turns": LONGS, "cost": LongType(),
          "audit": StringType(), "sha": StringType()}
PIECE = {"part": IntegerType(), "block": IntegerType(), "initials": STRINGS, "matrix": LONGS,
         "symbols": BinaryType(), "roles": STRINGS, "texts": STRINGS}
CHOICES = {"after": LONGS, "edits": STRINGS, "ends": LONGS}


def _shape(conv: StructField, *groups: dict) -> StructType:
    return StructType([conv, *(StructField(k, v) for group in groups for k, v in group.items())])


def _batches(rows: Iterator[dict], shape: pa.Schema, weight: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a thousand, or fewer where the lists in ``weight`` are long."""
    held, size = [], 0
    for row in rows:
        held.append({name: row.get(name) for name in shape.names})
        size += sum(map(len, row.get(weight) or ()))
        if len(held) >= 1000 or size >= 4 * BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(held, shape)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, shape)


def _arrow(shape: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(shape)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def blocks(rows: DataFrame) -> DataFrame:
    """A row for each conversation that lies inside a task and a block, or for each block of the others.

    The first and the last conversation of a task may have rows elsewhere and are left open.
    """
    shape = _shape(rows.schema["conv"], RESULT, PIECE)
    arrow = _arrow(shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, number, fresh = TaskContext.get().partitionId(), 0, None
        now, alone = None, False  # alone: the conversation began here and is in one block so far
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv", "turn", "role", "id", "kind", "text")]
            for conv, turn, role, place, kind, text in zip(*columns):
                if now is None:
                    now = _Block(conv)
                elif conv != now.conv:
                    yield now.finished() if alone else now.opened(part, number)
                    now, alone, number = _Block(conv), True, number + 1
                elif now.full:
                    yield now.opened(part, number)
                    now, alone, number = _Block(conv), False, number + 1
                if kind == 0:
                    fresh = place
                elif kind == 1:
                    now.add(turn, role, text, fresh == place)
                    fresh = None
        if now is not None:
            yield now.opened(part, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(cut(batches), arrow, "texts")

    return rows.select("conv", "turn", "role", "id", "kind", "text").mapInArrow(run, shape)


def costs_behind(pieces: DataFrame) -> DataFrame:
    """``(part, block, after)``: the costs behind every block, by a stream from each conversation's end."""
    shape = _shape(StructField("part", IntegerType()), {"block": IntegerType(), "after": LONGS})
    arrow = _arrow(shape)

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, costs, begun = None, AT_END, False
        for row in _records(batches):
            if not begun or row["conv"] != conv:
                conv, costs, begun = row["conv"], AT_END, True
            yield {"part": row["part"], "block": row["block"], "after": list(costs)}
            lines = [tuple(row["matrix"][4 * i : 4 * i + 4]) for i in STATES]
            costs = costs_before(tuple(lines), costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(behind(batches), arrow, "none")

    ordered = pieces.select("conv", "part", "block", "matrix").repartition("conv")
    ordered = ordered.sortWithinPartitions("conv", F.desc("part"), F.desc("block"))
    return ordered.mapInArrow(run, shape)


def _chosen(met: DataFrame) -> DataFrame:
    """Blocks with their edits from each state they may start after, and the states they end in."""
    shape = _shape(met.schema["conv"], RESULT, PIECE, CHOICES)
    arrow = _arrow(shape)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _records(batches):
            found = unrolled(row["symbols"], tuple(STATES), tuple(row["after"]))
            yield row | {"edits": [edits for edits, _ in found], "ends": [end for _, end in found]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(choose(batches), arrow, "texts")

    return met.select(*shape.names[:-2]).mapInArrow(run, shape)


class _Whole:
    """A conversation put together from its blocks in order."""

    def __init__(self, row: dict) -> None:
        self.conv, self.state, self.audit = row["conv"], 0, []
        self.counts, self.turns, self.initial = [0] * 5, None, None
        self.hash, self.empty = hashlib.sha256(), True
        lines = [tuple(row["matrix"][4 * i : 4 * i + 4]) for i in STATES]
        self.cost = costs_before(tuple(lines), tuple(row["after"]))[0]

    def _feed(self, lines: Iterator[str]) -> None:
        for line in lines:
            self.hash.update(("" if self.empty else "\n").encode())
            self.hash.update(line.encode())
            self.empty = False

    def add(self, row: dict) -> None:
        self.counts = [x + y for x, y in zip(self.counts, row["counts"])]
        if row["turns"]:
            if self.turns:
                self.counts[4] -= self.turns[1] == row["turns"][0]
                self.turns[1] = row["turns"][1]
            else:
                self.turns = list(row["turns"])
        if row["initials"]:
            if self.initial is not None:
                self.counts[3] += self.initial + row["initials"][0] not in ("su", "ua", "au")
            self.initial = row["initials"][1]
        edits = row["edits"][self.state]
        self._feed(repaired(edits, self.state, row["symbols"], row["roles"], row["texts"]))
        self.audit.append(edits)
        self.state = row["ends"][self.state]

    def finished(self) -> dict:
        end = closing(self.state)
        self._feed(repaired(end, self.state, b"", [], []))
        return {
            "conv": self.conv, "closed": True, "counts": self.counts, "turns": self.turns,
            "cost": self.cost, "audit": "".join(self.audit) + end, "sha": self.hash.hexdigest(),
        }


def joined_blocks(pieces: DataFrame) -> DataFrame:
    """The results of the conversations that have open blocks."""
    chosen = _chosen(pieces.join(costs_behind(pieces), ["part", "block"]))
    shape = _shape(chosen.schema["conv"], RESULT)
    arrow = _arrow(shape)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = None
        for row in _records(batches):
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    yield now.finished()
                now = _Whole(row)
            now.add(row)
        if now is not None:
            yield now.finished()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(put(batches), arrow, "none")

    ordered = chosen.repartition("conv").sortWithinPartitions("conv", "part", "block")
    return ordered.mapInArrow(run, shape)


def repair(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row for each conversation of ``rows`` after damage: faults, cost and audit of its repair, hash."""
    spark = rows.sparkSession
    found = blocks(dealt(damaged(rows, key, turn, role, text)))
    found = stored(found, new_folder(spark, "turn-blocks"))
    names = ["conv", *RESULT]
    done = found.where("closed").select(names).unionByName(joined_blocks(found.where("not closed")))
    count: dict[str, Column] = {
        name: F.col("counts")[i] for i, name in enumerate(("blank", "duplicate", "truncated", "illegal"))
    }
    gaps = F.col("turns")[1] - F.col("turns")[0] + 1 - F.col("counts")[4]
    return done.select(
        F.col("conv").alias(key),
        F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"),
        *(column.alias(name) for name, column in count.items()),
        "cost",
        "audit",
        F.col("sha").alias("repaired_sha256"),
    )
