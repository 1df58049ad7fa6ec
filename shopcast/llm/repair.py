"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation's rows in order of turn are edited at the least cost so that the
initials of the roles read ``(s?(ua)+)?``.  The item (i, p) says that rows i, i+1,
... can be repaired from state p of that pattern; an edit deduces (i, p) from the
item that it leaves behind, adds its cost and puts its initial before the audit.
Items are popped in order of (cost, rows used, audit): every deduction makes that
weight larger and keeps its order, so the first weight popped for an item is its
least one, and the agenda stops when the goal item (0, start) is popped.  From a
given item each initial leads to one item only, so equal costs are settled by the
first initial, and the audit is read off the deductions.

Rows are exchanged once by ranges of (conversation, turn, ...), so conversations of
any size are spread evenly.  A conversation inside one partition is finished
there.  The first and the last of a partition may go on in others (one that holds
a third of all rows does): their pieces are weighed from each state to each state,
combined by the binary rule (piece p -> q) + (rest from q), and their texts hashed
in order piece by piece.  Only that hash, which cannot be divided, and the audit
string itself run through one task for a conversation, as a stream.

Defined cases: a null role or text is one space, and so is a null id or turn in the
hash that picks the damage; null ids are one conversation, null turns come first.
Rows of one turn are ordered by role and hash of the text after the damage; equal
rows are next to each other.  Roles other than system, user and assistant count by
their first character (an empty role has none) and can only be changed or deleted
unless it is s, u or a.  Repeated rows are rows of their own.  Gaps beyond a long are the
largest long.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

START, SYSTEM, USER, ASSISTANT = range(4)       # states: nothing yet, after s, after u, after a
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)            # the state that a new user or assistant leads to
GIVEN = ("user", "user", "assistant", "user")   # and its role
FINAL = (START, ASSISTANT)
BEFORE = tuple(tuple(p for p in range(4) if NEXT[p] == q) for q in range(4))
KEPT = {(q, c): tuple(p for p in range(4) if STEP.get((p, c)) == q) for q in range(4) for c in "sua"}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
REMEMBERED = 200_000            # shapes of conversations whose repair a worker keeps
PARTITION_BYTES = 64 << 20
BLOB = 1 << 20
FLUSH = 4096
LONG = (1 << 63) - 1

Row = tuple     # (turn, role, text)


def lightest(shape: str, starts: Iterable[int], finals: Iterable[int]) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) from each start state that reaches a final one.

    ``shape`` has two characters a row: its role's initial and B (must go), T (truncated) or K.
    """
    n = len(shape) // 2
    agenda = [(0, 0, "", n, q, -1, -1) for q in finals]
    done: dict[tuple[int, int], tuple[int, str, int, int]] = {}
    goals = {(0, p) for p in starts}
    while agenda and goals:
        cost, used, edit, i, p, to_i, to_p = heappop(agenda)
        if (i, p) in done:
            continue
        done[i, p] = cost, edit, to_i, to_p
        goals.discard((i, p))
        for before in BEFORE[p]:
            heappush(agenda, (cost + INSERT, used, "I", i, before, i, p))
        if i:
            initial, fault = shape[2 * i - 2], shape[2 * i - 1]
            heappush(agenda, (cost + DELETE, used + 1, "D", i - 1, p, i, p))
            if fault != "B":
                more = cost + TRUNCATED * (fault == "T")
                for before in BEFORE[p]:
                    heappush(agenda, (more + REROLE, used + 1, "R", i - 1, before, i, p))
                for before in KEPT.get((p, initial), ()):
                    heappush(agenda, (more, used + 1, "K", i - 1, before, i, p))
    found = {}
    for p in starts:
        if (0, p) in done:
            audit, at = [], (0, p)
            while done[at][1]:
                audit.append(done[at][1])
                at = done[at][2:]
            found[p] = done[0, p][0], "".join(audit)
    return found


def lines(rows: Iterable[Row], audit: str, state: int = START) -> Iterator[str]:
    """The repaired ``role:text`` lines that the edits make of the rows."""
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            yield f"{GIVEN[state]}:"
            state = NEXT[state]
            continue
        _, role, text = next(rows)
        if edit == "K":
            yield f"{role}:{text}"
            state = STEP[state, role[0]]
        elif edit == "R":
            yield f"{GIVEN[state]}:{text}"
            state = NEXT[state]


def fault_of(text: str) -> str:
    """B: blank; T: truncated; K: neither."""
    text = text.rstrip(SPACE)
    return "B" if not text else "K" if text[-1] in ".!?" else "T"


class Tally:
    """Counts of a run of rows in order; ``shape`` is what the agenda needs of them."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None               # initials of the roles
        self.first_turn = self.last_turn = None     # also the least and the greatest
        self.shape: list[str] = []

    def add(self, turn: int | None, initial: str, fault: str, seen: bool) -> None:
        if fault == "B":
            self.blank += 1
        elif seen:
            self.duplicate += 1
            fault = "B"
        elif fault == "T":
            self.truncated += 1
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            self.turns += turn != self.last_turn or self.first_turn is None
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.shape.append((initial or "?") + fault)

    def join(self, other: Tally) -> None:
        """Add the counts of the rows that follow."""
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal
        if other.last is not None:
            self.illegal += self.last is not None and self.last + other.first not in LEGAL
            self.first, self.last = other.first if self.last is None else self.first, other.last
        if other.first_turn is not None:
            self.turns += other.turns - (other.first_turn == self.last_turn and self.first_turn is not None)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def counts(self) -> list[int]:
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.turns, LONG)
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def damaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, digest) after the damage; a dropped row stays with a null role and text."""
    src = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    name = "concat(coalesce(CAST(id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))"
    src = src.selectExpr("*", f"crc32(encode({name}, 'UTF-8')) % 20 AS code").selectExpr(
        "id", "turn", "CASE code WHEN 0 THEN NULL WHEN 4 THEN 'user' ELSE role END AS role",
        "CASE code WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "explode(IF(code = 3, array(0, 1), array(0))) AS copy").drop("copy")
    return src.selectExpr("*", "unhex(md5(concat(length(role), ':', role, text))) AS digest")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _grouped(df: DataFrame, keys: list[str], order: list[str], work: Callable[[Iterator[tuple]], Iterator[tuple]],
             schema: str, fields: list[pa.Field]) -> DataFrame:
    """``work`` on the sorted stream of rows whose keys share a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(work(_stream(batches)), fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batches(rows: Iterator[tuple], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)],
                                          names=[f.name for f in fields])
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= FLUSH or size >= BLOB:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = [pa.field(c, pa.int64()) for c in COUNTS] + [pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
OPEN = [pa.field("part", pa.int64()), pa.field("at", pa.int64()), pa.field("turn", pa.int64()), pa.field("role", pa.string()),
        pa.field("text", pa.string()), pa.field("fault", pa.string()), pa.field("digest", pa.binary())]
NOTHING = hashlib.sha256(b"").hexdigest()


def _ddl(fields: list[pa.Field]) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>",
             pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in fields)


def _finish(whole: list[tuple], memory: dict[str, tuple[int, str]]) -> tuple:
    """Counts, cost, audit and hash of a conversation that is all here."""
    rows = [r[1:4] for r in whole if r[2] is not None]
    tally, seen = Tally(), set()
    for turn, role, text in rows:
        tally.add(turn, role[:1], fault_of(text), (role, text) in seen)
        seen.add((role, text))
    shape = "".join(tally.shape)
    if shape not in memory:
        if len(memory) >= REMEMBERED:
            memory.clear()
        memory[shape] = lightest(shape, (START,), FINAL)[START]
    cost, audit = memory[shape]
    return *tally.counts(), cost, audit, hashlib.sha256("\n".join(lines(rows, audit)).encode()).hexdigest()


def _close(stream: Iterator[tuple], part: int) -> Iterator[tuple]:
    """Finished conversations, and the rows of a partition's first and last one, which may go on in other partitions."""
    memory: dict[str, tuple[int, str]] = {}
    at = 0

    def open_row(r: tuple) -> tuple:
        nonlocal at
        at += 1
        return (r[0], *[None] * len(RESULT), part, at, *r[1:4], fault_of(r[3]) if r[2] is not None else None, r[4])
    held = None
    for n, (_, rows) in enumerate(groupby(stream, key=lambda r: r[0])):
        if not n:
            yield from map(open_row, rows)
            continue
        if held:
            yield held[0][0], *_finish(held, memory), *[None] * len(OPEN)
        held = list(rows)
    yield from map(open_row, held or ())


SEGMENT = [pa.field("part", pa.int64()), pa.field("counts", pa.list_(pa.int64())), pa.field("initials", pa.list_(pa.string())),
           pa.field("ends", pa.list_(pa.int64())), pa.field("costs", pa.list_(pa.int64())), pa.field("audits", pa.list_(pa.string()))]


def _weigh(stream: Iterator[tuple]) -> Iterator[tuple]:
    """Each piece from each state to each state.  Rows: id, part, at, turn, initial, fault, digest.

    Digests that earlier pieces hold come first (``at`` -1).
    """
    for (name, part), rows in groupby(stream, key=lambda r: r[:2]):
        tally, seen = Tally(), set()
        for _, _, at, turn, initial, fault, digest in rows:
            if at >= 0 and initial is not None:
                tally.add(turn, initial, fault, digest in seen)
            if digest is not None:
                seen.add(digest)
        costs, audits = [None] * 16, [None] * 16
        shape = "".join(tally.shape)
        for q in range(4):
            for p, (cost, audit) in lightest(shape, range(4), (q,)).items():
                costs[4 * p + q], audits[4 * p + q] = cost, audit
        yield (name, part, [tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.turns],
               [tally.first, tally.last], [tally.first_turn, tally.last_turn], costs, audits)


CHOICE = [*RESULT[:-1], pa.field("part", pa.int64()), pa.field("state", pa.int64())]


def _combine(stream: Iterator[tuple]) -> Iterator[tuple]:
    """The pieces of each conversation in order: its counts and cost, and the edits chosen for each piece."""
    for name, pieces in groupby(stream, key=lambda r: r[0]):
        pieces, tally = list(pieces), Tally()
        for _, _, counts, initials, ends, _, _ in pieces:
            more = Tally()
            more.blank, more.duplicate, more.truncated, more.illegal, more.turns = counts
            (more.first, more.last), (more.first_turn, more.last_turn) = initials, ends
            tally.join(more)
        best = {q: 0 for q in FINAL}                # least cost of the rest from each state
        choices = []
        for *_, costs, audits in reversed(pieces):
            options = [[(costs[4 * p + q] + best[q], audits[4 * p + q], q) for q in best if costs[4 * p + q] is not None]
                       for p in range(4)]
            choice = {p: min(o) for p, o in enumerate(options) if o}
            best = {p: c[0] for p, c in choice.items()}
            choices.append(choice)
        state, parts = START, []
        for piece, choice in zip(pieces, reversed(choices), strict=True):
            _, audit, to = choice[state]
            parts.append((piece[1], state, audit))
            state = to
        yield name, *tally.counts(), best[START], "".join(a for *_, a in parts), None, None
        for part, state, audit in parts:
            yield name, *[None] * len(COUNTS), audit, part, state


TEXTS = [pa.field("part", pa.int64()), pa.field("at", pa.int64()), pa.field("raw", pa.binary())]


def _spell(stream: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired lines of each piece, a line feed before each, in blobs.  Rows: id, part, at, state, audit or role, text."""
    for (name, part), rows in groupby(stream, key=lambda r: r[:2]):
        _, _, _, state, audit, _ = next(rows)
        held, size, at = [], 0, 0
        for line in lines((r[3:] for r in rows if r[4] is not None), audit, state):
            held.append(b"\n" + line.encode())
            size += len(held[-1])
            if size >= BLOB:
                yield name, part, at, b"".join(held)
                held, size, at = [], 0, at + 1
        if held:
            yield name, part, at, b"".join(held)


def _hash(stream: Iterator[tuple]) -> Iterator[tuple]:
    for name, blobs in groupby(stream, key=lambda r: r[0]):
        total, skip = hashlib.sha256(), 1           # the first line has no line feed before it
        for *_, raw in blobs:
            total.update(memoryview(raw)[skip:])
            skip = 0
        yield name, total.hexdigest()


def repaired(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """One row per conversation: id, counts of faults, cost, audit and hash of its repair after the damage."""
    spark = conversations.sparkSession
    rows = damaged(conversations, id_col, turn_col, role_col, text_col)
    size = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "spread"]
    # equal rows may be parted anywhere, so they are numbered
    rows = rows.withColumn("spread", F.monotonically_increasing_id() % 997)
    kind, field = rows.schema["id"].dataType.simpleString(), pa.field("id", _arrow(rows))
    wide = [field, *RESULT, *OPEN]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_close(_stream(batches), TaskContext.get().partitionId()), wide)

    first = (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("spread")
             .mapInArrow(close, f"id {kind}, {_ddl([*RESULT, *OPEN])}"))
    first = written(first, "repair-rows")
    opened = first.where("part IS NOT NULL")
    closed = first.where("part IS NULL").select("id", *[f.name for f in RESULT])

    earlier = (opened.where("digest IS NOT NULL").groupBy("id", "digest")
               .agg(F.sort_array(F.collect_set("part")).alias("parts")).where("size(parts) > 1")
               .selectExpr("id", "explode(slice(parts, 2, size(parts) - 1)) AS part", "-1L AS at", "CAST(NULL AS LONG) AS turn",
                           "CAST(NULL AS STRING) AS initial", "CAST(NULL AS STRING) AS fault", "digest"))
    light = opened.selectExpr("id", "part", "at", "turn", "substr(role, 1, 1) AS initial", "fault", "digest")
    pieces = _grouped(light.unionByName(earlier), ["id", "part"], ["at"], _weigh, f"id {kind}, {_ddl(SEGMENT)}", [field, *SEGMENT])
    chosen = written(_grouped(pieces, ["id"], ["part"], _combine, f"id {kind}, {_ddl(CHOICE)}", [field, *CHOICE]), "repair-pieces")
    edits = chosen.where("part IS NOT NULL").selectExpr("id", "part", "-1L AS at", "state", "audit AS role", "'' AS text")
    texts = opened.selectExpr("id", "part", "at", "0L AS state", "role", "text")
    spelt = _grouped(texts.unionByName(edits), ["id", "part"], ["at"], _spell, f"id {kind}, {_ddl(TEXTS)}", [field, *TEXTS])
    hashes = _grouped(spelt, ["id"], ["part", "at"], _hash, f"id {kind}, hash string", [field, pa.field("hash", pa.string())])
    hashes = hashes.withColumnRenamed("id", "of")
    whole = (chosen.where("part IS NULL").join(hashes, F.col("id").eqNullSafe(F.col("of")), "left")
             .select("id", *COUNTS, "audit", F.coalesce("hash", F.lit(NOTHING)).alias("repaired_sha256")))
    return closed.unionByName(whole).withColumnRenamed("id", id_col)


def _arrow(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(rows.schema["id"].dataType)
