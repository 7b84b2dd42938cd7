"""Repair of conversation structure by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn; tasks read them as a stream. The cheapest
edits are found from the end: the costs-to-go of the four states a repaired prefix can be in
travel from batch to batch, and each row leaves one byte, the best edit in each state. From the
start those bytes spell the edits. A conversation whose texts fit a small buffer is finished when
its first turn arrives. Of a larger one nothing but the current costs stays in memory: its bytes
are written to shared storage in chunks, and a second stream, sorted the other way, meets each
chunk just before the rows it covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paymend.llm.batches import chunks, emit, raw
from paymend.sources.scratch import materialise

#: Bytes of roles and texts of one conversation held before it counts as giant, and edit bytes in a chunk.
HELD_BYTES, CHUNK_ROWS = 8_000_000, 65_536
#: Bytes of output rows in a batch.
BATCH_BYTES = 4_000_000
DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their letters
LETTERS = b"DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of a repaired prefix: nothing yet, system, user last, assistant last. A whole one ends in the first or the last.
STATES = range(4)
MOVE = ({b"s": 1, b"u": 2}, {b"u": 2}, {b"a": 3}, {b"u": 2})
NEXT = (2, 2, 3, 2)  # by a user or assistant turn
NAME = {2: b"user", 3: b"assistant"}
END = (0, 2 * INSERT_COST, INSERT_COST, 0)
_LONG = (1 << 63) - 1

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_HEAD = [("conv_id", "long"), *((c, "long") for c in _COUNTS), ("giant", "boolean"), ("turn", "long"), ("tie", "binary"), ("nth", "long"), ("edits", "binary")]
_TURNS = ["conv_id", "place", "turn", "role", "text", "edit"]


def _schema(fields: list[tuple[str, str]]) -> tuple[pa.Schema, str]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in fields]), ", ".join(f"{n} {k}" for n, k in fields)


_REPORT, _REPORT_DDL = _schema([*_HEAD, ("audit", "string"), ("repaired_sha256", "string")])
_REPORT_TURNS, _REPORT_TURNS_DDL = _schema([*_HEAD, ("place", "long"), ("role", "string"), ("text", "string"), ("edit", "string")])


@lru_cache(maxsize=65536)
def step(after: tuple[int, ...], initial: bytes, fault: int) -> tuple[tuple[int, ...], int]:
    """(costs-to-go before a row, the best edit in each state, two bits each) from the costs after it.

    Of equally cheap edits the first by letter is taken. ``after`` has 0 at its least, so few different ones exist.
    """
    best, choice = [], []
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for s in STATES:
        ways = [(DELETE_COST + after[s], DELETE)]
        if fault not in (BLANK, DUPLICATE):
            to = s if not initial else MOVE[s].get(initial)
            if to is not None:
                ways.append((extra + after[to], KEEP))
            ways.append((REROLE_COST + extra + after[NEXT[s]], REROLE))
        cost, letter = min(ways)
        best.append(cost)
        choice.append(letter)
    plain = list(best)
    for _ in STATES:
        for s in STATES:
            best[s] = min(plain[s], INSERT_COST + best[NEXT[s]])
    byte = 0
    for s in STATES:
        letter = choice[s] if best[s] == plain[s] else INSERT
        if best[s] == INSERT_COST + best[NEXT[s]]:
            letter = min(letter, INSERT)
        byte |= letter << 2 * s
    return tuple(best), byte


class _Costs:
    """Costs-to-go while rows come from the last to the first."""

    def __init__(self):
        self.taken, self.now = 0, END

    def before(self, initial: bytes, fault: int) -> int:
        now, byte = step(self.now, initial, fault)
        least = min(now)
        self.taken += least
        self.now = tuple(x - least for x in now) if least else now
        return byte

    def total(self) -> int:
        return self.taken + self.now[0]


class _Spell:
    """Follows edit bytes from the first row on."""

    def __init__(self):
        self.state, self.audit = 0, bytearray()

    def row(self, byte: int, role: bytes) -> Iterator[tuple[int, bytes | None]]:
        """(edit, role to write) of a row and of the turns inserted before it."""
        while True:
            edit = byte >> 2 * self.state & 3
            self.audit.append(LETTERS[edit])
            if edit == DELETE:
                yield edit, None
                return
            if edit == KEEP:
                if role:
                    self.state = MOVE[self.state][role[:1]]
                yield edit, role
                return
            self.state = NEXT[self.state]
            yield edit, NAME[self.state]
            if edit == REROLE:
                return

    def end(self) -> Iterator[tuple[int, bytes]]:
        while END[self.state]:
            self.audit.append(LETTERS[INSERT])
            self.state = NEXT[self.state]
            yield INSERT, NAME[self.state]


class _Digest:
    """SHA-256 over the repaired turns as ``role:text`` lines."""

    def __init__(self):
        self.sum, self.first = hashlib.sha256(), True

    def add(self, role: bytes, text: bytes) -> None:
        self.sum.update((b"" if self.first else b"\n") + role + b":" + text)
        self.first = False


class _Out:
    """Output rows by column, sent on in batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, size: int, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append([row.get(c) for c in self.schema.names])
        self.size += size + 128
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield emit(self.schema, **dict(zip(self.schema.names, map(list, zip(*self.rows)))))
            self.rows, self.size = [], 0


class _Conversation:
    """What is known of a conversation while its rows come from the last to the first."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.costs, self.counts = conv_id, _Costs(), [0, 0, 0, 0]
        self.illegal, self.later = 0, None
        self.low = self.high = self.seen = None
        self.turns = 0
        self.rows, self.size, self.edits, self.giant, self.key = [], 0, bytearray(), False, (None, None, None)

    def gaps(self) -> int:
        return min(_LONG, self.high - self.low + 1 - self.turns) if self.turns else 0

    def known(self) -> dict:
        values = (self.gaps(), *self.counts[1:], self.illegal, self.costs.total())
        return dict(zip(_COUNTS, values))

    def read(self, turn: int | None, role: bytes, fault: int, key: tuple) -> None:
        if turn is not None:
            if turn != self.seen:
                self.turns, self.seen = self.turns + 1, turn
            self.low, self.high = turn, turn if self.high is None else self.high
        self.counts[fault] += 1
        initial = role[:1]
        if self.later is not None and initial + self.later not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.later = initial
        self.edits.append(self.costs.before(initial, fault))
        self.key = key


class _Finish:
    """Spells a conversation from its first row on, into its digest or (``turns``) into rows."""

    def __init__(self, conv_id: int | None, turns: bool, out: _Out):
        self.conv_id, self.turns, self.out = conv_id, turns, out
        self.spell, self.digest, self.place = _Spell(), _Digest(), 0

    def _put(self, turn: int | None, role: bytes, text: bytes, edit: int) -> Iterator[pa.RecordBatch]:
        if self.turns:
            row = {"conv_id": self.conv_id, "place": self.place, "turn": turn, "role": role.decode(), "text": text.decode(), "edit": chr(LETTERS[edit])}
            yield from self.out.add(len(role) + len(text), **row)
        else:
            self.digest.add(role, text)
        self.place += 1

    def row(self, byte: int, turn: int | None, role: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        for edit, name in self.spell.row(byte, role):
            if edit == INSERT:
                yield from self._put(None, name, b"", edit)
            elif name is not None:
                yield from self._put(turn, name, text, edit)

    def end(self, known: dict) -> Iterator[pa.RecordBatch]:
        for edit, name in self.spell.end():
            yield from self._put(None, name, b"", edit)
        if not self.turns:
            yield from self.out.add(len(self.spell.audit), conv_id=self.conv_id, **known, audit=self.spell.audit.decode(), repaired_sha256=self.digest.sum.hexdigest())


def _backward(held_bytes: int, chunk_rows: int, turns: bool):
    """Rows from the last to the first -> what is asked for each conversation; of a giant one its counts and chunks of edit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = _Out(_REPORT_TURNS if turns else _REPORT), None

        def chunk() -> Iterator[pa.RecordBatch]:
            turn, tie, nth = now.key
            yield from out.add(len(now.edits), conv_id=now.conv_id, turn=turn, tie=tie, nth=nth, edits=bytes(reversed(now.edits)))
            now.edits = bytearray()

        def close() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if now.giant:
                if now.edits:
                    yield from chunk()
                yield from out.add(0, conv_id=now.conv_id, **now.known(), giant=True)
                return
            finish = _Finish(now.conv_id, turns, out)
            for byte, row in zip(reversed(now.edits), reversed(now.rows)):
                yield from finish.row(byte, *row)
            yield from finish.end(now.known())

        for batch in chunks(batches):
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "nth", "tie", "dropped", "fault")]
            for conv_id, turn, nth, tie, dropped, fault, role, text in zip(*columns, raw(batch, "role"), raw(batch)):
                if now is None or conv_id != now.conv_id:
                    yield from close()
                    now = _Conversation(conv_id)
                if dropped:
                    continue
                now.read(turn, role, fault, (turn, tie, nth))
                if not now.giant:
                    now.rows.append((turn, role, text))
                    now.size += len(role) + len(text) + 128
                    if now.size > held_bytes:
                        now.giant, now.rows = True, []
                if now.giant and len(now.edits) >= chunk_rows:
                    yield from chunk()
        yield from close()
        yield from out.flush()

    return run


def _forward(turns: bool):
    """Chunks of edit bytes, each before its rows, and rows from the first to the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, edits = _Out(_REPORT_TURNS if turns else _REPORT), None, iter(())
        for batch in chunks(batches):
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "edits")]
            for conv_id, turn, chunk, role, text in zip(*columns, raw(batch, "role"), raw(batch)):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield from now.end({})
                    now = _Finish(conv_id, turns, out)
                if chunk is not None:
                    edits = iter(chunk)
                else:
                    yield from now.row(next(edits), turn, role, text)
        if now is not None:
            yield from now.end({})
        yield from out.flush()

    return run


def _marked(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with their place among equal ones and their fault."""
    order = [F.col("turn").asc_nulls_first(), F.col("tie")]
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce("dropped", F.lit(False)).alias("dropped") if "dropped" in rows.columns else F.lit(False).alias("dropped"),
        F.coalesce("tie", F.lit("").cast("binary")).alias("tie") if "tie" in rows.columns else F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("tie"),
    )
    name = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"name": F.when(~F.col("dropped"), name), "last": F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))})
    # Dealt once: the window and both sorts keep to the conversations.
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "name").orderBy(*order)).cast("long"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(GOOD)
    return rows.withColumn("fault", fault).drop("name", "last")


def _repaired(rows: DataFrame, turns: bool, held_bytes: int, chunk_rows: int) -> DataFrame:
    ddl = _REPORT_TURNS_DDL if turns else _REPORT_DDL
    marked = _marked(rows)
    falling = [F.col("turn").desc_nulls_last(), F.col("tie").desc(), F.col("nth").desc()]
    first = marked.sortWithinPartitions("conv_id", *falling).mapInArrow(_backward(held_bytes, chunk_rows, turns), ddl)
    first = materialise(first, "repair")
    done = first.where("giant is null and edits is null")
    giant = first.where("giant").select("conv_id", *_COUNTS)
    if giant.isEmpty():
        return done
    covered = first.where("edits is not null").select("conv_id", "turn", F.lit("").alias("role"), F.lit("").alias("text"), "tie", "nth", "edits")
    own = marked.where("not dropped").join(giant.select(F.col("conv_id").alias("id")), F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    both = covered.unionByName(own.select("conv_id", "turn", "role", "text", "tie", "nth", F.lit(None).cast("binary").alias("edits")))
    rising = [F.col("turn").asc_nulls_first(), "tie", "nth", F.col("edits").isNull()]
    second = both.repartition("conv_id").sortWithinPartitions("conv_id", *rising).mapInArrow(_forward(turns), ddl)
    if turns:
        return done.unionByName(second)
    heads = giant.withColumnRenamed("conv_id", "id")
    named = second.drop(*_COUNTS).join(heads, F.col("conv_id").eqNullSafe(F.col("id"))).select(done.columns)
    return done.unionByName(named)


def repair_report(rows: DataFrame, held_bytes: int = HELD_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn, nulls first, and at one turn by ``tie`` (a binary column;
    without it the SHA-256 of role and text). The first fault of a row counts: blank (only white
    space), duplicate (role and text stood before), truncated (ends in none of ``.!?``). gaps are the
    turn numbers missing between the least and the greatest, illegal the neighbours whose role
    initials are not su, ua or au. The cheapest edits (keep 0, rerole to user or assistant 3, delete 4,
    which blanks and duplicates need, insert an empty user or assistant turn 3; 3 more for a truncated
    row that stays) make the initials ``(s?(ua)+)?``; audit has their letters, the first by ASCII of
    equally cheap ones, and repaired_sha256 is of the ``role:text`` lines that are left.

    A null role or text is one space; an empty role has no initial, so keeping it changes no state.
    Rows with a null conv_id are one conversation. Rows marked in an optional boolean column
    ``dropped`` do not count, but name their conversation: with no other rows it has zeros, an empty
    audit and the hash of nothing. An empty table gives no rows. Other columns are ignored.
    """
    return _repaired(rows, False, held_bytes, chunk_rows).select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame, held_bytes: int = HELD_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), turn (null: inserted), role, text, edit (I, K or R).

    Rows, order and edits as in ``repair_report``; a conversation of which nothing is left has no row.
    """
    return _repaired(rows, True, held_bytes, chunk_rows).select(_TURNS)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops (marked in ``dropped``), 1 empties the text,
    2 takes ``.!?`` out of it, 3 repeats the row beside itself, 4 sets the role to user. Nulls become one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    tie = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), tie.alias("tie"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "tie",
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
