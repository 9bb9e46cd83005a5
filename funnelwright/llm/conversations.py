"""Structure of conversations repaired by the cheapest edits, found by iterative-deepening A*.

A conversation's rows, by turn (nulls first), should have roles whose initials read ``(s?(ua)+)?``:
a system row perhaps, then user and assistant in turn. Edits in ASCII order of their initials:

* ``D`` deletes a row (2); blank rows and repeats of an earlier role and text must go,
* ``I`` inserts an empty row of the user or assistant, whichever may stand there (5),
* ``K`` keeps a row (0), ``R`` gives it the role that may stand there (1); either costs 5 more for
  a truncated row, one whose last character other than white space is not ``.``, ``!`` or ``?``.

``search`` looks for the first accepting path in that order under a growing bound; a table holds for
every (row, state) that failed what it still needs at least. The first path found is the cheapest
and among those the ASCII-least.

No conversation is gathered: copies are folded to a count, rows are dealt to tasks by ranges of
(conversation, turn, role, text), and a task reads them in that order. A conversation of up to BLOCK
rows that lies within a task is searched as it passes. Longer ones, and those at a task's ends, are
cut into blocks; for each block the best audit between any two states is searched, and the blocks
are joined in order. Two audits of one block at one cost are never one the prefix of the other (only
inserts, at 5 each, could follow), so the least whole is made of least parts. Whole audits and
digests are single values of the result; those of a long conversation are made by one task that
reads its blocks in order, some states at a time.

Rows of one turn are ordered by role and text; nulls in any column count as one space, a null turn
stands first, and rows without a conversation form one of their own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from funnelwright.llm.common import cut_lineage

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of a block; characters of a block's rows, about.
BLOCK, BLOCK_CHARS = 64, 1 << 20
#: States: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Role that may be inserted or given in a state, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60


@dataclass(frozen=True)
class Row:
    """What the search needs of a row: role's initial, whether it must go or is truncated.

    ``copies`` rows that must go are one item: deletes before an insert are ASCII-less than after it.
    """

    initial: str
    must_go: bool = False
    truncated: bool = False
    copies: int = 1


def _steps(row: Row | None, state: int, after: int) -> list[tuple[str, int, int, int]]:
    """Edits in ASCII order: (initials, cost, next row, next state)."""
    role, following = NEXT[state]
    here = after - 1
    if row is None:
        return [("I", INSERT, here, following)]
    steps = [("D" * row.copies, DELETE * row.copies, after, state), ("I", INSERT, here, following)]
    if row.must_go:
        return steps
    extra = TRUNCATED if row.truncated else 0
    if row.initial == "s" and state == START:
        steps.append(("K", extra, after, SYSTEM))
    if row.initial == role[0]:
        steps.append(("K", extra, after, following))
    else:
        steps.append(("R", REROLE + extra, after, following))
    return steps


def floors(rows: Sequence[Row]) -> list[int]:
    """For each row the least that the rows from there on cost, whatever the state.

    What must go costs its deletes, a truncated row 2, a role of no use 1. Of two neighbours (but for
    rows that must go between them) that can't stand side by side, one must be edited or something be
    inserted: 1 for disjoint pairs.
    """
    low = [0] * (len(rows) + 1)
    one, two, later = 0, 0, None
    forced = 0
    for at in range(len(rows) - 1, -1, -1):
        row = rows[at]
        if row.must_go:
            forced += DELETE * row.copies
        else:
            own = DELETE if row.truncated else (REROLE if row.initial not in ("s", "u", "a") else 0)
            best = own + one
            if later is not None:
                wrong = row.initial + later[0] not in LEGAL
                best = max(best, max(own + later[1], 1 if wrong else 0) + two)
            one, two, later = best, one, (row.initial, own)
        low[at] = forced + one
    return low


def search(rows: Sequence[Row], state: int = START, goals: Sequence[int] = (START, ASSISTANT)) -> tuple[int, str] | None:
    """Cost and audit of the cheapest, ASCII-least edits from a state to one of the goals; None if there are none."""
    low, end = floors(rows), len(rows)
    needs: dict[tuple[int, int], int] = {}
    # Inserts reach the user and the assistant only, in turn.
    at_end = {}
    for s in range(4):
        costs = [INSERT * k for k, t in enumerate((s, NEXT[s][1], NEXT[NEXT[s][1]][1])) if t in goals]
        at_end[s] = min(costs, default=NEVER)

    # No way leads back to the start, and only one from there to the system row.
    shut = {s for s in range(4) if not any(g >= USER or g == s or (s, g) == (START, SYSTEM) for g in goals)}

    def need(at: int, s: int) -> int:
        known = needs.get((at, s))
        return known if known is not None else NEVER if s in shut else at_end[s] if at == end else low[at]

    def down(at: int, s: int, budget: int) -> list[str] | None:
        if at == end and s in goals:
            return []
        least = NEVER
        for initials, cost, after, following in _steps(rows[at] if at < end else None, s, at + 1):
            rest = need(after, following)
            if cost + rest <= budget:
                found = down(after, following, budget - cost)
                if found is not None:
                    found.append(initials)
                    return found
                rest = need(after, following)
            least = min(least, cost + rest)
        needs[at, s] = max(min(least, NEVER), needs.get((at, s), 0))
        return None

    bound = need(0, state)
    while bound < NEVER:
        path = down(0, state, bound)
        if path is not None:
            return bound, "".join(reversed(path))
        bound = need(0, state)
    return None


class Editor:
    """Applies an audit to lines that come in parts."""

    def __init__(self, audit: str, state: int = START) -> None:
        self.audit, self.at, self.state = audit, 0, state

    def inserts(self) -> Iterator[tuple[str, str]]:
        """Rows inserted at this place."""
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = NEXT[self.state]
            self.at += 1
            yield role, ""

    def apply(self, lines: Sequence[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
        """(role, text) of what is left of (role, text, copies)."""
        for own, text, copies in lines:
            for _ in range(copies):
                yield from self.inserts()
                edit = self.audit[self.at]
                self.at += 1
                if edit == "K" and self.state == START and own[:1] == "s":
                    self.state = SYSTEM
                    yield own, text
                elif edit != "D":
                    role, self.state = NEXT[self.state]
                    yield (own if edit == "K" else role), text


@dataclass
class Block:
    """Consecutive rows of a conversation, with what is counted on them."""

    rows: list[Row] = field(default_factory=list)
    lines: list[tuple[str, str, int]] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int, repeated: bool) -> None:
        """A row and its copies; ``repeated`` if an earlier turn has the same role and text."""
        own = min(copies, 1) if fault != 1 and not repeated else 0
        gone, initial = copies - own, role[:1]
        if own:
            self.rows.append(Row(initial, truncated=fault == 3))
            self.truncated += fault == 3
        if gone:
            self.rows.append(Row(initial, must_go=True, copies=gone))
        self.lines.append((role, text, copies))
        self.chars += len(role) + len(text)
        if fault == 1:
            self.blank += gone
        else:
            self.duplicate += gone
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.illegal += copies - 1 if initial + initial not in LEGAL else 0
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn


_COUNTS = "blank duplicate truncated illegal turns low high first last".split()
_SUMMARY = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FOUND = (
    _SUMMARY + ", part int, block long, turns long, low long, high long, first string, last string, "
    "moves array<struct<start:int,goal:int,cost:long,audit:string>>, lines array<struct<role:string,text:string,copies:long>>"
)
_LINES = "conv_id {kind}, part int, block long, lines array<struct<role:string,text:string>>"
SUMMARY = [c.split()[0] for c in _SUMMARY.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return high - low + 1 - turns if low is not None else 0


def _whole(conv, block: Block) -> dict:
    """The result for a conversation that is one block; its lines are those of the repaired one."""
    cost, audit = search(block.rows)
    editor = Editor(audit)
    left = [*editor.apply(block.lines), *editor.inserts()]
    return {
        "conv_id": conv, "gaps": _gaps(block.low, block.high, block.turns), **{c: getattr(block, c) for c in _COUNTS[:4]},
        "cost": cost, "audit": audit, "lines": [{"role": r, "text": t} for r, t in left],
    }


def _part(conv, block: Block, part: int, number: int) -> dict:
    """A block of a conversation: the best audits from each state to each."""
    moves = []
    for start in range(4):
        for goal in range(4):
            found = search(block.rows, start, (goal,))
            if found:
                moves.append({"start": start, "goal": goal, "cost": found[0], "audit": found[1]})
    lines = [{"role": r, "text": t, "copies": n} for r, t, n in block.lines]
    return {"conv_id": conv, "part": part, "block": number, "moves": moves, "lines": lines, **{c: getattr(block, c) for c in _COUNTS}}


def _searched(schema: pa.Schema):
    """Rows in order to whole results and, for long conversations and those at a task's ends, blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        size = 0
        conv, block, number, at_start, begun = None, Block(), 0, True, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ended = begun and row[0] != conv
                if ended or len(block.rows) >= BLOCK or block.chars >= BLOCK_CHARS:
                    # The first conversation of a task may have begun in the one before.
                    in_parts = at_start or number or not ended
                    held.append(_part(conv, block, part, number) if in_parts else _whole(conv, block))
                    size += block.chars
                    block, number, at_start = Block(), 0 if ended else number + 1, at_start and not ended
                conv, begun = row[0], True
                if row[4]:
                    block.add(*row[1:])
                if len(held) >= 1000 or size > 4 * BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if begun:
            yield pa.RecordBatch.from_pylist([*held, _part(conv, block, part, number)], schema)

    return of


class Joiner:
    """The blocks of one conversation joined in order; what all paths' audits share is put aside."""

    def __init__(self, conv) -> None:
        self.conv, self.paths, self.shared = conv, {START: (0, "")}, []
        self.counts = dict.fromkeys(_COUNTS[:5], 0) | dict.fromkeys(_COUNTS[5:])

    def add(self, block: dict) -> None:
        own = self.counts
        for name in _COUNTS[:5]:
            own[name] += block[name]
        if block["first"] is not None:
            own["illegal"] += own["last"] is not None and own["last"] + block["first"] not in LEGAL
            own["last"] = block["last"]
        if block["low"] is not None:
            own["turns"] -= block["low"] == own["high"]
            own["low"], own["high"] = block["low"] if own["low"] is None else own["low"], block["high"]
        best: dict[int, tuple[int, str]] = {}
        for move in block["moves"]:
            if move["start"] in self.paths:
                cost, audit = self.paths[move["start"]]
                way = cost + move["cost"], audit + move["audit"]
                best[move["goal"]] = min(best.get(move["goal"], way), way)
        shared = len(os.path.commonprefix([audit for _, audit in best.values()]))
        self.shared.append(next(iter(best.values()))[1][:shared])
        self.paths = {s: (cost, audit[shared:]) for s, (cost, audit) in best.items()}

    def row(self) -> dict:
        cost, audit = min(way for s, way in self.paths.items() if s in (START, ASSISTANT))
        gaps = _gaps(self.counts["low"], self.counts["high"], self.counts["turns"])
        audit = "".join(self.shared) + audit
        return {"conv_id": self.conv, "gaps": gaps, **{c: self.counts[c] for c in _COUNTS[:4]}, "cost": cost, "audit": audit}


def _joined(schema: pa.Schema):
    """Blocks in order to one row for each conversation."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = None
        for batch in batches:
            done = []
            for block in batch.to_pylist():
                if joiner is None or joiner.conv != block["conv_id"]:
                    done += [joiner.row()] if joiner else []
                    joiner = Joiner(block["conv_id"])
                joiner.add(block)
            yield pa.RecordBatch.from_pylist(done, schema)
        yield pa.RecordBatch.from_pylist([joiner.row()] if joiner else [], schema)

    return of


def _edited(schema: pa.Schema):
    """Blocks in order, each conversation's audit before them, to blocks of repaired lines."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, last = None, None
        for batch in batches:
            for block in batch.to_pylist():
                if block["audit"] is not None:
                    if editor:
                        yield rest(editor, last)
                    editor, last = Editor(block["audit"]), block
                    continue
                last = block
                left = editor.apply([(x["role"], x["text"], x["copies"]) for x in block["lines"]])
                yield lines(block, block["block"], left)
        if editor:
            yield rest(editor, last)

    def rest(editor: Editor, last: dict) -> pa.RecordBatch:
        return lines(last, last["block"] + 1, editor.inserts())

    def lines(block: dict, number: int, left: Iterator[tuple[str, str]]) -> pa.RecordBatch:
        own = [{"role": r, "text": t} for r, t in left]
        return pa.RecordBatch.from_pylist([{"conv_id": block["conv_id"], "part": block["part"], "block": number, "lines": own}], schema)

    return of


def _digested(schema: pa.Schema):
    """Blocks of lines in order to (conv_id, repaired_sha256)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, between = None, None, b""
        for batch in batches:
            for block in batch.to_pylist():
                if digest is None or conv != block["conv_id"]:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)
                    conv, digest, between = block["conv_id"], hashlib.sha256(), b""
                for line in block["lines"]:
                    digest.update(between + f"{line['role']}:{line['text']}".encode("utf-8", "replace"))
                    between = b"\n"
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)

    return of


@dataclass(frozen=True)
class Repaired:
    """Repaired conversations. ``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``short`` has the summary and ``lines`` (role, text) of conversations that fit in a row, ``long`` the
    summary of the others, and ``long_lines`` their lines by (part, block).
    """

    short: DataFrame
    long: DataFrame
    long_lines: DataFrame

    @property
    def summary(self) -> DataFrame:
        return self.short.select(*SUMMARY).unionByName(self.long)

    def digests(self) -> DataFrame:
        """The summary with ``repaired_sha256``, the digest of the lines ``role:text`` joined by newlines."""
        text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
        short = self.short.select(*SUMMARY, F.sha2(text, 256).alias("repaired_sha256"))
        kind = self.long.schema["conv_id"].dataType.simpleString()
        ddl = f"conv_id {kind}, repaired_sha256 string"
        ordered = self.long_lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
        digests = ordered.mapInArrow(_digested(_arrow(ddl)), ddl).withColumnRenamed("conv_id", "of")
        long = self.long.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select(*SUMMARY, "repaired_sha256")
        return short.unionByName(long)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) after the damage that the query prescribes.

    By ``crc32("conv_id:turn") % 20``: 0 drops the row (``copies`` 0), 1 empties its text, 2 takes its
    ``.``, ``!`` and ``?`` away, 3 repeats it, 4 makes it the user's.
    """
    spoken = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spoken("text"), "[.!?]", "")).otherwise(spoken("text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(spoken("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _fault() -> Column:
    """0 for a sound text, 1 blank, 3 truncated."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).cast("int")


def repair(rows: DataFrame) -> Repaired:
    """The conversations of ``rows`` (conv_id, turn, role, text, copies); ``copies`` is how often a row stands there.

    ``copies`` 0 names a conversation without giving it a row; one without rows has zeros, an empty
    audit and no lines.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    # Rows of no copies only name their conversation: without their text they fold to one.
    given = lambda name, none: F.when(F.col("copies") > 0, F.col(name)).otherwise(none).alias(name)
    named = rows.select("conv_id", given("turn", F.lit(None)), given("role", F.lit("")), given("text", F.lit("")), "copies")
    folded = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # What is said in several turns of a conversation, and the first of them (null turns come first).
    said = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("said")
    turns = named.where("copies > 0").groupBy(F.col("conv_id").alias("of"), said).agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.count("turn") < F.count("*")).alias("untimed")
    )
    several = turns.where("first_turn < last_turn or (untimed and first_turn is not null)").select(
        "of", F.col("said").alias("same"), F.expr("if(untimed, null, first_turn)").alias("first_turn")
    )
    met = folded.select("*", said).join(several, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("same")), "left")
    repeated = F.col("same").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    order = ("conv_id", "turn", "role", "text")
    marked = met.select(*order, "copies", _fault().alias("fault"), repeated.alias("repeated"))
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = _FOUND.format(kind=kind)
    found = cut_lineage(ordered.mapInArrow(_searched(_arrow(ddl)), ddl))
    blocks = found.where("audit is null")
    ddl = _SUMMARY.format(kind=kind)
    counted = blocks.select("conv_id", "part", "block", *_COUNTS, "moves").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    long = cut_lineage(counted.mapInArrow(_joined(_arrow(ddl)), ddl))
    audits = long.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("block"), "audit", F.lit(None).cast(found.schema["lines"].dataType).alias("lines"))
    both = audits.union(blocks.select("conv_id", "part", "block", "audit", "lines"))
    ddl = _LINES.format(kind=kind)
    edited = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_edited(_arrow(ddl)), ddl)
    return Repaired(found.where("audit is not null").select(*SUMMARY, "lines"), long, edited)
