"""Repair of conversation structure by a Viterbi search over edits.

A conversation shall read ``(system? (user assistant)+)?``. Rows are kept (0),
given another role (3) or deleted (4, a must for blank and repeated ones), empty
turns are inserted (3), and a truncated row that stays adds 3. The cheapest edits
win; of equally cheap ones, those whose initials D, I, K, R read ASCII-least.

After each row four states may survive: nothing written, a system turn, a user
turn, an assistant turn. Each is the tip of a path in a tree of back-pointers.
Nodes count their references, so paths that no survivor uses go at once, and as
soon as all survivors share an ancestor, the edits up to it are emitted and
their rows forgotten. What is held is the stretch that is really undecided. A
survivor that another one beats whatever follows (``_EXTRA``) is dropped, else the
path that deletes everything would hold on to the start for ever.

Survivors have consumed the same rows and their paths end with a row's edit, so
no path is a prefix of another, and the order of two whole undecided paths never
changes when both grow. That order is carried on as a rank: ties are broken
by complete paths, at the cost of comparing one step.

A conversation's audit and digest are one value over all its rows, so one task
streams them in order; it holds neither the rows nor the texts of a whole one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.llm.common import text_parts

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8_000_000
OUT_ROWS = 4096
#: Turns inserted before a row, by state: how many, and the state they lead to.
_INSERTED = {START: ((0, START), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)), USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
#: Turns inserted at the end.
_CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: _EXTRA[y][x]: what it costs at most to go on from y as x would. Keeping a later
#: system row is open to START alone; the others delete it.
_EXTRA = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: max(DELETE, 2 * INSERT), USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}


def _next(state: int) -> int:
    """The state after one more user or assistant turn."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    return _next(state) if initial == ("a" if state == USER else "u") else None


@lru_cache(maxsize=64)
def _moves(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, str, int], ...]:
    """(from, to, letters, cost) of everything that can be done at a row."""
    out = []
    for state, inserted in _INSERTED.items():
        for n, at in inserted:
            letters, cost = "I" * n, INSERT * n
            out.append((state, at, letters + "D", cost + DELETE))
            if not must_go:
                stay = cost + (TRUNCATED if truncated else 0)
                if (to := _kept(at, initial)) is not None:
                    out.append((state, to, letters + "K", stay))
                out.append((state, _next(at), letters + "R", stay + REROLE))
    return tuple(out)


class _Node:
    __slots__ = ("parent", "letters", "row", "heirs", "refs")

    def __init__(self, parent: _Node | None, letters: str, row: tuple[str, str] | None):
        self.parent, self.letters, self.row = parent, letters, row
        self.heirs: list[_Node] = []
        self.refs = 0  # heirs, and one if it is a survivor's tip
        if parent is not None:
            parent.heirs.append(self)
            parent.refs += 1


class Repair:
    """One conversation: rows go in by ``row``, edits (initial, role, text) come out there and by ``end``."""

    def __init__(self) -> None:
        self._root = _Node(None, "", None)
        self._root.refs = 1
        self._survivors: dict[int, tuple[int, int, _Node]] = {START: (0, 0, self._root)}  # cost, rank, tip
        self._state = START  # of what has been emitted
        self.cost = 0

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> Iterator[tuple[str, str | None, str | None]]:
        initial = role[:1]
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, to, letters, cost in _moves(initial if initial in ("s", "u", "a") else "", must_go, truncated):
            if state in self._survivors:
                before, rank, _ = self._survivors[state]
                found = (before + cost, rank, letters, state)
                if to not in best or found < best[to]:
                    best[to] = found
        kept = {x: b for x, b in best.items() if all(b[0] <= best[y][0] + _EXTRA[y][x] for y in best if y != x)}
        order = sorted(kept, key=lambda x: kept[x][1:3])
        old, row = self._survivors, (role, text)
        self._survivors = {}
        for rank, x in enumerate(order):
            cost, _, letters, state = kept[x]
            tip = _Node(old[state][2], letters, row)
            tip.refs += 1
            self._survivors[x] = (cost, rank, tip)
        for _, _, tip in old.values():
            self._release(tip)
        yield from self._resolved()

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            parent = node.parent
            parent.heirs.remove(node)
            parent.refs -= 1
            node = parent

    def _resolved(self) -> Iterator[tuple[str, str | None, str | None]]:
        """Edits up to the last ancestor that all survivors share."""
        while self._root.refs == 1 and self._root.heirs:
            heir = self._root.heirs[0]
            heir.parent = None
            self._root = heir
            yield from self._applied(heir.letters, heir.row)

    def _applied(self, letters: str, row: tuple[str, str] | None) -> Iterator[tuple[str, str | None, str | None]]:
        for letter in letters:
            if letter == "D":
                yield letter, None, None
                continue
            if letter == "K":
                self._state = _kept(self._state, row[0][:1])
                yield letter, row[0], row[1]
                continue
            self._state = _next(self._state)
            yield letter, "user" if self._state == USER else "assistant", "" if letter == "I" else row[1]

    def undecided(self) -> int:
        """How many nodes are held."""
        todo, n = [self._root], 0
        while todo:
            node = todo.pop()
            todo += node.heirs
            n += 1
        return n

    def end(self) -> Iterator[tuple[str, str | None, str | None]]:
        self.cost, _, closing, tip = min((cost + INSERT * _CLOSING[x], rank, "I" * _CLOSING[x], tip) for x, (cost, rank, tip) in self._survivors.items())
        path = []
        while tip is not self._root:
            path.append(tip)
            tip = tip.parent
        for node in reversed(path):
            yield from self._applied(node.letters, node.row)
        yield from self._applied(closing, None)


class _Report:
    """Counts of one conversation's rows, and the audit and digest of its edits."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = None
        self.turns = 0
        self._before: str | None = None
        self.audit: list[str] = []
        self._digest = hashlib.sha256()
        self._written = False

    def row(self, turn: int | None, role: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.high:  # in order, so equal turns follow each other
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self._before is not None and self._before + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self._before = role[:1]

    def edit(self, letter: str, role: str | None, text: str | None) -> None:
        self.audit.append(letter)
        if letter != "D":
            self._digest.update((("\n" if self._written else "") + f"{role}:{text}").encode())
            self._written = True

    def values(self, cost: int) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.counts.values(), cost, "".join(self.audit), self._digest.hexdigest()


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, edit string, role string, text string"
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _faulted(rows: DataFrame) -> DataFrame:
    """Each row's first fault, rows in order, a conversation in one partition."""
    end = F.substring(F.rtrim(F.col("_text"), F.lit(SPACES)), -1, 1)
    rows = rows.withColumn("_end", end).repartition("_conv")
    again = Window.partitionBy("_conv", "_gone", "_role", "_text").orderBy(F.col("_turn").asc_nulls_first())
    fault = (
        F.when(F.col("_gone"), None)
        .when(F.col("_end") == "", "blank")
        .when(F.col("_nth") > 1, "duplicate")
        .when(~F.col("_end").isin(".", "!", "?"), "truncated")
    )
    # of rows that are equal in everything, those that repeat the first come after it
    return (
        rows.withColumn("_nth", F.row_number().over(again))
        .withColumn("_fault", fault)
        .drop("_end")
        .sortWithinPartitions("_conv", F.col("_turn").asc_nulls_first(), "_role", "_text", "_nth")
        .select("_conv", "_turn", "_role", "_text", "_gone", "_fault")
    )


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in text_parts(batch, "_text", BATCH_BYTES):
            yield from zip(*(c.to_pylist() for c in part.columns))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Repair, _Report, list]]:
    """(conversation, repair, report, edits): edits as they are decided, last of all with the report closed (repair None before)."""
    conv = repair = report = None
    for name, turn, role, text, gone, fault in _rows_of(batches):
        if repair is None or name != conv:
            if repair is not None:
                yield conv, repair, report, list(repair.end())
            conv, repair, report = name, Repair(), _Report()
        if gone:
            continue
        report.row(turn, role, fault)
        yield conv, None, report, list(repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    if repair is not None:
        yield conv, repair, report, list(repair.end())


def _written(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == OUT_ROWS or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), types)], names=names)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for conv, repair, report, edits in _streamed(batches):
        for edit in edits:
            report.edit(*edit)
        if repair is not None:
            yield conv, *report.values(repair.cost)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    place = 0
    for conv, repair, _, edits in _streamed(batches):
        for letter, role, text in edits:
            yield conv, place, letter, role, text
            place += 1
        if repair is not None:
            place = 0


def _mapped(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    fields = [f.split() for f in schema.split(", ")]
    names = ["conv_id", *(f[0] for f in fields)]
    types = [_ARROW[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _written(make(itertools.chain([first], batches)), names, [first.schema.field("_conv").type, *types])

    kind = rows.schema["_conv"].dataType.simpleString()
    return _faulted(rows).mapInArrow(run, f"conv_id {kind}, {schema}")


def _named(rows: DataFrame, gone_col: str | None) -> DataFrame:
    gone = F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    return rows.select(
        F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("_role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("_text"), gone.alias("_gone"),
    )


def repair_report(rows: DataFrame, gone_col: str | None = None) -> DataFrame:
    """One row per conversation: faults counted, the edits' cost and initials, and the digest of what they give.

    ``rows`` has conv_id, turn, role and text; other columns are let go. Rows are
    taken by turn, nulls first, equal turns by role and text. A null role or text
    is one space. A null conv_id is a conversation like any other. Rows whose
    ``gone_col`` is true count for nothing but their conversation's being there;
    one without other rows has zeros, an empty audit and the digest of nothing.
    Only exact repetitions of role and text are duplicates. An empty table gives
    an empty result.
    """
    return _mapped(_named(rows, gone_col), _reports, _REPORT)


def repaired_turns(rows: DataFrame, gone_col: str | None = None) -> DataFrame:
    """The edits themselves: conv_id, place (from 0), edit (D, I, K or R), role and text (null for D)."""
    return _mapped(_named(rows, gone_col), _turns, _TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with one fault in twenty of each kind, by CRC-32 of ``conv_id:turn`` (nulls: one space).

    0 marks a row as gone, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    hit = F.crc32(key) % 20
    return rows.select(
        "conv_id", "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (hit == 0).alias("gone"), F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
