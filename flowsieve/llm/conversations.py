"""Repair of conversations to a role grammar by generalised LR parsing with weighted edits.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. The grammar's LR(0) states are built from its rules. The stacks that are still possible form
a graph: a stack is a state on top of the stack below it, stacks that share what lies below share those nodes, and equal tops (same state on the same node) are one
node with the least (cost, audit). Each row moves every top by one of its edits: keep (shift its role), rerole (shift user or assistant), delete (no shift), and between rows insert
a user or assistant. Reductions follow a shift at once.

What a row does to a set of stacks depends only on the row's code (role initial and fault) and on the stacks' costs and audit order relative to each other. Both take few
values, so such a step is worked out once and remembered; for a row there remains the number of its step (for the audit), and one running SHA-256 per stack. A
conversation of any length is therefore read as a stream: nothing of its texts is kept.

Order of audits: the audits of stacks after the same number of rows never continue one another when both end in an edit of a row, so comparing the ranks of
two stacks, then what they add, compares the whole audits.

Spark's part: rows are damaged and judged by expressions; one shuffle by conversation serves the search for repeats (a window), the order of rows (a sort that may
spill) and the parser. A conversation is one stream in one task, because its result holds a hash over all its rows in order; a conversation of a third of the
table therefore takes one task that long, in bounded memory (four bytes a row).

Rules: a null id, role, text or turn reads as one space where text is asked for; a null turn sorts first and is in no gap; all rows with a null id are one conversation.
Rows of one turn go by role and text, equal ones are repeats. An empty role has no initial: it fits no state and no pair. Very long texts are hashed as they come.
An empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import table

# (s?(ua)+)? as rules; the first symbol of all is "C".
GRAMMAR = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a")))
START = "C"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
# The cheapest stack can follow any other one's future by an insertion and a deletion, or two insertions, at most: a stack dearer by more cannot win, nor tie.
SLACK = INSERT + DELETE + 1
INK = r"[^\x20\x09-\x0D]"
OPEN_END = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
SCHEMA = "conv_id bigint, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ORDER = ["turn", "role", "text", "copy"]


# ---- the grammar's automaton ---------------------------------------------------------------------------------------

class Automaton:
    """LR(0) item sets of a grammar. ``shift(state, symbol)`` is the next state or None; ``ready(state)`` the rule to reduce by, if the state holds a whole one."""

    def __init__(self, grammar: tuple, start: str):
        self.grammar, self.start = grammar, start
        self.parts = {left for left, _ in grammar}
        self.states: list[frozenset] = [self._closed({(k, 0) for k, (left, _) in enumerate(grammar) if left == start})]
        self.moves: dict[tuple[int, str], int] = {}
        number = {self.states[0]: 0}
        for at, state in enumerate(self.states):  # grows while it is read
            for symbol in sorted({grammar[k][1][dot] for k, dot in state if dot < len(grammar[k][1])}):
                moved = self._closed({(k, dot + 1) for k, dot in state if dot < len(grammar[k][1]) and grammar[k][1][dot] == symbol})
                if moved not in number:
                    number[moved] = len(self.states)
                    self.states.append(moved)
                self.moves[at, symbol] = number[moved]

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            k, dot = todo.pop()
            right = self.grammar[k][1]
            if dot < len(right) and right[dot] in self.parts:
                new = {(j, 0) for j, (left, _) in enumerate(self.grammar) if left == right[dot]} - items
                items |= new
                todo += new
        return frozenset(items)

    def shift(self, state: int, symbol: str) -> int | None:
        return self.moves.get((state, symbol))

    def ready(self, state: int) -> list[tuple[str, int]]:
        """Whole rules of a state other than the start symbol's: those wait for the end of the conversation."""
        return [(left, len(right)) for left, right in (self.grammar[k] for k, dot in self.states[state] if dot == len(self.grammar[k][1])) if left != self.start]

    def accepts(self, state: int) -> bool:
        return any(self.grammar[k][0] == self.start and dot == len(self.grammar[k][1]) for k, dot in self.states[state])


class Node:
    """A state on top of the node below. ``Stacks`` makes each only once, so equal stacks are the same object."""

    __slots__ = ("state", "below", "number")

    def __init__(self, state: int, below: Node | None, number: int):
        self.state, self.below, self.number = state, below, number


class Stacks:
    """The graph of stacks seen so far."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.made, self.nodes = automaton, {}, []
        self.root = self.node(0, None)

    def node(self, state: int, below: Node | None) -> Node:
        key = (state, below)
        if key not in self.made:
            self.made[key] = Node(state, below, len(self.nodes))
            self.nodes.append(self.made[key])
        return self.made[key]

    def push(self, top: Node, symbol: str) -> Node | None:
        """The stack after a shift and all reductions it allows; None where the symbol does not fit."""
        state = self.automaton.shift(top.state, symbol)
        if state is None:
            return None
        top = self.node(state, top)
        while rules := self.automaton.ready(top.state):
            (left, size), = rules
            for _ in range(size):
                top = top.below
            top = self.node(self.automaton.shift(top.state, left), top)
        return top

    def accepts(self, top: Node) -> bool:
        return self.automaton.accepts(top.state)


STACKS = Stacks(Automaton(GRAMMAR, START))


# ---- one row's step ------------------------------------------------------------------------------------------------
# A frontier is a sorted tuple of (node number, cost above the least, rank of its audit).

def _closure(frontier: tuple) -> list[tuple[int, int, int, str]]:
    """(node, cost, place in the frontier, inserted roles): every way to insert roles before the next row. A stack comes once per origin."""
    out = []
    for place, (number, cost, _) in enumerate(frontier):
        seen, todo = {number}, [(number, cost, "")]
        for number, cost, added in todo:  # grows while it is read; in order of cost
            out.append((number, cost, place, added))
            for symbol in NAMES:
                top = STACKS.push(STACKS.nodes[number], symbol)
                if top is not None and top.number not in seen:
                    seen.add(top.number)
                    todo.append((top.number, cost + INSERT, added + symbol))
    return out


@cache
def step(frontier: tuple, initial: str, fault: str) -> tuple[int, tuple, tuple]:
    """(least cost, next frontier, moves). A move per stack of the next frontier: (place it comes from, inserted roles, edit, role it gets or "")."""
    best: dict[int, tuple] = {}

    def offer(top: Node | None, cost: int, place: int, added: str, edit: str, role: str) -> None:
        if top is None:
            return
        key = (cost, frontier[place][2], "I" * len(added) + edit)
        if top.number not in best or key < best[top.number][0]:
            best[top.number] = (key, (place, added, edit, role))

    spared = fault not in ("blank", "duplicate")
    extra = TRUNCATED if fault == "truncated" else 0
    for number, cost, place, added in _closure(frontier):
        top = STACKS.nodes[number]
        offer(top, cost + DELETE, place, added, "D", "")
        if spared:
            if initial in ("s", "u", "a"):
                offer(STACKS.push(top, initial), cost + extra, place, added, "K", "")
            for symbol, name in NAMES.items():
                offer(STACKS.push(top, symbol), cost + REROLE + extra, place, added, "R", name)
    least = min(key[0] for key, _ in best.values())
    best = {number: found for number, found in best.items() if found[0][0] <= least + SLACK}
    ranks = {text: r for r, text in enumerate(sorted({key[1:] for key, _ in best.values()}))}
    numbers = sorted(best)
    after = tuple((k, best[k][0][0] - least, ranks[best[k][0][1:]]) for k in numbers)
    return least, after, tuple(best[k][1] for k in numbers)


@cache
def finish(frontier: tuple) -> tuple[int, int, str]:
    """(cost, place, inserted roles) of the cheapest accepted end."""
    ends = [(cost, frontier[place][2], "I" * len(added), place, added) for number, cost, place, added in _closure(frontier) if STACKS.accepts(STACKS.nodes[number])]
    cost, _, _, place, added = min(ends)
    return cost, place, added


START_FRONTIER = ((STACKS.root.number, 0, 0),)


class Parse:
    """One conversation, read row by row."""

    _steps: list[tuple] = []
    _number: dict[tuple, int] = {}

    def __init__(self) -> None:
        self.cost, self.frontier, self.trail = 0, START_FRONTIER, array("i")
        self.hashes = [(hashlib.sha256(), True)]

    def row(self, role: str, text: str, fault: str) -> None:
        key = (self.frontier, role[:1] if role[:1] in ("s", "u", "a") else "", fault)
        if key not in self._number:
            self._number[key] = len(self._steps)
            self._steps.append(step(*key))
        number = self._number[key]
        least, self.frontier, moves = self._steps[number]
        self.cost += least
        self.trail.append(number)
        own, body, hashes = role.encode(errors="surrogatepass"), text.encode(errors="surrogatepass"), []
        for place, added, edit, new in moves:
            digest, empty = self.hashes[place]
            digest = digest.copy()
            for symbol in added:
                empty = _line(digest, empty, NAMES[symbol].encode(), b"")
            if edit != "D":
                empty = _line(digest, empty, new.encode() if new else own, body)
            hashes.append((digest, empty))
        self.hashes = hashes

    def close(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired conversation)."""
        cost, place, added = finish(self.frontier)
        digest, empty = self.hashes[place]
        for symbol in added:
            empty = _line(digest, empty, NAMES[symbol].encode(), b"")
        parts = ["I" * len(added)]
        for number in reversed(self.trail):
            place, added, edit, _ = self._steps[number][2][place]
            parts.append("I" * len(added) + edit)
        return self.cost + cost, "".join(reversed(parts)), digest.hexdigest()


def _line(digest, empty: bool, role: bytes, text: bytes) -> bool:
    if not empty:
        digest.update(b"\n")
    digest.update(role)
    digest.update(b":")
    digest.update(text)
    return False


# ---- the table -----------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, kept) after the planned damage. A dropped row stays as a bare sign of its conversation, not ``kept``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(word("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (kind != 0).alias("kept"))


def judged(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: a row's first one of blank, duplicate, truncated. One shuffle, by conversation; rows of a task are in order of conversation and turn."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "copy")])
    fault: Column = (
        F.when(~F.col("text").rlike(INK), "blank").when(F.row_number().over(same) > 1, "duplicate").when(F.col("text").rlike(OPEN_END), "truncated").otherwise("")
    )
    dealt = rows.repartition("conv_id").withColumn("fault", fault)
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ORDER])


class Tally:
    """Counts of one conversation beside its parse."""

    def __init__(self, conv_id):
        self.conv_id, self.parse = conv_id, Parse()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys(FAULTS, 0)

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.faults[fault] += 1
        self.parse.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *[self.faults[f] for f in FAULTS[1:]], self.illegal, *self.parse.close())


def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done: list[tuple] = []
    kind, now = None, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, turn, role, text, fault, kept in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "kept")]):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Tally(conv_id)
            if kept:
                now.add(turn, role, text, fault)
        if len(done) > 4096:
            yield _batch(done, names, kind)
            done = []
    if now is not None:
        done.append(now.result())
        yield _batch(done, names, kind)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copy, kept); a conversation without ``kept`` rows is empty."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}," + SCHEMA.split(",", 1)[1]
    return judged(rows).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "fault", "kept").mapInArrow(parsed, schema)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damaged(table(spark, folder, "conversations")))
