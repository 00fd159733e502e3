"""Conversation structure repair: cheapest edits to a legal order of roles, by branch and bound."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: A prefix that ends in a user's or an assistant's turn does for this much more whatever any other prefix can do.
SWITCH = COST[INSERT] + COST[DELETE]
LEGAL_PAIRS = {"su", "ua", "au"}

# What the repaired part so far ends in: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_GOALS = (START, ASSISTANT)
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
          (ASSISTANT, "u"): USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows searched at once; a longer conversation is searched piece by piece, from each state to each.
SEGMENT = 64

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


@dataclass(slots=True)
class Turn:
    """A row as the search sees it: role and text, whether it must go, whether it is cut off."""

    role: str
    text: str
    doomed: bool
    truncated: bool


@dataclass(slots=True)
class Prefix:
    """The best repair so far that ends in one state; ``audit`` leaves out what all such repairs share."""

    cost: int
    audit: str
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True


def _moves(state: int, turn: Turn | None) -> Iterator[tuple[str, int, int, int]]:
    """Edits that are open in a state, as (letter, cost, next state, rows used), in the order of their letters."""
    if turn is not None:
        yield DELETE, COST[DELETE], state, 1
    follow = ASSISTANT if state == USER else USER
    yield INSERT, COST[INSERT], follow, 0
    if turn is not None and not turn.doomed:
        more = TRUNCATED_COST * turn.truncated
        kept = _AFTER.get((state, turn.role[:1]))
        if kept is not None:
            yield KEEP, COST[KEEP] + more, kept, 1
        if kept != follow:  # keeping does the same for less
            yield REROLE, COST[REROLE] + more, follow, 1


def _suffix_bounds(turns: list[Turn]) -> list[int]:
    """What the rows from each place on cost at least, whatever their order."""
    bounds = [0] * (len(turns) + 1)
    for i in range(len(turns) - 1, -1, -1):
        turn = turns[i]
        least = COST[DELETE] if turn.doomed else min(COST[DELETE], TRUNCATED_COST * turn.truncated)
        bounds[i] = bounds[i + 1] + least
    return bounds


def _dive(turns: list[Turn], state: int, goals: tuple[int, ...]) -> tuple[int, str, int]:
    """A first solution: the cheapest edit at each row, then insertions up to a goal."""
    cost, audit = 0, []
    for turn in turns:
        letter, spent, state, _ = min((m for m in _moves(state, turn) if m[3]), key=lambda m: (m[1], m[0]))
        cost += spent
        audit.append(letter)
    while state not in goals:
        letter, spent, state, _ = next(m for m in _moves(state, None))
        cost += spent
        audit.append(letter)
    return cost, "".join(audit), state


def search(turns: list[Turn], entries: dict[int, tuple[int, str]], final: bool) -> dict[int, tuple[int, str, int]]:
    """The cheapest edits of a run of rows by depth-first branch and bound.

    ``entries`` gives the (cost, audit) already spent to enter in a state. The
    result holds (cost, audit, entry state) of the best repair, ties to the
    smaller audit: a single one, under its end state, if the run is ``final``,
    else one per state worth ending in. A branch is left if its cost and the
    bound of the remaining rows exceed the incumbent (by more than any change
    of state costs, if the run is not the last), or if its node (row, state)
    was reached by a prefix that is no worse. Letters are tried in their
    order, so of equal costs the smaller audit comes first.
    """
    n, bounds = len(turns), _suffix_bounds(turns)
    best: dict[int, tuple[int, str, int]] = {}

    def offer(cost: int, audit: str, state: int, entry: int) -> None:
        slot = ASSISTANT if final else state
        if slot not in best or (cost, audit) < best[slot][:2]:
            best[slot] = (cost, audit, entry)

    for entry, (cost, audit) in entries.items():
        for goals in [_GOALS] if final else [(USER,), (ASSISTANT,)]:
            more, letters, end = _dive(turns, entry, goals)
            offer(cost + more, audit + letters, end, entry)
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, cost, audit, entry) for entry, (cost, audit) in sorted(
        entries.items(), key=lambda e: e[1], reverse=True)]
    while stack:
        i, state, cost, audit, entry = stack.pop()
        known = seen.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        limit = best[ASSISTANT][0] if final else min(best[USER][0], best[ASSISTANT][0]) + SWITCH
        if cost + bounds[i] > limit:
            continue
        seen[i, state] = (cost, audit)
        if i == n and (not final or state in _GOALS):
            offer(cost, audit, state, entry)
        turn = turns[i] if i < n else None
        for letter, spent, after, used in reversed(list(_moves(state, turn))):
            stack.append((i + used, after, cost + spent, audit + letter, entry))
    return best


def _replay(turns: list[Turn], letters: str, state: int, digest, empty: bool):
    """Feed the repaired rows of a run to a digest; returns it and whether nothing was fed yet."""
    rows = iter(turns)
    for letter in letters:
        turn = None if letter == INSERT else next(rows)
        if letter == DELETE:
            continue
        if letter == KEEP:
            state, role, text = _AFTER[state, turn.role[:1]], turn.role, turn.text
        else:
            state = ASSISTANT if state == USER else USER
            role, text = _ROLE[state], "" if turn is None else turn.text
        digest.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
        empty = False
    return digest, empty


def _advance(turns: list[Turn], fronts: dict[int, Prefix], final: bool) -> dict[int, Prefix]:
    """Best prefixes after a run of rows, from the best ones before it."""
    found = search(turns, {s: (p.cost, p.audit) for s, p in fronts.items()}, final)
    after = {}
    for state, (cost, audit, entry) in found.items():
        before = fronts[entry]
        digest, empty = _replay(turns, audit[len(before.audit):], entry, before.digest.copy(), before.empty)
        after[state] = Prefix(cost, audit, digest, empty)
    return after


class Conversation:
    """Counts and best repairs of one conversation, fed row by row; holds one segment of rows."""

    def __init__(self, conv_id: int | None, segment: int = SEGMENT) -> None:
        self.conv_id, self.segment = conv_id, segment
        self.rows: list[Turn] = []
        self.fronts, self.settled = {START: Prefix(0, "")}, []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault is not None:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = role[:1]
        if len(self.rows) == self.segment:
            self.fronts = _advance(self.rows, self.fronts, False)
            self.rows = []
            common = os.path.commonprefix([p.audit for p in self.fronts.values()])
            self.settled.append(common)
            for prefix in self.fronts.values():
                prefix.audit = prefix.audit[len(common):]
        self.rows.append(Turn(role, text, fault in ("blank", "duplicate"), fault == "truncated"))

    def result(self) -> dict:
        (best,) = _advance(self.rows, self.fronts, True).values()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": best.cost,
                "audit": "".join(self.settled) + best.audit, "repaired_sha256": best.digest.hexdigest()}


def _or_space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with the damage that ``crc32(conv_id:turn) % 20`` deals them.

    0 drops a row (it stays here with ``dropped`` set, so that its conversation
    is still named), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it,
    4 makes it a user's. A null counts as one space, in the key too.
    """
    source = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         _or_space("role").alias("role"), _or_space("text").alias("text"),
                         F.pmod(F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn"))),
                                F.lit(20)).alias("damage"))
    kind = F.col("damage")
    text = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate(F.col("text"), ".!?", "")).otherwise(
        F.col("text"))
    return source.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"), (kind == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair(rows: DataFrame, partitions: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``rows`` (as ``damaged`` returns them).

    One row per conv_id, null ids as one conversation: gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256. Rows count in the order
    of turn (nulls first), then role and text, so rows that share a turn have a
    defined order. A row's first fault counts: blank, a repeat of an earlier
    row's role and text, cut off. Empty input gives no row; other columns are
    ignored.

    One exchange by conv_id serves both sorts: one finds repeats, the other
    puts turns in order. A task then holds one segment of a conversation and a
    best prefix per state, each with its running digest, however long the
    conversation is. (Its digest is sequential, so one task must read it.)
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ended = F.rtrim(F.col("text"), F.lit(_SPACE))
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartition(n, "conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "hash", "text").orderBy("turn"))
    marked = dealt.withColumn("earlier", earlier).select(
        "conv_id", "turn", "role", "text", "dropped", F.when(F.col("dropped"), None).when(ended == "", "blank").when(
            F.col("earlier") > 1, "duplicate").when(
            ~F.substring(ended, -1, 1).isin(".", "!", "?"), "truncated").alias("fault"))
    ordered = marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
                                          "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def solve(batches):
        now, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                        if len(done) == 1000:
                            yield pa.RecordBatch.from_pylist(done, schema=schema)
                            done = []
                    now = Conversation(conv_id, segment)
                if not dropped:
                    now.add(turn, role, text, fault)
        if now is not None:
            done.append(now.result())
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return ordered.mapInArrow(solve, RESULT)
