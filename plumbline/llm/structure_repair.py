"""Cheapest repair of conversations whose roles do not alternate, streamed one turn at a time.

Rows are dealt by conversation and sorted by turn; the stream of a partition carries the state of the conversation it
is in across Arrow batches. Of every turn the state keeps one byte (role and fault); role and text go to a spool that
moves to the task's own temporary file when a conversation is large. At the end of a conversation the edit costs are
computed backwards over those bytes, which leaves one byte of back pointers a turn, also spooled, and the edits are
then read off forwards while the spooled turns pass by once more. Memory is bounded by the spools, not by the length
of a conversation; the audit, one letter an edit, is the only thing that grows with it. A lost task begins anew.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a conversation's turns, and of its flags and back pointers, that stay in memory.
SPOOL_TURNS = 8 << 20
SPOOL_FLAGS = 1 << 20
BLOCK = 1 << 18
#: Repaired turns handed on at once.
OUT_ROWS = 1000

DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: What has been given so far: nothing, a system turn, ... a user turn, ... an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a further user or assistant turn, and the role of that turn.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Costs of the end: an assistant turn or nothing may end a conversation.
END = (0, 2 * INSERT, INSERT, 0)
#: Edits in ASCII order, so that the first of equally cheap ones is the least.
EDITS = "DIKR"
_HEAD = struct.Struct("<II")
_INITIALS = {"s": 1, "u": 2, "a": 3}


def keep(state: int, initial: int) -> int | None:
    """The state after a kept turn of that initial; None where the roles would not alternate."""
    if initial == 1:
        return SYSTEM if state == EMPTY else None
    if initial == 2:
        return USER if state != USER else None
    return ASSISTANT if initial == 3 and state == USER else None


def step(after: tuple[int, ...], flag: int) -> tuple[tuple[int, ...], int]:
    """Costs from before a turn to the end, by state, and the best edits (two bits a state)."""
    initial, gone, extra = flag & 3, flag & 4, CUT_OFF * (flag >> 3)
    options = []
    for state in range(4):
        costs = {"D": DELETE + after[state]}
        if not gone:
            kept = keep(state, initial)
            if kept is not None:
                costs["K"] = extra + after[kept]
            costs["R"] = REROLE + extra + after[NEXT[state]]
        options.append(costs)
    own = [min(costs.values()) for costs in options]
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    before = (min(own[EMPTY], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant)
    best = 0
    for state, costs in enumerate(options):
        costs["I"] = INSERT + before[NEXT[state]]
        best |= next(k for k, e in enumerate(EDITS) if costs.get(e) == before[state]) << (2 * state)
    return before, best


class Steps(dict):
    """Steps by (costs less their minimum, flag): few differ, so a turn costs one look-up."""

    def __missing__(self, key: tuple[tuple[int, ...], int]) -> tuple[tuple[int, ...], int, int]:
        before, best = step(*key)
        low = min(before)
        self[key] = out = (tuple(x - low for x in before), low, best)
        return out


_STEPS = Steps()


def backwards(spool, size: int) -> Iterator[bytes]:
    for low in range((size - 1) // BLOCK * BLOCK, -1, -BLOCK) if size else ():
        spool.seek(low)
        yield spool.read(min(BLOCK, size - low))[::-1]


class Conversation:
    """One conversation as it streams by."""

    def __init__(self, key: str | None):
        self.key, self.size, self.last = key, 0, None
        self.turns, self.flags = SpooledTemporaryFile(SPOOL_TURNS), SpooledTemporaryFile(SPOOL_FLAGS)
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        if fault:
            self.faults[("blank", "duplicate", "truncated")[fault - 1]] += 1
        initial = role[:1]
        if self.size:
            self.faults["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.flags.write(bytes((_INITIALS.get(initial, 0) | 4 * (fault in (1, 2)) | 8 * (fault == 3),)))
        a, b = role.encode(), text.encode()
        self.turns.write(_HEAD.pack(len(a), len(b)))
        self.turns.write(a)
        self.turns.write(b)
        self.size += 1

    def decide(self) -> None:
        """Back pointers of all turns, last turn first, and the whole cost."""
        self.pointers, costs, base = SpooledTemporaryFile(SPOOL_FLAGS), END, 0
        for block in backwards(self.flags, self.size):
            found = bytearray()
            for flag in block:
                costs, low, best = _STEPS[costs, flag]
                base += low
                found.append(best)
            self.pointers.write(found)
        self.cost = base + costs[EMPTY]
        self.flags.close()

    def edits(self) -> Iterator[tuple[str, str | None, str]]:
        """(edit, role, text) in order; role is None for what is deleted."""
        state = EMPTY
        self.turns.seek(0)
        for block in backwards(self.pointers, self.size):
            for best in block:
                a, b = _HEAD.unpack(self.turns.read(_HEAD.size))
                role, text = self.turns.read(a).decode(), self.turns.read(b).decode()
                while (edit := EDITS[best >> (2 * state) & 3]) == "I":
                    yield edit, ROLE[state], ""
                    state = NEXT[state]
                if edit == "D":
                    yield edit, None, ""
                elif edit == "K":
                    yield edit, role, text
                    state = keep(state, _INITIALS[role[0]])
                else:
                    yield edit, ROLE[state], text
                    state = NEXT[state]
        while state in (SYSTEM, USER):
            yield "I", ROLE[state], ""
            state = NEXT[state]
        self.turns.close()
        self.pointers.close()

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)

    def summary(self) -> tuple:
        self.decide()
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for edit, role, text in self.edits():
            audit += edit.encode()
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        return (self.key, self.gaps(), *self.faults.values(), self.cost, audit.decode(), digest.hexdigest())

    def repaired(self) -> Iterator[tuple]:
        self.decide()
        given = 0
        for edit, role, text in self.edits():
            if role is not None:
                yield self.key, given, edit, role, text
                given += 1


SUMMARY = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "key string, position long, edit string, role string, text string"


def conversations(frames: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    now = None
    for frame in frames:
        columns = (frame[c].tolist() for c in ("key", "absent", "unnumbered", "turn", "role", "text", "fault"))
        for key, absent, unnumbered, turn, role, text, fault in zip(*columns, strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                now = Conversation(key)
            if not absent:
                now.add(None if unnumbered else turn, role, text, fault)
    if now is not None:
        yield now


def sorted_turns(turns: DataFrame, id: str, turn: str, role: str, text: str, absent: Column | None) -> DataFrame:
    """The rows dealt by conversation and in order, each with its first fault: 1 blank, 2 duplicate, 3 truncated.

    Repeated turns are found by a sort inside the same partitions, so no set of seen turns is held and nothing moves twice.
    """
    rows = turns.select(
        F.col(id).cast("string").alias("key"),
        F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"),
        F.col(turn).isNull().alias("unnumbered"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("same", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    order = [F.desc("unnumbered"), F.asc("turn"), F.asc("role"), F.asc("text")]
    seen = F.row_number().over(Window.partitionBy("key", "absent", "same").orderBy(*order)) > 1
    trimmed = F.expr("trim(trailing ' \\t\\n\\u000b\\f\\r' from text)")
    fault = F.when(trimmed == "", 1).when(F.col("seen"), 2).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    marked = rows.repartition("key").withColumn("seen", seen).withColumn("fault", fault)
    return marked.select("key", "absent", "unnumbered", "turn", "role", "text", "fault").sortWithinPartitions("key", *order)


def repair_conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cheapest repair's cost and edits, and a digest of the repaired turns.

    Turns are taken in order of their number, those without one first; turns of one number by role, then text. A null
    role or text is one space. Rows without an id make one conversation without an id. Rows where `absent` holds only
    say that their conversation exists: one without other rows has zeros, no edits and the digest of nothing. Repeated
    rows are duplicates. Columns that are not named are not read; an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SUMMARY.split(", ")]
        rows = []
        for one in conversations(frames):
            rows.append(one.summary())
            if len(rows) == OUT_ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    found = sorted_turns(turns, id, turn, role, text, absent).mapInPandas(run, SUMMARY)
    return found.select(F.col("key").cast(turns.schema[id].dataType).alias(id), *found.columns[1:])


def repaired_turns(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """The repaired turns themselves: id, position from 0, edit (K, R or I), role and text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TURNS.split(", ")]
        rows, held = [], 0
        for one in conversations(frames):
            for row in one.repaired():
                rows.append(row)
                held += len(row[4])
                if len(rows) == OUT_ROWS or held > SPOOL_TURNS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    found = sorted_turns(turns, id, turn, role, text, absent).mapInPandas(run, TURNS)
    return found.select(F.col("key").cast(turns.schema[id].dataType).alias(id), *found.columns[1:])
