"""Repair of conversations by cheapest edits, with secondary-sorted streaming.

A conversation should read: an optional system turn, then user and assistant in turn, or nothing.
Rows may be kept, given another role, or deleted, and empty turns may be inserted; blank and
repeated rows must go, and rows that break off cost more if they stay.

Rows are dealt by conversation and sorted by turn. A task streams them through mapInPandas and holds,
across Arrow batches, one entry for each of four states (nothing yet, after system, after user,
after assistant): the cheapest cost of ending there, the place of its edits in ASCII order among the
four, and the running digest of what the edits leave. Two states' edits differ before either
ends, since each ends with the edit of the same row, and the edits so far decide the state; so
comparing places is comparing whole edit texts. Every row leaves one byte a state that tells where the
best edits came from. These bytes are kept in memory up to a bound and then spill to a file of
the task; at the conversation's end they are read backwards for the edits.

So memory does not grow with a conversation but for its audit, a letter a row, which is a result
value. Which of several equal rows comes first is found before, by an aggregation over digests that
combines early; its answer travels as a marker row in front of the first one. A digest chain over
a conversation is sequential, so a giant one is one stream; nothing of it is collected.

Edge cases, all defined: a null role or text is one space; a null conversation id is a
conversation; null turns come first and do not count for gaps; rows of one turn are ordered by
role and digest of the text, so repeated rows are next to one another; roles count by their first letter,
and a role that starts otherwise than s, u or a can only be changed or deleted; ids listed in
``every`` without any row have zeros and an empty audit; an empty table gives an empty result. Only
the four named columns are read, so others play no part.
"""

from __future__ import annotations

import hashlib
import tempfile
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import texts

#: Costs of the edits, and of leaving a row that breaks off.
RENAME, DELETE, INSERT, BROKEN = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
STARTS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that can follow a state besides a first system turn.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINE, BROKEN_OFF, DOOMED = range(3)
#: Bytes of back pointers that stay in memory.
HELD = 16 << 20
LETTERS = "DKR"


def _ways(state: int, start: str, fault: int):
    """(edits, cost, next state, name or None) for one row: inserted turns, then its own edit."""
    yield "D", DELETE, state, None
    if fault == DOOMED:
        return
    extra = BROKEN if fault == BROKEN_OFF else 0
    for inserted in range(3):
        edits, cost = "I" * inserted, INSERT * inserted + extra
        if start == "s" and state == START:
            yield edits + "K", cost, SYSTEM, None
        elif start == "ua"[FOLLOWS[state] == ASSISTANT]:
            yield edits + "K", cost, FOLLOWS[state], None
        yield edits + "R", cost + RENAME, FOLLOWS[state], NAMES[FOLLOWS[state]]
        state = FOLLOWS[state]


@lru_cache(maxsize=100_000)
def step(best: tuple, start: str, fault: int) -> tuple:
    """One row further: (cost all states now share, best, back pointers, moves).

    best: for each state None or (cost above the cheapest, place among the states' edits).
    moves: (next state, state before, edits, new name or None).
    """
    found: dict[int, tuple] = {}
    for state, entry in enumerate(best):
        if entry is None:
            continue
        for edits, cost, after, name in _ways(state, start, fault):
            way = (entry[0] + cost, entry[1], edits, state, name)
            if after not in found or way[:3] < found[after][:3]:
                found[after] = way
    least = min(way[0] for way in found.values())
    order = sorted(found, key=lambda q: found[q][1:3])
    pointers, moves, new = bytearray(b"\xff" * 4), [], [None] * 4
    for q, (cost, _, edits, state, name) in found.items():
        new[q] = (cost - least, order.index(q))
        pointers[q] = state | (len(edits) - 1) << 2 | LETTERS.index(edits[-1]) << 4
        moves.append((q, state, edits, name))
    return least, tuple(new), bytes(pointers), moves


class Stream:
    """What is held of one conversation while its rows pass by."""

    def __init__(self, conv):
        self.conv = conv
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.cost, self.best = 0, ((0, 0), None, None, None)
        self.digests = {START: hashlib.sha256()}
        self.pointers = tempfile.SpooledTemporaryFile(HELD)
        self.rows = 0
        self.low = self.high = None
        self.turns = 0
        self.before = None

    def _add(self, digest, state: int, role: str, text: bytes) -> None:
        digest.update(b"%s%s:" % (b"" if state == START else b"\n", role.encode()))
        digest.update(text)

    def row(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        start = role[:1]
        if self.before is not None and self.before + start not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = start
        end, fault = text.rstrip(WHITE)[-1:], FINE
        if not end:
            fault, self.blank = DOOMED, self.blank + 1
        elif not first:
            fault, self.duplicate = DOOMED, self.duplicate + 1
        elif end not in ".!?":
            fault, self.truncated = BROKEN_OFF, self.truncated + 1
        cost, self.best, pointers, moves = step(self.best, start if start and start in STARTS else "", fault)
        self.cost += cost
        self.pointers.write(pointers)
        self.rows += 1
        if fault != DOOMED:
            text, old, self.digests = text.encode(), self.digests, {}
            for after, state, edits, name in moves:
                digest = old[state].copy()
                for edit in edits:
                    if edit == "I":
                        self._add(digest, state, NAMES[FOLLOWS[state]], b"")
                        state = FOLLOWS[state]
                    elif edit != "D":
                        self._add(digest, state, name or role, text)
                self.digests[after] = digest

    def _audit(self, state: int) -> str:
        """The edits that led to ``state``, read backwards from the spilled pointers."""
        parts, left = [], self.rows
        while left:
            take = min(left, 1 << 16)
            left -= take
            self.pointers.seek(4 * left)
            block, edits = self.pointers.read(4 * take), []
            for at in range(4 * take - 4, -1, -4):
                pointer = block[at + state]
                edits.append("I" * (pointer >> 2 & 3) + LETTERS[pointer >> 4])
                state = pointer & 3
            parts.append("".join(reversed(edits)))
        return "".join(reversed(parts))

    def finish(self) -> tuple:
        ends = []
        for state, entry in enumerate(self.best):
            last, inserted = state, 0
            while entry and last not in (START, ASSISTANT):
                last, inserted = FOLLOWS[last], inserted + 1
            if entry:
                ends.append((entry[0] + INSERT * inserted, entry[1], inserted, state))
        cost, _, inserted, state = min(ends)
        audit = self._audit(state) + "I" * inserted
        digest = self.digests[state]
        for _ in range(inserted):
            self._add(digest, state, NAMES[FOLLOWS[state]], b"")
            state = FOLLOWS[state]
        self.pointers.close()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + cost, audit,
                digest.hexdigest())


HEADER, FIRST, ROW = range(3)
SUMMARY = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long",
           "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _streamed(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows, markers of first ones and headers in one order: by conversation, then turn.

    Ids travel as text and turns beside a flag, as pandas would turn either into inexact floats
    wherever a null comes along.
    """
    same = ["conv", "role", "digest"]
    firsts = rows.groupBy(*same).agg(F.min(F.struct("turn")).alias("t")).select(
        "conv", F.col("t.turn").alias("turn"), "role", "digest", F.lit(FIRST).alias("kind"), F.lit(None).cast("string").alias("text"))
    every = rows.select("conv", "turn", "role", "digest", F.lit(ROW).alias("kind"), "text").unionByName(firsts)
    for name in ("turn", "role", "digest", "text"):
        if name not in headers.columns:
            headers = headers.withColumn(name, F.lit(None))
    every = every.unionByName(headers.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in every.schema.fields]))
    return every.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind").select(
        "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("dated"), "role",
        "digest", "kind", "text")


def _named(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    text_ = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv_id).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), text_.alias("text"), F.md5(text_.cast("binary")).alias("digest"))


def _records(batches):
    """(conversation, turn or None, role, text, kind, whether the row is the first of its like)."""
    marked = None
    for batch in batches:
        columns = [batch[c].tolist() for c in ("conv", "turn", "dated", "role", "digest", "kind", "text")]
        for conv, turn, dated, role, digest, kind, text in zip(*columns):
            at = (conv, turn if dated else None, role, digest)
            yield conv, at[1], role, text, kind, kind == ROW and marked == at
            marked = at if kind == FIRST else None


def _ids(rows: DataFrame, conv_id: str, every: DataFrame | None) -> DataFrame:
    return (rows if every is None else every).select(F.col(conv_id).cast("string").alias("conv")).distinct()


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row for each conversation in ``every`` (a table with the column ``conv_id``), or in ``rows``.
    The audit has the first letters of the cheapest edits in order, and of several the least:
    Keep, Rerole, Delete, Insert. repaired_sha256 is of the repaired turns, a ``role:text`` line each.
    """
    texts.small_batches(rows.sparkSession)
    kind = rows.schema[conv_id].dataType
    headers = _ids(rows, conv_id, every).select("conv", F.lit(HEADER).alias("kind"))

    def run(batches):
        now, done = None, []
        for conv, turn, role, text, kind, first in _records(batches):
            if kind == HEADER:
                if now:
                    done.append(now.finish())
                now = Stream(conv)
                if len(done) >= 1000 or sum(len(d[7]) for d in done[-1:]) > 1 << 20:
                    yield pd.DataFrame(done, columns=["conv", *SUMMARY])
                    done = []
            elif kind == ROW:
                now.row(turn, role, text, first)
        if now:
            done.append(now.finish())
        yield pd.DataFrame(done, columns=["conv", *SUMMARY])

    schema = ", ".join(["conv string", *(f"{c} {t}" for c, t in SUMMARY.items())])
    found = _streamed(_named(rows, conv_id, turn, role, text), headers).mapInPandas(run, schema)
    return found.select(F.col("conv").cast(kind).alias(conv_id), *SUMMARY)


def repaired_turns(rows: DataFrame, audits: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, edit) of every turn that stands after the edits.

    audits: (conv_id, audit) as ``repair`` gives them. The rows stream by once more, behind their audit;
    ``turn`` is null for inserted turns.
    """
    texts.small_batches(rows.sparkSession)
    kind = rows.schema[conv_id].dataType
    headers = audits.select(F.col(conv_id).cast("string").alias("conv"), F.lit(HEADER).alias("kind"), F.col("audit").alias("text"))
    out = ["conv", "place", "turn", "role", "text", "edit"]

    def run(batches):
        done, size = [], 0
        audit = at = place = state = conv = None

        def insert(last: bool):
            nonlocal at, place, state
            while at < len(audit) and audit[at] == "I":
                state = FOLLOWS[state]
                done.append((conv, place, None, NAMES[state], "", "I"))
                at, place = at + 1, place + 1

        for here, turn, role, text, kind, _ in _records(batches):
            if kind == HEADER:
                if audit is not None:
                    insert(True)
                audit, at, place, state, conv = text or "", 0, 0, START, here
            elif kind == ROW:
                insert(False)
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = SYSTEM if edit == "K" and role[:1] == "s" else FOLLOWS[state]
                    done.append((conv, place, str(turn) if turn is not None else None,
                                 role if edit == "K" else NAMES[state], text, edit))
                    place, size = place + 1, size + len(text)
            if len(done) >= 1000 or size > 4 << 20:
                yield pd.DataFrame(done, columns=out)
                done, size = [], 0
        if audit is not None:
            insert(True)
        yield pd.DataFrame(done, columns=out)

    found = _streamed(_named(rows, conv_id, turn, role, text), headers).mapInPandas(
        run, "conv string, place long, turn string, role string, text string, edit string")
    return found.select(F.col("conv").cast(kind).alias(conv_id), "place", F.col("turn").cast("long").alias("turn"),
                        "role", "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by a hash of id and turn, for trials of the repair.

    Of every 20 hash values, 0 drops a row, 1 empties its text, 2 takes its full stops, question and exclamation
    marks, 3 repeats it, 4 makes it a user's; the others leave it. Nulls are one space.
    """
    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), hit.alias("hit")).where(
        "hit != 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
