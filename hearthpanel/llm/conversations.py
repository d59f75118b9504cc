"""Conversation structure repair: the cheapest edits that bring a conversation's turns into order.

Rows are moved to their conversation's task and sorted there by turn, from the last to the first. A
dynamic program over what the repaired conversation ends with (nothing, a system row, a user row, an
assistant row) reads them as they come, in Arrow batches of any size, and carries four costs across
batches. Each row leaves one byte, the best edit for each of the four states. At a conversation's end
these bytes are walked from the first row on, which gives the audit and the repaired text. A
conversation of more than ``HELD_BYTES`` writes its bytes and texts in pieces to an unnamed file of the
task, as Spark's own sorter does, and reads the pieces back once; a lost task starts anew. So a giant
conversation needs the memory of one piece beside its audit.

Rows that say the same as an earlier row of the conversation are found before by a grouping that is
combined before the shuffle; the stream needs no set of what it has seen.

Output roles must read ``(s?(ua)+)?`` by initials. Edits and costs: Keep 0, Rerole to user or assistant 2,
Delete 3 (blank and duplicate rows must go), Insert an empty user or assistant row 2; a truncated row that
stays costs 1 more. Of equally cheap edits the audit that comes first in ASCII order is taken.

Nulls count as one space; rows are taken by turn, unknown turns first, ties by role and text. Unknown
conversation ids are one conversation. A conversation without rows has zeros, an empty audit and the hash of
the empty text. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import pick
from hearthpanel.operators.keyed import null_safe_join

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
HELD_BYTES = 8 << 20
MARKS = r"[^\x20\x09-\x0D]"
ROLES = {"u": "user", "a": "assistant"}
# States: nothing yet, a system row, a user row last, an assistant row last.
_NEXT = ("u", "u", "a", "u")
_AFTER = {"s": 1, "u": 2, "a": 3}
_FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"

RESULT = (
    "conv_key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (0: the row is dropped, 2: it is said twice)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def untouched(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form ``repair`` takes."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).alias("copies"))


def _edits(f: list[int], initial: str, must_go: bool, cut: int) -> tuple[list[int], int]:
    """Costs to the end before a row from those after it, ``f``, and the best edit of each state, two bits each.

    0 Delete, 1 Insert, 2 Keep, 3 Rerole: the order of their initials, so the first of the cheapest is taken.
    """
    own = []
    for state in range(4):
        go, keep, role = DELETE + f[state], _FAR, _FAR
        if not must_go:
            if initial == _NEXT[state] or (state == 0 and initial == "s"):
                keep = cut + f[_AFTER[initial]]
            role = REROLE + cut + f[_AFTER[_NEXT[state]]]
        own.append((go, keep, role))
    best = [min(o) for o in own]
    for _ in range(3):  # a second insertion leads from a user row to a user row, a third never pays
        best = [min(b, INSERT + best[_AFTER[_NEXT[s]]]) for s, b in enumerate(best)]
    pointers = 0
    for state, (go, keep, role) in enumerate(own):
        b = best[state]
        edit = 0 if go == b else 1 if INSERT + best[_AFTER[_NEXT[state]]] == b else 2 if keep == b else 3
        pointers |= edit << (2 * state)
    return best, pointers


def _at_end() -> list[int]:
    f = [0, _FAR, _FAR, 0]
    for _ in range(3):
        f = [min(c, INSERT + f[_AFTER[_NEXT[s]]]) for s, c in enumerate(f)]
    return f


class _Conversation:
    """One conversation, fed from its last row to its first."""

    def __init__(self, key: str | None) -> None:
        self.key, self.f = key, _at_end()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.high, self.low = 0, None, None
        self.later: str | None = None  # the initial of the row after
        self.held: list[tuple[int, str, str, str]] = []
        self.size, self.file, self.pieces = 0, None, []

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        if turn is not None:
            if turn != self.low:
                self.turns += 1
            self.low = turn
            self.high = turn if self.high is None else self.high
        initial = role[:1]
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.illegal += 1
        self.later = initial
        end = text.rstrip(_SPACE)
        cut = 0
        if not end:
            self.blank += 1
        elif duplicate:
            self.duplicate += 1
        elif end[-1] not in ".!?":
            self.truncated += 1
            cut = TRUNCATED
        must_go = not end or duplicate
        self.f, pointers = _edits(self.f, initial, must_go, cut)
        if must_go:
            role = text = ""  # never written
        self.held.append((pointers, initial, role, text))
        self.size += len(role) + len(text) + 100
        if self.size > HELD_BYTES:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.pieces.append(self.file.tell())
        pickle.dump(self.held, self.file, protocol=5)
        self.held, self.size = [], 0

    def _from_first(self) -> Iterator[tuple[int, str, str, str]]:
        yield from reversed(self.held)
        self.held = []
        for place in reversed(self.pieces):
            self.file.seek(place)
            yield from reversed(pickle.load(self.file))

    def result(self) -> tuple:
        digest, audit, state, first = hashlib.sha256(), bytearray(), 0, True

        def say(role: str, text: str) -> None:
            nonlocal first
            digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False

        def put(edit: bytes, role: str, text: str, initial: str) -> None:
            nonlocal state
            audit.extend(edit)
            say(role, text)
            state = _AFTER[initial]

        cost = self.f[0]
        for pointers, initial, role, text in self._from_first():
            while (edit := pointers >> (2 * state) & 3) == 1:
                put(b"I", ROLES[_NEXT[state]], "", _NEXT[state])
            if edit == 0:
                audit.extend(b"D")
            elif edit == 2:
                put(b"K", role, text, initial)
            else:
                put(b"R", ROLES[_NEXT[state]], text, _NEXT[state])
        while state not in (0, 3):
            put(b"I", ROLES[_NEXT[state]], "", _NEXT[state])
        if self.file is not None:
            self.file.close()
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return (
            self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit.decode(), digest.hexdigest()
        )


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One result per conversation from rows sorted by conversation and, within it, last row first."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    now: _Conversation | None = None
    waiting = None  # a row whose earlier neighbour is not known yet

    def settle(before: tuple | None) -> None:
        """Hand the waiting row over; it is a duplicate if the row before it in order is the same."""
        if waiting is None:
            return
        turn, role, text, copies, again = waiting
        same = before is not None and before[:3] == (turn, role, text)
        for copy in range(copies, 0, -1):
            now.add(turn, role, text, again or same or copy > 1)

    for batch in batches:
        done = []
        columns = zip(*[batch[c].tolist() for c in ("conv_key", "known", "turn", "role", "text", "copies", "again")])
        for key, known, turn, role, text, copies, again in columns:
            key = None if key is None or key != key else key
            if now is None or key != now.key:
                settle(None)
                if now is not None:
                    done.append(now.result())
                now, waiting = _Conversation(key), None
            if copies:
                row = (int(turn) if known else None, role, text, int(copies), bool(again))
                settle(row)
                waiting = row
        yield pd.DataFrame(done, columns=names)
    settle(None)
    if now is not None:
        yield pd.DataFrame([now.result()], columns=names)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as ``damaged`` gives them): its faults, the cost and audit of the
    cheapest repair and the hash of the repaired conversation."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumns(
        {"place": F.when(F.col("copies") > 0, place), "said": F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)}
    )
    firsts = rows.filter("copies > 0").groupBy("conv_id", "said").agg(
        F.min("place").alias("first"), F.max("place").alias("last")
    )
    rows = null_safe_join(rows, firsts.filter("first != last").drop("last"), ["conv_id", "said"])
    sent = rows.select(
        F.col("conv_id").cast("string").alias("conv_key"),
        F.col("turn").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0).cast("long")).alias("turn"),
        F.when(F.col("copies") > 0, F.col("role")).otherwise("").alias("role"),
        F.when(F.col("copies") > 0, F.col("text")).otherwise("").alias("text"),
        "copies",
        F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("again"),
    )
    last_first = [F.desc(c) for c in ("known", "turn", "role", "text", "copies")]
    ordered = sent.repartition("conv_key").sortWithinPartitions("conv_key", *last_first)
    found = ordered.mapInPandas(_streamed, RESULT)
    kind = rows.schema["conv_id"].dataType
    return found.select(F.col("conv_key").cast(kind).alias("conv_id"), *[c.split()[0] for c in RESULT.split(", ")[1:]])


def repair_damaged(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
