"""Conversation structure repair: the cheapest edits that make the roles alternate and leave out broken turns.

Rows are taken in order of turn (nulls first; ties by role, then by the text's MD5 digest). Each row's first fault
counts: blank (no character but \\x20 and \\x09-\\x0D), duplicate (role and text stood in an earlier row), truncated
(the last such character isn't one of ``.!?``). Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank
and duplicate rows), Insert an empty user or assistant turn 2; a truncated row that stays costs 1 more. The roles'
initials must become ``(s?(ua)+)?``. Of the cheapest audits (the edits' initials in order) the least in ASCII is taken.

Method: A* on the lattice of (row, what the roles so far allow). The heuristic, admissible and consistent, is the
suffix sum of the deletions that are a must and of the charge that no truncated row escapes (1 at least, as deletion
costs 3). Open nodes are keyed (cost + heuristic, audit): the first audit to reach a node is the cheapest and, of those,
the least, as two audits of one node and cost are never prefixes of each other. A conversation is searched in blocks
of rows; only the best arrival in each of the four states goes on, named by its rank in the order of audits.

Scale: faults and audits come from narrow rows (flags and digests, no texts), sorted by Spark and read as a stream, so a
conversation of any length costs a task its audit and one block. Earlier copies are found by counting (conversation,
role, digest), combined before the shuffle. The texts are shuffled once: each conversation's audit, sorted before its
rows, is applied to them as they stream by. A SHA-256 digest has to be taken in order, so a conversation's rows pass
one task, as a stream.

Null roles and texts count as one space, so such a row's text is blank and such a role is none that can be kept. Rows
of a null conv_id are one conversation. Rows repeated in the table are turns that are said twice, so duplicates. Empty
tables give empty results; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.llm.common import col

BLANK, DUPLICATE, TRUNCATED = 1, 2, 4
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled turn becomes after each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, CHARGE = 3, 2, 2, 1
#: Rows that are searched at once.
BLOCK = 256
LEGAL = {"su", "ua", "au"}


def after(state: int, initial: str) -> int | None:
    """The state once a row of this role has been kept; None if it can't be."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def search(rows: list[tuple[str, int]], begin: list[tuple[int, int]], last: bool) -> list[tuple[int, int, int, str]]:
    """The best arrivals behind `rows` (initial, fault): (state, cost, which of `begin`, audit since), least audit first.

    `begin`: states and costs to begin with, in the order of their audits. One arrival for each state that can be
    reached; with `last` only the best that ends a conversation.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] & (BLANK | DUPLICATE) else CHARGE if rows[i][1] else 0)
    heap: list[tuple[int, str, int, int]] = []
    for k, (state, cost) in enumerate(begin):
        heappush(heap, (cost + rest[0], str(k), 0, state))
    closed, out = set(), []
    while heap:
        f, audit, i, state = heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and not last:
            out.append((state, f, int(audit[0]), audit[1:]))
            continue
        if i == n and state in (START, ASSISTANT):
            return [(state, f, int(audit[0]), audit[1:])]
        heappush(heap, (f + INSERT, audit + "I", i, NEXT[state]))
        if i < n:
            initial, fault = rows[i]
            g = f - rest[i] + rest[i + 1]
            heappush(heap, (g + DELETE, audit + "D", i + 1, state))
            if not fault & (BLANK | DUPLICATE):
                charge = CHARGE if fault else 0
                heappush(heap, (g + REROLE + charge, audit + "R", i + 1, NEXT[state]))
                if (to := after(state, initial)) is not None:
                    heappush(heap, (g + charge, audit + "K", i + 1, to))
    return sorted(out, key=lambda x: (x[2], x[3]))


class Conversation:
    """Measures and audit of one conversation whose rows come in order."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block, self.rows, self.begin = block, [], [(START, 0)]
        self.arrivals: list[list[tuple[int, str]]] = []  # of each block, by rank: which of those before it, audit since
        self.counts = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.turns = 0
        self.first = self.turn = self.before = None
        self.any = False

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.any and self.before + initial not in LEGAL:
            self.illegal += 1
        self.any, self.before = True, initial
        if fault:
            self.counts[fault] += 1
        if len(self.rows) == self.block:
            self._go_on(False)
        self.rows.append((initial, fault))

    def _go_on(self, last: bool) -> None:
        found = search(self.rows, self.begin, last)
        self.begin = [(state, cost) for state, cost, _, _ in found]
        self.arrivals.append([(k, audit) for _, _, k, audit in found])
        self.rows = []

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        if self.any:
            self._go_on(True)
        parts, k = [], 0
        for block in reversed(self.arrivals):
            k, audit = block[k]
            parts.append(audit)
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return gaps, *(self.counts[x] for x in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, self.begin[0][1], "".join(reversed(parts))


MEASURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of batches sorted by conversation and order."""
    at, now, last, ids, out = object(), None, None, [], []

    def given(kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], pa.int64() if k < len(MEASURES) else pa.string()) for k in range(len(MEASURES) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], ["conv_id", *MEASURES, "audit"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i, turn, role, digest, fault, stays, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "fault", "stays", "again"))):
            if now is None or i != at:
                if now is not None:
                    ids.append(at)
                    out.append(now.result())
                at, now, last = i, Conversation(), None
            if stays:
                own = (turn, role, digest)
                now.add(turn, role[:1], fault if fault == BLANK else DUPLICATE if again or own == last else fault)
                last = own
        if len(out) > 1000:
            yield given(kind)
            ids.clear(), out.clear()
    if now is not None:
        ids.append(at)
        out.append(now.result())
        yield given(kind)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, tuple | None]]:
    """Each conversation's audit row, ("audit", conv_id, row), then its repaired turns, ("turn", conv_id, (edit, role, text))."""
    audit, place, state = "", 0, START
    at: object = None

    def inserted() -> Iterator[tuple]:
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            place, state = place + 1, NEXT[state]
            yield "turn", at, ("I", ROLE[state], "")

    for batch in batches:
        heads = zip(*(batch.column(c).to_pylist() for c in (*MEASURES, "audit")))
        for i, is_row, role, text, head in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_row", "role", "text")), heads):
            if not is_row:
                yield from inserted()  # what follows the last row of the conversation before
                at, audit, place, state = i, head[-1], 0, START
                yield "audit", i, head
                continue
            yield from inserted()
            edit, place = audit[place], place + 1
            if edit == "K":
                state = after(state, role[:1])
                yield "turn", at, (edit, role, text)
            elif edit == "R":
                state = NEXT[state]
                yield "turn", at, (edit, ROLE[state], text)
    yield from inserted()


def _turns(conversations: DataFrame, damage: bool, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, stays (false for dropped rows), digest and fault (blank, truncated or 0) of each row."""
    said = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    rows = conversations.select(col(conv_id).alias("conv_id"), col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), F.concat(said(conv_id), F.lit(":"), said(turn)).alias("key"))
    if damage:
        k = F.crc32(F.col("key").cast("binary")) % 20
        rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), (k != 0).alias("stays"), F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))))
    else:
        rows = rows.withColumn("stays", F.lit(True))
    ending: Column = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(ending == "", BLANK).when(~ending.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "stays", F.md5(F.col("text").cast("binary")).alias("digest"), fault.alias("fault"))


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "digest")


def _audits(rows: DataFrame) -> DataFrame:
    narrow = rows.drop("text")
    same = [narrow[c].eqNullSafe(F.col(f"k_{c}")) for c in ("conv_id", "role", "digest")]
    said = narrow.filter("stays").groupBy(*(F.col(c).alias(f"k_{c}") for c in ("conv_id", "role", "digest")))
    twice = said.agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("before_all")).filter("n > 1")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("before_all") | (F.col("turn") > F.col("first"))), F.lit(False))
    rows = narrow.join(twice, same[0] & same[1] & same[2], "left").select(*narrow.columns, again.alias("again"))
    return _sorted(rows).mapInArrow(_audited, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in MEASURES)}, audit string")


def audits(conversations: DataFrame, damage: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation: conv_id, gaps (turns missing between the first and the last), blank, duplicate and truncated rows, illegal (neighbours whose initials aren't su, ua or au), cost, audit."""
    return _audits(_turns(conversations, damage, conv_id, turn, role, text))


def _with_audits(rows: DataFrame) -> DataFrame:
    """The rows with texts that stay, each conversation's audit before them, in order."""
    none = {c: F.lit(None).cast("long" if c != "audit" else "string").alias(c) for c in (*MEASURES, "audit")}
    heads = _audits(rows).select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "digest", "text")), *none.keys())
    return _sorted(heads.unionByName(rows.filter("stays").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "digest", "text", *none.values())), "is_row")


def repair(conversations: DataFrame, damage: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role and text of each turn left."""
    rows = _turns(conversations, damage, conv_id, turn, role, text)

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, size, n = None, [], 0, 0

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def given() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["conv_id", "position", "edit", "role", "text"])

        for what, i, x in _applied(watched()):
            if what == "audit":
                n = 0
                continue
            out.append((i, n, *x))
            n, size = n + 1, size + len(x[2])
            if len(out) >= 5000 or size > 2_000_000:
                yield given()
                out, size = [], 0
        if out:
            yield given()

    return _with_audits(rows).mapInArrow(turns, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string")


def digest(conversations: DataFrame, damage: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The columns of `audits`, and repaired_sha256 of the repaired turns (``role:text``, joined by line feeds).

    `damage` first breaks one row in four by crc32 of ``conv_id:turn``: drops it, empties it, takes its ``.!?``, says it twice or makes it the user's.
    """
    rows = _turns(conversations, damage, conv_id, turn, role, text)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, now = None, [], None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def given() -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * len(MEASURES), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["conv_id", *MEASURES, "audit", "repaired_sha256"])

        some = False
        for what, i, x in _applied(watched()):
            if what == "audit":
                if now is not None:
                    out.append((*head, now.hexdigest()))
                    if len(out) >= 5000:
                        yield given()
                        out = []
                head, now, some = (i, *x), hashlib.sha256(), False
            else:
                now.update(f"{chr(10) if some else ''}{x[1]}:{x[2]}".encode())
                some = True
        if now is not None:
            out.append((*head, now.hexdigest()))
            yield given()

    return _with_audits(rows).mapInArrow(hashed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in MEASURES)}, audit string, repaired_sha256 string")
