"""Cheapest repair of conversations: which messages to keep, drop, give another role or insert.

Every conversation is solved by depth-first branch and bound with an explicit stack. A node is a prefix of edits that
stands before some row with some role last; for each such place a table keeps the best prefix so far, and a prefix that
is no better ends there. The suffix bound is the least cost from a place on, whatever the order of ties; a prefix whose
cost and bound exceed the incumbent's cost, or equal it with a later audit, ends too. The incumbent is the pair of cost
and audit; it is optimal once the stack is empty.

What decides is one small code per message, so texts stay out of the search. Messages are streamed in order inside
their partition. Longer conversations are searched in blocks: the best prefix for every last role goes on to the next
block, so memory is one block and four audits, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema

DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
#: Messages that one search takes.
BLOCK = 4096
#: Messages of one batch that is returned.
BATCH = 1000
#: Last role of a prefix: none, system, user, assistant; a repair may end with none or with an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
FINAL = -1
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_WELL, _CUT, _GONE = range(3)
_FAULTS = {"": _WELL, "truncated": _CUT, "blank": _GONE, "duplicate": _GONE}
_FAR = 1 << 60


def _edits(initial: int, fault: int, last: int) -> tuple[tuple[str, int, int], ...]:
    """Edits of a message after a prefix with this last role: (letter, cost, last role then)."""
    found = [("D", DELETE_COST, last)]
    if fault != _GONE:
        extra = TRUNCATED_COST if fault == _CUT else 0
        if initial == AFTER[last] or (initial == SYSTEM and last == NONE):
            found.append(("K", extra, initial))
        found.append(("R", REROLE_COST + extra, AFTER[last]))
    return tuple(found)


EDITS = [[_edits(code // 3, code % 3, last) for last in range(4)] for code in range(12)]


def code_of(initial: str, fault: str) -> int:
    """One number for what the search needs to know of a message."""
    return 3 * _INITIALS.get(initial, 0) + _FAULTS[fault]


def suffix_bounds(codes: bytes, goal: int) -> list[list[int]]:
    """For every row and last role, the least cost of the edits from there on."""
    ends = [NONE, ASSISTANT] if goal == FINAL else [goal]
    tail = [0 if last in ends else _FAR for last in range(4)]
    inserted = lambda own: [min(own[q], INSERT_COST + own[AFTER[q]], 2 * INSERT_COST + own[AFTER[AFTER[q]]]) for q in range(4)]
    bounds = [inserted(tail) if goal == FINAL else tail]
    for code in reversed(codes):
        below = bounds[-1]
        bounds.append(inserted([min(cost + below[then] for _, cost, then in EDITS[code][last]) for last in range(4)]))
    return bounds[::-1]


class _Search:
    """Nodes of one search: parent, letter, cost, depth, row and last role."""

    def __init__(self, codes: bytes, entry: int, goal: int):
        self.codes, self.goal, self.bounds = codes, goal, suffix_bounds(codes, goal)
        self.nodes = [(-1, "", 0, 0, 0, entry)]
        self.table = {(0, entry): 0}
        self.incumbent: tuple[int, int] | None = None

    def before(self, x: int, y: int) -> bool:
        """Whether the audit of node x comes before that of node y: their first letters after the common prefix decide."""
        nodes, a, b = self.nodes, "", ""
        while x != y:
            if nodes[x][3] >= nodes[y][3]:
                a, x = nodes[x][1], nodes[x][0]
            else:
                b, y = nodes[y][1], nodes[y][0]
        return a < b

    def hopeless(self, cost: int, row: int, last: int) -> bool:
        return cost + self.bounds[row][last] > (self.incumbent[0] if self.incumbent else _FAR - 1)

    def children(self, node: int) -> list[tuple[int, str, int, int, int]]:
        """(cost and bound, letter, cost, row, last role) of every edit that may follow."""
        _, _, cost, _, row, last = self.nodes[node]
        found = []
        if row < len(self.codes):
            found = [(letter, cost + more, row + 1, then) for letter, more, then in EDITS[self.codes[row]][last]]
        if row < len(self.codes) or self.goal == FINAL:
            found.append(("I", cost + INSERT_COST, row, AFTER[last]))
        return sorted((c + self.bounds[r][q], letter, c, r, q) for letter, c, r, q in found if not self.hopeless(c, r, q))

    def run(self) -> tuple[int, str] | None:
        stack, ends = [0], (NONE, ASSISTANT) if self.goal == FINAL else (self.goal,)
        while stack:
            node = stack.pop()
            _, _, cost, depth, row, last = self.nodes[node]
            if self.table[row, last] != node or self.hopeless(cost, row, last):
                continue
            if self.incumbent and cost + self.bounds[row][last] == self.incumbent[0] and not self.before(node, self.incumbent[1]):
                continue
            if row == len(self.codes) and last in ends:
                self.incumbent = (cost, node)
                continue
            fresh = []
            for _, letter, c, r, q in self.children(node):
                self.nodes.append((node, letter, c, depth + 1, r, q))
                new, old = len(self.nodes) - 1, self.table.get((r, q))
                if old is not None and (self.nodes[old][2] < c or (self.nodes[old][2] == c and not self.before(new, old))):
                    self.nodes.pop()
                    continue
                self.table[r, q] = new
                fresh.append(new)
            stack += reversed(fresh)
        return (self.incumbent[0], self.audit(self.incumbent[1])) if self.incumbent else None

    def audit(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.nodes[node][1])
            node = self.nodes[node][0]
        return "".join(reversed(letters))


@lru_cache(maxsize=1 << 14)
def best_edits(codes: bytes, entry: int = NONE, goal: int = FINAL) -> tuple[int, str] | None:
    """Least cost and first audit from the last role `entry` over all messages to `goal`; None where there is no way.

    A goal other than FINAL is a last role; then nothing is inserted after the last message.
    """
    return _Search(codes, entry, goal).run()


class Blocks:
    """Edits of a conversation whose codes come one after the other."""

    def __init__(self, block: int = BLOCK):
        self.block, self.codes = block, bytearray()
        self.prefixes: dict[int, tuple[int, str]] = {NONE: (0, "")}

    def _joined(self, goal: int) -> tuple[int, str] | None:
        codes, found = bytes(self.codes), []
        for entry, (cost, audit) in self.prefixes.items():
            if own := best_edits(codes, entry, goal):
                found.append((cost + own[0], audit + own[1]))
        return min(found, default=None)

    def add(self, code: int) -> None:
        if len(self.codes) == self.block:
            self.prefixes = {goal: best for goal in range(4) if (best := self._joined(goal))}
            self.codes = bytearray()
        self.codes.append(code)

    def end(self) -> tuple[int, str]:
        return self._joined(FINAL)


# ---- messages --------------------------------------------------------------------------


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages with planted faults, by the remainder of a checksum of conversation and turn; `copies` of each remain (0: dropped)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", named(conv), named(turn))) % 20
    own = named(text)
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(named(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(own, "[.!?]", "")).otherwise(own).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages as they are, in the columns that `plan_repairs` takes; null roles and texts are one space."""
    named = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), named(role).alias("role"), named(text).alias("text"), F.lit(1).alias("copies"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _in_order(*before: Column) -> list[Column]:
    return [F.col("conv"), *before, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest")]


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct messages without their text: how many copies, whether the first is new, and the fault of that one."""
    gone = F.col("copies") == 0
    present = lambda c: F.when(~gone, c)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    narrow = rows.select(
        "conv", present(F.col("turn")).alias("turn"), present(F.col("role")).alias("role"), present(_digest(F.col("text"))).alias("digest"),
        present(fault).alias("fault"), "copies",
    )
    counted = narrow.groupBy("conv", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("copies"))
    same = Window.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    return counted.withColumn("new", F.row_number().over(same) == 1)


PLAN = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType())]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Conversation:
    """Counts and edits of one conversation, message by message."""

    def __init__(self, block: int):
        self.blocks, self.last, self.turns, self.n_turns = Blocks(block), None, None, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0

    def take(self, row: dict) -> None:
        turn, initial = row["turn"], (row["role"] or "")[:1]
        if row["copies"] and turn is not None:
            self.n_turns += self.turns is None or self.turns[1] != turn
            self.turns = (turn if self.turns is None else self.turns[0], turn)
        for copy in range(row["copies"]):
            fault = row["fault"] if row["fault"] == "blank" or (row["new"] and not copy) else "duplicate"
            if fault:
                self.counts[fault] += 1
            self.illegal += self.last is not None and (self.last, initial) not in _LEGAL
            self.last = initial
            self.blocks.add(code_of(initial, fault))

    def plan(self) -> list:
        gaps = self.turns[1] - self.turns[0] + 1 - self.n_turns if self.turns else 0
        return [gaps, *(self.counts[k] for k in ("blank", "duplicate", "truncated")), self.illegal, *self.blocks.end()]


def plan_repairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of `messages` or `damaged`: its faults, the cost of the cheapest repair and the audit.

    Messages stand by turn, null first; those of one turn by role, then by the SHA-256 of their text. Counted are missing
    turns between the first and the last (`gaps`), blank, repeated and truncated messages (each by its first fault in this
    order) and neighbours whose roles may not follow each other (`illegal`). The audit has a letter for every edit: Keep,
    Delete, Insert, Rerole. Kept and inserted messages are an optional system message, then user and assistant in turns,
    ending with an assistant, or nothing at all; an empty role fits nowhere. Of repairs of the same cost the audit that comes first in ASCII order is
    taken. Conversations without messages (all dropped) have zeros and an empty audit; a null id is one conversation;
    identical rows are copies of one message; other columns are ignored. An empty table gives no rows.
    """
    schema = T.StructType([rows.schema["conv"], *(T.StructField(*x) for x in PLAN)])
    arrow = arrow_schema(schema)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if own is None or row["conv"] != key:
                    if own:
                        done.append([key, *own.plan()])
                    key, own = row["conv"], _Conversation(block)
                own.take(row)
            if len(done) >= BATCH:
                yield _batch(done, arrow)
                done = []
        if own:
            done.append([key, *own.plan()])
        yield _batch(done, arrow)

    return _coded(rows).repartition("conv").sortWithinPartitions(*_in_order()).mapInArrow(solve, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _beside_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Every plan in front of the messages of its conversation, in their order."""
    named = [name for name, _ in PLAN]
    kept = rows.where("copies > 0").withColumn("digest", _digest(F.col("text"))).withColumn("plan", F.lit(None).cast(plans.select(F.struct(*named)).schema[0].dataType))
    ahead = plans.select("conv", F.struct(*named).alias("plan"))
    both = kept.unionByName(ahead, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions(*_in_order(F.col("plan").isNull()))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The plan of every conversation as (conv, plan), then its repaired messages as (conv, edit, turn, role, text)."""
    key, plan, place, last = None, None, 0, NONE

    def inserts() -> Iterator[tuple]:
        nonlocal place, last
        while plan and place < len(plan["audit"]) and plan["audit"][place] == "I":
            place, last = place + 1, AFTER[last]
            yield key, "I", None, NAME[last], ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["plan"] is not None:
                yield from inserts()
                key, plan, place, last = row["conv"], row["plan"], 0, NONE
                yield key, plan
                continue
            for _ in range(row["copies"]):
                yield from inserts()
                edit, place = plan["audit"][place], place + 1
                if edit == "D":
                    continue
                system = edit == "K" and last == NONE and row["role"][:1] == "s"
                last = SYSTEM if system else AFTER[last]
                yield key, edit, row["turn"], row["role"] if edit == "K" else NAME[last], row["text"]
    yield from inserts()


def repaired_messages(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The messages that the plans leave: conv, place from 0, edit, turn (null for inserted ones), role, text."""
    schema = T.StructType([
        rows.schema["conv"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), rows.schema["turn"],
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    ])
    arrow = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for found in _edited(batches):
            if len(found) == 2:
                number = 0
                continue
            held.append([found[0], number, *found[1:]])
            number += 1
            if len(held) == BATCH:
                yield _batch(held, arrow)
                held = []
        yield _batch(held, arrow)

    return _beside_plans(rows, plans).mapInArrow(work, schema)


def with_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with `repaired_sha256` of the repaired messages as lines `role:text`; the digest follows the stream, nothing is gathered."""
    schema = T.StructType([rows.schema["conv"], *(T.StructField(*x) for x in PLAN), T.StructField("repaired_sha256", T.StringType())])
    arrow = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = [], None
        for found in _edited(batches):
            if len(found) == 2:
                if digest:
                    held[-1].append(digest.hexdigest())
                if len(held) >= BATCH:
                    yield _batch(held, arrow)
                    held = []
                held.append([found[0], *(found[1][name] for name, _ in PLAN)])
                digest, first = hashlib.sha256(), True
            else:
                digest.update(f"{'' if first else '\n'}{found[3]}:{found[4]}".encode())
                first = False
        if digest:
            held[-1].append(digest.hexdigest())
        yield _batch(held, arrow)

    return _beside_plans(rows, plans).mapInArrow(work, schema)
