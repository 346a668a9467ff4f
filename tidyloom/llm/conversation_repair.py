"""Repair of the turn structure of conversations by a generalised LR parser.

A good conversation is empty, or a system turn that may be missing and then pairs
of a user and an assistant turn. The rows of a conversation, in order of their
turn (NULL first; equal turns by role and text), are its input; the parser may keep a row (0), give it
the role of a user or assistant (2), delete it (3), or insert an empty user or
assistant turn before the next row or at the end (2). Blank rows and rows that repeat an earlier role
and text have to be deleted, and a row that stops in the middle of a sentence
costs 1 more if it stays. All ways are parsed at once on a graph-structured
stack: stacks share what lies below, and those with equal tops are merged to the
one with the smallest (cost, audit), where the audit has a letter for each edit
in order (Delete, Insert, Keep, Rerole). What may follow depends on the top alone
in this grammar, and no audit that ends with the same row begins another one, so
the merged way is the cheapest and, among those, the smallest in ASCII order.

A conversation is read by one task (its result is one audit and one hash), but as
a stream that Spark sorts: of a row only the few bytes that tell the edits are
held, never its text. Rows of all stacks are hashed as they come.

NULL roles and texts are one space, so such a row is blank or has no role of the
grammar. NULL keys are a conversation of their own. Rows that repeat are
duplicates. Without rows there is an empty audit, zeros and the hash of the empty
text; an empty table gives no rows; other columns are not read, whatever their
names. Roles count by their first character, as they are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import col

BLANKS = r"[\x20\x09-\x0D]"
#: Costs of the edits by their letters, and of keeping a row that is cut off.
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
CUT_OFF = 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

# The LR automaton of  C -> (nothing) | s P | P    P -> P u a | u a
SHIFT = {
    0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 5}, 3: {"u": 6}, 4: {"u": 6}, 6: {"a": 7},
}
GOTO = {0: 3, 1: 4}
#: Symbols that a complete pair takes off the stack, by the state on top.
REDUCE = {5: 2, 7: 3}
ACCEPT = {0, 3, 4}
TOPS = (0, 1, 2, 5, 6, 7)


class Stack:
    """A node of the graph: a state, the stack below it, and the least way to get here.

    ``rank`` orders the audits up to the last row, ``since`` are the edits after it
    and ``roles`` the turns that they make.
    """

    __slots__ = ("state", "below", "cost", "rank", "since", "roles", "base")

    def __init__(self, state, below, cost, rank, since, roles, base):
        self.state, self.below, self.cost, self.rank = state, below, cost, rank
        self.since, self.roles, self.base = since, roles, base

    def key(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.since

    def reduced(self) -> Stack:
        """The stack with complete pairs replaced by their symbol."""
        if self.state not in REDUCE:
            return self
        below = self
        for _ in range(REDUCE[self.state]):
            below = below.below
        return Stack(GOTO[below.state], below, self.cost, self.rank, self.since, self.roles, self.base)

    def shifted(self, role: str, edit: str, cost: int) -> Stack | None:
        top = self.reduced()
        state = SHIFT.get(top.state, {}).get(role)
        if state is None:
            return None
        return Stack(state, top, self.cost + cost, self.rank, self.since + edit, self.roles + role, self.base)


class Parser:
    """All stacks of a conversation after the rows so far."""

    def __init__(self):
        start = Stack(0, None, 0, 0, "", "", -1)
        self.tops: dict[int, Stack] = {0: start}
        # For each row and each state: the state before it, and the code of its edits.
        self.trail = bytearray()
        self.codes: list[tuple[str, str]] = []
        self.code_of: dict[tuple[str, str], int] = {}
        self.hashes = {0: (hashlib.sha256(), True)}

    @staticmethod
    def merge(tops: dict[int, Stack], stack: Stack | None) -> bool:
        if stack is None or (stack.state in tops and tops[stack.state].key() <= stack.key()):
            return False
        tops[stack.state] = stack
        return True

    def inserted(self) -> dict[int, Stack]:
        """The stacks with all insertions that can pay."""
        tops = dict(self.tops)
        open_ = list(tops.values())
        while open_:
            stack = open_.pop(0)
            for role in ROLES:
                new = stack.shifted(role, "I", COST["I"])
                if self.merge(tops, new):
                    open_.append(new)
        return tops

    def row(self, role: str, text: str, must_go: bool, cut_off: bool) -> None:
        found: dict[int, Stack] = {}
        for stack in self.inserted().values():
            gone = Stack(stack.state, stack.below, stack.cost + COST["D"], stack.rank, stack.since + "D", stack.roles, stack.base)
            self.merge(found, gone)
            if must_go:
                continue
            more = CUT_OFF if cut_off else 0
            self.merge(found, stack.shifted(role[:1], "K", COST["K"] + more))
            for new in ROLES:
                self.merge(found, stack.shifted(new, "R", COST["R"] + more))
        self.advance(found, role, text)

    def advance(self, found: dict[int, Stack], role: str, text: str) -> None:
        """Take the stacks after a row as the new ones; remember how each came about."""
        order = sorted(found.values(), key=lambda s: (s.rank, s.since))
        hashes, at = {}, {s: 255 for s in TOPS}
        step = bytearray(2 * len(TOPS))
        self.tops = {}
        for rank, s in enumerate(order):
            how = (s.since, s.roles)
            if how not in self.code_of:
                self.code_of[how] = len(self.codes)
                self.codes.append(how)
            before = 0 if s.base < 0 else s.base
            i = TOPS.index(s.state)
            step[2 * i], step[2 * i + 1] = TOPS.index(before), self.code_of[how]
            hashes[s.state] = hashed(self.hashes[before], s.since, s.roles, role, text)
            self.tops[s.state] = Stack(s.state, s.below, s.cost, rank, "", "", s.state)
        self.trail += step
        self.hashes = hashes

    def result(self) -> tuple[int, str, str, str]:
        """Cost, audit, the roles of all turns, and the hash of the repaired conversation."""
        best = min((s for s in self.inserted().values() if s.reduced().state in ACCEPT), key=Stack.key)
        before = 0 if best.base < 0 else best.base
        digest, _ = hashed(self.hashes[before], best.since, best.roles, "", "")
        edits, roles = [best.since], [best.roles]
        width, i = 2 * len(TOPS), TOPS.index(before)
        for at in range(len(self.trail) - width, -1, -width):
            since, made = self.codes[self.trail[at + 2 * i + 1]]
            edits.append(since)
            roles.append(made)
            i = self.trail[at + 2 * i]
        return best.cost, "".join(reversed(edits)), "".join(reversed(roles)), digest.hexdigest()


def hashed(state, edits: str, made: str, role: str, text: str):
    """The hash of a repaired conversation after some more edits."""
    digest, empty = state
    if made:
        digest = digest.copy()
    for line in lines(edits, made, role, text):
        digest.update((line[0] + ":" + line[1] if empty else "\n" + line[0] + ":" + line[1]).encode("utf-8", "surrogatepass"))
        empty = False
    return digest, empty


def lines(edits: str, made: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """Role, text and edit of the turns that some edits around one row make."""
    places = iter(made)
    for edit in edits:
        if edit == "D":
            continue
        new = next(places)
        if edit == "I":
            yield ROLES[new], "", edit
        else:
            yield (role if edit == "K" else ROLES[new]), text, edit


# --- conversations -----------------------------------------------------------------------


def text_or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
    """Rows with faults by a checksum of key and turn; a dropped row stays with ``dropped`` set."""
    key, turn, role, text = col(id_col), col(turn_col), text_or_space(col(role_col)), text_or_space(col(text_col))
    kind = F.crc32(F.concat(text_or_space(key), F.lit(":"), text_or_space(turn))) % 20
    worse = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return df.select(
        key.alias("conv_id"), turn.cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"), worse.alias("text"), (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def in_order(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` with faults, the rows of a conversation in order in one partition."""
    rows = df.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), text_or_space(F.col("role")).alias("role"),
        text_or_space(F.col("text")).alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"),
    ).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy("turn")
    blank = ~F.col("text").rlike(BLANKS.replace("[", "[^"))
    whole = F.col("text").rlike(rf"[.!?]{BLANKS}*\z")
    fault = F.when(blank, "b").when(F.row_number().over(earlier) > 1, "d").when(~whole, "t").otherwise("")
    return rows.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text")


class Counts:
    """What is told of a conversation's rows as they are."""

    def __init__(self):
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.initial = None

    def row(self, turn: int | None, role: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


REPAIRS = {
    "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
    "cost": "bigint", "audit": "string", "roles": "string", "repaired_sha256": "string",
}


def repair_conversations(df: DataFrame) -> DataFrame:
    """A row for each conversation of ``conv_id, turn, role, text, dropped``: faults, edits and hash.

    ``audit`` has a letter for each edit, ``roles`` one for each repaired turn.
    Dropped rows count for nothing, but their conversation is told.
    """
    kind = dict(df.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parser, counts, out = None, None, None, []

        def told() -> tuple:
            cost, audit, roles, digest = parser.result()
            f = counts.faults
            return now[0], counts.gaps(), f["b"], f["d"], f["t"], counts.illegal, cost, audit, roles, digest

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [pa.int64()] * 6 + [pa.string()] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_type), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["conv_id", *REPAIRS]
            )

        for b in batches:
            key_type = b.schema.field(0).type
            for key, turn, role, text, dropped, fault in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != key:
                    if now is not None:
                        out.append(told())
                        if len(out) >= 1000:
                            yield batch()
                            out.clear()
                    now, parser, counts = (key,), Parser(), Counts()
                if not dropped:
                    counts.row(turn, role, fault)
                    parser.row(role, text, fault in ("b", "d"), fault == "t")
        if now is not None:
            out.append(told())
            yield batch()

    return in_order(df).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in REPAIRS.items()))


def repaired_turns(df: DataFrame, repairs: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit``: the turns of the repaired conversations, from 0 on."""
    kind = dict(df.dtypes)["conv_id"]
    rows = in_order(df).where("NOT dropped").withColumns({"audit": F.lit(None).cast("string"), "roles": F.lit(None).cast("string")})
    first = repairs.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(False).alias("dropped"), F.lit("").alias("fault"), "audit", "roles",
    )
    both = rows.unionByName(first).withColumn("row", F.col("audit").isNull()).repartition("conv_id")
    stream = both.sortWithinPartitions("conv_id", "row", "turn", "role", "text").select("conv_id", "role", "text", "audit", "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit = roles = ""
        at = made = 0
        now: list = []
        for b in batches:
            out = []

            def put(edit: str, role: str, text: str) -> None:
                nonlocal made
                if edit != "D":
                    (found,) = lines(edit, roles[made], role, text)
                    out.append((now[0], made, *found))
                    made += 1

            for key, role, text, new_audit, new_roles in zip(*(c.to_pylist() for c in b.columns)):
                if new_audit is not None:
                    audit, roles, at, made, now = new_audit, new_roles, 0, 0, [key]
                else:
                    put(audit[at], role, text)
                    at += 1
                # Insertions stand before the row that they precede, or at the end.
                while at < len(audit) and audit[at] == "I":
                    put("I", "", "")
                    at += 1
            if out:
                columns = list(zip(*out))
                types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "place", "role", "text", "edit"])

    return stream.mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string, edit string")
