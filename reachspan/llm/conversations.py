"""Conversation structure repair: the cheapest edits that give every conversation legal turns.

Grammar of role initials: nothing, or an optional system turn and then user and assistant in turn.  Its four states (start, after
system, after user, after assistant) are the bits of a set.  From the last turn to the first, each turn has one such set for every
increasing cost: the states from which the rest can be made legal at that cost, reached from the sets of the turn
after it by keeping, changing or deleting, and from cheaper sets of its own by inserting.  The first layer that holds the start state gives
the cost; following the bits from there, smallest initial first, gives the least audit.

Any two states differ by at most `WIDTH` - 1 in cost (one can be led into the other by two inserts, or by a deletion and an insert), so a turn's
layers fit one small integer beside their lowest cost, and there are few different ones: a row costs two lookups.

Scale: texts are shuffled twice, first by ranges of (conversation, turn, ...), so that a conversation of any length is spread over
tasks, then by conversation for the digest of the repaired text, which is sequential by nature: rows are streamed past it, sorted by Spark, and
only the conversation's audit is held, one byte a row, as in the result.  Repeats are found by an aggregate on (conversation, digest of role and text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches, written

KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
WIDTH = 8
ROLES = {"u": "user", "a": "assistant"}
#: Codes of rows: four times the fault plus the role's initial (s, u, a, other).
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
_INITIALS = "sua"
#: State after an initial in a state; what is missing is not legal.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one turn of user or assistant that is legal in each state.
_LEGAL = "uuau"
_BEFORE = {x: [[q for q in range(4) if _NEXT.get((q, x)) == to] for to in range(4)] for x in "sua"}


def _preimage(states: int, initials: str) -> int:
    """The states that one of the initials leads into one of a set."""
    return sum({1 << q for x in initials for to in range(4) if states >> to & 1 for q in _BEFORE[x][to]})


class Layers:
    """The layers of turns as a finite automaton over their different values, built as they are met."""

    def __init__(self):
        self.values: list[list[int]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self._number(self._closed([0b1001]))[0]

    @staticmethod
    def _closed(layers: list[int]) -> list[int]:
        """Adds inserts, cheapest layers first; a state stays in its first layer only."""
        out, seen, cost = [], 0, 0
        while seen != 15:
            new = layers[cost] if cost < len(layers) else 0
            if cost >= INSERT:
                new |= _preimage(out[cost - INSERT], "ua")
            out.append(new & ~seen)
            seen |= new
            cost += 1
        return out

    def _number(self, layers: list[int]) -> tuple[int, int]:
        """The number of the layers without their empty first ones, and how many these were."""
        empty = next(c for c, states in enumerate(layers) if states)
        key = tuple(layers[empty:])
        if len(key) > WIDTH:
            raise AssertionError("layers are wider than proven")
        if key not in self.known:
            self.known[key] = len(self.values)
            self.values.append([next(c for c, states in enumerate(key) if states >> q & 1) for q in range(4)])
        return self.known[key], empty

    def before(self, after: int, code: int) -> tuple[int, int]:
        """Layers at a row from those after it: their number, and by how much their lowest cost rises."""
        if (after, code) not in self.steps:
            costs, fault, initial = self.values[after], code >> 2, _INITIALS[code & 3 : (code & 3) + 1]
            layers = [0] * (2 * WIDTH)
            for q, cost in enumerate(costs):
                layers[cost + DELETE] |= 1 << q
                if fault < BLANK:
                    extra = KEEP_TRUNCATED * (fault == TRUNCATED)
                    layers[cost + extra] |= _preimage(1 << q, initial)
                    layers[cost + REROLE + extra] |= _preimage(1 << q, "ua")
            self.steps[after, code] = self._number(self._closed(layers))
        return self.steps[after, code]

    def trace(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The least initials that lead past a row at lowest cost, and the state then.  Delete, Insert, Keep, Rerole are in ASCII order."""
        if (after, code, state) not in self.traces:
            own, rise = self.before(after, code)
            here, there, fault, initial = self.values[own], self.values[after], code >> 2, _INITIALS[code & 3 : (code & 3) + 1]
            extra, out, q = KEEP_TRUNCATED * (fault == TRUNCATED), "", state
            while True:
                left, legal = here[q] + rise, _NEXT[q, _LEGAL[q]]
                if there[q] + DELETE == left:
                    out, to = out + "D", q
                elif here[legal] + rise + INSERT == left:
                    out, q = out + "I", legal
                    continue
                elif fault < BLANK and (q, initial) in _NEXT and there[_NEXT[q, initial]] + extra == left:
                    out, to = out + "K", _NEXT[q, initial]
                else:
                    out, to = out + "R", legal
                break
            self.traces[after, code, state] = out, to
        return self.traces[after, code, state]

    def least(self, codes: bytes) -> tuple[int, str]:
        """Cost and least audit of a conversation's rows."""
        own, total, values = self.end, 0, bytearray(len(codes) + 1)
        values[-1] = own
        for i in range(len(codes) - 1, -1, -1):
            own, rise = self.before(own, codes[i])
            values[i] = own
            total += rise
        total += self.values[own][0]
        state, parts = 0, []
        for i, code in enumerate(codes):
            edits, state = self.trace(values[i + 1], code, state)
            parts.append(edits)
        while self.values[self.end][state]:
            parts.append("I")
            state = _NEXT[state, _LEGAL[state]]
        return total, "".join(parts)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the query's damage by crc32(`conv_id:turn`) % 20; nulls in strings become one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of rows (conv_id, turn, role, text).

    Rows go by turn, nulls first; rows of one turn by role, then by text (its first 256 characters, then its digest).  Null roles and texts are one space, so such a
    text is blank.  Rows without conv_id are one conversation.  `every` (conv_id) adds conversations without rows: zeros, an empty audit and the digest of nothing.
    Empty tables give empty results.  Very long texts are streamed row by row.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    # equal rows may go to several ranges: which of them is first does not matter
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.col("head"), F.col("digest"), F.col("salt")]
    keyed = own.select("*", F.substring("text", 1, 256).alias("head"), digest.alias("digest"), F.monotonically_increasing_id().alias("salt"))
    placed = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at")))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    # instr finds an empty initial at the first place
    role = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    light = placed.select("conv", "turn", "at", "digest", fault.alias("fault"), role.alias("role"))
    firsts = light.where(F.col("fault") != BLANK).groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "first")
    known = light.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")) & (F.col("fault") != BLANK), "left")
    code = (F.when(F.col("at") > F.col("first"), DUPLICATE).otherwise(F.col("fault")) * 4 + F.col("role")).cast("byte")
    none = (own if every is None else every).select(F.col("conv" if every is None else "conv_id").cast("long").alias("conv")).distinct()
    coded = known.select("conv", "at", "turn", code.alias("code")).unionByName(none.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), F.lit(-1).cast("byte").alias("code")))
    audits = coded.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_audited, _AUDIT)
    first = audits.select("conv", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*_FOUND, "audit").alias("found"))
    rows = first.unionByName(placed.select("conv", "at", "role", "text", F.lit(None).cast(first.schema["found"].dataType).alias("found")))
    small_batches(conversations.sparkSession)
    return rows.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_repaired, _RESULT)


_FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_AUDIT = "conv long, " + ", ".join(f"{c} long" for c in _FOUND) + ", audit string"
_RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in _FOUND) + ", audit string, repaired_sha256 string"
_PAIRS = np.ones((4, 4), bool)
_PAIRS[[0, 1, 2], [1, 2, 1]] = False


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows sorted by it, of which the first has code -1."""
    layers, schema = Layers(), pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in _FOUND), ("audit", pa.string())])
    conv, codes, turns, open_ = None, bytearray(), (None, None, 0), False

    def closed() -> tuple:
        code = np.frombuffer(bytes(codes), np.uint8)
        fault, role = code >> 2, code & 3
        cost, audit = layers.least(bytes(codes))
        low, high, different = turns
        return conv, (high - low + 1 - different) if different else 0, int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()), int((fault == TRUNCATED).sum()), int(_PAIRS[role[:-1], role[1:]].sum()), cost, audit

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("conv")
        code, turn = batch.column("code").to_numpy(zero_copy_only=False), batch.column("turn")
        present, turn = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy()
        heads, out = np.flatnonzero(code == -1), []
        for begin, end in zip([0, *heads.tolist()], [*heads.tolist(), len(code)], strict=True):
            if begin == end:
                continue
            if code[begin] == -1:
                if open_:
                    out.append(closed())
                conv, codes, turns, open_ = names[begin].as_py(), bytearray(), (None, None, 0), True
                begin += 1
            codes += code[begin:end].astype(np.uint8).tobytes()
            if len(own := turn[begin:end][present[begin:end]]):
                low, high, different = turns
                different += int((np.diff(own) != 0).sum()) + (not different or int(own[0]) != high)
                turns = int(own[0]) if low is None else low, int(own[-1]), different
        if out:
            yield table(out)
    if open_:
        yield table([closed()])


class _Repair:
    """The digest of a conversation's repaired rows, as its rows come."""

    def __init__(self, conv, found: dict):
        self.conv, self.found, self.audit, self.at, self.state, self.first, self.sum = conv, found, found["audit"], 0, 0, True, hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.sum.update(b"" if self.first else b"\n")
        self.sum.update(f"{role}:{text}".encode())
        self.first = False
        self.state = _NEXT[self.state, role[:1]]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(ROLES[_LEGAL[self.state]], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._put(role, text)
        elif edit == "R":
            self._put(ROLES[_LEGAL[self.state]], text)

    def result(self) -> tuple:
        self.inserted()
        return (self.conv, *(self.found[c] for c in _FOUND), self.audit, self.sum.hexdigest())


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _FOUND), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    own = None
    for batch in batches:
        out = []
        for conv, found, role, text in zip(*(batch.column(c) for c in ("conv", "found", "role", "text")), strict=True):
            if found.is_valid:
                if own is not None:
                    out.append(own.result())
                own = _Repair(conv.as_py(), found.as_py())
            else:
                own.row(role.as_py(), text.as_py())
        if out:
            yield table(out)
    if own is not None:
        yield table([own.result()])
