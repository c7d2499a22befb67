"""Repair of conversations by a forward Viterbi pass over four grammar states.

The repaired role initials must read ``(s?(ua)+)?``; the states are the start, after a system, a user and an assistant turn. Each
turn's layer carries, for every state, the least (cost, audit string), and is closed by insertions, of which two at most are
useful in a row. The passes are associative over stretches of turns, so a conversation needn't lie in one task: turns are
dealt by ranges of (conversation, turn, role, text hash), each task walks its sorted turns and emits pieces of bounded size, and a
piece that doesn't begin its conversation carries the least (cost, audit) from each entry state to each exit state. A second,
narrow pass follows a conversation's pieces and picks the states at their borders.

Repeated turns are found by counts of narrow keys: markers of the later ones go through the ranges beside the turns.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, join_with_hot, tidy

START, SYSTEM, USER, ASSISTANT = range(4)
SPACES = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
MOST_PARTITIONS = 20_000
FACTS = ["rows", "blank", "duplicate", "truncated", "illegal"]

Path = tuple[int, str] | None


def close(states: list[Path]) -> list[Path]:
    """The layer with insertions: a user turn from any other state, then an assistant turn from there."""
    start, system, user, assistant = states
    for x in (start, system, assistant):
        if x is not None:
            y = (x[0] + INSERT, x[1] + "I")
            if user is None or y < user:
                user = y
    if user is not None:
        y = (user[0] + INSERT, user[1] + "I")
        if assistant is None or y < assistant:
            assistant = y
    return [start, system, user, assistant]


def turn_layer(states: list[Path], initial: str, dead: bool, cut: bool) -> list[Path]:
    """The layer behind one turn: deleted, or (if it isn't dead) kept or given the role that fits."""
    out: list[Path] = [None if x is None else (x[0] + DELETE, x[1] + "D") for x in states]
    if not dead:
        more = TRUNCATED if cut else 0
        start = states[START]
        if start is not None and initial == "s":
            y = (start[0] + more, start[1] + "K")
            if out[SYSTEM] is None or y < out[SYSTEM]:
                out[SYSTEM] = y
        cost, letter = (more, "K") if initial == "u" else (more + REROLE, "R")
        for x in (start, states[SYSTEM], states[ASSISTANT]):
            if x is not None:
                y = (x[0] + cost, x[1] + letter)
                if out[USER] is None or y < out[USER]:
                    out[USER] = y
        cost, letter = (more, "K") if initial == "a" else (more + REROLE, "R")
        if (x := states[USER]) is not None:
            y = (x[0] + cost, x[1] + letter)
            if out[ASSISTANT] is None or y < out[ASSISTANT]:
                out[ASSISTANT] = y
    return close(out)


class Pass:
    """The paths from one entry. What all audits share is put aside, so that only their short ends are compared and copied.

    Equally dear audits of one state are never each other's beginning (they'd differ by insertions), so ends decide.
    """

    def __init__(self, states: list[Path]):
        self.states, self.shared = states, []

    def turn(self, initial: str, dead: bool, cut: bool) -> None:
        self.states = turn_layer(self.states, initial, dead, cut)
        if any(x is not None and len(x[1]) > 96 for x in self.states):
            self.settle()

    def settle(self) -> None:
        common = os.path.commonprefix([x[1] for x in self.states if x is not None])
        if common:
            self.shared.append(common)
            self.states = [None if x is None else (x[0], x[1][len(common) :]) for x in self.states]

    def exits(self) -> list[Path]:
        head = "".join(self.shared)
        return [None if x is None else (x[0], head + x[1]) for x in self.states]


def entry(state: int) -> list[Path]:
    return [(0, "") if i == state else None for i in range(4)]


class Piece:
    """A stretch of one conversation's turns: counts, and the paths through it."""

    def __init__(self, conv, begins: bool):
        self.conv, self.begins = conv, begins
        self.passes = [Pass(close(entry(START)))] if begins else [Pass(entry(s)) for s in range(4)]
        self.roles: list[str | None] = []
        self.texts: list[str | None] = []
        self.count = dict.fromkeys(FACTS, 0)
        self.bytes = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        initial, body = role[:1], text.strip(SPACES)
        blank = not body
        cut = not blank and not repeated and body[-1] not in ".!?"
        dead = blank or repeated
        count = self.count
        count["rows"] += 1
        count["blank" if blank else "duplicate"] += dead
        count["truncated"] += cut
        if self.last is None:
            self.first = initial
        else:
            count["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        for p in self.passes:
            p.turn(initial, dead, cut)
        self.roles.append(None if dead else role)
        self.texts.append(None if dead else text)
        self.bytes += 0 if dead else len(role) + len(text)

    def row(self, part: int, number: int, ends: bool) -> tuple:
        paths = [x for p in self.passes for x in p.exits()]
        return (
            self.conv, part, number, self.begins, self.begins and ends, *self.count.values(), self.low, self.high, self.distinct, self.first, self.last,
            [None if x is None else x[0] for x in paths], [None if x is None else x[1] for x in paths], self.roles, self.texts,
        )


def _arrow(spark_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}[spark_type]


PIECE = (
    [("part", "int"), ("number", "bigint"), ("begins", "boolean"), ("whole", "boolean")] + [(x, "bigint") for x in FACTS]
    + [("low", "bigint"), ("high", "bigint"), ("distinct", "bigint"), ("first", "string"), ("last", "string"), ("costs", "array<bigint>"), ("audits", "array<string>"), ("roles", "array<string>"), ("texts", "array<string>")]
)
BORDER = [("part", "int"), ("number", "bigint"), ("piece", "bigint"), ("pieces", "bigint"), ("entry", "int"), ("exit", "int"), ("cost", "bigint"), ("gaps", "bigint")] + [("all_" + x, "bigint") for x in FACTS[1:]]


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)


def _batch(rows: list[tuple], conv: pa.DataType, fields: list[tuple[str, str]], named: bool = True) -> pa.RecordBatch:
    kinds = ([conv] if named else []) + [_arrow(kind) for _, kind in fields]
    names = (["conv_id"] if named else []) + [name for name, _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names)


def _walk_pieces(piece_rows: int, piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, piece, kind = TaskContext.get().partitionId(), 0, None, None
        marked = seen = None
        out: list[tuple] = []
        held = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, sha, mark, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        out.append(piece.row(part, number, True))
                        held, number = held + piece.bytes, number + 1
                    # the range's first conversation may have begun in another range
                    piece, marked, seen = Piece(conv, piece is not None), None, None
                key = (turn, role, sha)
                if not mark:
                    marked = key
                    continue
                for _ in range(copies):
                    if piece.count["rows"] >= piece_rows or piece.bytes >= piece_bytes:
                        out.append(piece.row(part, number, False))
                        held, number, piece = held + piece.bytes, number + 1, Piece(conv, False)
                    piece.add(turn, role, text, key == seen or key == marked)
                    seen = key
                    if held > piece_bytes or len(out) >= 4096:
                        yield _batch(out, kind, PIECE)
                        out, held = [], 0
        if piece is not None:
            out.append(piece.row(part, number, False))
            yield _batch(out, kind, PIECE)

    return run


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border states of conversations in several pieces, from pieces sorted by conversation and place.

    For each piece and state it keeps the entry state the least path came from, nothing else that grows.
    """
    out: list[tuple] = []
    conv = vector = None
    begun = False

    def finish() -> None:
        best = min((START, ASSISTANT), key=lambda s: vector.states[s] or (1 << 62, ""))
        cost, state, ways = vector.states[best][0], best, []
        for places, back in reversed(steps):
            ways.append((places, back[state], state))
            state = back[state]
        gaps = high - low + 1 - distinct if low is not None else 0
        for i, (places, came, went) in enumerate(reversed(ways)):
            out.append((*places, i, len(ways), came, went, cost, gaps, *total.values()))

    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["conv_id"] != conv:
                if begun:
                    finish()
                begun, conv, vector, steps, total = True, row["conv_id"], Pass(close(entry(START))), [], dict.fromkeys(FACTS[1:], 0)
                low = high = last = None
                distinct = 0
            costs, audits = row["costs"], row["audits"]
            if row["begins"]:
                states, back = [None if c is None else (c, a) for c, a in zip(costs, audits)], [START] * 4
            else:
                states, back = [None] * 4, [START] * 4
                for exit_ in range(4):
                    for came in range(4):
                        x, c = vector.states[came], costs[4 * came + exit_]
                        if x is not None and c is not None:
                            y = (x[0] + c, x[1] + audits[4 * came + exit_])
                            if states[exit_] is None or y < states[exit_]:
                                states[exit_], back[exit_] = y, came
            vector.states = states
            vector.settle()
            vector.shared.clear()
            steps.append(((row["part"], row["number"]), back))
            for x in total:
                total[x] += row[x]
            if row["rows"]:
                total["illegal"] += last is not None and last + row["first"] not in ("su", "ua", "au")
                last = row["last"]
            if row["low"] is not None:
                distinct += row["distinct"] - (high == row["low"])
                low = row["low"] if low is None else low
                high = row["high"]
        if len(out) > 4096:
            yield _batch(out, None, BORDER, False)
            out.clear()
    if begun:
        finish()
    if out:
        yield _batch(out, None, BORDER, False)


def path_through(begins: bool, piece: int, entry_: int, exit_: int, audits: list[str | None]) -> str:
    """The audit of a piece between its border states; a first piece that couldn't know it was first starts with insertions."""
    if begins:
        return audits[exit_]
    lead = "I" * max(0, entry_ - SYSTEM) if piece == 0 else ""
    return lead + audits[4 * entry_ + exit_]


def apply_audit(audit: str, state: int, roles: list[str | None], texts: list[str | None]) -> list[dict[str, str]]:
    """The repaired turns that an audit makes of the turns, from a state on."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        fitting = "assistant" if state == USER else "user"
        role, text = fitting, ""
        if letter != "I":
            role, text = (roles[at] if letter == "K" else fitting), texts[at]
            at += 1
        out.append({"role": role, "text": text})
        state = ASSISTANT if state == USER else SYSTEM if letter == "K" and role[0] == "s" else USER
    return out


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, turns = [], []
        for begins, piece, came, went, paths, roles, texts in zip(*(batch.column(x).to_pylist() for x in ("begins", "piece", "entry", "exit", "audits", "roles", "texts"))):
            audit = path_through(begins, piece, came, went, paths)
            audits.append(audit)
            turns.append(apply_audit(audit, START if piece == 0 else came, roles, texts))
        keep = ["conv_id", "piece", "pieces", "gaps", *FACTS[1:], "cost"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(audits, pa.string()), pa.array(turns, TURNS)], [*keep, "audit", "turns"])


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None,
    piece_rows: int = 4096, piece_bytes: int = 4 << 20, partitions: int | None = None,
) -> DataFrame:
    """conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, turns array<struct<role, text>>.

    One row for each piece of a conversation, nearly always the only one: ``audit`` and ``turns`` (the repaired turns) are the piece's, the
    counts and the cost the whole conversation's. Turns go by ``turn`` (null first), then role, then the SHA-256 of the text, so the
    order of different rows of one turn is defined, and equal rows are adjacent. Keeping a turn costs 0, another role 1, deletion 2 (the only
    choice for blank and repeated turns), an inserted empty turn 5, a truncated turn that stays 5 more; of equally cheap audits the ASCII-least.

    ``copies`` names an integer column: how often a row stands there; a conversation all of whose rows have 0 copies gives zeros and
    an empty audit. A null role or text counts as empty; a null conv_id is a conversation; an empty table gives no row; very long texts are
    carried as they are; other columns are not read. A turn of many equal rows is counted before it is shuffled.
    """
    spark = rows.sparkSession
    configure(spark)
    scratch = Scratch(spark)
    kind = rows.schema[conv_id].dataType.simpleString()
    base = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.lit(1) if copies is None else F.coalesce(F.col(copies), F.lit(0))).cast("long").alias("copies"),
    )
    there = F.col("copies") > 0
    base = base.select("conv_id", "turn", F.when(there, F.col("role")).otherwise("").alias("role"), F.when(there, F.col("text")).otherwise("").alias("text"), "copies")
    name = F.col("conv_id").cast("string")
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    base = base.select("conv_id", "turn", "role", sha, "copies", "text")
    key = F.sha2(F.concat(F.coalesce(F.length(name), F.lit(-1)), F.lit(":"), F.coalesce(name, F.lit("")), F.lit(":"), F.col("role"), F.hex("sha")), 256)

    # narrow: how often each (conversation, turn, role, text) stands there, and the first turn of each (conversation, role, text)
    counted = base.filter(there).groupBy("conv_id", "turn", "role", "sha").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    counted = scratch.stash(counted, "counted")
    total = counted.agg(F.count(F.lit(1)), F.sum("copies")).first()
    when = F.struct(F.col("turn").isNotNull(), "turn")
    again = counted.groupBy("key").agg(F.min(when).alias("begun"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = scratch.stash(again, "again")
    later = join_with_hot(counted, again, "key", "times", total[0]).filter(when > F.col("begun"))
    later = later.select("conv_id", "turn", "role", "sha", F.lit(0).alias("mark"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("text"))
    hot = counted.filter(F.col("copies") > (total[1] or 0) // 1000).select(F.sha2(F.concat_ws(":", "key", "turn"), 256).alias("hot"))  # under a thousand rows
    place = F.sha2(F.concat_ws(":", key, "turn"), 256)
    cold = base.join(F.broadcast(hot), place == F.col("hot"), "left_anti")
    packed = base.join(F.broadcast(hot), place == F.col("hot"), "left_semi").groupBy("conv_id", "turn", "role", "sha").agg(F.sum("copies").alias("copies"), F.max("text").alias("text"))
    both = cold.unionByName(packed).withColumn("mark", F.lit(1)).unionByName(later).select("conv_id", "turn", "role", "sha", "mark", "copies", "text")

    if partitions is None:
        size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = min(MOST_PARTITIONS, max(spark.sparkContext.defaultParallelism, -(-size // (32 << 20))))
    order = ["conv_id", "turn", "role", "sha"]
    ranged = both.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "mark")
    pieces = scratch.stash(ranged.mapInArrow(tidy(_walk_pieces(piece_rows, piece_bytes)), f"conv_id {kind}, {_ddl(PIECE)}"), "pieces")

    parts = pieces.filter(~F.col("whole")).drop("roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    borders = scratch.stash(parts.mapInArrow(_follow, _ddl(BORDER)), "borders")
    joined = pieces.filter(~F.col("whole")).join(borders, ["part", "number"]).select(
        "conv_id", "begins", "piece", "pieces", "gaps", *(F.col("all_" + x).alias(x) for x in FACTS[1:]), "cost", "entry", "exit", "audits", "roles", "texts"
    )
    worth = lambda s: F.when(F.col("costs")[s].isNotNull(), F.struct(F.col("costs")[s].alias("cost"), F.col("audits")[s].alias("audit"), F.lit(s).alias("exit")))
    single = pieces.filter("whole").withColumn("best", F.array_min(F.array(worth(START), worth(ASSISTANT)))).select(
        "conv_id", "begins", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps"),
        *FACTS[1:], "best.cost", F.lit(START).alias("entry"), "best.exit", "audits", "roles", "texts",
    )
    fields = ", ".join(f"{x} long" for x in ["piece", "pieces", "gaps", *FACTS[1:], "cost"])
    return single.unionByName(joined).mapInArrow(tidy(_apply), f"conv_id {kind}, {fields}, audit string, turns array<struct<role: string, text: string>>")


def _digest(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        sha = None
        for batch in batches:
            for conv, piece, turns, body, audit in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "piece", "n", "body", "audit"))):
                if piece == 0:
                    if sha is not None:
                        out.append((name, "".join(audits), sha.hexdigest()))
                    name, audits, sha, some = conv, [], hashlib.sha256(), False
                audits.append(audit)
                if turns:
                    sha.update((b"\n" if some else b"") + body.encode())
                    some = True
        if sha is not None:
            out.append((name, "".join(audits), sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), (batch.schema.field(0).type, pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"])

    return run


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: its counts and cost, the whole audit, and the SHA-256 of its repaired ``role:text`` lines.

    Expressions do it for conversations of one piece. A hash over several pieces must read them in turn, so those of a conversation stream
    through one task, a row for each piece; the audit, a letter for each turn, is what grows with the conversation there.
    """
    numbers = ["gaps", *FACTS[1:], "cost"]
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = pieces.filter("pieces = 1").select("conv_id", *numbers, "audit", F.sha2(body, 256).alias("repaired_sha256"))
    parts = pieces.filter("pieces > 1").select("conv_id", "piece", F.size("turns").alias("n"), body.alias("body"), "audit")
    kind = pieces.schema["conv_id"].dataType.simpleString()
    digests = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_digest(kind), f"conv_id {kind}, audit string, repaired_sha256 string")
    head = pieces.filter("pieces > 1 AND piece = 0").select(F.col("conv_id").alias("same"), *numbers)
    many = digests.join(head, F.col("conv_id").eqNullSafe(F.col("same"))).select("conv_id", *numbers, "audit", "repaired_sha256")
    return one.unionByName(many)


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, piece, place, role, text: the repaired turns as rows; place counts from 0 in the piece."""
    return pieces.select("conv_id", "piece", F.posexplode("turns").alias("place", "turn")).select("conv_id", "piece", "place", "turn.role", "turn.text")
