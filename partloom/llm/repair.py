"""Conversation structure repair by Four-Russians block tables.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. Turns may be kept (0), given the role user or assistant (1)
or deleted (2), and empty turns of these roles inserted (5); blank and repeated turns have to be deleted, and a truncated one
that stays costs 5 more. The costs of what is left, from each of the four states of the expression's automaton, are a vector;
less its minimum it is one of a few dozen. For every block of ``BLOCK`` symbols and every such vector behind it, a table holds
the vector before it and what the minimum grows by (Arlazarov, Dinic, Kronrod and Faradzev's method). A conversation is
processed from its end by one look-up a block; then each block is expanded from its right vector and walked from the left,
taking the ASCII-least letter among the edits that lose nothing, so the audit is the least of all cheapest ones.

Turns are dealt by ranges of (conversation, turn, row), so a conversation of any size is shared by many tasks. Within a task
all conversations but the first and the last are whole. Of these two the task gives a piece: the composed table of its blocks
(next vector, cost and exit state for each vector and state) and its turns; pieces of a conversation are joined in order,
which needs a row for each task, and are then walked each for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.shared import stored

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Where each initial leads, and what may be inserted or a role be made of.
_LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_MADE = ("u", "u", "a", "u")
_ROLES = {"u": "user", "a": "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: padding, must be deleted, then initial (s, u, a, other) and whether truncated.
PAD, GONE, _INITIALS = 0, 1, "sua"
_SYMBOLS = 10
_BLANKS = " \t\n\x0b\x0c\r"


def symbol(initial: str, truncated: bool) -> int:
    return 2 + 2 * (_INITIALS.index(initial) if initial and initial in _INITIALS else 3) + truncated


def _edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a turn, in ASCII order of the letters without I."""
    found = [("D", DELETE, state)]
    if sym != GONE:
        more = TRUNCATED * ((sym - 2) % 2)
        initial = (*_INITIALS, "")[(sym - 2) // 2]
        if initial in _LEADS[state]:
            found.append(("K", KEEP + more, _LEADS[state][initial]))
        found.append(("R", REROLE + more, _LEADS[state][_MADE[state]]))
    return found


def _before(after: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """The costs from each state before a turn, given those after it."""
    if sym == PAD:
        return after
    cost = [min(c + after[t] for _, c, t in _edits(sym, s)) for s in range(4)]
    for _ in range(3):
        cost = [min(cost[s], INSERT + cost[_LEADS[s][_MADE[s]]]) for s in range(4)]
    return tuple(cost)


def _walk(after: tuple[int, ...], sym: int, state: int) -> tuple[str, int]:
    """The least letters of a turn from a state, and the state behind it."""
    if sym == PAD:
        return "", state
    cost, letters = _before(after, sym), ""
    while True:
        steps = [(letter, c + after[t], t) for letter, c, t in _edits(sym, state)]
        made = _LEADS[state][_MADE[state]]
        letter, _, to = min((x, c, t) for x, c, t in [*steps, ("I", INSERT + cost[made], made)] if c == cost[state])
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


@dataclass
class Tables:
    vectors: list[tuple[int, ...]]
    after: np.ndarray  # [vector, block]: the vector before the block
    cost: np.ndarray  # [vector, block]: what its minimum is above
    leaves: np.ndarray  # [vector, block, state]: the state behind the block
    walked: dict[tuple[int, int, int], tuple[list[str], int]] = field(default_factory=dict)

    def walk(self, right: int, block: int, state: int) -> tuple[list[str], int]:
        """The letters of each turn of a block, expanded from the vector behind it; every case is expanded once."""
        found = self.walked.get(key := (right, block, state))
        if found is None:
            symbols, behind = [block // _SYMBOLS ** (BLOCK - 1 - i) % _SYMBOLS for i in range(BLOCK)], [self.vectors[right]]
            for sym in reversed(symbols):
                behind.append(_before(behind[-1], sym))
            letters = []
            for sym, after in zip(symbols, reversed(behind[:-1]), strict=True):
                done, state = _walk(after, sym, state)
                letters.append(done)
            found = self.walked[key] = letters, state
        return found


@cache
def tables() -> Tables:
    """Built once in each worker from the costs and the automaton."""
    least = lambda v: tuple(x - min(v) for x in v)
    vectors, numbers = [_END], {_END: 0}
    for v in vectors:
        for sym in range(_SYMBOLS):
            if (to := least(_before(v, sym))) not in numbers:
                numbers[to] = len(vectors)
                vectors.append(to)
    shape = (len(vectors), _SYMBOLS)
    one, more, leave = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int64), np.zeros((*shape, 4), dtype=np.int8)
    for (i, v), sym in product(enumerate(vectors), range(_SYMBOLS)):
        before = _before(v, sym)
        one[i, sym], more[i, sym], leave[i, sym] = numbers[least(before)], min(before), [_walk(v, sym, s)[1] for s in range(4)]
    after, cost, leaves = one, more, leave
    for _ in range(BLOCK - 1):  # a symbol more on the left
        n = after.shape[1]
        first = leave[after][:, :, :, :].transpose(0, 2, 1, 3)  # [vector, symbol, block, state]
        leaves = np.take_along_axis(np.broadcast_to(leaves[:, None], (shape[0], _SYMBOLS, n, 4)), first.astype(np.int64), axis=3).reshape(shape[0], -1, 4)
        cost = (cost[:, None, :] + more[after].transpose(0, 2, 1)).reshape(shape[0], -1)
        after = one[after].transpose(0, 2, 1).reshape(shape[0], -1)
    return Tables(vectors, after, cost, leaves)


def blocks_of(symbols: bytes) -> list[int]:
    padded = symbols + bytes(-len(symbols) % BLOCK)
    codes = np.frombuffer(padded, dtype=np.uint8).reshape(-1, BLOCK).astype(np.int64)
    return (codes @ _SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()


def walk(symbols: bytes, right: int, state: int) -> tuple[int, int, list[str], int]:
    """Cost above the right vector's, the vector before the symbols, the letters of each turn and the state behind them."""
    t, blocks = tables(), blocks_of(symbols)
    cost, behind, letters = 0, [], []
    for block in reversed(blocks):
        behind.append(right)
        cost, right = cost + int(t.cost[right, block]), int(t.after[right, block])
    for block, vector in zip(blocks, reversed(behind), strict=True):
        done, state = t.walk(vector, block, state)
        letters += done
    return cost, right, letters[: len(symbols)], state


def composed(symbols: bytes) -> tuple[list[int], list[int], list[int]]:
    """For every vector behind the symbols: the vector before them, the cost, and from every state the state behind them."""
    t = tables()
    n = len(t.vectors)
    at, cost, leaves = np.arange(n), np.zeros(n, dtype=np.int64), np.tile(np.arange(4), (n, 1))
    for block in reversed(blocks_of(symbols)):
        leaves = np.take_along_axis(leaves, t.leaves[at, block].astype(np.int64), axis=1)
        cost, at = cost + t.cost[at, block], t.after[at, block]
    return at.tolist(), cost.tolist(), leaves.ravel().tolist()


def closing(state: int) -> str:
    """The letters that a conversation needs behind its last turn."""
    letters = ""
    while _END[state]:
        letters, state = letters + "I", _LEADS[state][_MADE[state]]
    return letters


def edited(state: int, letters: str, role: str, text: str) -> tuple[int, list[tuple[str, str, str]]]:
    """The state behind a turn's edits, and (letter, role, text) of each."""
    out = []
    for x in letters:
        made = _MADE[state]
        if x == "D":
            out.append((x, role, text))
            continue
        out.append((x, role if x == "K" else _ROLES[made], "" if x == "I" else text))
        state = _LEADS[state][role[0] if x == "K" else made]
    return state, out


class _Sink:
    """A conversation's repaired turns, hashed as they come."""

    def __init__(self) -> None:
        self.sha, self.audit, self.any, self.state, self.nth = hashlib.sha256(), [], False, 0, 0

    def add(self, letters: str, role: str = "", text: str = "") -> list[tuple[int, str, str, str]]:
        self.state, done = edited(self.state, letters, role, text)
        self.audit.append(letters)
        out = []
        for x, r, t in done:
            out.append((self.nth, x, r, t))
            self.nth += 1
            if x != "D":
                self.sha.update((("\n" if self.any else "") + f"{r}:{t}").encode())
                self.any = True
        return out

    def end(self) -> tuple[str, str]:
        return "".join(self.audit), self.sha.hexdigest()


@dataclass
class _Part:
    """What a task has seen of a conversation."""

    conv: int | None
    symbols: bytearray = field(default_factory=bytearray)
    turns: list[tuple[str, str]] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])  # blank, duplicate, truncated, illegal
    ends: list[str] | None = None  # first and last initial
    low: int | None = None
    high: int | None = None
    distinct: int = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        bare, initial = text.rstrip(_BLANKS), role[:1]
        fault = 0 if not bare else 1 if repeated else 2 if bare[-1] not in ".!?" else None
        if fault is not None:
            self.counts[fault] += 1
        if self.ends is None:
            self.ends = [initial, initial]
        else:
            self.counts[3] += self.ends[1] + initial not in ("su", "ua", "au")
            self.ends[1] = initial
        self.symbols.append(GONE if fault in (0, 1) else symbol(initial, fault == 2))
        self.turns.append((role, text))
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn


#: kind: conversation, piece or turn of a piece, and repaired turn.
_CONV, _PIECE, _TURN, _REPAIRED = range(4)
_TYPES = {
    "kind": ("int", pa.int32()), "conv_id": ("long", pa.int64()), "gaps": ("long", pa.int64()), "blank": ("long", pa.int64()), "duplicate": ("long", pa.int64()), "truncated": ("long", pa.int64()), "illegal": ("long", pa.int64()), "cost": ("long", pa.int64()),
    "audit": ("string", pa.string()), "repaired_sha256": ("string", pa.string()), "piece": ("int", pa.int32()), "at": ("long", pa.int64()), "edit": ("string", pa.string()), "role": ("string", pa.string()), "text": ("string", pa.string()),
    "symbols": ("binary", pa.binary()), "first": ("string", pa.string()), "last": ("string", pa.string()), "low": ("long", pa.int64()), "high": ("long", pa.int64()), "distinct": ("long", pa.int64()),
    "befores": ("array<int>", pa.list_(pa.int32())), "costs": ("array<long>", pa.list_(pa.int64())), "leaves": ("array<int>", pa.list_(pa.int32())),
}
_SCHEMA = pa.schema([(k, t) for k, (_, t) in _TYPES.items()])
_DDL = ", ".join(f"{k} {d}" for k, (d, _) in _TYPES.items())
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_BATCH_CHARS = 1 << 22


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r.get("text") or "") + len(r.get("audit") or "") + len(r.get("symbols") or b"")
        if size > _BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _whole(part: _Part, turns: bool) -> Iterator[dict]:
    cost, vector, letters, _ = walk(bytes(part.symbols), 0, 0)
    sink = _Sink()
    done = [x for (role, text), these in zip(part.turns, letters, strict=True) for x in sink.add(these, role, text)]
    done += sink.add(closing(sink.state))
    audit, sha = sink.end()
    yield {"kind": _CONV, "conv_id": part.conv, "gaps": _gaps(part.low, part.high, part.distinct), **dict(zip(_COUNTS, part.counts, strict=True)), "cost": cost + tables().vectors[vector][0], "audit": audit, "repaired_sha256": sha}
    if turns:
        yield from ({"kind": _REPAIRED, "conv_id": part.conv, "at": i, "edit": x, "role": r, "text": t} for i, x, r, t in done)


def _piece(part: _Part, number: int) -> Iterator[dict]:
    befores, costs, leaves = composed(bytes(part.symbols))
    first, last = part.ends or (None, None)
    yield {"kind": _PIECE, "conv_id": part.conv, "piece": number, "symbols": bytes(part.symbols), "first": first, "last": last, "low": part.low, "high": part.high, "distinct": part.distinct, "befores": befores, "costs": costs, "leaves": leaves, **dict(zip(_COUNTS, part.counts, strict=True))}
    yield from ({"kind": _TURN, "conv_id": part.conv, "piece": number, "at": i, "role": r, "text": t} for i, (r, t) in enumerate(part.turns))


def _scan(sorted_turns: DataFrame, turns: bool) -> DataFrame:
    """conv_id, turn, role, text and mark (0: the next row is a repeated one, 1: a turn, 2: only a conversation's id) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            part, first, repeated, number = None, True, False, TaskContext.get().partitionId()
            for batch in batches:
                for conv, turn, role, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part is None or conv != part.conv:
                        if part is not None:
                            yield from _piece(part, number) if first else _whole(part, turns)
                            first = False
                        part = _Part(conv)
                    if mark == 1:
                        part.add(turn, role, text, repeated)
                    repeated = mark == 0
            if part is not None:
                yield from _piece(part, number)

        yield from _batches(rows())

    return sorted_turns.select("conv_id", "turn", "role", "text", "mark").mapInArrow(run, _DDL)


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of a conversation, at most one a task of the scan: each one's right vector and entry state, and the sums."""

    def run(table: pa.Table) -> pa.Table:
        t, parts = tables(), sorted(table.to_pylist(), key=lambda p: p["piece"])
        right, cost, state, out = 0, 0, 0, []
        for p in reversed(parts):
            p["right"] = right
            cost, right = cost + p["costs"][right], p["befores"][right]
        cost += t.vectors[right][0]
        sums, last, low, high, distinct = dict.fromkeys(_COUNTS, 0), None, None, None, 0
        for p in parts:
            out.append({"conv_id": p["conv_id"], "piece": p["piece"], "right": p["right"], "state": state})
            state = p["leaves"][4 * p["right"] + state]
            for k in _COUNTS:
                sums[k] += p[k]
            if p["first"] is not None:
                sums["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
                last = p["last"]
            if p["low"] is not None:
                distinct += p["distinct"] - (p["low"] == high)
                low, high = p["low"] if low is None else low, p["high"]
        whole = {**sums, "cost": cost, "gaps": _gaps(low, high, distinct)}
        return pa.Table.from_pylist([r | whole for r in out], schema=schema)

    names = ["conv_id", "gaps", *_COUNTS, "cost"]
    schema = pa.schema([*((k, _TYPES[k][1]) for k in names), ("piece", pa.int32()), ("right", pa.int32()), ("state", pa.int32())])
    ddl = ", ".join(f"{k} {_TYPES[k][0]}" for k in names) + ", piece int, right int, state int"
    return pieces.drop("symbols").groupBy("conv_id").applyInArrow(run, ddl)


def _walked(pieces: DataFrame) -> DataFrame:
    """pieces (symbols, right, state, sums) with letters: what is done with each of their turns."""
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [walk(s.as_py(), r.as_py(), q.as_py())[2] for s, r, q in zip(batch.column("symbols"), batch.column("right"), batch.column("state"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.string()))], [*names, "letters"])

    return pieces.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", letters array<string>")


def _finished(marks: DataFrame, turns_of_pieces: DataFrame, turns: bool) -> DataFrame:
    """Conversations that several tasks had: their texts pass once, in order, as a hash of all of them needs it; no more than
    a piece's letters and the audit are held."""
    names = ["conv_id", "piece", "at", "role", "text", "letters", "gaps", *_COUNTS, "cost"]
    rows = marks.withColumn("at", F.lit(-1).cast("long")).unionByName(turns_of_pieces, allowMissingColumns=True).select(names)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            head, sink, letters = None, None, None

            def close() -> Iterator[dict]:
                yield from done(sink.add(closing(sink.state)))
                audit, sha = sink.end()
                yield head | {"kind": _CONV, "audit": audit, "repaired_sha256": sha}

            def done(made: list) -> Iterator[dict]:
                if turns:
                    yield from ({"kind": _REPAIRED, "conv_id": head["conv_id"], "at": i, "edit": x, "role": r, "text": t} for i, x, r, t in made)

            for batch in batches:
                for r in batch.to_pylist():
                    if r["at"] < 0:
                        if head is None or head["conv_id"] != r["conv_id"]:
                            if head is not None:
                                yield from close()
                            head, sink = {k: r[k] for k in ("conv_id", "gaps", *_COUNTS, "cost")}, _Sink()
                        letters = r["letters"]
                    else:
                        yield from done(sink.add(letters[r["at"]], r["role"], r["text"]))
            if head is not None:
                yield from close()

        yield from _batches(rows())

    return dealt.mapInArrow(run, _DDL)


def repair(turns: DataFrame, *, order: Column, present: Column | None = None, repaired: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Two tables of turns (conv_id, turn, role, text): of each conversation conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256; and, if asked for, its edits in order: conv_id, at, edit, role and text.

    A conversation's turns are taken by turn, nulls first, and those of one turn by ``order``, which tells rows apart and
    stays the same however often turns is read. Rows that aren't ``present`` only name a conversation. Null roles and texts
    count as one blank; null ids are one conversation. A role is judged by its first letter as it stands; an empty one has
    none and is never kept. Texts are compared whole. Conversations without turns are legal, with an empty audit. An empty
    table gives no rows; extra columns are ignored.
    """
    spark = turns.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else present
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), order.alias("row"), text("role").alias("role"), text("text").alias("text"), F.when(there, 1).otherwise(2).alias("mark"))
    digest = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed = rows.where("mark = 1").select(digest.alias("digest"), "conv_id", F.struct("turn", "row").alias("place"))
    many = keyed.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(keyed.join(many.select("digest", "first"), "digest").where(F.col("place") > F.col("first")).select("conv_id", "place.turn", "place.row"), "repeated")
    marked = rows.unionByName(repeated.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(tasks, "conv_id", "turn", "row").sortWithinPartitions("conv_id", "turn", "row", "mark")
    scanned = stored(_scan(dealt, repaired), "scanned")
    pieces = scanned.where(F.col("kind") == _PIECE)
    joined = _joined(pieces.select("conv_id", "piece", "first", "last", "low", "high", "distinct", "befores", "costs", "leaves", *_COUNTS, "symbols"))
    same = pieces.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "symbols")
    walked = _walked(joined.join(same, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).drop("c", "p")).drop("symbols", "right", "state")
    whole = stored(_finished(walked, scanned.where(F.col("kind") == _TURN).select("conv_id", "piece", "at", "role", "text"), repaired), "joined")
    every = scanned.unionByName(whole)
    conversations = every.where(F.col("kind") == _CONV).select("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")
    return conversations, every.where(F.col("kind") == _REPAIRED).select("conv_id", "at", "edit", "role", "text") if repaired else None


def damaged(turns: DataFrame, row: Column) -> DataFrame:
    """turns with faults by the crc32 of conversation and turn: see the query's contract. row tells rows apart; order and
    present are added, and dropped turns stay as rows that aren't present."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), row.alias("row"), fault.alias("fault"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.struct("row", "copy").alias("order"), (F.col("fault") != 0).alias("present"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one conversation and turn are in the order of the files and of their rows."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return repair(damaged(turns, place), order=F.col("order"), present=F.col("present"))[0]
