"""Conversation repair by a square-root checkpointed dynamic program.

The rows of a conversation, in the order of ``turn`` (nulls first; rows of one
turn by role, then text), are edited at least cost into roles of the pattern
``(s?(ua)+)?``: an automaton of four states (start, after s, after u, after
a). The backward pass keeps state-cost vectors only at checkpoints and the
forward walk recomputes the vectors between two of them, so the walk takes the
ASCII-least tight edits with memory of the root of the number of rows.

Spark holds two levels of checkpoints. A conversation is cut into blocks of
``BLOCK`` rows; each block of a long conversation becomes a 4 x 4 matrix of
costs (they compose, so blocks run in parallel), and folding the matrices from
the back gives the vector at the end of every block. Inside a block, vectors
are kept every ``sqrt(rows)`` rows. A block is walked once from each of the
four states; the last pass reads a conversation's rows in order, knows the
state at each block, and writes the repaired text into the running hash. Texts
are never held: that pass is a stream, and the hash of a conversation is the
one thing that has to be made in order.

Defined results: a null role or text counts as one space, as does a null id
or turn in the damage rule (null ids are one conversation). Repeated rows are
duplicates of the first. Every id of the input has a row, also when no row of
it is left. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import inf, isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import drop_written, laid_out, written

BLOCK = 4096
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The role that a
# state wants next, and the state after it.
WANTS = ("u", "u", "a", "u")
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
# Code of a row: its role's initial, plus 4 if truncated; FORCED must go.
INITIALS = {"s": 0, "u": 1, "a": 2}
FORCED = 8
SOLID = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20``; adds ``key``,
    the conversation's id as text."""
    space = F.lit(" ")
    key = F.coalesce(F.col("conv_id").cast("string"), space)
    turn = F.coalesce(F.col("turn").cast("string"), space)
    kind = F.crc32(F.concat(key, F.lit(":"), turn).cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        key.alias("key"), "conv_id", "turn", kind.alias("__kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).filter("__kind <> 0").select(
        "key", "conv_id", "turn", "role", "text",
        F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _relaxed(costs: list) -> list:
    """State costs when rows may be inserted here."""
    for _ in range(2):  # at most two inserts lead to a state of its own
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


TERMINAL = _relaxed([0 if s in ENDS else inf for s in range(4)])


def _keeps(code: int, state: int) -> int | None:
    """State after keeping a row, None if its role does not fit."""
    role = code & 3
    if role == 0:
        return 1 if state == 0 else None
    return NEXT[state] if role < 3 and "sua"[role] == WANTS[state] else None


def back(costs: list, code: int) -> list:
    """Costs before a row, from those after it."""
    out = [DELETE + c for c in costs]
    if code != FORCED:
        cut = TRUNCATED if code & 4 else 0
        for s in range(4):
            out[s] = min(out[s], REROLE + cut + costs[NEXT[s]])
            kept = _keeps(code, s)
            if kept is not None:
                out[s] = min(out[s], KEEP + cut + costs[kept])
    return _relaxed(out)


def matrix(codes: bytes) -> list[list]:
    """Least cost from each state before the rows to each state after them."""
    columns = []
    for end in range(4):
        costs = [0 if s == end else inf for s in range(4)]
        for code in reversed(codes):
            costs = back(costs, code)
        columns.append(costs)
    return [[columns[t][s] for t in range(4)] for s in range(4)]


class Checkpoints:
    """Backward vectors of a block: kept every root of its length, and
    recomputed for the stretch that the walk is in."""

    def __init__(self, codes: bytes, end: list):
        self.codes, self.step = codes, max(1, isqrt(len(codes)))
        self.kept = {len(codes): end}
        for i in range(len(codes) - 1, -1, -1):
            end = back(end, codes[i])
            if i % self.step == 0:
                self.kept[i] = end
        self.first, self.stretch = len(codes), [self.kept[len(codes)]]

    def at(self, i: int) -> list:
        if not self.first <= i < self.first + len(self.stretch):
            self.first = i - i % self.step
            last = min(len(self.codes), self.first + self.step)
            made = [self.kept[last]]
            for j in range(last - 1, self.first, -1):
                made.append(back(made[-1], self.codes[j]))
            self.stretch = [*([self.kept[self.first]] if last > self.first else []), *reversed(made)]
        return self.stretch[i - self.first]


def walk(codes: bytes, end: list, state: int, last: bool) -> tuple[str, int]:
    """ASCII-least tight edits of a block from a state (``D < I < K < R``) and
    the state after it; the last block of a conversation is completed."""
    vectors, edits, i = Checkpoints(codes, end), [], 0
    while i < len(codes) or last and state not in ENDS:
        here = vectors.at(i)
        code, after = (codes[i], vectors.at(i + 1)) if i < len(codes) else (None, None)
        here = here[state]
        if code is not None and here == DELETE + after[state]:
            edits.append("D")
            i += 1
        elif here == INSERT + vectors.at(i)[NEXT[state]]:
            edits.append("I")
            state = NEXT[state]
        else:
            kept = _keeps(code, state)
            cut = TRUNCATED if code & 4 else 0
            keeps = kept is not None and here == KEEP + cut + after[kept]
            edits.append("K" if keeps else "R")
            state = kept if keeps else NEXT[state]
            i += 1
    return "".join(edits), state


def _codes(column: pa.Array) -> list[bytes]:
    return [bytes(c) for c in column.to_pylist()]


def _block_matrices(batches):
    for batch in batches:
        made = [[-1 if x == inf else int(x) for row in matrix(c) for x in row] for c in _codes(batch.column("codes"))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"),
                                          pa.array(made, pa.list_(pa.int64()))], ["key", "block", "costs"])


def _block_ends(batches):
    """Fold a conversation's matrices from the back: the vector at the end of
    every block."""
    for batch in batches:
        keys, blocks, ends = [], [], []
        for key, pieces in zip(batch.column("key").to_pylist(), batch.column("pieces").to_pylist()):
            vector = TERMINAL
            for piece in reversed(pieces):
                keys.append(key)
                blocks.append(piece["block"])
                ends.append([int(x) for x in vector])
                m = [inf if x < 0 else x for x in piece["costs"]]
                vector = [min(m[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, pa.int64()),
                                          pa.array(ends, pa.list_(pa.int64()))], ["key", "block", "end"])


def _block_walks(batches):
    for batch in batches:
        made = []
        for codes, end, last in zip(_codes(batch.column("codes")), batch.column("end").to_pylist(),
                                    batch.column("last").to_pylist()):
            made.append([dict(zip(("edits", "state"), walk(codes, end or TERMINAL, s, last))) for s in range(4)])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "block", "blank", "duplicate", "truncated")),
             pa.array(made, pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32())])))],
            ["key", "block", "blank", "duplicate", "truncated", "walks"])


class _Reader:
    """The running result of one conversation: blocks and rows in order."""

    def __init__(self, key: str):
        self.key, self.state, self.audit, self.cost = key, 0, [], 0
        self.faults, self.illegal, self.before = [0, 0, 0], 0, None
        self.low = self.high = None
        self.turns, self.edits, self.hash, self.any = 0, iter(()), hashlib.sha256(), False
        self.pending = None

    def block(self, walks, faults):
        self.flush()
        chosen = walks[self.state]
        self.audit.append(chosen["edits"])
        # inserts after the last row of a block belong to no row: kept at its end
        self.edits, self.exit = iter(chosen["edits"]), chosen["state"]
        self.faults = [a + b for a, b in zip(self.faults, faults)]

    def write(self, line: str):
        self.hash.update((("\n" if self.any else "") + line).encode("utf-8", "surrogatepass"))
        self.any = True

    def insert(self):
        role = WANTS[self.state]
        self.write("user:" if role == "u" else "assistant:")
        self.state, self.cost = NEXT[self.state], self.cost + INSERT

    def row(self, turn, role: str, text: str):
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        edit = next(self.edits)
        while edit == "I":
            self.insert()
            edit = next(self.edits)
        if edit == "D":
            self.cost += DELETE
            return
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        self.cost += TRUNCATED * (solid[-1:] not in (".", "!", "?"))
        if edit == "K":
            self.write(f"{role}:{text}")
            self.state = 1 if self.state == 0 and initial == "s" else NEXT[self.state]
        else:
            self.write(("user:" if WANTS[self.state] == "u" else "assistant:") + text)
            self.state, self.cost = NEXT[self.state], self.cost + REROLE

    def flush(self):
        for edit in self.edits:  # inserts after the last row
            self.insert()

    def result(self) -> tuple:
        self.flush()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


RESULT = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _read_conversations(batches):
    """Rows sorted by conversation, block, blocks before rows, place."""
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
    reader = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if reader is None or r["key"] != reader.key:
                if reader is not None:
                    out.append(reader.result())
                reader = _Reader(r["key"])
            if r["kind"] == 0:
                reader.block(r["walks"], (r["blank"], r["duplicate"], r["truncated"]))
            else:
                reader.row(r["turn"], r["role"], r["text"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    if reader is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(reader.result(), types)], names)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)`` of each conversation of ``rows (key, turn, role, text,
    copy)``; ``block`` (a power of two) is the number of rows between the
    outer checkpoints."""
    said = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    laid = laid_out(rows.select("key", "turn", "role", "text", "copy", said.alias("said")),
                    ["key", F.col("turn").asc_nulls_first(), "role", "text", "copy"], "conversations")
    laid = laid.withColumn("block", F.shiftright("place", block.bit_length() - 1))
    # what was said before, without a window over a conversation
    again = laid.groupBy("key", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("c")) \
        .filter("c > 1").select("key", "said", "first")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    flags = laid.select(
        "key", "block", "place", "said", (~F.col("text").rlike(SOLID)).alias("is_blank"),
        (~last.isin(".", "!", "?")).alias("is_cut"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role"))
    flags = flags.join(again, ["key", "said"], "left")
    is_copy = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    forced = F.col("is_blank") | is_copy
    code = F.when(forced, FORCED).otherwise(F.col("role") + F.when(F.col("is_cut"), 4).otherwise(0))
    blocks = flags.groupBy("key", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", code.cast("byte").alias("c")))), lambda x: x["c"])
        .alias("codes"),
        F.count_if("is_blank").alias("blank"), F.count_if(~F.col("is_blank") & is_copy).alias("duplicate"),
        F.count_if(~forced & F.col("is_cut")).alias("truncated"))
    blocks = codes = written(blocks, "codes")
    spans = blocks.groupBy("key").agg(F.min("block").alias("from"), F.max("block").alias("to"))
    blocks = blocks.join(spans, "key")
    long = blocks.filter(F.col("from") < F.col("to")).select("key", "block", "codes")
    pieces = long.mapInArrow(_block_matrices, "key string, block long, costs array<long>").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("pieces"))
    ends = pieces.mapInArrow(_block_ends, "key string, block long, end array<long>")
    walks = blocks.withColumn("last", F.col("block") == F.col("to")).join(ends, ["key", "block"], "left").mapInArrow(
        _block_walks, "key string, block long, blank long, duplicate long, truncated long, "
                      "walks array<struct<edits:string,state:int>>")
    stream = walks.withColumn("kind", F.lit(0)).unionByName(
        laid.select("key", "block", "place", "turn", "role", "text", F.lit(1).alias("kind")), allowMissingColumns=True)
    out = written(stream.repartition("key").sortWithinPartitions("key", "block", "kind", "place").mapInArrow(
        _read_conversations, RESULT), "repaired")
    drop_written(codes)
    drop_written(laid)
    return out


def repair_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage the conversations as the contract says and repair them: one row
    for every ``conv_id`` of the input."""
    found = repair(damaged(conversations), block).withColumnRenamed("key", "__key")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")) == F.col("__key"), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
