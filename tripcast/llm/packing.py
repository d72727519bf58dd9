"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method (large-item matching): pieces above a third of the capacity go at most
two to a sequence, matched greedily from the largest with the largest partner
that still fits; smaller pieces, largest first, go into the tightest gap.

Only sizes decide, so the plan is made from the histogram of piece lengths
(at most ``capacity`` rows, whatever the input): every step of the plan says
that a run of equal pieces goes to a run of sequences. Spark numbers the
pieces of each length and every piece looks up its step.

Defined cases: a null text is an empty text (one piece that holds just the
end id); rows that repeat an id are packed each; an empty table gives no rows;
a row with a null id is packed like any other.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.llm import tokens
from tripcast.llm.common import id_and_text, partitions, written

CAPACITY = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of at most
    ``capacity`` tokens: a longer document is cut so that its first piece
    takes what is left over and all others are full. ``ids`` are unsigned
    little-endian 32-bit numbers."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode(text or "")
                first = len(ids) % capacity or capacity
                at, piece = 0, 0
                while at < len(ids):
                    end = first if at == 0 else at + capacity
                    raw = ids[at:end].astype("<u4").tobytes()
                    for c, v in zip(cols, (doc_id, piece, at, len(raw) // 4, zlib.crc32(raw), raw)):
                        c.append(v)
                    at, piece, held = end, piece + 1, held + len(raw)
                if keep_ids and held > 1 << 24:
                    yield _pieces(cols, keep_ids)
                    cols, held = [[], [], [], [], [], []], 0
            yield _pieces(cols, keep_ids)

    return id_and_text(docs).mapInArrow(cut, PIECES + (", ids binary" if keep_ids else ""))


def _pieces(cols: list[list], keep_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    n = len(names) if keep_ids else len(names) - 1
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], names[:n])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps ``(size, first, count, sequence, per_bin, offset)``: pieces
    ``first .. first + count - 1`` of that size go ``per_bin`` to each of the
    sequences from ``sequence`` on, at ``offset`` and after one another."""
    left = {s: n for s, n in histogram.items() if n > 0}
    total = dict(left)
    if any(s > capacity or s < 1 for s in left):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, sequences)
    open_gaps: list[int] = []  # sorted
    sequences = 0

    def put(size: int, count: int, sequence: int, per_bin: int, offset: int) -> None:
        steps.append((size, total[size] - left[size], count, sequence, per_bin, offset))
        left[size] -= count

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((sequence, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            partners = [b for b in large[:bisect.bisect_right(large, min(a, capacity - a))]
                        if left[b] > (b == a)]
            if not partners:
                n = left[a]
                put(a, n, sequences, 1, 0)
                leave(capacity - a, sequences, n)
            elif (b := partners[-1]) == a:
                n = left[a] // 2
                put(a, 2 * n, sequences, 2, 0)
                leave(capacity - 2 * a, sequences, n)
            else:
                n = min(left[a], left[b])
                put(a, n, sequences, 1, 0)
                put(b, n, sequences, 1, a)
                leave(capacity - a - b, sequences, n)
            sequences += n

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect.bisect_left(open_gaps, s)
            if k < len(open_gaps):
                gap = open_gaps[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(k)
            else:
                gap, first, n = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += n
            each = gap // s
            whole = min(n, left[s] // each)
            if whole:
                put(s, whole * each, first, each, capacity - gap)
                leave(gap - each * s, first, whole)
            rest, used = left[s], whole
            if whole < n and rest:  # fewer pieces than one more sequence takes
                put(s, rest, first + whole, rest, capacity - gap)
                leave(gap - rest * s, first + whole, 1)
                used += 1
            leave(gap, first + used, n - used)
    return steps


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece,
    length``. ``pieces`` should be a stored table: it is read twice."""
    spark = pieces.sparkSession
    buckets = max(64, 2 * partitions(spark))
    placed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = placed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # At most `capacity` rows: a histogram of lengths.
    steps = plan({r[0]: r[1] for r in pieces.groupBy("length").count().collect()}, capacity)
    steps.sort(key=lambda s: (s[0], s[1]))
    table = spark.sparkContext.broadcast(np.asarray(steps, dtype=np.int64).reshape(-1, 6))

    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    numbered = placed.join(firsts, ["length", "__bucket"]).withColumn(
        "__at", F.col("__first") + F.row_number().over(within) - 1)
    names = pieces.columns
    numbered = numbered.select(*names, "__at")
    at_size, at_pos = names.index("length"), len(names)

    def look_up(batches) -> Iterator[pa.RecordBatch]:
        s = table.value
        keys = (s[:, 0] << 44) + s[:, 1]
        for batch in batches:
            size, pos = batch.column(at_size).to_numpy(), batch.column(at_pos).to_numpy()
            row = s[np.searchsorted(keys, (size << 44) + pos, side="right") - 1]
            j = pos - row[:, 1]
            sequence, offset = row[:, 3] + j // row[:, 4], row[:, 5] + (j % row[:, 4]) * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at_pos], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(look_up, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenise once into a stored table of pieces, then pack it."""
    return pack(written(token_pieces(docs, capacity, keep_ids), "pieces"), capacity)
