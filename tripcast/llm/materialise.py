"""Training-order materialisation: every fixed-length token sequence gets a
global slot by a keyed permutation, and the slots are written as fixed-stride
binary shards.

Sequences are numbered in the order of (doc_id, piece), so that the same key
gives the same training order however the input is split. Texts are tokenised
once, into a stored table of unpadded sequences; only the documents' ids, digests
and counts are put in order, and a document's first number joins its sequences.

The permutation is a balanced Feistel network over the smallest even number
of bits that holds ``n`` values; a value outside ``0 .. n-1`` is permuted
again until it falls inside (cycle walking), so the slots are exactly
``0 .. n-1`` and any slot can be inverted without a table.

Records go to their shards as compressed batches: a task collects the records of
a run of shards into one row, which takes less disk than rows of single records,
whose neighbours in a shuffle have nothing in common. The batches are stored by
steps of shards, and the sequences dropped. Step by step the batches are shuffled,
written as shards and dropped, so that no record lies in more than two forms at once
but those of one step.

A record is ``2 * seq_len`` bytes of little-endian unsigned 16-bit ids (a
short sequence is filled up with ``PAD_ID``) and one newline byte; ``stride``
bytes in all, so record ``k`` of a shard starts at ``k * stride`` and a
reader can start or resume at any slot. Spark's own writer commits the
shards, so a lost executor leaves no half shard.

Defined cases: a null text is empty (one sequence with the end id); repeated
rows each get a slot, rows of one id in the order of their ids' digests; null
ids come first; extra columns are ignored; an empty table writes nothing and
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripcast.llm import tokens
from tripcast.llm.common import PLACE_BITS, drop_written, id_and_text, laid_out, partitions, written
from tripcast.session import scratch_path

SEQ_LEN = 256
PAD_ID = 50256
KEY = 20240607
ROUNDS = 6
SHARD_RECORDS = 1 << 15
# Documents of which the first numbers (16 bytes each) go to every task; with
# more of them the ids are shuffled once more, to meet their numbers.
SENT = 1 << 22
# Bytes of records that a task collects before it packs them.
HELD = 1 << 26
# Steps in which the shards are written, if each of them has this many shards.
STEPS, STEP_SHARDS = 8, 4

ROWS = "row long, doc_id long, pieces int, digest binary, piece int, length int, ids_crc32 long, record binary"


def stride(seq_len: int = SEQ_LEN) -> int:
    return 2 * seq_len + 1


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def round_keys(key: int, rounds: int = ROUNDS) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little"))
            for i in range(rounds)]


def permute(values: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Keyed bijection of ``0 .. n-1`` (element by element)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << shift) | right

    out = once(values.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def sequences(docs: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Sequences ``(row, doc_id, pieces, digest, piece, length, ids_crc32,
    record)``: ``row`` is a number of the input row (stable once stored),
    ``pieces`` and ``digest`` are its document's, set in its first sequence,
    ``record`` holds the ids without padding."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def cut(batches) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << PLACE_BITS
        cols: list[list] = [[] for _ in names]

        def flush() -> pa.RecordBatch:
            nonlocal cols
            arrays, cols = [pa.array(c, k) for c, k in zip(cols, kinds)], [[] for _ in names]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = tokens.encode(text or "").astype("<u2").tobytes()
                parts = [raw[at:at + 2 * seq_len] for at in range(0, len(raw), 2 * seq_len)]
                for piece, part in enumerate(parts):
                    first = (len(parts), hashlib.blake2b(raw, digest_size=16).digest()) if piece == 0 else (None, None)
                    for c, v in zip(cols, (row, doc_id, *first, piece, len(part) // 2, zlib.crc32(part), part)):
                        c.append(v)
                row += 1
                if len(cols[0]) * 2 * seq_len > 1 << 23:
                    yield flush()
        yield flush()

    return id_and_text(docs).mapInArrow(cut, ROWS)


def first_numbers(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(row, start)``: how many sequences come before a document's in the
    order of (doc_id, digest), and how many there are in all. Documents are
    range-partitioned; the pieces meet in a table with one row a piece."""
    docs = rows.filter("piece = 0").select("row", "doc_id", "digest", "pieces")
    laid = laid_out(docs, [F.col("doc_id").asc_nulls_first(), "digest", "row"], "order")
    laid = laid.withColumn("range", F.shiftright("place", PLACE_BITS))
    sizes = laid.groupBy("range").agg(F.sum("pieces").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    inside = F.sum("pieces").over(Window.partitionBy("range").orderBy("place")) - F.col("pieces")
    return laid.withColumn("inside", inside).join(before, "range").select(
        "row", (F.col("before") + F.col("inside")).alias("start")), total


def assign_slots(rows: DataFrame, starts: DataFrame, total: int, key: int = KEY) -> DataFrame:
    """Add ``slot`` to sequences with ``row`` and ``piece``."""
    numbered, others, move = _slots(rows, starts, total, key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields if f.name in others)
    return numbered.mapInArrow(move, kinds + ", slot long")


def _slots(rows: DataFrame, starts: DataFrame, total: int, key: int):
    """Sequences with their numbers in ``start``, the other columns' names, and
    what puts the slot in the number's place."""
    numbered = rows.join(starts, "row").withColumn("start", F.col("start") + F.col("piece"))
    names = numbered.columns
    at = names.index("start")
    others = [c for c in names if c != "start"]

    def move(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = permute(batch.column(at).to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(slots)], [*others, "slot"])

    return numbered, others, move


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def packed_records(rows: DataFrame, starts: DataFrame, total: int, key: int, shard_records: int, parts: int) -> DataFrame:
    """``(part, batch)``: the slots and records of a task's sequences, one
    compressed batch for each of ``parts`` runs of shards."""
    shards = max(1, -(-total // shard_records))
    numbered, _, move = _slots(rows.select("row", "piece", "record"), starts, total, key)

    def pack(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            part = table["slot"].to_numpy() // shard_records * parts // shards
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[order[lo]]], pa.int32()), pa.array([_packed(table.take(pa.array(order[lo:hi])))])],
                    ["part", "batch"])

        for batch in move(batches):
            held.append(batch.select(["slot", "record"]))
            size += held[-1].nbytes
            if size > HELD:
                yield from flush()
                held, size = [], 0
        yield from flush()

    return numbered.mapInArrow(pack, "part int, batch binary")


def unpacked_records(packed: DataFrame, low: int, parts: int) -> DataFrame:
    """``(slot, record)`` of the batches of ``parts`` runs of shards from
    ``low`` on, each run in a partition."""

    def unpack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column(1):
                yield from pa.ipc.open_stream(one.as_buffer())

    return packed.select("part", "batch").repartitionById(parts, (F.col("part") - low).cast("int")).mapInArrow(
        unpack, "slot long, record binary")


def materialise(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, key: int = KEY,
                shard_records: int = SHARD_RECORDS) -> tuple[str, DataFrame]:
    """Write the shards below ``path`` (default: a new folder in the shared
    scratch folder). Returns the path and the index ``(doc_id, piece, length,
    ids_crc32, slot, shard, byte_offset)``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    rows = written(sequences(docs, seq_len), "sequences")
    starts, total = first_numbers(rows)
    starts = written(starts, "starts")
    if starts.count() <= SENT:
        starts = F.broadcast(starts)
    shard = F.floor(F.col("slot") / shard_records)
    filler = F.lit(PAD_ID.to_bytes(2, "little"))
    shards = -(-total // shard_records)
    steps = max(1, min(STEPS, shards // STEP_SHARDS))
    parts = min(shards, steps * partitions(spark))
    packed = scratch_path(spark, "packed")
    (packed_records(rows, starts, total, key, shard_records, parts)
     .withColumn("step", F.expr(f"part * {steps} div {max(1, parts)}"))
     .write.partitionBy("step").option("compression", "none").parquet(packed))
    index = assign_slots(rows.select("row", "doc_id", "piece", "length", "ids_crc32"), starts, total, key)
    index = written(index.select("doc_id", "piece", "length", "ids_crc32", "slot", shard.alias("shard"),
                                 (F.pmod("slot", F.lit(shard_records)) * stride(seq_len)).alias("byte_offset")), "index")
    drop_written(rows)
    drop_written(starts)
    edges = [-(-parts * k // steps) for k in range(steps + 1)]
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        if low == high:  # an empty table
            continue
        batches = spark.read.schema("part int, batch binary").parquet(f"{packed}/step={k}")
        (unpacked_records(batches, low, high - low)
         .withColumn("shard", shard).sortWithinPartitions("shard", "slot")
         .select("shard", F.rpad("record", F.lit(2 * seq_len), filler).cast("string").alias("value"))
         .write.mode("append").partitionBy("shard").text(path))
        drop_written(batches)
    return path, index


def read_slots(spark: SparkSession, path: str, first: int, count: int, seq_len: int = SEQ_LEN,
               shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Records ``(slot, ids array<int>)`` of ``count`` slots from ``first``
    on: only the shards that hold them are listed and read."""
    step, last = stride(seq_len), first + count - 1
    shards = range(first // shard_records, last // shard_records + 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(
        [f"{path}/shard={s}" for s in shards])

    def records(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = int(name.rsplit("shard=", 1)[1].split("/", 1)[0]) * shard_records
                got = range(max(first, base), min(last + 1, base + len(content) // step))
                ids = [np.frombuffer(content, "<u2", seq_len, (s - base) * step).astype(np.int32) for s in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(got), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["slot", "ids"])

    return files.select("path", "content").mapInArrow(records, "slot long, ids array<int>")
