"""Removal of repeated passages: bytes covered by a ``WIDTH``-byte string that
also starts in a document with a smaller id.

Every window of ``WIDTH`` bytes has one anchor, the leftmost smallest hash of
the ``GRAM``-byte strings in it; equal windows have equal anchors at equal
places, and neighbouring windows mostly share theirs. So anchors, about one
for every ten to twenty bytes, route the comparison:

0. A document whose whole text a smaller document has is a copy, found by its
   digest: it goes whole, and its anchors need no comparison, nor do they
   count beside those of the smaller document.
1. Texts are stored in chunks, bucketed by chunk, so that no step moves them
   again. Each chunk's distinct anchor hashes go, 32 bits
   each and sorted, to ranges of the hash space; a range says by one bit per
   anchor whether another document has it. Chunks get their bits back.
2. Each occurrence of a shared anchor gives a snippet, the bytes of its
   windows; a chunk sends equal ones once, with their places. Snippets meet by anchor; the distinct ones of an anchor form one
   text, whose suffix array (see ``suffixes``) lays equal windows side by
   side. A window is removed where its class has a smaller document.
3. An anchor of more than ``FREQUENT`` occurrences, however few documents have
   them, is not gathered: its windows are classed within each chunk the same
   way, all such anchors of a chunk together, a document's windows of one class go as merged runs of bytes (a long
   run of one character is one), and the chunks' classes meet by a 128-bit
   digest of their bytes in a grouped minimum and a join.
4. Chunks get their documents' removed runs and write the results.

Memory is bounded by the chunk (``CHUNK`` bytes, or one longer text), by the
range and by ``FREQUENT`` snippets.

Defined cases: a null text is empty; texts under ``WIDTH`` bytes lose nothing;
rows that repeat an id have no smaller id between them; a row with a null id
takes part in no match; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import drop_written, id_and_text, text_slices, written, written_by
from tripcast.llm.suffixes import equal_windows

WIDTH, GRAM = 50, 24
SPAN = WIDTH - GRAM + 1  # grams in a window
CHUNK = 2 << 20
RANGE_ROWS = 1 << 21  # anchors that one range holds, about
FREQUENT = 1 << 15  # occurrences of one anchor that a task gathers, some 2 MB
OFTEN = 200_000  # occurrences of a frequent anchor that a chunk expands at once
TOGETHER = 12  # distinct snippets in one text of the suffix array
GATHERED = 24_000  # occurrences, in whole anchors, that one call of the suffix array treats, about
NO_ID = np.iinfo(np.int64).min  # stands for a null id

_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 256, np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

CHUNKS = "chunk long, bytes long, ids binary, lens binary, digests binary, text binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _UNBASE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return have[0][:n], have[1][:n]


def _grams(a: np.ndarray) -> np.ndarray:
    n = len(a) - GRAM + 1
    up, down = _powers(len(a))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.multiply(_BYTES[a], up, out=sums[1:])
    np.cumsum(sums, out=sums)
    h = sums[GRAM:] - sums[:-GRAM]
    h *= down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk's documents, one after another: each anchor's hash, the
    number of its document, its place in the chunk, and the first and last
    start of the windows that it stands for."""
    empty = np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    if not (lens >= WIDTH).any():
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    h = _grams(np.frombuffer(text, np.uint8))
    # The high bits of a hash with its place below them: the smallest of a
    # window's grams, the leftmost of equal ones, and its place in one number.
    bits = np.uint64(max(1, len(h).bit_length()))
    low = h >> bits
    low <<= bits
    low |= np.arange(len(h), dtype=np.uint64)
    width = 1  # smallest of ever wider windows
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[:-(SPAN - width)], low[SPAN - width:])
    n = np.maximum(lens - WIDTH + 1, 0)  # windows of the documents; none goes over a document's end
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), n)
    start = np.arange(n.sum(), dtype=np.int32)
    start += np.repeat((ends - lens - np.cumsum(n) + n).astype(np.int32), n)
    place = low[start]
    place &= (np.uint64(1) << bits) - np.uint64(1)
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    end = np.append(cut[1:], len(start)) - 1
    place = place[cut].astype(np.int64)
    return h[place], doc[cut].astype(np.int64), place, start[cut].astype(np.int64), start[end].astype(np.int64)


def store_chunks(docs: DataFrame) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for ids, texts in text_slices(batches, CHUNK):
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            lens = np.array([len(t) for t in texts], np.int64)
            digests = b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in texts])
            yield pa.RecordBatch.from_arrays(
                [pa.array([nth], pa.int64()), pa.array([lens.sum()], pa.int64()),
                 *(pa.array([x], pa.binary()) for x in (known.tobytes(), lens.tobytes(), digests, b"".join(texts)))],
                ["chunk", "bytes", "ids", "lens", "digests", "text"])
            nth += 1

    return written_by(id_and_text(docs).mapInArrow(run, CHUNKS), "chunks", "chunk")


def _distinct(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, in how many documents each of them occurs, and how
    often in all."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    more = new.copy()
    if len(h):
        more[1:] |= ids[1:] != ids[:-1]
    at = np.flatnonzero(new)
    return h[at], (np.add.reduceat(more.astype(np.int64), at) if len(at) else at), np.diff(np.append(at, len(h)))


def _own_anchors(row: dict) -> tuple[np.ndarray, ...]:
    """Anchors of a stored chunk with document ids; null ids and the chunk's
    ``copies`` take no part."""
    ids, lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
    own = ids != NO_ID
    own[np.array(row["copies"] or [], np.int64)] = False
    docs, ends, text = np.flatnonzero(own), np.cumsum(lens), row["text"]
    if len(docs) < len(ids):
        text = b"".join([text[b - n:b] for b, n in zip(ends[docs].tolist(), lens[docs].tolist())])
    h, doc, place, first, last = anchors(text, lens[docs])
    left_out = (ends[docs] - np.cumsum(lens[docs]))[doc]  # bytes before the document
    return h, docs[doc], place + left_out, first + left_out, last + left_out, ids


def shared_anchors(chunks: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """``(chunk, marks)``: for each distinct anchor hash of a chunk outside its
    copies, ascending, 0 (its alone), 1 (shared) or 2 (frequent), by hash
    ranges."""
    return _by_chunk(_marks(chunks, copies))


def _by_chunk(marks: DataFrame) -> DataFrame:
    # A chunk has at most a row for each of its anchors.
    return marks.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "marks"))).alias("marks"))


def _meet(group: pd.DataFrame, frequent: int, rows: int) -> list[bytes]:
    """Marks of one range's anchors, which ascend in each row; anchors being
    smallest hashes, low ranges hold many, so slices of their values meet one
    after another, of about ``rows`` anchors each."""
    hs = [np.frombuffer(x, "<u4") for x in group["h"]]
    slices = sum(map(len, hs)) // rows + 1
    edges = (np.arange(1, slices, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(slices)).astype("<u4")
    cuts = [np.concatenate(([0], np.searchsorted(h, edges), [len(h)])) for h in hs]
    ats = [np.frombuffer(x, "<u4") for x in group["at"]]
    at_cuts = [np.searchsorted(at, cut) for at, cut in zip(ats, cuts)]
    counts = [[np.frombuffer(x, "<u4") for x in group[c]] for c in ("n", "often")]
    marks = [np.zeros(len(h), np.uint8) for h in hs]
    for k in range(slices):
        _, back = np.unique(np.concatenate([h[cut[k]:cut[k + 1]] for h, cut in zip(hs, cuts)]), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum([cut[k + 1] - cut[k] for cut in cuts])))

        def total(ns: list[np.ndarray]) -> np.ndarray:
            m = np.ones(len(back), np.int64)
            for b, cut, at, at_cut, n in zip(begin.tolist(), cuts, ats, at_cuts, ns):
                if at_cut[k + 1] > at_cut[k]:
                    m[b - cut[k] + at[at_cut[k]:at_cut[k + 1]]] = n[at_cut[k]:at_cut[k + 1]]
            return np.bincount(back, m)[back]

        found = np.where(total(counts[0]) > 1, np.where(total(counts[1]) > frequent, 2, 1), 0).astype(np.uint8)
        for mark, cut, b in zip(marks, cuts, begin.tolist()):
            mark[cut[k]:cut[k + 1]] = found[b:b + cut[k + 1] - cut[k]]
    return [m.tobytes() for m in marks]


def _marks(chunks: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """The marks of each chunk and hash range, stored."""
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    bits = max(4, int(size / 15 / RANGE_ROWS).bit_length() + 1)

    def send(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, doc, _, _, _, ids = _own_anchors(row)
                h, n, often = _distinct(h, ids[doc] if len(doc) else doc)
                part = (h >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))  # of the ranges it has
                short = ((h << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
                out: list[list] = [[], [], [], [], [], []]
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if hi > lo:
                        several = np.flatnonzero(often[lo:hi] > 1)
                        for c, v in zip(out, (int(part[lo]), row["chunk"], short[lo:hi].tobytes(), several.astype("<u4").tobytes(),
                                              n[lo:hi][several].astype("<u4").tobytes(), often[lo:hi][several].astype("<u4").tobytes())):
                            c.append(v)
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                                 ["part", "chunk", "h", "at", "n", "often"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": group["part"], "chunk": group["chunk"], "marks": _meet(group, FREQUENT, RANGE_ROWS)})

    sides = chunks.select("chunk", "ids", "lens", "text")
    joined = (sides.withColumn("copies", F.lit(None).cast("array<int>")) if copies is None else
              sides.join(copies.hint("shuffle_merge"), "chunk", "left"))
    sent = joined.mapInArrow(send, "part int, chunk long, h binary, at binary, n binary, often binary")
    met = sent.groupBy("part").applyInPandas(meet, "part int, chunk long, marks binary")
    return written(met, "marks")


SNIPPETS = ("kind int, h long, snippet binary, places binary, chunk long, doc int, id long, first int, last int, "
            "d1 long, d2 long")
# Where a snippet occurs in a chunk: document's number and id, first start.
PLACE = np.dtype([("doc", "<i4"), ("id", "<i8"), ("first", "<i4")])


def _batch(n: int, **columns) -> pa.RecordBatch:
    fields = [c.split() for c in SNIPPETS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(n, kinds[kind])
                                       for name, kind in fields], [name for name, _ in fields])


def _places(row, text: bytes, k: np.ndarray, h, doc, ids, first, last, begin) -> Iterator[pa.RecordBatch]:
    """One row for each distinct snippet of a chunk's anchors ``k``, with all
    of its places: a passage that many documents share goes once a chunk."""
    k = k[np.argsort(h[k], kind="stable")]
    for at in range(0, len(k), 20_000):
        part = k[at:at + 20_000]
        number: dict[tuple[int, bytes], int] = {}
        of = np.fromiter((number.setdefault((x, text[a:b]), len(number)) for x, a, b in zip(
            h[part].tolist(), first[part].tolist(), (last[part] + WIDTH).tolist())), np.int64, len(part))
        order = np.argsort(of, kind="stable")
        part, of = part[order], of[order]
        packed = np.empty(len(part), PLACE)
        packed["doc"], packed["id"], packed["first"] = doc[part], ids[doc[part]], first[part] - begin[doc[part]]
        raw, edges = packed.tobytes(), np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)) * PLACE.itemsize
        n = len(number)
        yield _batch(n, kind=np.full(n, 1, np.int32), h=np.array([x for x, _ in number], np.uint64).astype(np.int64),
                     snippet=[x for _, x in number], places=[raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())],
                     chunk=np.full(n, row["chunk"]))


def _steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _merge(classes: np.ndarray, strings: list[bytes], windows: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Classes of the snippets ``some``, made one where their bytes agree."""
    offsets = np.cumsum(windows) - windows
    at = np.repeat(offsets[some], windows[some]) + _steps(windows[some])
    which = np.repeat(some, windows[some])
    _, once = np.unique(classes[at], return_index=True)
    same: dict[bytes, int] = {}
    to = np.arange(classes.max() + 1)
    for w, o, c in zip(which[once].tolist(), (at[once] - offsets[which[once]]).tolist(), classes[at[once]].tolist()):
        to[c] = same.setdefault(strings[w][o:o + WIDTH], c)
    return to[classes]


def _whole_anchors(h: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts occurrences that lie by anchor into whole anchors, about
    ``GATHERED`` occurrences at a time."""
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    done = 0
    while done < len(h):
        upto = int(ends[min(np.searchsorted(ends, done + GATHERED), len(ends) - 1)])
        yield done, upto
        done = upto


def _class_windows(strings: list[bytes], anchor: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct snippets that lie by their ``anchor`` (numbers): the windows,
    numbered through all snippets, of anchors with several of them, and their
    classes. Windows of one snippet differ, and so do windows of two anchors."""
    offsets = np.cumsum(windows) - windows
    several = np.bincount(anchor)[anchor]
    multi = np.flatnonzero(several > 1)
    where = np.repeat(offsets[multi], windows[multi]) + _steps(windows[multi])
    if not len(multi):
        return where, where
    # Texts of a few snippets each; classes of two texts of one anchor are
    # merged by their bytes.
    rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    owner = np.unique(anchor[multi] * (len(anchor) + 1) + rank[multi] // TOGETHER, return_inverse=True)[1]
    some = [strings[k] for k in multi]
    classes = equal_windows(some, owner, windows[multi], WIDTH)
    large = np.flatnonzero(several[multi] > TOGETHER)
    return where, _merge(classes, some, windows[multi], large) if len(large) else classes


def snippets(chunks: DataFrame, marks: DataFrame, copies: DataFrame) -> DataFrame:
    """Occurrences of shared anchors (kind 1) and windows of frequent ones
    (kind 2: for each class and document of the chunk, its merged byte runs)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, doc, place, first, last, ids = _own_anchors(row)
                if not len(h) or not row["marks"]:
                    continue
                mark = np.concatenate([np.frombuffer(m["marks"], np.uint8) for m in row["marks"]])
                _, back = np.unique(h, return_inverse=True)
                mark = mark[back]
                text, begin = row["text"], np.concatenate(([0], np.cumsum(np.frombuffer(row["lens"], np.int64))))
                yield from _places(row, text, np.flatnonzero(mark == 1), h, doc, ids, first, last, begin)
                often = np.flatnonzero(mark == 2)
                often = often[np.argsort(h[often], kind="stable")]
                for lo, hi in _whole_anchors(h[often]):
                    yield from _frequent(row, text, often[lo:hi], h, doc, ids, first, last, begin)

    joined = chunks.select("chunk", "ids", "lens", "text").join(
        marks.join(copies.hint("shuffle_merge"), "chunk", "left").hint("shuffle_merge"), "chunk")
    return joined.mapInArrow(run, SNIPPETS)


def _frequent(row, text, k, h, doc, ids, first, last, begin) -> Iterator[pa.RecordBatch]:
    """Rows of whole anchors' occurrences ``k``, which lie by anchor."""
    number: dict[bytes, int] = {}
    of = np.empty(len(k), np.int64)
    for at in range(0, len(k), OFTEN):
        part = k[at:at + OFTEN]
        of[at:at + OFTEN] = [number.setdefault(text[a:b + WIDTH], len(number)) for a, b in zip(first[part].tolist(), last[part].tolist())]
    distinct = list(number)
    windows = np.fromiter(map(len, distinct), np.int64, len(distinct)) - WIDTH + 1
    offsets = np.concatenate(([0], np.cumsum(windows)))
    anchor = np.concatenate(([0], np.cumsum(h[k][1:] != h[k][:-1])))[np.unique(of, return_index=True)[1]]
    index = np.arange(offsets[-1])  # of a window: the first one of its class, then its class
    where, classes = _class_windows(distinct, anchor, windows)
    _, once, back = np.unique(classes, return_index=True, return_inverse=True)
    index[where] = where[once][back]
    at, index = np.unique(index, return_inverse=True)
    which = np.searchsorted(offsets, at, side="right") - 1
    digests = np.frombuffer(b"".join([hashlib.blake2b(distinct[s][a:a + WIDTH], digest_size=16).digest()
                                      for s, a in zip(which.tolist(), (at - offsets[which]).tolist())]), np.int64).reshape(-1, 2)
    for at in range(0, len(k), OFTEN):  # occurrences lie in the order of their places
        part, these = k[at:at + OFTEN], of[at:at + OFTEN]
        n = windows[these]
        step = _steps(n)
        who, cls = doc[np.repeat(part, n)], index[np.repeat(offsets[these], n) + step]
        lo = np.repeat(first[part], n) + step - begin[who]
        order = np.lexsort((lo, cls, who))
        who, cls, lo = who[order], cls[order], lo[order]
        new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (cls[1:] != cls[:-1]) | (lo[1:] > lo[:-1] + WIDTH))))
        who, cls, hi = who[new], cls[new], lo[np.append(new[1:], len(lo)) - 1] + WIDTH
        yield _batch(len(who), kind=np.full(len(who), 2, np.int32), chunk=np.full(len(who), row["chunk"]),
                     doc=who.astype(np.int32), id=ids[who], first=lo[new].astype(np.int32), last=hi.astype(np.int32),
                     d1=digests[cls, 0], d2=digests[cls, 1])


RUNS = "chunk long, doc int, lo int, hi int"


def _match(found: DataFrame) -> DataFrame:
    """Removed runs from the snippets of shared anchors, anchor by anchor."""

    def flush(h, own, chunk, doc, ids, first) -> Iterator[pa.RecordBatch]:
        """Whole anchors: their occurrences' snippets, documents and places."""
        anchor = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        # A snippet has its anchor inside, so equal ones belong to one anchor.
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(x, len(number)) for x in own), np.int64, len(own))
        distinct = list(number)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, of, ids)
        n = np.fromiter(map(len, distinct), np.int64, len(distinct)) - WIDTH + 1
        offsets = np.concatenate(([0], np.cumsum(n)))
        least = np.repeat(low, n)  # of each window: the smallest document of its class
        where, classes = _class_windows(distinct, anchor[np.unique(of, return_index=True)[1]], n)
        if len(where):
            best = np.full(classes.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, classes, least[where])
            least[where] = best[classes]
        m = n[of]
        step = _steps(m)
        gone = np.flatnonzero(least[np.repeat(offsets[of], m) + step] < np.repeat(ids, m))
        if len(gone):  # runs of neighbouring windows of one occurrence
            who, start = np.repeat(np.arange(len(of)), m)[gone], (np.repeat(first, m) + step)[gone]
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1))))
            a, b = who[new], np.append(new[1:], len(gone)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.astype(k)) for x, k in zip((chunk[a], doc[a], start[new], start[b] + WIDTH),
                                                       (np.int64, np.int32, np.int32, np.int32))],
                ["chunk", "doc", "lo", "hi"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of the last anchor, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column(3).to_pylist()
            n = np.fromiter(map(len, packed), np.int64, len(packed)) // PLACE.itemsize
            at = np.frombuffer(b"".join(packed), PLACE)
            own = [x for x, c in zip(batch.column(1).to_pylist(), n.tolist()) for _ in range(c)]
            cols = [np.repeat(batch.column(0).to_numpy(), n), own, np.repeat(batch.column(2).to_numpy(), n),
                    *(np.ascontiguousarray(at[c]) for c in ("doc", "id", "first"))]
            if rest is not None:
                cols = [x + y if isinstance(y, list) else np.concatenate((x, y)) for x, y in zip(rest, cols)]
            cuts = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1  # beginnings of anchors
            done = 0
            while len(cuts) and cuts[-1] - done >= GATHERED:
                upto = cuts[min(np.searchsorted(cuts, done + GATHERED), len(cuts) - 1)]
                yield from flush(*(c[done:upto] for c in cols))
                done = upto
            rest = [c[done:] for c in cols]
        if rest is not None and len(rest[0]):
            yield from flush(*rest)

    rows = found.filter("kind = 1").select("h", "snippet", "chunk", "places")
    # An anchor here has at most FREQUENT occurrences; the order keeps it together.
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, RUNS)


def _match_frequent(found: DataFrame) -> DataFrame:
    rows = found.filter("kind = 2").select("d1", "d2", "chunk", "doc", "id", F.col("first").alias("lo"), F.col("last").alias("hi"))
    low = rows.groupBy("d1", "d2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    low = written(low.drop("high"), "frequent")
    return rows.join(low.hint("shuffle_merge"), ["d1", "d2"]).filter("low < id").select(
        "chunk", "doc", "lo", "hi")


def copied(chunks: DataFrame) -> DataFrame:
    """``(chunk, doc, lo, hi)`` of whole copies of a smaller document's text,
    stored."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
                k = np.flatnonzero((lens >= WIDTH) & (ids != NO_ID))
                digests = [row["digests"][16 * i:16 * i + 16] for i in k.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), row["chunk"])), pa.array(k.astype(np.int32)), pa.array(ids[k]),
                     pa.array(lens[k].astype(np.int32)), pa.array(digests, pa.binary())], ["chunk", "doc", "id", "hi", "digest"])

    sides = chunks.select("chunk", "ids", "lens", "digests")
    rows = written(sides.mapInArrow(run, "chunk long, doc int, id long, hi int, digest binary"), "digests")
    low = rows.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    low = written(low.select("digest", "low"), "copied")
    out = written(rows.join(low.hint("shuffle_merge"), "digest").filter("low < id").select(
        "chunk", "doc", F.lit(0).alias("lo"), "hi"), "copies")
    for used in (rows, low):
        drop_written(used)
    return out


def removed_runs(chunks: DataFrame) -> DataFrame:
    """``(chunk, doc, lo, hi)``: removed byte runs (they may overlap) of the
    chunk's documents, by number."""
    whole = copied(chunks)
    copies = whole.groupBy("chunk").agg(F.collect_list("doc").alias("copies"))
    marks = _marks(chunks, copies)
    found = written(snippets(chunks, _by_chunk(marks), copies), "snippets")
    drop_written(marks)
    runs = written(_match(found).unionByName(_match_frequent(found)).unionByName(whole), "runs")
    for used in (found, whole):
        drop_written(used)
    return runs


RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
          "spans array<struct<lo:int,hi:int>>, kept_text string")


def _whole_characters(text: bytes, los: np.ndarray, his: np.ndarray) -> str:
    """The text outside the spans; a character that a span cuts goes whole."""
    edges = zip([0, *his.tolist()], [*los.tolist(), len(text)])
    return "".join(text[a:b].decode("utf-8", "ignore") for a, b in edges)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row for each input row: sizes, the kept bytes' digest and, with
    ``with_text``, the kept bytes, the removed spans and the kept bytes' whole
    characters as text."""
    chunks = store_chunks(docs)
    return _results(chunks, removed_runs(chunks), with_text)


def _results(chunks: DataFrame, runs: DataFrame, with_text: bool) -> DataFrame:
    # A chunk's runs: at most one for each anchor of its bytes, and the merged
    # runs of its frequent anchors' classes.
    by_chunk = runs.groupBy("chunk").agg(F.collect_list(F.struct("doc", "lo", "hi")).alias("runs"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
                 pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.string()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans", "kept_text"]
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lens, text = (batch.column(c)[k].as_py() for c in (1, 2, 3))
                ids, lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
                begin = np.concatenate(([0], np.cumsum(lens)))
                change = np.zeros(len(text) + 1, np.int32)
                found = batch.column(4)[k]
                if found.is_valid:
                    flat = found.values
                    doc, lo, hi = (flat.field(c).to_numpy() for c in range(3))
                    np.add.at(change, begin[doc] + lo, 1)
                    np.add.at(change, begin[doc] + hi, -1)
                gone = np.cumsum(change[:-1]) > 0
                a = np.frombuffer(text, np.uint8)
                out: list[list] = [[] for _ in names]
                for i, n, b in zip(ids.tolist(), lens.tolist(), begin.tolist()):
                    mask = gone[b:b + n]
                    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
                    los, his = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    kept = a[b:b + n][~mask].tobytes()
                    for c, v in zip(out, (None if i == NO_ID else i, n, int(mask.sum()), len(los), hashlib.sha256(kept).hexdigest(),
                                          kept if with_text else None,
                                          [{"lo": x, "hi": y} for x, y in zip(los.tolist(), his.tolist())] if with_text else None,
                                          _whole_characters(text[b:b + n], los, his) if with_text else None)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    joined = chunks.select("chunk", "ids", "lens", "text").join(by_chunk.hint("shuffle_merge"), "chunk", "left")
    return joined.select("chunk", "ids", "lens", "text", "runs").mapInArrow(run, RESULT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed bytes gone from ``text`` (a character cut in
    two goes whole) and ``n_chars``, where there is one, counted anew. Only
    documents that lose bytes are rewritten; one that loses all of its text is
    dropped."""
    chunks = store_chunks(docs)
    runs = removed_runs(chunks)
    found = written(_results(chunks, runs, True).filter("n_removed > 0").select("doc_id", "n_bytes", "kept_text"), "cut")
    for used in (chunks, runs):
        drop_written(used)
    # Rows that repeat an id are told apart by their text's length; rows equal
    # in both are one and the same case, so any of the results holds.
    found = found.select(F.col("doc_id").alias("__id"), F.col("n_bytes").alias("__n"), F.col("kept_text").alias("__kept")
                         ).dropDuplicates(["__id", "__n"])
    size = F.octet_length("text").cast("long")
    d = docs.join(found.hint("shuffle_merge"), (docs["doc_id"] == found["__id"]) & (size == found["__n"]), "left")
    d = d.withColumn("text", F.coalesce("__kept", "text"))
    d = d.filter(F.col("__kept").isNull() | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return d.select(*docs.columns)
