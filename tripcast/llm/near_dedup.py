"""MinHash near-duplicate classes with sequential Bayesian verification.

A document's set holds its distinct five-word shingles (see ``shingles``).
Documents with equal sets are one node. Of every node a signature of ``HASHES``
minimum hashes is kept; nodes that agree on all rows of a band are
candidates. A candidate pair is compared batch by batch of its signatures:
after each batch the posterior of the similarity (uniform prior, binomial
matches) gives the chance that it still reaches the threshold, and below
``MISS`` the pair is dropped. Survivors are verified on their full sets.

Buckets are not expanded into all pairs. In each round every node meets one
node of each of its buckets (first the smallest id, then random ones of finer
buckets, made of two bands) if the two are not in one component yet, and the
verified links merge components. Nodes whose buckets still hold different
components are then joined on the rare ends of their sets: with shingles in
one fixed order, rare first, two sets can only reach the threshold if they
share a shingle near their beginnings, and the places of the first shared one
bound the overlap. That loses nothing and does not pair the members of a
large group of loosely similar texts. The hashes of a signature are dealt to
bands by the threshold (``bands``): a pair at it shares none with a chance below
``LOST``.

Defined cases: an empty or null text has the empty set and is linked with
nothing; fewer than five words are one shingle; rows that repeat an id each get
a row, by their own text (ids are taken to be distinct for different texts); a
null id is kept, linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import drop_written, id_and_text, text_slices, written
from tripcast.llm.components import components

SHINGLE = 5
PERCENT = 85  # link when 100 * intersection >= PERCENT * union
HASHES = 120  # minimum hashes of a signature
LOST = 1e-6  # chance at which a pair at the threshold may share no band
BATCH = 24  # minimum hashes that one step of a comparison reads
MISS = 1e-7  # chance at which a pair is given up
ROUNDS = 2
RARE_BITS = 18  # shingles are counted in this many bits' buckets, to order them

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    data = b"\n".join(texts).translate(_LOWER)
    a = np.frombuffer(data, np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    gap = _SPACE[a]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * _powers(_BASE, len(a))[:len(a)], dtype=np.uint64)))
    words = _mix((sums[last] - sums[first]) * _powers(_UNBASE, len(a))[first] + (last - first).astype(np.uint64))
    bounds = np.searchsorted(first, np.concatenate(([0], ends_of)))
    total = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total += words[k:k + len(total)] * _PLACES[k]
    total = _mix(total)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= SHINGLE:
            out.append(np.unique(total[lo:hi - SHINGLE + 1]))
        elif hi > lo:  # the whole sequence; its length sets it apart
            h = (words[lo:hi] * _PLACES[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes, one row a set (an empty set has the largest number)."""
    out = np.full((len(sets), HASHES), np.iinfo(np.uint32).max, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        for k in range(HASHES):
            h = (((values ^ _MASKS[k]) * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(h, starts)
    return out


def bands(percent: int = PERCENT) -> tuple[int, int]:
    """Bands and their rows: the most rows by which fewer than ``LOST`` of the
    pairs at the threshold share no band."""
    for rows in range(10, 0, -1):
        if (1 - (percent / 100) ** rows) ** (HASHES // rows) < LOST:
            return HASHES // rows, rows
    raise ValueError(f"{HASHES} minimum hashes are too few for {percent} percent")


def band_keys(sigs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n, rows = bands(percent)
    keys = np.zeros((len(sigs), n), np.uint64)
    for b in range(n):
        x = np.full(len(sigs), b + 1, np.uint64)
        for r in range(rows):
            x = _mix(x * _BASE + sigs[:, b * rows + r])
        keys[:, b] = x
    return keys.astype(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS, n: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """After each batch the number of matches below which the posterior
    chance of a similarity of ``percent`` or more is under ``miss``."""
    t, out = percent / 100, []
    for seen in range(batch, n + 1, batch):
        # P(similarity >= t | m of seen) = P(Binomial(seen + 1, t) <= m)
        chance, least = 0.0, seen
        for m in range(seen + 1):
            chance += math.comb(seen + 1, m) * t ** m * (1 - t) ** (seen + 1 - m)
            if chance >= miss:
                least = m
                break
        out.append((seen, least))
    return out


NODE = "doc_id long, n_shingles long, digest binary, signature binary, keys array<long>"


def nodes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, digest, signature, keys)`` of every row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        import hashlib

        for ids, texts in text_slices(batches):
            sets = shingles(texts)
            sigs = signatures(sets)
            keys = band_keys(sigs, percent)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s.astype("<u4").tobytes() for s in sigs], pa.binary()),
                pa.array(list(keys), pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "signature", "keys"])

    return id_and_text(docs).mapInArrow(run, NODE)


def prune(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Sequential test of ``(a, b, sig_a, sig_b)``; returns ``(a, b)``."""
    steps = least_matches(percent)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(n, -1) for c in (2, 3))
            alive, seen, matches = np.arange(n), 0, np.zeros(n, np.int64)
            for upto, least in steps:
                matches[alive] += (left[alive, seen:upto] == right[alive, seen:upto]).sum(axis=1)
                alive, seen = alive[matches[alive] >= least], upto
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Exact test on the full sets of ``(a, b, text_a, text_b)``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                s, t = shingles([x.encode()])[0], shingles([y.encode()])[0]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    good.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def rare_ends(left: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(key, place, id, size, label)``: the first shingles of each set of
    ``(id, label, text)``, in the order of how often their bucket occurs and
    then of their hash, as many as a partner must share one of."""
    shift = np.uint64(64 - RARE_BITS)

    def count(batches) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << RARE_BITS, np.int64)
        for _, texts in text_slices(batches):
            for s in shingles(texts):
                np.add.at(n, (s >> shift).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    rows = left.select("id", "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    counts = np.zeros(1 << RARE_BITS, np.int64)  # a fixed number of buckets
    for bucket, n in rows:
        counts[bucket] = n
    table = left.sparkSession.sparkContext.broadcast(counts)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for node, label, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                s = shingles([text.encode()])[0]
                s = s[np.lexsort((s, table.value[(s >> shift).astype(np.int64)]))]
                n = len(s) - -(-percent * len(s) // 100) + 1
                cols[0].append(s[:n].astype(np.int64))
                cols[1].append(np.arange(n))
                for c, v in zip(cols[2:], (node, len(s), label)):
                    c.append(np.full(n, v, np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 ["key", "place", "id", "size", "label"])

    return left.select("id", "label", "text").mapInArrow(run, "key long, place long, id long, size long, label long")


def _sized(n: Column, m: Column, percent: int) -> Column:
    """Can sets of these sizes reach the threshold at all?"""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def classes(docs: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for every input row."""
    found = written(nodes(docs, percent), "nodes")
    # One node for each distinct set; its id is the smallest document's.
    named = found.filter("doc_id is not null and n_shingles > 0")
    sets = named.groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"),
        F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    sets = written(sets, "sets")
    bands = sets.select("id", "size", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    # Only nodes that share a bucket go on: their buckets, signatures and texts.
    met = written(bands.join(shared.hint("shuffle_merge"), "key").groupBy("id").agg(
        F.first("size").alias("size"), F.collect_set("key").alias("keys")), "met")  # a key for each band
    sigs = written(sets.join(met.select("id").hint("shuffle_merge"), "id", "left_semi").select("id", "signature"), "signatures")
    texts = written(id_and_text(docs).join(met.select(F.col("id").alias("doc_id")).hint("shuffle_merge"), "doc_id", "left_semi")
                    .groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")), "texts")
    labels = met.select("id", F.col("id").alias("label"))

    def settle(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Compare, verify, and merge the components that are linked."""
        pairs = written(pairs.distinct(), "pairs")
        with_sigs = (pairs.join(sigs.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")).hint("shuffle_merge"), "a")
                     .join(sigs.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")).hint("shuffle_merge"), "b"))
        left = written(prune(with_sigs, percent), "survivors")
        with_texts = (left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("shuffle_merge"), "a")
                      .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("shuffle_merge"), "b"))
        new = written(verify(with_texts, percent), "links")
        at = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        bt = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        merged = components(new.join(at, "a").join(bt, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        out = written(labels.join(merged.withColumnRenamed("id", "label"), "label", "left").select(
            "id", F.coalesce("component", "label").alias("label")), "labels")
        for used in (pairs, left, new):
            drop_written(used)
        return out

    for r in range(rounds):
        if r == 0:
            keyed = met.select("id", "size", F.explode("keys").alias("key"))
            first = F.struct("id")
        else:  # buckets of two bands, and another node of each to meet
            ks = F.array_sort("keys")
            two = F.transform(ks, lambda k, i: F.xxhash64(
                k, F.element_at(ks, F.lit(1) + ((i + r) % F.size(ks)).cast("int"))))
            keyed = met.select("id", "size", F.explode(two).alias("key"))
            first = F.struct(F.xxhash64("id", "key", F.lit(r)), F.col("id"))
        keyed = keyed.join(labels, "id")
        hub = keyed.groupBy("key").agg(
            F.min_by(F.struct("id", "size", "label"), first).alias("hub"),
            F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "hub")
        pairs = keyed.join(hub, "key").filter(F.col("label") != F.col("hub.label")).filter(
            _sized(F.col("size"), F.col("hub.size"), percent)).select(
            F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
        labels = settle(pairs, labels)

    keyed = met.select("id", F.explode("keys").alias("key")).join(labels, "id")
    mixed = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(
        "lo < hi").select("key")
    left = written(keyed.join(mixed, "key").select("id", "label").distinct()
                   .join(texts.hint("shuffle_merge"), "id"), "open")
    ends = written(rare_ends(left, percent), "ends")
    a, b = ends.alias("a"), ends.alias("b")
    overlap = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))  # at most
    pairs = a.join(b.hint("shuffle_merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label"))
                   & (overlap * (100 + percent) >= percent * (F.col("a.size") + F.col("b.size")))).select(
        F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    labels = settle(pairs, labels)

    for used in (met, sigs, texts, left, ends):
        drop_written(used)
    # Every set's component: the smallest id among its merged nodes.
    out = found.join(sets.select("digest", "id").hint("shuffle_merge"), "digest", "left").join(labels, "id", "left")
    component = F.coalesce("label", "id")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "n_shingles", F.when(linked, component).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    out = classes(docs, percent)
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return out.withColumn("kept", kept)
