"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected, ``ORDERINGS`` times, onto ``DIMENSIONS`` random
orthonormal directions, spread over a shifted unit grid and numbered along a
Hilbert curve. Each ordering is range-partitioned and sorted by Spark and cut
into blocks of ``BLOCK`` neighbouring keys. A query meets, in each ordering,
the blocks around its own key; every block yields the query's nearest by the
exact distance on the original vectors, and a merge keeps the nearest of all
blocks. Only the centre and spread of the projections are fitted, on at most
``FIT_ROWS`` rows (those with the smallest id hashes); every vector is indexed.

The window is a share of the ordering, so that recall does not fall when the
table grows. On data without structure (the test vectors have 64 nearly
independent components, their tenth neighbour lies at 0.8 of the median
distance) a curve can hardly prune, and the windows of all orderings together
hold about as many rows as the table; where the vectors have fewer real
dimensions a much smaller ``share`` does. Of equal vectors only the ``k + 1``
smallest ids are indexed, which loses nothing: they come before the others of
their group at every distance. Memory in a task is one block and
one batch of queries, whatever the table's size.

Null, empty or all-zero vectors and vectors with a null or non-finite
component take no part, nor do null ids. Vectors of different lengths are
never compared. Rows that repeat an id are versions of one vector: they are
not each other's candidates, and the nearest version counts. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripcast.llm.common import drop_written, laid_out, positions, written

ORDERINGS = 16
DIMENSIONS = 8
BITS = 6            # of a grid coordinate; DIMENSIONS * BITS stay below 64
BLOCK = 512         # neighbouring keys of an ordering that are scored together
SHARE = 0.03        # of the ordering, on either side of a query
LEAST_BLOCKS = 2    # on either side, however small the table
FIT_ROWS = 4096
SEED = 20


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN sorts above
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hilbert_index(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``grid`` (whole numbers
    below ``2**bits``), by Skilling's transform: undo the excess rotations
    from the top bit down, Gray-code, then interleave the bits."""
    x = grid.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


@lru_cache(maxsize=64)
def directions(length: int, ordering: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal projection and grid shift of an ordering, from its number."""
    rng = np.random.default_rng([SEED, ordering, length])
    basis = np.linalg.qr(rng.normal(size=(length, min(dims, length))))[0]
    return basis, rng.random(basis.shape[1]) / 2


def curve_keys(vectors: np.ndarray, fit: dict, orderings: int, dims: int, bits: int) -> np.ndarray:
    """One Hilbert key an ordering for each row of ``vectors``."""
    length = vectors.shape[1]
    centre, spread = fit.get(length, (np.zeros(length), 1.0))
    out = np.empty((len(vectors), orderings), np.int64)
    for t in range(orderings):
        basis, shift = directions(length, t, dims)
        # a logistic curve close to the normal law fills the grid evenly
        even = 1.0 / (1.0 + np.exp(np.clip(-1.702 * ((vectors - centre) / spread) @ basis, -500, 500)))
        cells = (even + shift) / 1.5 * (1 << bits)
        out[:, t] = hilbert_index(np.clip(cells, 0, (1 << bits) - 1), bits)
    return out


def fit_projection(vectors: DataFrame, rows: int = FIT_ROWS) -> dict[int, tuple[np.ndarray, float]]:
    """Centre and spread of each vector length met among at most ``rows`` rows."""
    sample: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect():
        sample.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for length, found in sample.items():
        x = np.asarray(found, np.float64)
        spread = float(np.sqrt(np.square(x - x.mean(0)).mean()))
        out[length] = (x.mean(0), spread if spread > 0 else 1.0)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length of a list column, as doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows with equal values in all columns."""
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = np.append(np.flatnonzero(change), len(change))
    yield from zip(starts[:-1], starts[1:])


def with_keys(vectors: DataFrame, fit: dict, orderings: int, dims: int, bits: int) -> DataFrame:
    """Adds ``length`` and ``keys``, the vector's key in each ordering."""
    schema = f"vec_id long, vector {vectors.schema['vector'].dataType.simpleString()}, length int, keys array<long>"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("vector")
            lengths = np.asarray(column.value_lengths())
            keys = np.empty((len(lengths), orderings), np.int64)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                keys[rows] = curve_keys(_vectors(column.take(pa.array(rows))), fit, orderings, dims, bits)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, orderings, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), column, pa.array(lengths.astype(np.int32)), lists],
                ["vec_id", "vector", "length", "keys"])

    return vectors.mapInArrow(run, schema)


def nearest_in_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int
                     ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ``k`` nearest rows of a block that are not its own:
    ids and exact distances. A product of matrices finds them but for its
    rounding, whose bound decides which rows are measured exactly."""
    squares = np.einsum("ij,ij->i", rows, rows)
    own = np.einsum("ij,ij->i", queries, queries)
    rough = own[:, None] + squares[None, :] - 2.0 * (queries @ rows.T)
    slack = 1e-12 * (own + squares.max())
    for i, q in enumerate(query_ids):
        other = np.flatnonzero(ids != q)
        if not len(other):
            continue
        d = rough[i, other]
        if len(d) > k:
            other = other[d <= np.partition(d, k - 1)[k - 1] + 2 * slack[i]]
        exact = np.sqrt(np.square(rows[other] - queries[i]).sum(1))
        best = np.lexsort((ids[other], exact))[:k]
        yield q, ids[other][best], exact[best]


def score_blocks(rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the nearest of each met block. Rows come
    sorted by block, its vectors before the queries that meet it."""
    def run(batches):
        at, ids, vectors, block = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, length, number, kind = (np.asarray(batch.column(c)) for c in ("t", "length", "block", "kind"))
            vec_ids, column = np.asarray(batch.column("vec_id")), batch.column("vector")
            out: list[tuple] = []
            for a, b in _runs(t, length, number, kind):
                here = (t[a], length[a], number[a])
                if here != at:
                    at, ids, vectors, block = here, [], [], None
                if kind[a] == 0:
                    ids.append(vec_ids[a:b])
                    vectors.append(_vectors(column.slice(a, b - a)))
                    continue
                if block is None:
                    if not ids:  # keys of queries only
                        continue
                    block = np.concatenate(ids), np.concatenate(vectors)
                for c in range(a, b, BLOCK):
                    e = min(b, c + BLOCK)
                    out += nearest_in_block(*block, vec_ids[c:e], _vectors(column.slice(c, e - c)), k)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in out]), pa.int64()),
                     pa.array(np.concatenate([i for _, i, _ in out]), pa.int64()),
                     pa.array(np.concatenate([d for _, _, d in out]), pa.float64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, orderings: int = ORDERINGS, dims: int = DIMENSIONS,
           bits: int = BITS, share: float = SHARE, least: int = LEAST_BLOCKS) -> DataFrame:
    """The ``k`` nearest found of each query row of ``vectors (vec_id, vector)``
    among all other rows: ``query_id, rank, vec_id, score``, by Euclidean
    distance, ties to the smaller id. ``is_query`` is a condition on
    ``vec_id``."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").filter(
        F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # of equal vectors only the k + 1 smallest ids can be among anyone's k nearest
    equal = Window.partitionBy("vector").orderBy("vec_id")
    candidates = own.distinct().withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).drop("n")
    fit = fit_projection(own)
    keyed = [with_keys(part, fit, orderings, dims, bits).withColumn("query", F.lit(flag))
             for part, flag in ((candidates, False), (own.filter(is_query), True))]
    each = keyed[0].unionByName(keyed[1]).select(
        "vec_id", "vector", "length", "query", F.posexplode("keys").alias("t", "key"))
    laid = laid_out(each, ["t", "length", "key", "query", "vec_id"], "curves")
    placed = positions(laid, ["t", "length"])
    block = F.floor(F.col("pos") / BLOCK)
    rows = placed.filter(~F.col("query")).select("t", "length", block.alias("block"), F.lit(0).alias("kind"), "vec_id",
                                                 "vector")
    blocks = F.ceil(F.col("n") / BLOCK)
    side = F.greatest(F.lit(least), F.round(blocks * share)).cast("long")
    met = F.explode(F.sequence(F.greatest(F.lit(0), block - side), F.least(blocks - 1, block + side)))
    queries = placed.filter("query").select("t", "length", met.alias("block"), F.lit(1).alias("kind"), "vec_id", "vector")
    group = ["t", "length", "block"]
    met_rows = rows.unionByName(queries).repartition(*group).sortWithinPartitions(*group, "kind")
    found = score_blocks(met_rows, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                  .select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_written(laid)
    return out
