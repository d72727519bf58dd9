"""Nearest neighbours by Hilbert orderings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.llm import common, hilbert

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, vector array<double>, rank string, score double, t int"


def brute(rows, is_query, k):
    out = {}
    for q, x in rows:
        if is_query(q):
            found = {}
            for i, y in rows:
                if i != q and len(y) == len(x):
                    d = float(np.sqrt(np.square(np.asarray(y, float) - np.asarray(x, float)).sum()))
                    found[i] = min(d, found.get(i, np.inf))
            for i, d in found.items():
                out.setdefault(q, {}).setdefault(i, d)
                out[q][i] = min(out[q][i], d)
    return {q: sorted((d, i) for i, d in f.items())[:k] for q, f in out.items()}


def as_lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for found in out.values():
        assert [f[0] for f in sorted(found)] == list(range(1, len(found) + 1))
    return {q: [f[1:] for f in sorted(found)] for q, found in out.items()}


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert.hilbert_index(grid, bits)
        assert sorted(keys) == list(range(side ** dims))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_fixture_is_exact_on_a_small_table(llm):
    vectors = common.read_table(llm, SF, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    rows = [(r.vec_id, r.vector) for r in vectors.collect()]
    assert as_lists(hilbert.search(vectors, F.col("vec_id") % 100 == 0)) == brute(rows, lambda i: i % 100 == 0, 10)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_where_windows_are_narrow(llm, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(40, size=12000)] + spread * rng.normal(size=(12000, 24))
    vectors = llm.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<float>")
    got = as_lists(hilbert.search(vectors, F.col("vec_id") % 200 == 0, least=1))
    f = x.astype(np.float32).astype(float)
    hit = total = 0
    for q in range(0, 12000, 200):
        d = np.sqrt(np.square(f - f[q]).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(12000), d))[:10]
        hit += len(set(want) & {i for _, i in got[q]})
        total += 10
        assert all(d[i] == s for s, i in got[q])
    assert hit / total >= 0.9


def test_odd_rows_ties_and_a_hot_vector(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]),
            (600, [None, 1.0]), (None, [1.0, 1.0]), (700, [2.0, 0.0, 0.0]), (800, [5.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]),
            (2, [3.0, 4.0]), (2, [1.0, 0.5]), (100, [1.0, 2.0])]
    rows += [(1000 + i, [1.0, 0.25]) for i in range(3000)]  # one vector many times
    df = llm.createDataFrame([(i, v, "r", 0.0, 1) for i, v in rows], SCHEMA)
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    got = as_lists(hilbert.search(df, F.col("vec_id") % 100 == 0))
    want = brute(good, lambda i: i % 100 == 0, 10)
    assert got == want and not {300, 700, 800} & set(got)
    assert got[1500] == [(0.0, i) for i in range(1000, 1010)]
    assert hilbert.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
