"""Merkle manifest against a plain recomputation of the contract."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tripcast.llm import common, manifest

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def climb(nodes, proofs):
    """Root of a tree; each leaf's list of (left, right) goes to ``proofs``."""
    members, level = [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        up, joined = [], []
        for a in range(0, len(level), 3):
            run = level[a:a + 3]
            for j in range(len(run)):
                for i in members[a + j]:
                    proofs[i].append((run[:j], run[j + 1:]))
            up.append(h(*run))
            joined.append(sum(members[a:a + 3], []))
        level, members = up, joined
    return level[0]


def brute(rows):
    """Multiset of result rows."""
    by = collections.defaultdict(list)
    for r in rows:
        text = r[4]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        changed = text.replace("\n", "") if hit and text is not None else text
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, text), leaf(r, changed)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner, subroots = {}, []
    for name in names:
        by[name].sort()
        inner[name] = [[] for _ in by[name]]
        subroots.append(climb([x[2] for x in by[name]], inner[name]))
    outer = [[] for _ in names]
    root = climb(subroots, outer)
    out = collections.Counter()
    for s, name in enumerate(names):
        for x, path in zip(by[name], inner[name]):
            path = path + outer[s]
            got = x[3]
            for left, right in path:
                got = h(*left, got, *right)
            proof = h(*[d for left, right in path for d in (*left, *right)])
            out[(x[1] if x[0] else None, x[2], subroots[s], root, proof, got, got == root)] += 1
    return out


def check(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    got = manifest.verify(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == brute(rows)


def test_whole_fixture_equals_plain_recomputation(llm):
    docs = common.documents(llm, SF)
    check(docs)
    verified = {r.doc_id: r.verified for r in manifest.verify(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for i, ok in verified.items():
        assert ok == ("\n" not in (text[i] or "") or zlib.crc32(str(i).encode()) % 2 == 1)


@pytest.mark.parametrize("sizes", [[1], [2], [9], [1, 1], [4, 1, 10, 27], [1] * 11, [28, 3]])
def test_trees_of_all_shapes(llm, sizes):
    rows = [(100 * s + i, None if s == 1 else f"s{s}é", "en", i, f"line {i}\nmore") for s, n in enumerate(sizes) for i in range(n)]
    check(llm.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, ""))
          .withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x")))
    assert manifest.verify(no_documents).collect() == []
