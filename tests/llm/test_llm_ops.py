"""Operators against brute force on small tables, and odd rows for each."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.llm import (
    common, components, fingerprints, language, licences, materialise, near_dedup, packing, passages, pieces, pipeline,
    quality, suffixes, tokens, toxicity)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(llm):
    return common.documents(llm, SF)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def shingle_set(text):
    w = re.findall(common.WORD, "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_near_duplicates_odd_rows(odd_documents, no_documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[2][0].component_id == 0 and not by[2][0].kept
    assert by[6][0].component_id == 5 and by[5][0].n_shingles == 1  # case and blanks aside
    assert [r.component_id for r in by[3] + by[4]] == [3, 4] and by[4][0].n_shingles == 0
    assert len(by[9]) == 2 and all(r.component_id is None and r.kept for r in by[None])
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_sequential_bounds_keep_pairs_at_the_threshold():
    for seen, least in near_dedup.least_matches():
        assert 0 < least < 0.85 * seen


def test_components_of_chain_and_star(llm):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components.components(llm.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def brute_repeats(rows):
    first, out = {}, {}
    for i in sorted(rows):
        b = rows[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first.setdefault(b[s:s + 50], i) < i:
                gone[s:s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [1 << 15, 2])
def test_repeats_equal_brute_force(docs, texts, frequent, monkeypatch):
    monkeypatch.setattr(passages, "FREQUENT", frequent)
    got = passages.remove_repeats(docs, with_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(texts)


def test_repeats_odd_rows(odd_documents, no_documents):
    rows = passages.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].n_removed == by[2].n_bytes and by[2].n_spans == 1
    assert by[3].n_bytes == by[4].n_bytes == 0 and by[9].n_removed == 0
    assert by[11].kept.decode().strip() == "tail of its own"
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    left = passages.without_repeats(odd_documents)
    assert left.columns == odd_documents.columns
    assert 2 not in {r.doc_id for r in left.collect()} and passages.remove_repeats(no_documents).count() == 0


def test_cut_characters_go_whole_and_others_stay(llm):
    shared = "é" * 30  # 60 bytes
    docs = llm.createDataFrame([(1, "x" + shared), (2, "a\ufffdb è" + shared[:26] + "ü end"), (3, "\ufffd")],
                               "doc_id long, text string")
    left = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert left == {1: "x" + shared, 2: "a\ufffdb è end", 3: "\ufffd"}  # the run takes the first byte of ü
    assert passages._whole_characters("aéb".encode(), np.array([2]), np.array([4])) == "a"


def test_suffix_arrays_equal_sorting():
    rng = np.random.default_rng(3)
    for _ in range(40):
        rows = [np.append(rng.integers(1, 4, rng.integers(0, 50)), 0) for _ in range(5)] + [np.array([1] * 20 + [0])]
        order = suffixes.suffix_arrays(np.concatenate(rows), np.array([len(r) for r in rows]))
        at = 0
        for r in rows:
            assert (order[at:at + len(r)] - at).tolist() == sorted(range(len(r)), key=lambda i: r[i:].tolist())
            at += len(r)


def test_packing_covers_every_token_once(docs, texts):
    rows = packing.pack_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    found = collections.defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    for i, t in texts.items():
        ids = full.encode(t, add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(found[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    least = -(-sum(r.length for r in rows) // 1024)
    assert len(by) <= 1.06 * least + 2


def test_packing_odd_rows(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents).collect()
    assert sum(1 for r in rows if r.piece == 0) == odd_documents.count()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(no_documents).count() == 0


def test_packing_plan_places_large_pieces_in_pairs():
    sizes = {600: 3, 424: 2, 500: 4, 100: 11, 1024: 1, 7: 300}
    steps = packing.plan(sizes)
    placed = collections.Counter()
    fill, large = collections.Counter(), collections.Counter()
    for size, _, count, sequence, each, offset in steps:
        placed[size] += count
        for j in range(count):
            fill[sequence + j // each] += size
            large[sequence + j // each] += 3 * size > 1024
    assert placed == collections.Counter(sizes) and max(fill.values()) <= 1024 and max(large.values()) <= 2


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 10, 1000, 4097):
        slots = materialise.permute(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
        assert materialise.permute(slots, n, inverse=True).tolist() == list(range(n))


def test_shards_read_back_in_order(llm, odd_documents, no_documents):
    path, index = materialise.materialise(odd_documents, seq_len=16, shard_records=64)
    rows = {r.slot: r for r in index.collect()}
    assert sorted(rows) == list(range(len(rows)))
    got = materialise.read_slots(llm, path, 10, 100, 16, 64).collect()
    assert sorted(r.slot for r in got) == list(range(10, 110))
    for r in got:
        n = rows[r.slot].length
        assert zlib.crc32(np.array(r.ids[:n], "<u2").tobytes()) == rows[r.slot].ids_crc32
    assert materialise.materialise(no_documents)[1].count() == 0


def test_slots_and_records_equal_an_own_tokenisation_however_the_input_is_split(llm, odd_documents):
    from tokenizers import Tokenizer

    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = []
    for r in odd_documents.collect():
        ids = np.array([*full.encode(r.text or "", add_special_tokens=False).ids, 2], "<u2")
        digest = hashlib.blake2b(ids.tobytes(), digest_size=16).digest()
        rows.append((r.doc_id is not None, r.doc_id or 0, digest, ids))
    rows.sort(key=lambda x: x[:3])
    want = [(d if known else None, p, ids[at:at + 16]) for known, d, _, ids in rows for p, at in enumerate(range(0, len(ids), 16))]
    slots = materialise.permute(np.arange(len(want)), len(want))
    for split in (1, 5):
        path, index = materialise.materialise(odd_documents.repartition(split, "score", F.rand(split)), seq_len=16, shard_records=50)
        found = {r.slot: r for r in index.collect()}
        stored = {r.slot: r.ids for r in materialise.read_slots(llm, path, 0, len(want), 16, 50).collect()}
        assert len(found) == len(stored) == len(want)
        for slot, (doc, piece, ids) in zip(slots.tolist(), want):
            assert (found[slot].doc_id, found[slot].piece, found[slot].length) == (doc, piece, len(ids))
            assert stored[slot] == [*ids.tolist(), *[materialise.PAD_ID] * (16 - len(ids))]


def test_small_batches_of_snippets_are_matched_together(monkeypatch):
    import pyarrow as pa

    class Frame:  # gives back what a task would run
        filter = select = repartition = sortWithinPartitions = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    h, own, places, want = [], [], [], set()
    for k in range(300):
        shared = hashlib.sha256(str(k).encode()).hexdigest()[:55].encode()
        for doc, tail in ((0, b"first"), (1, b"other")):
            h.append(k)
            own.append(shared + tail)
            places.append(np.array([(doc, 10 + doc, 100 * k)], passages.PLACE).tobytes())
        want.add((7, 1, 100 * k, 100 * k + 55))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(own, pa.binary()), pa.array([7] * len(h), pa.int64()), pa.array(places, pa.binary())],
        ["h", "snippet", "chunk", "places"])
    calls = []
    monkeypatch.setattr(passages, "equal_windows", lambda *a: calls.append(1) or suffixes.equal_windows(*a))
    run = passages._match(Frame())
    for limit, most in ((1 << 20, 1), (100, 7)):
        calls.clear()
        monkeypatch.setattr(passages, "GATHERED", limit)
        got = [tuple(r.values()) for b in run(batch.slice(at, 25) for at in range(0, 600, 25)) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want
        assert len(calls) <= most


def test_frequent_anchors_of_a_chunk_are_classed_together(monkeypatch):
    import pyarrow as pa

    class Frame:  # gives back what a task would run
        select = join = hint = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    texts = [b"".join(hashlib.sha256(str(k).encode()).hexdigest().encode() + b"%d" % (doc % 3) for k in range(30)) for doc in range(5)]
    texts.append(b"-" * 90 + texts[0][700:900])
    lens, text = np.array([len(t) for t in texts], np.int64), b"".join(texts)
    distinct = len(np.unique(passages.anchors(text, lens)[0]))
    row = {"chunk": 7, "ids": np.arange(10, 16).tobytes(), "lens": lens.tobytes(), "text": text,
           "marks": [{"part": 0, "marks": b"\2" * distinct}], "copies": None}
    want = set()
    for doc, t in enumerate(texts):
        at = collections.defaultdict(list)
        for lo in range(len(t) - 49):
            runs = at[np.frombuffer(hashlib.blake2b(t[lo:lo + 50], digest_size=16).digest(), np.int64).tobytes()]
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = lo + 50
            else:
                runs.append([lo, lo + 50])
        want |= {(7, doc, 10 + doc, lo, hi, d) for d, runs in at.items() for lo, hi in runs}
    calls = []
    monkeypatch.setattr(passages, "equal_windows", lambda *a: calls.append(1) or suffixes.equal_windows(*a))
    for limit in (passages.GATHERED, 100):
        calls.clear()
        monkeypatch.setattr(passages, "GATHERED", limit)
        rows = [r for b in passages.snippets(Frame(), Frame(), Frame())([pa.RecordBatch.from_pylist([row])]) for r in b.to_pylist()]
        got = [(r["chunk"], r["doc"], r["id"], r["first"], r["last"], np.array([r["d1"], r["d2"]], np.int64).tobytes()) for r in rows]
        assert len(got) == len(want) and set(got) == want and {r["kind"] for r in rows} == {2}
        assert len(calls) <= max(1, distinct // 10)


def test_copies_send_no_snippets_and_texts_are_not_moved(llm, monkeypatch):
    base = " ".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(40))
    rows = {k: base for k in range(3, 8)}
    rows |= {9: "of its own " + base[100:300] + " only", 10: base[100:300], 11: " ".join(reversed(base.split()[:9])), 12: ""}
    docs = llm.createDataFrame([*rows.items(), (None, base), (None, None)], "doc_id long, text string").repartition(3)
    sent, snippets = [], passages.snippets

    def seen(*tables):
        found = snippets(*tables)
        plan = found._jdf.queryExecution().executedPlan().toString()
        sent.append((found.count(), plan.count("Exchange hashpartitioning(chunk")))
        return found

    monkeypatch.setattr(passages, "snippets", seen)

    def check(some):
        got = passages.remove_repeats(docs.filter(F.col("doc_id").isNull() | F.col("doc_id").isin(some)), with_text=False).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == brute_repeats(
            {i: rows[i] for i in some})
        assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]

    check([3, 4, 5, 6, 7, 12])
    assert sent[-1][0] == 0  # nothing is shared but by whole copies
    check(list(rows))
    n, exchanges = sent[-1]
    assert 0 < n < 200 and exchanges == 2  # of the marks and of the copies


def test_a_full_range_of_anchors_meets_in_slices():
    import tracemalloc

    rng = np.random.default_rng(5)
    known = np.sort(rng.integers(0, 1 << 32, 40_000).astype("<u4"))
    rows, often, within = [], collections.Counter(), collections.Counter()
    for chunk in range(60):
        h = np.unique(rng.choice(known, 20_000))
        at = np.flatnonzero(rng.random(len(h)) < 0.1)
        n, times = np.ones(len(h), "<u4"), np.ones(len(h), "<u4")
        n[at], times[at] = rng.integers(1, 4, len(at)), rng.integers(2, 9, len(at))
        often.update(dict(zip(h.tolist(), times.tolist())))
        within.update(dict(zip(h.tolist(), n.tolist())))
        rows.append((0, chunk, h.tobytes(), at.astype("<u4").tobytes(), n[at].tobytes(), times[at].tobytes()))
    import pandas as pd

    group = pd.DataFrame(rows, columns=["part", "chunk", "h", "at", "n", "often"])
    peaks = []
    for size in (1 << 30, 50_000):
        tracemalloc.start()
        marks = passages._meet(group, 40, size)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        for row, mark in zip(rows, marks):
            assert list(mark) == [0 if within[h] < 2 else 2 if often[h] > 40 else 1 for h in np.frombuffer(row[2], "<u4").tolist()]
    assert peaks[1] < peaks[0] / 3


def test_records_go_to_their_shards_packed(llm, docs):
    rows = common.written(materialise.sequences(docs, 16), "test-sequences")
    starts, total = materialise.first_numbers(rows)
    packed = common.written(materialise.packed_records(rows, starts, total, 1, 100, 7), "test-packed")
    size = packed.agg(F.sum(F.length("batch"))).first()[0]
    assert size < 0.85 * rows.agg(F.sum(F.length("record") + 8)).first()[0]  # rows of records take more than that
    got = materialise.unpacked_records(packed.filter("part >= 2"), 2, 5).withColumn("p", F.spark_partition_id()).collect()
    shards = {(r.slot // 100, r.p) for r in got}
    n = -(-total // 100)
    assert sorted(s for s, _ in shards) == [s for s in range(n) if s * 7 // n >= 2]  # a shard in one partition
    assert all(s * 7 // n == p + 2 for s, p in shards)
    got += materialise.unpacked_records(packed.filter("part < 2"), 0, 2).collect()
    want = materialise.assign_slots(rows.select("row", "piece", "record"), starts, total, 1).collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((r.slot, r.record) for r in want)


def test_sequences_are_dropped_before_the_shards_are_written(llm, docs, monkeypatch):
    left = []
    unpacked = materialise.unpacked_records
    tables = []
    monkeypatch.setattr(materialise, "written", lambda df, name: tables.append(common.written(df, name)) or tables[-1])

    def watched(packed, low, parts):
        folders = {f.rsplit("/", 1)[0].removeprefix("file://") for t in tables for f in t.inputFiles()}
        left.append((parts, sorted(os.path.basename(f).rsplit("-", 1)[0] for f in folders if os.path.isdir(f))))
        return unpacked(packed, low, parts)

    monkeypatch.setattr(materialise, "unpacked_records", watched)
    path, index = materialise.materialise(docs, seq_len=16, shard_records=100)
    assert len(left) == materialise.STEPS
    assert all(names == ["index"] for _, names in left)
    n = index.count()
    assert materialise.read_slots(llm, path, 0, n, 16, 100).count() == n


def test_fingerprints_and_search(docs, texts):
    found = common.written(fingerprints.fingerprints(docs), "test-fp")
    rows = {r.doc_id: r for r in fingerprints.search(found).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    same = collections.defaultdict(set)
    for i in ids:
        same[texts[i]].add(rows[i].fp)
    assert all(len(s) == 1 for s in same.values())
    near, after = (np.mean([getattr(r, c) for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert near > after + 0.1
    mask = (1 << 64) - 1
    fps = {r.fp for r in rows.values()}
    for i in ids:
        want = sum(1 <= ((rows[i].fp ^ f) & mask).bit_count() <= 3 for f in fps) if i % 20 == 0 else None
        assert rows[i].n_near == want


def test_block_tables_find_all_within_the_radius(llm):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 20)]
    fps = sorted({(b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False))) for b in base for _ in range(15)})
    frame = llm.createDataFrame([(f,) for f in fps], "fp long")
    got = [(r.fp, r.other) for r in fingerprints.within_radius(frame, frame).collect()]
    mask = (1 << 64) - 1
    want = {(a, b) for a in fps for b in fps if 1 <= ((a ^ b) & mask).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_fingerprints_odd_rows(odd_documents, no_documents):
    rows = fingerprints.fingerprints(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].fp == by[2].fp and by[3].fp == by[4].fp == 0
    assert fingerprints.fingerprints(no_documents).count() == 0


def test_quality_equals_sql_on_odd_rows(llm, odd_documents, no_documents):
    import duckdb

    labels = llm.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 1), (0, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd_documents, labels).toPandas()
    con = duckdb.connect()
    con.register("documents", odd_documents.toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    want = con.sql(quality.SQL).df()
    key = list(got.columns)
    assert sorted(map(str, got[key].fillna(-1).values.tolist())) == sorted(map(str, want[key].astype({"doc_id": float}).fillna(-1).values.tolist()))
    assert quality.judge(no_documents, labels).count() == 0


def test_language_held_out(llm, odd_documents, no_documents):
    docs = common.documents(llm, "/root/testdata/sf0.01")
    rows = language.identify_documents(docs).select("row.lang", "lang_pred", common.held_out(F.col("row.doc_id")).alias("h")).collect()
    out = [r for r in rows if r.h]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    odd = language.identify_documents(odd_documents).select("row.doc_id", "lang_pred", "score").collect()
    assert len(odd) == odd_documents.count()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} >= {3, 4, 7, 20}
    assert language.identify_documents(no_documents).count() == 0


def test_language_letters_and_stray_values(llm):
    signs = ["² ½ ①", "123 _ -", "ª", "x²", "你"]
    rows = [(100 + i, t, "en") for i, t in enumerate(signs)]
    rows += [(i, "the cat sat on the mat and looked at the dog", "en") for i in range(12)]
    rows += [(20 + i, "el gato mira al perro en la casa de la abuela", "es") for i in range(12)]
    rows += [(40 + i, "the cat", f"stray{i}") for i in range(12)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["row"].doc_id: r.lang_pred for r in language.identify_documents(df).collect()}
    assert [got[100 + i] == "und" for i in range(5)] == [not any(c.isalpha() for c in t) for t in signs]
    assert got[0] == "en" and got[20] == "es" and not {v for v in got.values() if v.startswith("stray")}
    assert language.learn(df, languages=1)[0] == ["en"]


def test_forward_sums_all_segmentations():
    lat = language.lattice(language.VOCABULARY)
    prob = np.random.default_rng(1).random(len(lat.pieces) + 1) / 1000
    index = {p: i for i, p in enumerate(lat.pieces)}

    def total(w):
        if not w:
            return 1.0
        return sum(prob[index.get(w[:n], -1)] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in index or n == 1)

    ws = ["▁the", "▁nation", "▁é你x", "a"]
    assert np.allclose(lat.forward(ws, prob[:, None])[:, 0], [np.log(total(w)) for w in ws])


def test_toxicity_finds_gapped_insults_and_leaves_clean_text(llm, odd_documents, no_documents):
    insults = ["idiot", "moron", "worthless", "scum"]
    rng = np.random.default_rng(2)
    plain = ["river", "window", "letter", "garden", "number", "station", "music", "paper", "yellow", "winter"]
    rows = []
    for i in range(400):
        ws = list(rng.choice(plain, 30))
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(int(rng.integers(30)), str(rng.choice(insults)))
        rows.append((i, " ".join(ws) + "."))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    odd = ["i-d-i-o-t", "id*iot", "w.o.r.t.h.l.e.s.s", "moroon"]
    clean = ["river", "wintergarden", "letters", "st"]
    assert model.margins(odd).min() > model.margins(clean).max()
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).select("row.doc_id", "predicted", "score").collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    rows = toxicity.score_texts(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(no_documents, labels).count() == 0
    nothing = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert toxicity.score_texts(docs, nothing).filter("predicted = 1").count() == 0


def test_pieces_round_trip(odd_documents, no_documents):
    rows = odd_documents.filter("doc_id is not null and doc_id <> 9")
    encoded = pieces.encode(rows)
    back = dict(pieces.decode(encoded).collect())
    want = {r.doc_id: " ".join(re.findall(common.WORD, r.text or "")) for r in rows.collect()}
    assert back == want
    sums = {r.doc_id: r for r in pieces.digests(odd_documents).collect()}
    assert sums[3].n_pieces == 0 and {i: len(x) for i, x in encoded.collect()} == {i: sums[i].n_pieces for i in want}
    assert pieces.digests(no_documents).count() == 0


def test_licences_own_and_inherited(llm):
    files = llm.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x", "words only here"), ("a/b/c/y", None),
        ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("z/q", "words only here"),
        ("z/w", "long text " * 50 + "\nThis work is licensed under the GNU General Public License, version 3."),
        (None, "")], "path string, text string")
    got = {r.path: (r.own, r.licence, r.from_dir) for r in licences.scan(files).collect()}
    assert got["a/LICENSE"] == ("MIT", "MIT", None)
    assert got["a/b/x"] == (None, "Apache-2.0", "a/b") == got["a/b/c/y"]
    assert got["z/q"] == (None, None, None) and got["z/w"][0] == "GPL-3.0" and got[None] == (None, None, None)
    assert licences.scan(files.limit(0)).count() == 0


def test_pieces_equal_sentencepiece(llm, docs, odd_documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(9)
    odd = ["the cat requires ordinary words", "x" * 5000 + "é你" * 3000, "ab" * 4000 + "\x01" + "the" * 3000, "a▁ 你 ▁x▁▁▁ y ▁", "▁",
           " \t\n", "é ﬁ Ａ é ​ x y <s> </s> <unk> <0x41> \x00",
           "".join(rng.choice(list("abcdeinrst ▁你\x01"), 20000))]
    extra = llm.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    want = {r.doc_id: sp.encode(" ".join(re.findall(common.WORD, r.text or ""))) for r in rows.collect()}
    encoded = pieces.encode(rows)
    assert dict(encoded.collect()) == want
    back = dict(pieces.decode(encoded).collect())
    got = {r.doc_id: r for r in pieces.digests(rows).collect()}
    assert {i: (r.n_pieces, r.text_sha256) for i, r in got.items()} == {
        i: (len(want[i]), hashlib.sha256(back[i].encode()).hexdigest()) for i in want}
    strange = llm.createDataFrame([(1, [1, 272, 99_999, -4]), (2, [3 + 0xC3]), (3, None)], "doc_id long, ids array<int>")
    assert dict(pieces.decode(strange).collect()) == {1: "the", 2: "�", 3: ""}


def test_forward_of_long_unseen_runs(llm, monkeypatch):
    lat = language.lattice(language.VOCABULARY)
    rng = np.random.default_rng(4)
    prob = np.full((len(lat.pieces) + 1, 2), 2e-8) * rng.uniform(0.5, 1, (len(lat.pieces) + 1, 2))
    prob[-1] = language.UNKNOWN
    index = {p: i for i, p in enumerate(lat.pieces)}

    def brute(w, p):
        out = [0.0]
        for e in range(1, len(w) + 1):
            out.append(np.logaddexp.reduce([out[e - n] + np.log(p[index.get(w[e - n:e], -1)]) for n in range(1, min(e, lat.longest) + 1)
                                            if w[e - n:e] in index or n == 1]))
        return out[-1]

    unseen = "".join(chr(0x4E00 + 3 * i) for i in range(100))
    ws = ["▁" + unseen, "▁the", "▁" + "ꙮ" * 100, "▁internationalisation" * 40, "▁" + unseen + "nation" * 600]
    got = lat.forward(ws, prob)
    assert np.isfinite(got).all() and np.allclose(got, [[brute(w, prob[:, c]) for c in range(2)] for w in ws])
    # Training: products, logarithms and the walk block by block agree.
    few, counts = ["▁internationalisation", "▁thé" + unseen[:9], "▁nationnationnation"], np.array([3.0, 2.0, 5.0])
    want = lat.expected(few, counts, prob[:, 0])
    monkeypatch.setattr(language, "SAFE", 20.0)
    assert np.allclose(lat.expected(few, counts, prob[:, 0]), want, rtol=1e-9)
    monkeypatch.setattr(language, "BROAD", 1)
    monkeypatch.setattr(language, "STRETCH", 7)
    assert np.allclose(lat.expected(few, counts, prob[:, 0]), want, rtol=1e-9)
    monkeypatch.undo()
    assert np.isfinite(language.learn_pieces(ws, np.ones(len(ws)))).all()
    # A run that no language has decides nothing against the other words.
    plain = {"en": "the house and the garden of the king ", "fr": "la maison et le jardin du roi "}
    rows = [(i, plain[l] * 30 + (unseen if i < 2 else ""), l) for i, l in enumerate(["en", "fr"] * 20)]
    docs = llm.createDataFrame(rows + [(100, plain["fr"] * 5 + "ꙮ" * 100, None), (101, "語" * 100, None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify_documents(docs).select("row.doc_id", "lang_pred", "score").collect()}
    assert found[100].lang_pred == "fr" and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == l for i, _, l in rows)


def test_pipeline_drops_near_duplicates_from_four_fifths_on(llm):
    def text(k, changed):  # 100 shingles apart from the last words, of which some differ
        ws = [f"d{k}w{i}" for i in range(104)]
        return " ".join(ws[:104 - changed] + [f"other{i}" for i in range(changed)])

    rows = [(10 * k + j, text(k, c)) for k in range(20) for j, c in enumerate((0, 10))]  # 90 / 110 = 0.82
    rows += [(1000, text(99, 0)), (1001, text(99, 12)), (None, text(99, 0))]  # 88 / 112 = 0.79
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in pipeline.drop_near_duplicates(llm, docs, "").collect()}
    assert left == {10 * k for k in range(20)} | {1000, 1001, None}
    assert near_dedup.bands() == (24, 5) and near_dedup.bands(80) == (30, 4)


def test_long_runs_of_one_character_are_few_rows(llm, monkeypatch):
    monkeypatch.setattr(passages, "FREQUENT", 1000)
    monkeypatch.setattr(passages, "OFTEN", 700)
    rows = {1: "first " + "x" * 6000 + " end", 2: "second" + "x" * 5000 + "y" + "x" * 60 + "ab" * 2000, 3: "ab" * 1500 + "-" * 49, 4: "-" * 2000}
    docs = llm.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = passages.remove_repeats(docs, with_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)
    chunks = passages.store_chunks(docs)
    none = llm.createDataFrame([], "chunk long, copies array<int>")
    found = passages.snippets(chunks, passages.shared_anchors(chunks), none)
    assert found.filter("kind = 1").count() < 1000 and found.count() < 1500


def brute_language(rows, names, probs):
    """``(id, best fit)`` of texts with letters, summed place by place."""
    lat = language.lattice(language.VOCABULARY)
    index, logs, seen, out = {p: i for i, p in enumerate(lat.pieces)}, np.log(probs), {}, {}

    def word(w):
        sums = [np.zeros(len(names))]
        for e in range(1, len(w) + 1):
            sums.append(np.logaddexp.reduce([sums[e - n] + logs[index.get(w[e - n:e], -1)] for n in range(1, min(e, lat.longest) + 1)
                                             if w[e - n:e] in index or n == 1]))
        return sums[-1]

    for i, t in rows.items():
        ws = ["▁" + w for w in t.lower().split()]
        if any(map(str.isalpha, t)):
            out[i] = max(sum(seen.setdefault(w, word(w)) if w not in seen else seen[w] for w in ws)) / sum(map(len, ws))
    return out


def test_pipeline_stages_equal_brute_force(llm, tmp_path):
    base = common.documents(llm, SF)
    top = base.agg(F.max("doc_id")).first()[0]
    some = base.filter("length(text) > 400").orderBy("doc_id").first()
    odd = [(top + 1, "语言模型训练数据" * 5), (top + 2, "1 2 3 ###"), (top + 3, None), (top + 4, some.text + " tail"),
           (top + 5, "own words before " + some.text[:200] + " own words after"), (top + 6, "you idiot worthless moron scum " * 6)]
    docs = base.unionByName(llm.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in odd], base.schema))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    sf, now = str(tmp_path), common.documents(llm, str(tmp_path))

    def rows(d):
        return {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}

    def after(k):
        return common.written(pipeline.STAGES[k][1](llm, now, sf), "test-stage")

    before, model = rows(now), toxicity.learn(now, labels)
    want = {r.doc_id for r in toxicity.score_texts(now, model).filter("predicted = 0").select("row.doc_id").collect()}
    now = after(0)
    assert {i: t for i, t in before.items() if i in want} == rows(now) and top + 6 not in want
    before, fits = rows(now), brute_language({i: t or "" for i, t in rows(now).items()}, *language.learn(now))
    nothing = now.withColumn("lang", F.lit(None).cast("string"))
    assert set(rows(pipeline.drop_unknown_language(llm, nothing, sf))) == set(fits)  # all with letters
    now = after(1)
    assert rows(now) == {i: before[i] for i, f in fits.items() if f >= pipeline.FLOOR}
    assert not {top + 1, top + 2, top + 3} & set(rows(now))
    before = rows(now)
    sets = {i: shingle_set(t) for i, t in before.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    now = after(2)
    assert rows(now) == {i: t for i, t in before.items() if find(i) == i} and top + 4 not in rows(now)
    before, cut = rows(now), brute_repeats(rows(now))
    now = after(3)
    left = rows(now)
    for i, t in before.items():
        n, gone, _, digest = cut[i]
        assert left.get(i) == t if not gone else gone == n or hashlib.sha256(left[i].encode()).hexdigest() == digest or i != top + 5
    assert cut[top + 5][1] >= 200 and set(left) >= {i for i, c in cut.items() if c[1] < c[0]} - {i for i, c in cut.items() if c[0] - c[1] < 4}
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    packed = pipeline.run(llm, sf).collect()
    got = collections.Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == {i: len(full.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}


def test_licence_texts_wrapped_headers_and_neighbours(llm):
    import pkgutil

    rows = [(f"{n}/LICENSE", pkgutil.get_data("tripcast.llm", f"licence_texts/{n}.txt").decode()) for n in licences.TEXTS]
    rows += [(f"{n}/src/code", "plain code of its own") for n in licences.TEXTS]
    code = "\n\n" + "value = compute(other) + something\n" * 200
    mit = rows[licences.TEXTS.index("MIT")][1].replace("\n\n", "\n\n")
    rows += [("h/wrapped", "# This work is licensed under the GNU\n# General Public License,\n# version 2." + code),
             ("h/mit", "\n".join("# " + l for l in mit.split("\n")) + code),
             ("v/lgpl", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
             ("v/agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
             ("v/sa", "Licensed under CC BY-SA 4.0"), ("v/gpl2", "This work is licensed under the GNU General Public License, version 2."),
             ("two/NOTE", "Released under the MIT License.\n" + "some other words of this file here now\n" * 3 + "Released under the MIT License.\n" * 2)]
    got = {r.path: r for r in licences.scan(llm.createDataFrame(rows, "path string, text string")).collect()}
    for n in licences.TEXTS:
        assert (got[f"{n}/LICENSE"].own, got[f"{n}/LICENSE"].is_file, got[f"{n}/src/code"].licence, got[f"{n}/src/code"].from_dir) == (n, True, n, n)
    assert {p: got[p].own for p in got if p[:2] in ("h/", "v/")} == {
        "h/wrapped": "GPL-2.0", "h/mit": "MIT", "v/lgpl": "LGPL-2.1", "v/agpl": "AGPL-3.0", "v/sa": "CC-BY-SA-4.0", "v/gpl2": "GPL-2.0"}
    assert not got["h/wrapped"].is_file and not got["h/mit"].is_file and got["two/NOTE"].is_file
