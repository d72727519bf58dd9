"""Licence scan against plain TF-IDF vectors, and a labelled set of headers."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripcast.llm import common, licences, queries

SF = "/root/testdata/sf0.001"


def cosine(part, template, weight):
    """Cosine of two bags (word -> multiplier of its weight)."""
    dot = sum(weight(t) ** 2 * part[t] * template[t] for t in part.keys() & template.keys())
    size = [math.sqrt(sum((weight(t) * n) ** 2 for t, n in bag.items())) for bag in (part, template)]
    return dot / (size[0] * size[1]) if dot else 0.0


def brute(texts):
    """``[(own, likeness)]`` of texts, without any bound: every part against
    every template."""
    lines = [[licences._words(x) for x in (t or "").lower().split("\n") if x.strip(" ")] for t in texts]
    kinds = licences.templates()
    vocabulary = set().union(*(w for _, w in kinds))
    total = sum(map(len, lines))
    seen = Counter(t for doc in lines for line in doc for t in set(line) & vocabulary)
    idf = {t: math.log((total + 1) / (seen[t] + 1.0)) + 0.1 if seen[t] else math.log(total + 1.0) for t in vocabulary}
    top = max([math.log(total + 1), *idf.values()])
    legal = licences.full_texts()
    rare = {t: math.log((len(legal) + 1) / (sum(t in x for x in legal.values()) + 1)) + 1 for t in set().union(*legal.values())}
    out = []
    for text, doc in zip(texts, lines):
        low = (text or "").lower()
        blocks = [b for b in re.split(licences.BLANK, low) if "\n" in b.strip(" ")]
        found = []
        parts = [Counter(set(line)) for line in doc]
        for b in blocks:  # known words once, other ones each time
            n = Counter(licences._words(b))
            parts.append(Counter({t: 1 if t in vocabulary else math.sqrt(c) for t, c in n.items()}))
        for part in parts:
            found += [(-round(cosine(part, Counter(w), lambda t: idf.get(t, top)), 6), name) for name, w in kinds]
        first = next((b for b in re.split(licences.BLANK, low) if b.strip(" ")), "")
        for whole in (Counter(licences._words(first)), sum((Counter(x) for x in doc), Counter())):
            bag = {}
            for t, c in whole.items():
                bag[t] = math.sqrt(c)
            for name, words in legal.items():
                t = {w: math.sqrt(c) for w, c in words.items()}
                found.append((-round(cosine(bag, t, lambda w: rare.get(w, math.log(len(legal) + 1) + 1)), 6), name))
        best = min((f for f in found if f[0] <= -licences.LIKE), default=(None, None))
        out.append((best[1], None if best[0] is None else -best[0]))
    return out


HEADERS = {
    "# SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "BSD 3-Clause License": "BSD",
    "licensed under the terms of the MIT license": "MIT",
    "This file is licensed under the terms of the MIT license.": "MIT",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache-2.0",
    "Released under the ISC License": "ISC",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "Dedicated to the public domain under CC0 1.0 Universal.": "CC0-1.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary",
}
PROSE = ["The license of the poet knows no version", "he was released under the bridge at noon", "apache horses run in the terms of the wind",
         "a public source of joy in code and form", "universal rights and the common good", "mit der zeit wird alles gut",
         "the work of this hand is under the stone", "redistribution of wealth and the use of power", "version two of the same old story"]
BODY = "\n\n" + "\n".join(f"value{i} = compute{i}(other{i}) + something{i}" for i in range(40))


def frame(llm, texts):
    return llm.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")


def test_scan_equals_plain_cosines(llm):
    texts = [r.text for r in common.documents(llm, SF).select("text").collect()]
    texts += [h + BODY for h in HEADERS] + [p + BODY for p in PROSE] + PROSE
    texts += ["# This work is licensed under the GNU\n# General Public License,\n# version 2." + BODY, None, "", "\n \n", "MIT", "x" * 50000,
              "Released under the MIT License.\n" * 500]
    got = {r.doc_id: (r.own, r.likeness) for r in licences.scan(frame(llm, texts), ("doc_id",)).collect()}
    assert len(got) == len(texts)
    for i, (own, like) in enumerate(brute(texts)):
        assert got[i][0] == own, (texts[i] or "")[:80]
        assert like is None or abs(got[i][1] - like) < 2e-6


def test_precision_and_recall_on_labelled_headers(llm):
    base = [r.text for r in common.documents(llm, SF).select("text").limit(60).collect()]
    texts = [h + BODY for h in HEADERS] + [p + BODY for p in PROSE] + base
    got = {r.doc_id: r for r in licences.scan(frame(llm, texts), ("doc_id",)).collect()}
    right = sum(got[i].own == want for i, want in enumerate(HEADERS.values()))
    wrong = sum(got[len(HEADERS) + i].own is not None for i in range(len(PROSE)))
    assert right == len(HEADERS) and wrong == 0


def test_prose_about_rights_speaks_for_no_directory(llm):
    rows = [("p/a", "All rights reserved to imagination, permission to dream"), ("p/b", "other words"),
            ("q/LICENSE", "All rights reserved."), ("q/b", "other words"), ("r/license.txt", "no such thing here"), ("r/b", "words")]
    got = {r.path: r for r in licences.scan(llm.createDataFrame(rows, "path string, text string")).collect()}
    assert not got["p/a"].is_file and got["p/b"].licence is None
    assert got["q/LICENSE"].is_file and (got["q/b"].licence, got["q/b"].from_dir) == ("Proprietary", "q")
    assert not got["r/license.txt"].is_file and got["r/b"].licence is None


def test_odd_rows_and_the_query(llm, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda spark, sf: odd_documents)
    rows = queries.op7_licences(llm, "").collect()
    assert len(rows) == odd_documents.count() and sum(r.doc_id is None for r in rows) == 2
    monkeypatch.setattr(queries, "documents", lambda spark, sf: no_documents)
    assert queries.op7_licences(llm, "").collect() == []
    clash = odd_documents.select(F.lit(None).cast("string").alias("path"), "text", F.lit(1).alias("words"), F.lit(2).alias("own"))
    assert licences.scan(clash).count() == odd_documents.count()


@pytest.mark.parametrize("n", [3000])
def test_hot_directory_inherits_by_distinct_directories(llm, n):
    rows = [("hot/LICENSE", "Released under the MIT License.")] + [(f"hot/f{i}", "plain words") for i in range(n)]
    out = licences.scan(llm.createDataFrame(rows, "path string, text string"))
    assert out.filter("licence = 'MIT'").count() == n + 1
