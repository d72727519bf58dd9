"""Licence scan: TF-IDF cosine of lines, headers and whole files to licence
notices and licence texts, and inheritance from the nearest directory above.

Every line of a text, and every block of several lines between blank ones (a
notice wrapped over lines), is a sparse vector of its words, weighted by how
rare they are among all lines; words outside the templates count with the
largest weight. The templates are the notices, and for each identifier of
``IDENTIFIERS`` its header line.

The first block (the header) and the whole file are compared with the full
licence texts of ``licence_texts`` too, words weighted by the root of how often
they occur and by how rare they are among those texts.

A text is read once: its tokens give each document's counts, the known words of
its lines, and the parts that can reach ``LIKE`` at all by the bound ``KNOWN``.
The bound is exact, nothing that could match is left out; a block or header can
meet it only if one of its lines does. All later steps read that table.

A file's own licence is the template of its best part, at ``LIKE`` or more. A
file that as a whole matches a licence text, that has a licence file's name and a
licence of its own, or of which matching lines, or matching blocks, make up
``FILE_SHARE`` of the words in all, is a licence file: it speaks for its
directory. A bare reservation of rights (``UNSTATED``) does so only under a
licence file's name. Files without a licence of their own take that of the
nearest directory above that has one (the smallest path of equal ones); the
ancestors of each distinct directory join the directories, once.

DataFrame operations only; the template tables are fixed and small. Defined
cases: a null or empty text has no licence of its own; a null path lies in no
directory; equal cosines go to the first template by name; rows that repeat a path get
a row each; extra columns are kept if named, ignored else; an empty table gives
no rows. AGPL and the Creative Commons licences but CC0 have notices and no full
text.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import written

LIKE = 0.55
FILE_SHARE = 0.2
# A part can be LIKE a template only if known words make up this many times the
# other ones: its cosine is at most the root of the known words' share of its
# square, and no word weighs more than an unknown one.
KNOWN = LIKE ** 2 / (1 - LIKE ** 2)
UNSTATED = "Proprietary"  # no licence: never speaks for a directory

# Short notices by which works name their licence.
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "licensed under the terms of the Apache License 2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted",
            "BSD 3-Clause License", "BSD 2-Clause License", "licensed under the terms of the BSD license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0 Creative Commons Attribution", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0 Creative Commons Attribution-ShareAlike", "Licensed under CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0 Creative Commons Attribution-ShareAlike", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "ISC": ["Released under the ISC License"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["Released under the MIT License", "licensed under the terms of the MIT license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved"],
}
# Identifiers of licence headers, by licence.
IDENTIFIERS = {
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "Apache-2.0": ["Apache-2.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause", "0BSD"],
    "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0-1.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"],
    "MPL-2.0": ["MPL-2.0"],
}
TEXTS = ("Apache-2.0", "BSD", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
         "MIT", "MPL-1.1", "MPL-2.0")
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|copyright)[^/]*$"
BLANK = r"\n[ \t\r]*(?=\n)"
TOKEN = r"[^a-z0-9.\-]+|\.+(?=[^0-9]|$)"


def _words(text: str) -> list[str]:
    return [t for t in re.split(TOKEN, text.lower()) if t]


def _tokens(text: str) -> set[str]:
    return set(_words(text))


@lru_cache(maxsize=1)
def full_texts() -> dict[str, Counter]:
    return {name: Counter(_words(pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode())) for name in TEXTS}


def templates() -> list[tuple[str, frozenset[str]]]:
    """Licence and word set of each notice and identifier line."""
    lines = [(name, text) for name, texts in NOTICES.items() for text in texts]
    lines += [(name, f"SPDX-License-Identifier: {i}") for name, ids in IDENTIFIERS.items() for i in ids]
    return [(name, frozenset(_words(text))) for name, text in lines]


def _known(tokens: Column, words: list[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(words))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, TOKEN), "")


PART = "array<struct<kind:int,words:int,foreign:int,hits:array<string>>>"
WHOLE = "array<struct<kind:int,tokens:array<string>>>"


def read_parts(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a file, stored: ``__row``, ``path``, the columns ``keep``, the
    number of ``lines`` and of ``words``, the known words of its lines
    (``seen``), and the parts to compare with notices (``parts``: lines 0 and
    blocks 1) and with licence texts (``whole``: the header 2, the file 3)."""
    vocabulary = sorted(set().union(*(words for _, words in templates())))
    legal = sorted(set().union(*full_texts().values()))
    rows = files.select("path", *keep, F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn("__lines", F.transform(F.filter(F.split("low", "\n"), lambda s: F.btrim(s) != ""), _split))

    def counted(t: Column) -> Column:
        hits = F.array_distinct(_known(t, vocabulary))
        return F.struct(F.size(t).alias("words"), hits.alias("hits"), F.size(F.array_distinct(t)).alias("distinct"),
                        F.size(_known(t, legal)).alias("legal"))

    rows = rows.withColumn("__stats", F.transform("__lines", counted))
    lines = F.transform("__stats", lambda s: F.struct(
        F.lit(0).alias("kind"), s["words"].alias("words"), (s["distinct"] - F.size(s["hits"])).alias("foreign"), s["hits"].alias("hits")))
    rows = rows.withColumn("__part", F.filter(lines, lambda p: (F.size(p["hits"]) > 0) & (F.size(p["hits"]) >= F.lit(KNOWN) * p["foreign"])))

    def block(t: Column) -> Column:  # other words of a block count each time
        known = _known(t, vocabulary)
        return F.struct(F.lit(1).alias("kind"), F.size(t).alias("words"), (F.size(t) - F.size(known)).alias("foreign"),
                        F.array_distinct(known).alias("hits"))

    some = F.filter(F.split("low", BLANK), lambda b: F.btrim(b).contains("\n"))
    blocks = F.filter(F.transform(F.transform(some, _split), block), lambda p: F.size(p["hits"]) >= F.lit(KNOWN) * p["foreign"])
    rows = rows.withColumn("__blocks", F.when(F.size("__part") > 0, blocks).otherwise(F.array().cast(PART)))

    def enough(words: Column, legal_words: Column) -> Column:
        return (legal_words > 0) & (legal_words >= F.lit(KNOWN) * (words - legal_words))

    first = F.get(F.filter(F.split("low", BLANK), lambda b: F.btrim(b) != ""), F.lit(0))
    header = F.when(F.exists("__stats", lambda s: enough(s["words"], s["legal"])), _split(first)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({
        "words": F.aggregate("__stats", F.lit(0), lambda a, s: a + s["words"]),
        "__legal": F.aggregate("__stats", F.lit(0), lambda a, s: a + s["legal"]), "__header": header})
    texts = [(F.lit(2), F.col("__header"), enough(F.size("__header"), F.size(_known(F.col("__header"), legal)))),
             (F.lit(3), F.flatten("__lines"), enough(F.col("words"), F.col("__legal")))]
    whole = F.concat(*[F.when(fits, F.array(F.struct(k.alias("kind"), t.alias("tokens")))).otherwise(F.array().cast(WHOLE))
                       for k, t, fits in texts])
    return written(rows.select(
        "__row", "path", *keep, F.size("__lines").alias("lines"), "words",
        F.flatten(F.transform("__stats", lambda s: s["hits"])).alias("seen"),
        F.concat("__part", "__blocks").alias("parts"), whole.alias("whole")), "licence-parts")


def like_notices(files: DataFrame) -> DataFrame:
    """``(__row, kind, part, n, name, like)``: parts that are like a notice."""
    kinds = templates()
    total = files.agg(F.sum("lines")).first()[0] or 0
    # rarity of the templates' words among all lines: a row for each word
    count = {r[0]: r[1] for r in files.select(F.explode("seen").alias("t")).groupBy("t").count().collect()}
    vocabulary = sorted(set().union(*(words for _, words in kinds)))
    idf = {t: math.log((total + 1) / (count[t] + 1.0)) + 0.1 if t in count else math.log(total + 1.0) for t in vocabulary}
    top = max([math.log(total + 1), *idf.values()])
    weights = files.sparkSession.createDataFrame(
        [(t, idf[t] ** 2, [i for i, (_, words) in enumerate(kinds) if t in words]) for t in vocabulary],
        "t string, w double, kinds array<int>")
    norms = F.array(*[F.lit(math.sqrt(sum(idf[t] ** 2 for t in words))) for _, words in kinds])
    names = F.array(*[F.lit(name) for name, _ in kinds])
    parts = files.select("__row", F.posexplode("parts").alias("part", "p")).select("__row", "part", "p.*")
    known = parts.select("__row", "part", "kind", "words", "foreign", F.explode("hits").alias("t")).join(F.broadcast(weights), "t")
    known = known.groupBy("__row", "part", "kind", "words", "foreign").agg(
        F.sum("w").alias("square"), F.collect_list(F.struct("w", "kinds")).alias("ws"))  # at most the vocabulary
    square = F.col("square") + F.col("foreign") * F.lit(top ** 2)
    near = F.array_distinct(F.flatten(F.transform("ws", lambda x: x["kinds"])))
    scored = known.select("__row", "part", "kind", "words", square.alias("square"), "ws", F.explode(near).alias("i"))
    dot = F.aggregate(F.filter("ws", lambda x: F.array_contains(x["kinds"], F.col("i"))), F.lit(0.0), lambda a, x: a + x["w"])
    like = F.round(F.try_divide(dot, F.sqrt("square") * F.element_at(norms, F.col("i") + 1)), 6)
    return scored.select("__row", "kind", "part", F.col("words").alias("n"), F.element_at(names, F.col("i") + 1).alias("name"),
                         like.alias("like")).filter(F.col("like") >= LIKE)


def like_texts(files: DataFrame) -> DataFrame:
    """``(__row, kind, part, n, name, like)``: headers and whole files that are
    like a licence text."""
    texts = full_texts()
    idf = {t: math.log((len(texts) + 1) / (sum(t in x for x in texts.values()) + 1)) + 1 for t in set().union(*texts.values())}
    top = math.log(len(texts) + 1) + 1
    weights = files.sparkSession.createDataFrame(
        [(t, idf[t] ** 2, {name: math.sqrt(texts[name][t]) for name in texts if t in texts[name]}) for t in sorted(idf)],
        "t string, w double, names map<string,double>")
    norms = F.create_map(*[F.lit(v) for name in texts for v in (name, math.sqrt(sum(idf[t] ** 2 * n for t, n in texts[name].items())))])
    units = files.select("__row", F.explode("whole").alias("u")).select("__row", "u.kind", "u.tokens")
    hits = units.select("__row", "kind", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(F.broadcast(weights), "t")
    hits = hits.groupBy("__row", "kind", "t").agg(F.first("n").alias("n"), F.count("*").alias("tf"), F.first("w").alias("w"), F.first("names").alias("names"))
    square = (F.sum(F.col("w") * F.col("tf")) + (F.first("n") - F.sum("tf")) * top ** 2).alias("square")  # other words count each time
    vectors = hits.groupBy("__row", "kind").agg(F.first("n").alias("n"), square, F.collect_list(F.struct((F.col("w") * F.sqrt("tf")).alias("w"), "names")).alias("ws"))  # at most the vocabulary
    scored = vectors.select("__row", "kind", "n", "square", "ws", F.explode(F.array(*[F.lit(x) for x in sorted(texts)])).alias("name"))
    dot = F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at(x["names"], F.col("name")), F.lit(0.0)))
    like = F.round(dot / F.sqrt("square") / F.element_at(norms, F.col("name")), 6)
    return scored.select("__row", "kind", F.lit(0).alias("part"), "n", "name", like.alias("like")).filter(F.col("like") >= LIKE)


def scan(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``files`` with ``path`` and ``text``: adds ``own`` (licence or null),
    ``likeness``, ``is_file``, ``licence`` and ``from_dir`` (null for an own
    licence); the columns ``keep`` come along."""
    parts = read_parts(files, keep)
    # Each line, block, header or file counts once, by its best template.
    best = like_notices(parts).unionByName(like_texts(parts)).groupBy("__row", "kind", "part").agg(
        F.min_by("name", F.struct(-F.col("like"), F.col("name"))).alias("name"), F.max("like").alias("like"), F.first("n").alias("n"))
    stated = F.col("name") != UNSTATED
    of = [F.coalesce(F.sum(F.when((F.col("kind") == k) & stated, F.col("n"))), F.lit(0)) for k in range(4)]
    best = best.groupBy("__row").agg(F.min_by("name", F.struct(-F.col("like"), F.col("name"))).alias("own"),
                                     F.max("like").alias("likeness"), F.greatest(*of).alias("licence_words"))
    named = F.col("path").rlike(FILE_NAME) & F.col("own").isNotNull()
    share = (F.col("own") != UNSTATED) & (F.col("licence_words") >= FILE_SHARE * F.col("words"))
    own = parts.select("__row", "path", *keep, "words").join(best, "__row", "left").select(
        "__row", "path", *keep, "own", "likeness", F.coalesce(named | share, F.lit(False)).alias("is_file"),
        F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("__dir"))
    own = written(own, "licences")
    dirs = own.filter("is_file").groupBy(F.col("__dir").alias("above")).agg(F.min_by("own", F.struct("path", "own")).alias("found"))
    path = F.split("__dir", "/")
    wanting = own.filter("own is null").select("__dir").distinct()
    above = wanting.select("__dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(path)), lambda k: F.array_join(F.slice(path, 1, k), "/"))).alias("above"))
    heirs = above.join(dirs, "above").groupBy("__dir").agg(F.max_by(F.struct("found", "above"), F.length("above")).alias("up"))
    # a row for each distinct directory; adaptive execution broadcasts it where
    # it is small and splits a hot directory's rows where not
    out = own.join(heirs.withColumnRenamed("__dir", "__heir"), F.col("own").isNull() & (F.col("__dir") == F.col("__heir")), "left")
    return out.select("path", *keep, "own", "likeness", "is_file", F.coalesce("own", "up.found").alias("licence"),
                      F.col("up.above").alias("from_dir"))
