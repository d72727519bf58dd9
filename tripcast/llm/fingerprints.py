"""SimHash document fingerprints and search by Hamming distance.

Terms are pairs of neighbouring words (the last word has an empty neighbour),
weighted by their length in characters, so long and mostly rare words count
more. Each term's 64-bit hash votes with its weight on every bit, for it where
the hash has a 1 and against it where it has a 0; the fingerprint has a 1
where the votes for it prevail. Votes are summed two bits to a number.

Search: 64 bits fall into ``RADIUS + 3`` blocks. Two fingerprints within the
radius agree in at least three of them, so one table for every three blocks
(their bits as the key) finds all; a pair is reported by the first of its
tables only.

DataFrame operations only. Defined cases: a null or empty text has no terms
and fingerprint 0; equal texts have equal fingerprints; rows that repeat an id
are one place in the order of documents (its next document's smallest text
counts) and get a row each; a null id is followed by the first document.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripcast.llm.common import id_and_text, partitions, written
from tripcast.llm.quality import words

BITS = 64
RADIUS = 3
QUERY_EVERY = 20
_HIGH = 1 << 32


def vote(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints (``fp`` long) of rows with ``keys`` and ``text``; the keys
    must tell the rows apart."""
    d = texts.withColumn("__words", words(F.lower("text")))
    after = F.transform("__words", lambda w, i: F.struct(
        F.xxhash64(w, F.coalesce(F.get(F.col("__words"), i + 1), F.lit(""))).alias("h"),
        (F.length(w) + F.length(F.coalesce(F.get(F.col("__words"), i + 1), F.lit("")))).cast("long").alias("w")))
    d = d.select(*keys, F.explode_outer(after).alias("t")).select(*keys, F.col("t.h").alias("h"), F.col("t.w").alias("w"))
    h, w = F.col("h"), F.col("w")

    def bit(k: int) -> Column:
        return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1))

    sums = [F.sum(w * bit(k) + F.shiftleft(w * bit(k + 32), 32)).alias(f"v{k}") for k in range(32)]
    d = d.groupBy(*keys).agg(F.sum("w").alias("__all"), *sums)

    def set_bit(k: int) -> Column:
        v = F.col(f"v{k % 32}")
        votes = F.shiftrightunsigned(v, 32) if k >= 32 else v.bitwiseAND(F.lit(_HIGH - 1))
        return F.when(2 * votes > F.col("__all"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    fp = reduce(lambda a, b: a.bitwiseOR(b), [set_bit(k) for k in range(BITS)])
    return d.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_tables(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows once for each table, with ``table`` and ``key``."""
    blocks = radius + 3
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(blocks)]
    keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(*[part[k] for k in some]).alias("key"))
            for t, some in enumerate(combinations(range(blocks), 3))]
    return fps.select("*", F.explode(F.array(*keys)).alias("__k")).select(*fps.columns, "__k.table", "__k.key")


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``(fp, other)`` of distinct fingerprints of the two tables
    that differ in 1 to ``radius`` bits."""
    blocks = radius + 3
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    first = []  # by the set of agreeing blocks: the first table inside it
    tables = [sum(1 << k for k in some) for some in combinations(range(blocks), 3)]
    for agree in range(1 << blocks):
        first.append(next((t for t, need in enumerate(tables) if agree & need == need), -1))
    q = block_tables(queries.select("fp").distinct(), radius).alias("q")
    f = block_tables(fps.select("fp").distinct(), radius).select(F.col("fp").alias("other"), "table", "key").alias("f")
    x = F.col("q.fp").bitwiseXOR(F.col("f.other"))
    agree = reduce(lambda a, b: a + b, [
        F.when(F.shiftrightunsigned(x, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) == 0, 1 << k).otherwise(0)
        for k in range(blocks)])
    on = ((F.col("q.key") == F.col("f.key")) & (F.col("q.table") == F.col("f.table"))
          & F.bit_count(x).between(1, radius)
          & (F.element_at(F.lit(first), agree + 1) == F.col("q.table")))
    return q.join(f.hint("shuffle_merge"), on).select("q.fp", "f.other")


def following(docs: DataFrame) -> DataFrame:
    """``(doc_id, next_id, half)`` for each id: the next id in ascending order
    (after the last: the first) and half its longest text's characters. Ids
    are range-partitioned, so no task sees more than its range."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(
        F.floor(F.max(F.length("text")) / 2).cast("int").alias("half"))
    parts = partitions(docs.sparkSession)
    ids = written(ids.repartitionByRange(parts, "doc_id").withColumn("__part", F.spark_partition_id()), "ids")
    firsts = ids.groupBy("__part").agg(F.min("doc_id").alias("__first"))  # a row for each range
    lead = F.lead("__first").over(Window.orderBy("__part"))
    bounds = firsts.select("__part", lead.alias("__after"), F.min("__first").over(Window.partitionBy()).alias("__least"))
    inside = F.lead("doc_id").over(Window.partitionBy("__part").orderBy("doc_id"))
    return ids.withColumn("__next", inside).join(bounds, "__part").select(
        "doc_id", F.coalesce("__next", "__after", "__least").alias("next_id"), "half")


def _voted(rows: DataFrame) -> DataFrame:
    """Fingerprints of the texts (kind 0) and edited texts (kind 1) of rows
    with ``__row, doc_id, next_id, text, head``."""
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"),
                      F.coalesce(F.expr("left(head, cast(length(text) div 2 as int))"), F.lit("")))
    d = rows.select("__row", "doc_id", "next_id", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    kinds = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))))
    d = d.select("__row", "doc_id", "next_id", "n_chars", kinds.alias("k")).select(
        "__row", "doc_id", "next_id", "n_chars", "k.kind", "k.sha", "k.text")
    return vote(d, ["__row", "doc_id", "next_id", "n_chars", "kind", "sha"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the module
    text for ``next``), and their likeness."""
    d = id_and_text(docs)
    order = written(following(d), "order")
    row = order.agg(F.min("doc_id"), F.count("*")).first()
    least = row[0]
    n_rows = d.filter("doc_id is not null").count()
    # Both joins read the same exchange of the texts; only the given halves
    # are exchanged once more.
    known = d.filter("doc_id is not null")
    # What each document gives to the one before it.
    given = known.join(order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), F.col("half").alias("most"))
                       .hint("shuffle_merge"), "doc_id").select("to", F.expr("left(text, most)").alias("head"))
    if n_rows != row[1]:  # some id is repeated
        given = given.groupBy("to").agg(F.min("head").alias("head"))
    own = known.join(order.select("doc_id", "next_id").hint("shuffle_merge"), "doc_id")
    both = own.join(given.hint("shuffle_merge"), own["doc_id"] == given["to"], "left").select(
        F.monotonically_increasing_id().alias("__row"), "doc_id", "next_id", "text", "head")
    alone = d.filter("doc_id is null").select(
        (-1 - F.monotonically_increasing_id()).alias("__row"), "doc_id", F.lit(least).cast("long").alias("next_id"), "text",
        F.lit(None).cast("string").alias("head"))
    # voted apart: the first keeps its exchange by id, which a union would lose
    voted = written(_voted(both).unionByName(_voted(alone)), "votes")
    a = voted.filter("kind = 0").select("__row", "doc_id", "next_id", "n_chars", F.col("fp"))
    b = voted.filter("kind = 1").select("__row", F.col("sha").alias("edited_sha256"), F.col("fp").alias("edited"))
    by_id = a.filter("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    found = a.join(b.hint("shuffle_merge"), "__row").join(by_id.hint("shuffle_merge"), "next_id", "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited",
        likeness(F.col("fp"), F.col("edited")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("next_fp")), likeness(F.col("fp"), F.col("fp"))).alias("near_next"))


def search(found: DataFrame, every: int = QUERY_EVERY, radius: int = RADIUS) -> DataFrame:
    """``found`` (a stored table with ``doc_id`` and ``fp``) with ``n_near``:
    for rows whose id is divisible by ``every``, how many other fingerprints
    of the table lie within the radius; null for the others."""
    is_query = F.col("doc_id") % every == 0
    near = within_radius(found.filter(is_query), found, radius).groupBy("fp").agg(F.count("*").alias("__n"))
    return found.join(near.hint("shuffle_merge"), "fp", "left").withColumn(
        "n_near", F.when(is_query, F.coalesce("__n", F.lit(0)))).drop("__n")
