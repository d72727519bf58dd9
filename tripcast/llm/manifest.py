"""Merkle dataset manifest with proofs by pointer jumping.

Each row becomes a leaf digest at the scan, so no text is shuffled. Leaves are
numbered within their source by a range partition (no source lies in one
task); the run of node ``p`` on a level is ``p div FAN``, so each level of all
trees is one grouped hash of at most ``FAN`` children, a third of the size of
the last. The sources' roots are the leaves of one more tree.

A node then holds a *segment*: the siblings left and right of it, towards its
parent. A round joins the nodes with themselves: each takes over the segment of
the ancestor it points to and that ancestor's pointer, which doubles the
distance. After ``log2(depth)`` rounds every leaf points to the root and its
segment is its proof. Nodes that can be pointed to thin out with the distance,
so from the second round on the joined side is far smaller than the leaves.

Defined results: a null field hashes as ``-``; rows without a source are a
source of their own, which comes first, and null ids come first in it; rows
that repeat an id are leaves of their own, in the order of their digests. A
null id is never tampered with. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import drop_written, laid_out, positions, written

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ("tree", "level", "pos")
TOP = -1  # number of the tree over the sources' roots
SEGMENT = "array<struct<left:binary,right:binary>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a row with the given text (hex text)."""
    return F.sha2(F.concat(*[_field(F.col(f)) for f in FIELDS[:-1]], _field(text)), 256)


def tampered_text() -> Column:
    """The contract's damage: every second id loses its line ends."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def numbered_leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(doc_id, leaf, tampered, tree, pos, n)`` with the number of
    their source, and the sources ``(tree, n)``."""
    leaves = docs.select("doc_id", "source", F.unhex(leaf_digest(F.col("text"))).alias("leaf"),
                         F.unhex(leaf_digest(tampered_text())).alias("tampered"))
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "tampered"]
    laid = laid_out(leaves, order, "leaves")
    placed = positions(laid, ["source"])
    names = laid_out(laid.groupBy("source").agg(F.count(F.lit(1)).alias("size")),
                     [F.col("source").asc_nulls_first()], "sources")
    sources = positions(names.withColumn("all", F.lit(0)), ["all"]).select(
        F.col("source").alias("__source"), F.col("pos").alias("tree"), F.col("size").alias("n"))
    sources = written(sources, "trees")
    leaves = placed.drop("place", "n").join(sources, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "leaf", "tampered", "tree", "pos", "n")
    return leaves, sources.select("tree", "n")


def _joined(parts: Column) -> Column:
    """Digests in a row, as one binary value."""
    return F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))


def _digest(parts: Column) -> Column:
    """Digest of binary digests given as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def grow(nodes: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of trees ``nodes (tree, level, pos, digest, n)``, of which the
    largest has ``size`` leaves: for each level its runs, written, and the
    roots ``(tree, level, digest)``."""
    runs, roots, level = [], [], 0
    while True:
        roots.append(nodes.filter("n = 1").select("tree", "level", "digest"))
        if size <= 1:
            break
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        run = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / FAN).alias("run")).agg(
            F.first("n").alias("n"), kids.alias("kids"))
        run = written(run.withColumn("digest", _digest(_joined(F.col("kids")))), "runs")
        runs.append(run)
        level, size = level + 1, -(-size // FAN)
        nodes = run.select("tree", F.lit(level).alias("level"), F.col("run").alias("pos"), "digest",
                           F.ceil(F.col("n") / FAN).alias("n"))
    return runs, reduce(DataFrame.unionByName, roots)


def pointers(runs: list[DataFrame], tree: Column | None = None) -> DataFrame | None:
    """Each child of the runs, its parent and its one-step segment."""
    found = None
    for level, run in enumerate(runs):
        kids = run.select("tree", "run", "kids", F.posexplode("kids").alias("i", "digest"))
        side = lambda a, b: _joined(F.slice("kids", a, b))
        step = kids.select(
            "tree", F.lit(level).alias("level"), (F.col("run") * FAN + F.col("i")).alias("pos"),
            F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("run").alias("up_pos"),
            F.array(F.struct(side(F.lit(1), F.col("i")).alias("left"),
                             side(F.col("i") + 2, F.lit(FAN)).alias("right"))).alias("segment"))
        found = step if found is None else found.unionByName(step)
    return found


def jump(nodes: DataFrame, depth: int) -> DataFrame:
    """Pointer jumping over ``nodes (tree, level, pos, up_*, segment)`` until
    a pointer spans ``depth`` steps: every node's segment reaches the root."""
    nodes = written(nodes, "pointers")
    reach = 1
    while reach < depth:
        up = nodes.select(*[F.col(c).alias(f"at_{c}") for c in NODE], *[F.col(f"up_{c}").alias(f"next_{c}") for c in NODE],
                          F.col("segment").alias("more"))
        met = nodes.join(up, [F.col(f"up_{c}") == F.col(f"at_{c}") for c in NODE], "left")
        further = written(met.select(
            *NODE, *[F.coalesce(f"next_{c}", f"up_{c}").alias(f"up_{c}") for c in NODE],
            F.concat("segment", F.coalesce("more", F.array().cast(SEGMENT))).alias("segment")), "pointers")
        drop_written(nodes)
        nodes, reach = further, 2 * reach
    return nodes


def _levels(size: int) -> int:
    out = 0
    while size > 1:
        out, size = out + 1, -(-size // FAN)
    return out


def fold(start: Column, segment: Column) -> Column:
    """Root that a leaf and its siblings lead to."""
    return F.aggregate(segment, start, lambda acc, s: _digest(F.concat(s["left"], acc, s["right"])))


def proofs(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, leaf, tampered, subroot, root`` (binary
    digests) and ``segment``, its siblings level by level up to the root."""
    leaves, sources = numbered_leaves(docs)
    leaves = written(leaves, "numbered")
    trees, largest = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    first = leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"), "n")
    runs, roots = grow(first, largest)
    roots = written(roots, "subroots")
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"), "digest",
                       F.lit(trees).cast("long").alias("n"))
    top_runs, top_roots = grow(top, trees)
    root = top_roots.select("digest").first()
    steps = pointers(runs)
    above = pointers(top_runs)
    if above is not None:  # a leaf of the upper tree is a source's root, in its own tree
        base = above.filter("level = 0").join(roots.select(F.col("tree").alias("pos"), F.col("level").alias("at")), "pos")
        base = base.select(F.col("pos").alias("tree"), F.col("at").alias("level"), F.lit(0).cast("long").alias("pos"),
                           *[f"up_{c}" for c in NODE], "segment")
        above = base.unionByName(above.filter("level > 0"))
        steps = above if steps is None else steps.unionByName(above)
    out = leaves.join(roots.select("tree", F.col("digest").alias("subroot")), "tree")
    none = F.array().cast(SEGMENT)
    if steps is not None:
        nodes = jump(steps, _levels(largest) + _levels(trees))
        out = out.join(nodes.filter("level = 0").select("tree", "pos", "segment"), ["tree", "pos"], "left")
        out = out.withColumn("segment", F.coalesce("segment", none))
    else:
        out = out.withColumn("segment", none)
    for table in (*runs, *top_runs):
        drop_written(table)
    return out.select("doc_id", "leaf", "tampered", "subroot", F.lit(bytes(root[0]) if root else None).cast("binary").alias("root"),
                      "segment")


def verify(docs: DataFrame) -> DataFrame:
    """The manifest with every proof folded from the tampered leaf."""
    found = proofs(docs)
    text = lambda c: F.lower(F.hex(c))
    siblings = F.aggregate("segment", F.lit(b""), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    folded = found.withColumn("folded", fold(F.col("tampered"), F.col("segment")))
    return folded.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text(siblings), 256).alias("proof_sha256"), text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
