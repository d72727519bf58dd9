"""Box index: ordered pages of a person's rows under bounding boxes.

Rows are range-partitioned in the order of ``(person, *order)``, cut into pages
of ``PAGE`` neighbouring rows and written once. A page keeps its rows in an
array, with how many rows it stands for and, of each box column, the least and
the largest value. ``FAN`` pages share a directory row, ``FAN`` directory rows
a row above, and those of a person a top row: a person of 10^9 rows has a few
hundred entries at the top, a person of up to a page one. No row ever holds
more than ``PAGE`` rows or ``FAN`` boxes of one person, but for the top, which
holds one box for each ``PAGE * FAN * FAN`` rows.

A probe descends from the top: in every directory row it bounds, by the boxes,
the key that rows under each child can have. The least upper bound of a child
with at least ``k`` rows is a cut: children whose lower bound lies above it
cannot hold one of the ``k`` smallest keys, ties included. Bounds are structs
and compare from left to right. The cuts of all directory rows of a probe are
combined before any page is read. One plan at every size: nothing is counted
on the driver, and a hot person's probes spread over the pages that they need.

A person of few rows and few probes needs no index: all rows lie in one array
(:func:`blocks`), which each probe meets in one join. :func:`sides` parts the
persons by both counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.session import scratch_path, stored

PAGE_BITS = 5   # 32 rows
FAN_BITS = 8    # 256 pages, and again
PAGE, FAN = 1 << PAGE_BITS, 1 << FAN_BITS
BLOCK = 256            # most rows of a key that lie in one array
BLOCK_PROBES = 20_000  # and most probes that one task may bring to them


@dataclass(frozen=True)
class Bounds:
    """Bounds of the keys under a box, in two steps so that no distance is
    computed twice: ``gaps`` names the distances of a probe to a box, and from
    those and the box ``keys`` makes the lower bound, and the upper bound or
    null where a row under the box may have no key."""
    gaps: Callable[[Column], dict[str, Column]]
    keys: Callable[[Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class BoxIndex:
    key: str
    levels: tuple[DataFrame, ...]   # top first: (key[, node], children)
    pages: DataFrame                # (key, node, rows)


def _children(df: DataFrame, boxes: Sequence[str]) -> Column:
    sides = [f"{c}_{side}" for c in boxes for side in ("lo", "hi")]
    return F.collect_list(F.struct(F.col("node").alias("child"), "n", "one", *sides)).alias("children")


@dataclass(frozen=True)
class Side:
    rows: DataFrame
    probes: DataFrame


def sides(rows: DataFrame, probes: DataFrame, key: str) -> tuple[Side, Side]:
    """``rows`` and ``probes`` of the keys with at most ``BLOCK`` rows and
    ``BLOCK_PROBES`` probes, and those of all others. Both are stored frames; so
    are the keys of the second side, at most one for each ``BLOCK`` rows."""
    rows, probes = rows.filter(F.col(key).isNotNull()), probes.filter(F.col(key).isNotNull())
    large = None
    for df, most in ((rows, BLOCK), (probes, BLOCK_PROBES)):
        over = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(key)
        large = over if large is None else large.union(over).distinct()
    large = stored(large, "large-keys")
    return tuple(Side(rows.join(large, key, how), probes.join(large, key, how)) for how in ("left_anti", "left_semi"))


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """``(key, rows)``: all rows of a key in one array."""
    return rows.groupBy(key).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("rows"))


def build_index(rows: DataFrame, key: str, order: Sequence[str], boxes: Sequence[str], weight: str,
                example: Sequence[str] = ()) -> BoxIndex:
    """Index of ``rows`` by ``key``: ``order`` must tell rows of a key apart,
    ``boxes`` are the columns that bounds are made of, ``weight`` says how many
    rows one stands for. A box also names ``one`` of its rows, with the columns
    ``example``, whose own key bounds the least one."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    page = F.shiftright(F.monotonically_increasing_id(), PAGE_BITS)
    kept = [c for c in rows.columns if c != key]
    pages = laid.withColumn("node", page).groupBy(key, "node").agg(
        F.sum(weight).alias("n"), F.first(F.struct(F.lit(0).alias("of"), *example)).alias("one"),
        *[f(c).alias(f"{c}_{side}") for c in boxes for side, f in (("lo", F.min), ("hi", F.max))],
        F.collect_list(F.struct(*kept)).alias("rows"))
    path = scratch_path(spark, "pages")  # written: a recomputed task cannot cut other pages
    pages.write.parquet(path)
    pages = spark.read.schema(pages.schema).parquet(path)
    levels, node = [], pages.drop("rows")
    both = [F.sum("n").alias("n"), F.first("one").alias("one"), *[f(f"{c}_{side}").alias(f"{c}_{side}") for c in boxes
                                     for side, f in (("lo", F.min), ("hi", F.max))]]
    for _ in range(2):
        up = node.groupBy(key, F.shiftright("node", FAN_BITS).alias("__up")).agg(
            _children(node, boxes), *both).withColumnRenamed("__up", "node")
        levels.append(up.select(key, "node", "children"))
        node = up.drop("children")
    levels.append(node.groupBy(key).agg(_children(node, boxes)))
    return BoxIndex(key, tuple(reversed(levels)), pages.select(key, "node", "rows"))


def descend(probes: DataFrame, index: BoxIndex, bounds: Bounds, k: int, probe_id: str) -> DataFrame:
    """``(probe columns, node, cut)``: the pages that each probe needs for its
    ``k`` smallest keys. Probes carry the index's key; several rows of one
    ``probe_id`` are one probe."""
    cols = probes.columns
    at, cut = probes, None
    for level in index.levels:
        met = at.join(level, [index.key] if cut is None else [index.key, "node"])

        def measured(c: Column) -> Column:
            return F.struct(c.alias("c"), F.struct(*[g.alias(n) for n, g in bounds.gaps(c).items()]).alias("g"))

        def scored(m: Column) -> Column:
            low, high = bounds.keys(m["c"], m["g"])
            return F.struct(m["c"]["child"].alias("child"), low.alias("low"), F.when(m["c"]["n"] >= k, high).alias("high"))

        met = met.withColumn("children", F.transform(F.transform("children", measured), scored))
        here = F.array_min(F.transform("children", lambda c: c["high"]))
        met = met.withColumn("cut", here if cut is None else F.least("cut", here))
        near = F.filter("children", lambda c: F.col("cut").isNull() | (c["low"] <= F.col("cut")))
        at = met.select(*cols, "cut", F.explode(near).alias("child"))
        at = at.select(*cols, "cut", F.col("child.child").alias("node"), F.col("child.low").alias("low"))
        cut = True
    # at most one entry for each page that the directory could not rule out
    needed = at.groupBy(probe_id).agg(F.min("cut").alias("cut"), F.collect_list(F.struct(
        *[c for c in cols if c != probe_id], "node", "low")).alias("met"))
    near = F.filter("met", lambda m: F.col("cut").isNull() | (m["low"] <= F.col("cut")))
    needed = needed.select(probe_id, "cut", F.explode(near).alias("m"))
    return needed.select(*[F.col(c) if c == probe_id else F.col(f"m.{c}").alias(c) for c in cols], "cut",
                         F.col("m.node").alias("node"))


def page_rows(needed: DataFrame, index: BoxIndex) -> DataFrame:
    """The needed pages with their ``rows`` array."""
    return needed.join(index.pages, [index.key, "node"])


# --------------------------------------------------------------------------
# distances of a value to a box side

def nearest(lo: Column, hi: Column, x: Column) -> Column:
    return F.greatest(lo - x, x - hi, F.lit(0).cast("double"))


def farthest(lo: Column, hi: Column, x: Column) -> Column:
    return F.greatest(hi - x, x - lo).cast("double")


def folded(a: Column, x: Column) -> Column:
    """Degrees between two longitudes on the circle, by exact arithmetic."""
    gap = F.abs(a - x) % F.lit(360.0)
    return F.least(gap, F.lit(360.0) - gap)


def folded_range(lo: Column, hi: Column, x: Column) -> tuple[Column, Column]:
    """Least and largest folded distance of a longitude to ``[lo, hi]``."""
    def holds(*points: Column) -> Column:
        found = F.lit(False)
        for p in points:
            found = found | ((lo <= p) & (p <= hi))
        return found

    wild = (lo < -360.0) | (hi > 360.0) | (F.abs(x) > 360.0)  # no longitude: no bound
    ends = folded(lo, x), folded(hi, x)
    near = F.when(wild | holds(x, x - 360.0, x + 360.0), F.lit(0.0)).otherwise(F.least(*ends))
    half = holds(x - 180.0, x + 180.0, x - 540.0, x + 540.0)
    return near, F.when(wild | half, F.lit(180.0)).otherwise(F.greatest(*ends))
