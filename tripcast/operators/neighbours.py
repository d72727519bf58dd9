"""Nearest-neighbour predictors (O-12 ... O-14, O-26 ... O-28b, O-38).

Past trips are first grouped into entries: rows of one bucket ``(person,
hour, day type)`` with identical values of everything a metric and a class
depend on, with their count ``cnt``. Every selection below counts an entry
``cnt`` times, which is exactly the result on the raw rows.

The entries of a person with few trips lie in one array, and a trip to predict
takes its neighbours from it by array expressions, in the task of one join. A
person with more has a box index (:mod:`tripcast.operators.boxes`): a trip
finds the pages whose bounds can still rank among its k nearest, takes the k
best entries of each page likewise, and a grouped merge of these short lists
gives its neighbours. Both are exact, and no pair of a trip and an entry
becomes a row.

Metrics are ranked unrounded, on keys of exact arithmetic where the metric is a
monotone function of one: the folded longitude gap in degrees stands for the
meridian distance, and ``dh * dd * gap`` for the log metric. A tie is an equal
key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.functions.geo import ellipsoid_m, meridian_gap_m, with_geohash, with_geohash_center, with_geohash_corner
from tripcast.functions.metrics import pair_metric_root
from tripcast.operators.boxes import (Bounds, blocks, build_index, descend, farthest, folded, folded_range, nearest,
                                      page_rows, sides)
from tripcast.operators.features import drop_invalid
from tripcast.session import stored

WEIGHT_DIGITS = 6
# Degrees within which a meridian gap can be below a metre, or fold to zero.
CORE_DEG = 2e-5
INF = float("inf")

BUCKET = ("out_id", "hour", "type_of_day")
TEST_COLS = ["r_key", "out_id2", "hour2", "type_of_day2", "start_lat2", "start_lon2", "end_lat2", "end_lon2"]


# --------------------------------------------------------------------------
# candidates

def candidate_counts(test_f: DataFrame, train_f: DataFrame, broadcast: str = "never") -> DataFrame:
    """Number of candidate past trips of each trip to predict, from
    per-person counts instead of listed pairs (O-12 / O-13 summary).
    ``broadcast='auto'`` leaves it to adaptive execution to broadcast the
    per-person table where its real size is below Spark's threshold (O-13
    without a driver-side collect); ``'never'`` always shuffles both sides."""
    per_person = train_f.groupBy("out_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    if broadcast == "never":
        per_person = per_person.hint("shuffle_merge")
    elif broadcast != "auto":
        raise ValueError("broadcast must be 'never' or 'auto'")
    return test_f.join(per_person, test_f["out_id2"] == per_person["out_id"], "inner").select(
        "r_key", "out_id", "n_candidates")


@dataclass(frozen=True)
class Form:
    """How one predictor orders the entries of a person for a trip."""
    entry_cols: tuple[str, ...]                # entry identity besides the bucket
    carry: tuple[str, ...]                     # values constant per entry, carried along
    boxes: tuple[str, ...]                     # columns that bounds are made of
    place: Callable[[DataFrame], DataFrame]    # adds the index order
    order: tuple[str, ...]
    bounds: Bounds
    gap: Callable[[Column], Column]            # a distance that the key needs more than once
    key: Callable[[Column, Column], dict[str, Column]]  # ranking key of an entry, first fields of its struct


def make_entries(train_f: DataFrame, form: Form) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("cnt")] + [F.first(c).alias(c) for c in form.carry]
    return train_f.groupBy(*BUCKET, *form.entry_cols).agg(*aggs)


def _cut_off(entries: Column, k: int, ties: Sequence[str]) -> Column:
    """The sorted entries that hold the first ``k`` rows; with ``ties`` (key
    fields) also all entries whose key equals the k-th row's."""
    if not ties:
        return F.slice(entries, 1, k)  # an entry holds at least one row
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(0).alias("n"), *[F.lit(INF).alias(t) for t in ties])

    def step(acc: Column, e: Column) -> Column:
        same = acc["rows"] > 0
        for t in ties:
            same = same & (acc[t] == e[t])
        taken = F.struct((acc["rows"] + e["cnt"]).alias("rows"), (acc["n"] + 1).alias("n"), *[e[t].alias(t) for t in ties])
        return F.when((acc["rows"] < k) | same, taken).otherwise(acc)

    # a prefix, so only its length is computed
    return F.slice(entries, 1, F.aggregate(entries, start, step, lambda acc: acc["n"]))


def nearest_entries(train_f: DataFrame, test_f: DataFrame, k: int, form: Form, ties: Sequence[str] = ()) -> DataFrame:
    """``(r_key, found)``: the entries that hold each trip's k nearest rows, in
    order, as an array of structs: the key fields, then entry columns, ``cnt``
    and the trip's true end ``end_lat2, end_lon2``. Rows that repeat an
    ``r_key`` are one trip with the neighbours of all."""
    past = stored(train_f.select(*BUCKET, *form.entry_cols, *form.carry), "past-rows")
    probes = stored(test_f.select(*TEST_COLS).withColumnRenamed("out_id2", "out_id"), "probes")
    few, many = sides(past, probes, "out_id")
    index = build_index(form.place(make_entries(many.rows, form)), "out_id", form.order, form.boxes, "cnt")
    paged = page_rows(descend(many.probes, index, form.bounds, k, "r_key"), index)
    # laid out by person once: entries, blocks and the join need no other exchange
    block = blocks(make_entries(few.rows.repartition("out_id"), form), "out_id")
    # only an r_key of several rows has lists to merge
    repeated = stored(probes.groupBy("r_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r_key"), "repeated")
    once, again = (few.probes.join(repeated, few.probes["r_key"].eqNullSafe(repeated["r_key"]), how)
                   for how in ("left_anti", "left_semi"))
    own = [c for c in (*form.entry_cols, *BUCKET[1:], *form.carry)]

    def measured(e: Column) -> Column:
        return F.struct(e.alias("e"), form.gap(e).alias("gap"))

    def scored(m: Column) -> Column:
        e, keys = m["e"], form.key(m["e"], m["gap"])
        return F.struct(*[c.alias(n) for n, c in keys.items()], *[e[c].alias(c) for c in own if c not in keys],
                        e["cnt"].alias("cnt"), F.col("end_lat2").alias("end_lat2"), F.col("end_lon2").alias("end_lon2"))

    def best(met: DataFrame) -> DataFrame:
        ranked = F.sort_array(F.transform(F.transform("rows", measured), scored))
        return met.select("r_key", ranked.alias("found")).select("r_key", _cut_off(F.col("found"), k, ties).alias("found"))

    lists = best(again.join(block, "out_id")).unionByName(best(paged))
    merged = lists.groupBy("r_key").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
    merged = merged.select("r_key", _cut_off(F.col("found"), k, ties).alias("found"))
    return best(once.join(block, "out_id")).unionByName(merged)


def _row_of(ranked: DataFrame, value: Column, name: str) -> DataFrame:
    """``(r_key, name)`` with a struct computed from ``found``. A generated row,
    so that a filter above does not compute it again for each of its columns."""
    return ranked.select("r_key", F.explode(F.array(value)).alias(name))


# --------------------------------------------------------------------------
# the three forms

def _time_gaps(c: Column) -> dict[str, Column]:
    """Least and largest hour and day-type distances of a box to the trip."""
    out = {}
    for short, name in (("h", "hour"), ("d", "type_of_day")):
        side = (c[f"{name}_lo"].cast("double"), c[f"{name}_hi"].cast("double"), F.col(f"{name}2").cast("double"))
        out |= {short: nearest(*side), f"{short}_far": farthest(*side)}
    return out


def _circle_gaps(c: Column) -> dict[str, Column]:
    near, far = folded_range(c["start_lon_lo"], c["start_lon_hi"], F.col("start_lon2"))
    return _time_gaps(c) | {"near": near, "far": far}


def _circle_gap(e: Column) -> Column:
    return folded(e["start_lon"], F.col("start_lon2"))


def _bound(*values: Column) -> Column:
    return F.struct(*[v.alias(f"b{i}") for i, v in enumerate(values)])


def _core_bounds(c: Column, g: Column, below: Sequence[Column], above: Sequence[Column]) -> tuple[Column, Column]:
    """The given bounds outside the core; a box at exactly the trip's longitude
    holds rows that rank last, one that touches the core anything."""
    clear = g["near"] >= CORE_DEG
    ruled_out = (c["start_lon_lo"] == c["start_lon_hi"]) & (g["near"] == 0.0)
    rest = [F.lit(0.0), *below[2:]]
    low = F.when(clear, _bound(*below)).when(ruled_out, _bound(F.lit(INF), *rest)).otherwise(_bound(F.lit(-INF), *rest))
    return low, F.when(clear, _bound(*above))


def _in_core(value: Column, gap: Column, in_core: Column) -> Column:
    """``value`` unless the row lies in the core and ``in_core`` is null."""
    return F.when(gap >= CORE_DEG, value).otherwise(F.coalesce(in_core, F.lit(INF)))


def root_form(clamp: bool = False) -> Form:
    """SQL form: root metric, rank with ties, nearest wins (O-21a, O-26). The
    key is ``dh^2 + dd^2 + 2 log10(gap in degrees)``, the metric's square but
    for a constant; NaN rows have the key infinity."""
    def keys(c: Column, g: Column) -> tuple[Column, Column]:
        low = g["h"] * g["h"] + g["d"] * g["d"] + F.lit(2.0) * F.log10(g["near"])
        high = g["h_far"] * g["h_far"] + g["d_far"] * g["d_far"] + F.lit(2.0) * F.log10(g["far"])
        return _core_bounds(c, g, [low, g["near"]], [high, g["far"]])

    def key(e: Column, gap: Column) -> dict[str, Column]:
        dh = (e["hour"] - F.col("hour2")).cast("double")
        dd = (e["type_of_day"] - F.col("type_of_day2")).cast("double")
        s = dh * dh + dd * dd + F.lit(2.0) * F.log10(gap)
        metric = pair_metric_root(e["hour"], F.col("hour2"), e["type_of_day"], F.col("type_of_day2"),
                                  e["start_lon"], F.col("start_lon2"), clamp=clamp, digits=None)
        # in the core: last, or with clamp the least key of all below one metre
        core = F.when(F.isnan(metric), F.lit(None).cast("double")).when(metric == 0.0, F.lit(-1e6)).otherwise(s)
        flat = F.isnan(metric) | (metric == 0.0)
        return {"s": _in_core(s, gap, core),
                "gap": F.when(gap >= CORE_DEG, gap).otherwise(F.when(flat, F.lit(0.0)).otherwise(gap)), "class": e["class"]}

    return Form(entry_cols=("start_lon", "class"), carry=("lat", "lon"), boxes=("hour", "type_of_day", "start_lon"),
                place=lambda df: df, order=("hour", "type_of_day", "start_lon", "class"),
                bounds=Bounds(_circle_gaps, keys), gap=_circle_gap, key=key)


def log_form() -> Form:
    """Queue form: log metric, then gap, then destination (O-21b, O-27). The
    key is ``dh * dd * gap``: 0 where the metric is -Infinity."""
    def keys(c: Column, g: Column) -> tuple[Column, Column]:
        return _core_bounds(c, g, [g["h"] * g["d"] * g["near"], g["near"], c["end_lat_lo"]],
                            [g["h_far"] * g["d_far"] * g["far"], g["far"], c["end_lat_hi"]])

    def key(e: Column, gap: Column) -> dict[str, Column]:
        dh = F.abs(F.col("hour2") - e["hour"]).cast("double")
        dd = F.abs(F.col("type_of_day2") - e["type_of_day"]).cast("double")
        lost = F.isnan(meridian_gap_m(F.col("start_lon2"), e["start_lon"]))
        core = F.when(lost, F.lit(None).cast("double")).otherwise(dh * dd * gap)
        return {"p": _in_core(dh * dd * gap, gap, core),
                "gap": F.when(gap >= CORE_DEG, gap).otherwise(F.when(lost, F.lit(0.0)).otherwise(gap)),
                "end_lat": e["end_lat"], "end_lon": e["end_lon"]}

    return Form(entry_cols=("start_lon", "end_lat", "end_lon"), carry=(),
                boxes=("hour", "type_of_day", "start_lon", "end_lat"), place=lambda df: df,
                order=("hour", "type_of_day", "start_lon", "end_lat", "end_lon"), bounds=Bounds(_circle_gaps, keys),
                gap=_circle_gap, key=key)


def l2_form() -> Form:
    """Distance-weighted form: plain Euclidean metric, then class (O-21c,
    O-28). Entries lie in the order of their start cells, so that boxes are
    small in latitude and longitude alike."""
    parts = (("start_lat", "start_lat2"), ("start_lon", "start_lon2"), ("hour", "hour2"), ("type_of_day", "type_of_day2"))

    def square(gaps: Sequence[Column]) -> Column:
        out = gaps[0] * gaps[0]
        for g in gaps[1:]:
            out = out + g * g
        return out

    def box_gaps(c: Column) -> dict[str, Column]:
        out = {}
        for a, b in parts:
            side = (c[f"{a}_lo"].cast("double"), c[f"{a}_hi"].cast("double"), F.col(b).cast("double"))
            out |= {a: nearest(*side), f"{a}_far": farthest(*side)}
        return out

    def keys(c: Column, g: Column) -> tuple[Column, Column]:
        return (_bound(square([g[a] for a, _ in parts]), c["class_lo"]),
                _bound(square([g[f"{a}_far"] for a, _ in parts]), c["class_hi"]))

    def distance(e: Column) -> Column:
        return square([(F.col(b) - e[a]).cast("double") for a, b in parts])

    def key(e: Column, gap: Column) -> dict[str, Column]:
        return {"d2": gap, "class": e["class"]}

    return Form(entry_cols=("start_lon", "start_lat", "class"), carry=("end_lat_pre", "end_lon_pre"),
                boxes=("hour", "type_of_day", "start_lat", "start_lon", "class"),
                place=lambda df: with_geohash(df, "start_lat", "start_lon", "cell"),
                order=("hour", "type_of_day", "cell", "start_lat", "start_lon", "class"),
                bounds=Bounds(box_gaps, keys), gap=distance, key=key)


# --------------------------------------------------------------------------
# truth and result rows

def attach_truth(pred: DataFrame, test: DataFrame) -> DataFrame:
    """Join the true end point of each trip to its prediction (O-14).
    A repeated ``r_key`` keeps one truth: the smallest ``(end_lat, end_lon)``."""
    truth = test.groupBy("r_key").agg(
        F.min(F.struct(F.col("end_lat").alias("a"), F.col("end_lon").alias("o"))).alias("__t"))
    return pred.join(truth, "r_key", "inner").select(
        *pred.columns, F.col("__t.a").alias("end_lat"), F.col("__t.o").alias("end_lon"))


def _result_distance(lat: str, lon: str, lat_t: str, lon_t: str, distance: str) -> Column:
    if distance == "meridian":
        return meridian_gap_m(lon, lon_t, lat, lat_t)
    if distance == "ellipsoid":
        return ellipsoid_m(lat, lon, lat_t, lon_t)
    raise ValueError("distance must be 'meridian' or 'ellipsoid'")


def _results(df: DataFrame, k: int, type_: str | None, distance: str) -> DataFrame:
    """Rows of the result table, invalid rows dropped (O-10)."""
    out = df.withColumn("dis", _result_distance("lat", "lon", "end_lat2", "end_lon2", distance))
    out = drop_invalid(out, ["end_lat2", "end_lon2", "lat", "lon", "dis"])
    return out.select(
        "r_key", "lat", "lon", "dis",
        F.lit(type_).cast("string").alias("type"), F.lit(k).cast("int").alias("k"))


# --------------------------------------------------------------------------
# SQL form: k nearest with ties, votes, nearest wins (O-26)

KEY = ("s", "gap")


def _same_key(a: Column, b: Column) -> Column:
    return (a["s"] == b["s"]) & (a["gap"] == b["gap"])


def rank_neighbours(train_f: DataFrame, test_f: DataFrame, k: int, clamp: bool = False, lat_range: int = 90) -> DataFrame:
    """``(r_key, found)``: entries whose rows have rank <= k under the root
    metric, ties kept (O-26a), in order."""
    # Cells are decoded on the past-trip side, before any join: a filter on
    # the decoded point above would otherwise be pushed down and inline the
    # whole bit decoding into one expression.
    decoded = with_geohash_corner(train_f, "class", "lat", "lon", lat_range)
    return nearest_entries(decoded, test_f, k, root_form(clamp), KEY)


def with_votes(ranked: DataFrame) -> DataFrame:
    """Each kept entry as a row, with its rank ``pos`` and the votes of its
    class among the kept rows (O-26b)."""
    def counted(e: Column) -> Column:
        before = F.filter("found", lambda o: F.struct(o["s"].alias("s"), o["gap"].alias("gap"))
                          < F.struct(e["s"].alias("s"), e["gap"].alias("gap")))
        alike = F.filter("found", lambda o: o["class"] == e["class"])
        rows = [F.aggregate(x, F.lit(0).cast("long"), lambda acc, o: acc + o["cnt"]) for x in (before, alike)]
        return F.struct((rows[0] + 1).cast("int").alias("pos"), rows[1].alias("votes"), e.alias("e"))

    return ranked.select("r_key", F.explode(F.transform("found", counted)).alias("x")).select(
        "r_key", "x.pos", "x.votes", "x.e.*")


def nearest_winner(ranked: DataFrame) -> DataFrame:
    """Class of the nearest row; votes, then class, break ties (O-26c)."""
    first = F.filter("found", lambda e: _same_key(e, F.col("found")[0]))

    def standing(e: Column) -> Column:
        votes = F.aggregate(F.filter("found", lambda o: o["class"] == e["class"]), F.lit(0).cast("long"),
                            lambda acc, o: acc + o["cnt"])
        return F.struct((-votes).alias("less"), e["class"].alias("class"), e["lat"].alias("lat"), e["lon"].alias("lon"),
                        e["end_lat2"].alias("end_lat2"), e["end_lon2"].alias("end_lon2"))

    return _row_of(ranked, F.array_min(F.transform(first, standing)), "w").select(
        "r_key", "w.class", (-F.col("w.less")).alias("votes"), "w.lat", "w.lon", "w.end_lat2", "w.end_lon2")


def kept_neighbours(train_f: DataFrame, test_f: DataFrame, k: int, clamp: bool = False, lat_range: int = 90) -> DataFrame:
    """Entry rows of rank <= k under the root metric, with ``pos``, ``votes``
    and the unrounded ``metric``."""
    kept = with_votes(rank_neighbours(train_f, test_f, k, clamp, lat_range))
    trip = test_f.groupBy("r_key").agg(*[F.first(c).alias(c) for c in ("out_id2", "hour2", "type_of_day2", "start_lon2")])
    return kept.join(trip, "r_key").withColumnRenamed("out_id2", "out_id").withColumn("metric", pair_metric_root(
        "hour", "hour2", "type_of_day", "type_of_day2", "start_lon", "start_lon2", clamp=clamp, digits=None))


def nearest_vote_winners(train_f: DataFrame, test_f: DataFrame, k: int, clamp: bool = False,
                         lat_range: int = 90) -> DataFrame:
    """One row per trip: the winning class, its decoded cell and the truth."""
    return nearest_winner(rank_neighbours(train_f, test_f, k, clamp, lat_range))


def knn_nearest_vote(train_f: DataFrame, test_f: DataFrame, k: int, distance: str = "meridian",
                     clamp: bool = False, lat_range: int = 90) -> DataFrame:
    """The SQL-form predictor, scan to result rows (O-26).

    ``train_f`` / ``test_f`` come from ``train_features`` (12-character
    classes) and ``test_features``. Output: ``r_key, lat, lon, dis, type
    (null), k``; a NaN distance (exact longitude hit) is dropped as in the
    reference.
    """
    return _results(nearest_vote_winners(train_f, test_f, k, clamp, lat_range), k, None, distance)


# --------------------------------------------------------------------------
# queue form: k-th nearest (O-27) and voted destinations (O-27b)

def queue_neighbours(train_f: DataFrame, test_f: DataFrame, k: int) -> DataFrame:
    """``(r_key, found)`` in the order of the queue form, stored: one search for
    several of :func:`knn_kth` and :func:`knn_voted`, given as ``found``."""
    return stored(_queue_entries(train_f, test_f, k), "queue")


def _queue_entries(train_f: DataFrame, test_f: DataFrame, k: int) -> DataFrame:
    def shown(e: Column) -> Column:
        return F.struct(*[e[c].alias(c) for c in ("end_lat", "end_lon", "cnt", "end_lat2", "end_lon2")])

    found = nearest_entries(train_f, test_f, k, log_form())
    return found.select("r_key", F.transform("found", shown).alias("found"))


def _with_spans(found: str, k: int) -> Column:
    """The entries that hold the first ``k`` rows, each with the number of rows
    ``prev`` before it."""
    def prev(i: Column) -> Column:
        return F.aggregate(F.slice(found, 1, i), F.lit(0).cast("long"), lambda acc, o: acc + o["cnt"])

    spans = F.transform(found, lambda e, i: F.struct(prev(i).alias("prev"), e.alias("e")))
    return F.filter(spans, lambda x: x["prev"] < k)


def knn_kth(train_f: DataFrame, test_f: DataFrame, k: int, distance: str = "meridian",
            found: DataFrame | None = None) -> DataFrame:
    """Destination of the k-th nearest past trip, or of the farthest when a
    person has fewer than k (O-27): what the reference's bounded queue
    returns. Order: log metric, then meridian gap, then destination. ``found``
    are the :func:`queue_neighbours` of the same trips and ``k``."""
    found = _queue_entries(train_f, test_f, k) if found is None else found
    last = _row_of(found, F.element_at(_with_spans("found", k), -1)["e"], "e")
    win = last.select("r_key", F.col("e.end_lat").alias("lat"), F.col("e.end_lon").alias("lon"), "e.end_lat2", "e.end_lon2")
    return _results(win, k, "queue", distance)


def knn_voted(train_f: DataFrame, test_f: DataFrame, k: int, distance: str = "meridian",
              found: DataFrame | None = None) -> DataFrame:
    """Most frequent destination among the k nearest past trips; the one
    reached first in nearest order wins a tie (O-27b: the queue's intent).
    ``found`` as for :func:`knn_kth`."""
    found = _queue_entries(train_f, test_f, k) if found is None else found
    spans = _row_of(found, _with_spans("found", k), "spans")

    def standing(x: Column) -> Column:
        alike = F.filter("spans", lambda o: (o["e"]["end_lat"] == x["e"]["end_lat"]) & (o["e"]["end_lon"] == x["e"]["end_lon"]))
        votes = F.aggregate(alike, F.lit(0).cast("long"), lambda acc, o: acc + F.least(o["e"]["cnt"], F.lit(k) - o["prev"]))
        return F.struct((-votes).alias("less"), x["prev"].alias("prev"), x["e"].alias("e"))

    best = _row_of(spans, F.array_min(F.transform("spans", standing))["e"], "e")
    win = best.select("r_key", F.col("e.end_lat").alias("lat"), F.col("e.end_lon").alias("lon"), "e.end_lat2", "e.end_lon2")
    return _results(win, k, "queue_voted", distance)


# --------------------------------------------------------------------------
# distance-weighted vote (O-28) and k sweep (O-28b)

def _weighted(train_f: DataFrame, test_f: DataFrame, ks: Sequence[int]) -> DataFrame:
    ks = sorted(set(int(x) for x in ks))
    train_d = with_geohash_center(train_f, "class", "end_lat_pre", "end_lon_pre")
    # the nearest entry is among the first k of every k, so it tells whether a distance is zero
    rows = nearest_entries(train_d, test_f, max(ks), l2_form()).select(
        "r_key", F.sqrt(F.col("found")[0]["d2"]).alias("least"), F.explode(_with_spans("found", max(ks))).alias("x"))
    rows = rows.select("r_key", "least", "x.prev", "x.e.*").withColumn("metric", F.sqrt("d2"))
    w_one = F.when(F.col("least") == 0, F.when(F.col("metric") == 0, 1.0).otherwise(0.0)).otherwise(
        F.lit(1.0) / F.col("metric"))
    rows = rows.withColumn("w", w_one)
    inc = {x: F.least(F.col("cnt"), F.lit(x) - F.col("prev")) for x in ks}
    sums = rows.groupBy("r_key", "class").agg(
        *[F.sum(F.when(i > 0, i.cast("double") * F.col("w"))).alias(f"w{x}") for x, i in inc.items()],
        *[F.first(c).alias(c) for c in ("end_lat2", "end_lon2", "end_lat_pre", "end_lon_pre")])

    def standing(x: int) -> Column:
        """The least of a trip's is its winner for k = x: the largest sum, the smallest class on a tie."""
        w = F.round(f"w{x}", WEIGHT_DIGITS)
        return F.when(w.isNotNull(), F.struct(
            (~F.isnan(w)).alias("number"), (-w).alias("less"), "class", "end_lat_pre", "end_lon_pre",
            F.col("end_lat2").alias("end_lat"), F.col("end_lon2").alias("end_lon")))

    best = sums.groupBy("r_key").agg(*[F.min(standing(x)).alias(f"best{x}") for x in ks])
    win = best.select("r_key", F.explode(F.array(*[
        F.struct(F.lit(x).alias("k"), F.col(f"best{x}").alias("b")) for x in ks])).alias("w"))
    return win.select("r_key", "w.b.end_lat", "w.b.end_lon", "w.b.end_lat_pre", "w.b.end_lon_pre",
                      F.col("w.k").cast("int").alias("k"), F.col("w.b.class").alias("predict"))


PREDICTION = ("r_key", "end_lat", "end_lon", "end_lat_pre", "end_lon_pre", "k")


def knn_weighted(train_f: DataFrame, test_f: DataFrame, k: int = 10) -> DataFrame:
    """Distance-weighted vote of the k nearest past trips by plain Euclidean
    distance (O-28): weight 1/d, or only the d = 0 neighbours when any; the
    largest weight sum wins, the smallest class on a tie. ``train_f``
    carries 8-character classes, ``test_f`` raw starts; fewer than k past
    trips use all of them. Output: ``r_key, end_lat, end_lon, end_lat_pre,
    end_lon_pre, k`` with the cell centre as the predicted point."""
    return _weighted(train_f, test_f, [k]).select(*PREDICTION)


def knn_sweep(train_f: DataFrame, test_f: DataFrame, ks: Sequence[int] = (5, 10, 20, 30),
              with_class: bool = False) -> DataFrame:
    """``knn_weighted`` for several k in one job (O-28b): candidates are
    found once for max(k), then each k keeps its prefix. ``with_class`` adds
    the predicted class as ``predict``."""
    out = _weighted(train_f, test_f, ks)
    return out if with_class else out.select(*PREDICTION)


def shuffle_rows(df: DataFrame, seed: int = 42, key: str = "r_key") -> DataFrame:
    """Rows in a seeded pseudo-random order (O-38), reproducible because the
    order key is a hash of the row key, not of the row's position."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
