"""The box index must give exactly the brute-force answer."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tripcast.operators import boxes
from tripcast.operators import neighbours as N
from tripcast.operators.features import split_by_time, train_features
from tripcast.operators.features import test_features as make_test_features
from tripcast.plans import queries as Q

from trip_helpers import SF_SMALL, trips_frame

DESTS = [(30.1, 110.2), (30.3, 110.9), (31.0, 111.5), (29.5, 109.9), (-33.9, 179.9)]


def adversarial_trips(seed=7, n=420):
    """One hot person with duplicate longitudes, trips at the exact
    longitude of later trips (NaN core), longitudes on both sides of the
    date line, few destinations (many ties); small persons with 0, 1, 2
    past trips."""
    rnd = random.Random(seed)
    lons = [110.0, 110.00001, 110.5, 111.25, 179.99, -179.99, 179.5, -179.5, 112.0]
    rows, key = [], 0
    for i in range(n):
        day = 1 + i % 29
        hour = rnd.choice([7, 8, 8, 9, 18])
        lon = rnd.choice(lons) if rnd.random() < 0.7 else round(rnd.uniform(100, 120), 5)
        lat = round(rnd.uniform(20, 40), 5)
        el, eo = rnd.choice(DESTS)
        rows.append((key, 1, f"2018-06-{day:02d} {hour:02d}:{rnd.randint(0, 59):02d}:00", None, lat, lon, el, eo))
        key += 1
    for person, n_train in ((2, 0), (3, 1), (4, 2)):
        for j in range(n_train):
            rows.append((key, person, f"2018-06-0{j + 1} 08:00:00", None, 30.0, 110.0 + j, 30.5, 110.5 + j))
            key += 1
        rows.append((key, person, "2018-06-25 08:00:00", None, 30.0, 110.0, 30.5, 110.5))
        key += 1
    return rows


# ---------------------------------------------------------------- brute force

def _gap(a, b):
    x = math.acos(max(-1.0, min(1.0, math.cos(math.radians(a) - math.radians(b)))))
    return math.nan if x == 0 else 6378140 * x


def _fold(a, b):
    g = math.fmod(abs(a - b), 360.0)
    return min(g, 360.0 - g)


def _root_key(tr, te, clamp=False):
    gap = _gap(tr.start_lon, te.start_lon2)
    d = float((tr.hour - te.hour2) ** 2 + (tr.type_of_day - te.type_of_day2) ** 2)
    if math.isnan(gap):
        return (math.inf, 0.0)
    if d + math.log10(gap * gap) < 0:
        return (-1e6, 0.0) if clamp else (math.inf, 0.0)
    f = _fold(tr.start_lon, te.start_lon2)
    return (d + 2 * math.log10(f), f)


def brute_nearest(past, trips, k, clamp=False):
    """``{r_key: (class, votes)}`` and the kept rows ``{r_key: {(nb_key, pos)}}``."""
    win, kept = {}, {}
    for te in trips:
        rows = sorted(((_root_key(tr, te, clamp), tr) for tr in past if tr.out_id == te.out_id2), key=lambda x: (x[0], x[1]["class"]))
        if not rows:
            continue
        limit = rows[min(k, len(rows)) - 1][0]
        near = [(key, tr) for key, tr in rows if key <= limit]
        votes = {}
        for _, tr in near:
            votes[tr["class"]] = votes.get(tr["class"], 0) + 1
        first = [tr["class"] for key, tr in near if key == near[0][0]]
        win[te.r_key] = min((-votes[c], c) for c in first)[1]
        kept[te.r_key] = {(tr.nb_key, 1 + sum(o < key for o, _ in near)) for key, tr in near}
    return win, kept


def brute_queue(past, trips, k):
    """``{r_key: (k-th destination, voted destination)}``."""
    out = {}
    for te in trips:
        def key(tr):
            f = _fold(tr.start_lon, te.start_lon2)
            lost = math.isnan(_gap(te.start_lon2, tr.start_lon))
            p = abs(te.hour2 - tr.hour) * abs(te.type_of_day2 - tr.type_of_day) * f
            return (math.inf, 0.0) if lost else (p, f)
        rows = sorted((*key(tr), tr.end_lat, tr.end_lon) for tr in past if tr.out_id == te.out_id2)[:k]
        if rows:
            dests = [r[2:] for r in rows]
            out[te.r_key] = dests[-1], min(set(dests), key=lambda d: (-dests.count(d), dests.index(d)))
    return out


def brute_weighted(past, trips, k):
    out = {}
    for te in trips:
        rows = sorted(((te.start_lat2 - tr.start_lat) ** 2 + (te.start_lon2 - tr.start_lon) ** 2
                       + float(te.hour2 - tr.hour) ** 2 + float(te.type_of_day2 - tr.type_of_day) ** 2, tr["class"])
                      for tr in past if tr.out_id == te.out_id2)[:k]
        if not rows:
            continue
        zero = rows[0][0] == 0
        sums = {}
        for d2, c in rows:
            sums[c] = sums.get(c, 0.0) + (float(d2 == 0) if zero else 1 / math.sqrt(d2))
        out[te.r_key] = min((-round(s, 6), c) for c, s in sums.items())[1]
    return out


def check(spark, rows, k):
    tr, te = split_by_time(trips_frame(spark, rows))
    trf, tef = train_features(tr).cache(), make_test_features(te).cache()
    past, trips = trf.collect(), tef.collect()
    for clamp in (False, True):
        win, kept = brute_nearest(past, trips, k, clamp)
        ranked = N.rank_neighbours(trf, tef, k, clamp).cache()
        got = N.nearest_winner(ranked).collect()
        assert {r.r_key: r["class"] for r in got} == win and len(got) == len(win)
        if clamp:
            continue
        rows_of = N.kept_neighbours(trf, tef, k, clamp).join(
            trf.select("nb_key", "out_id", "hour", "type_of_day", "start_lon", "class"),
            ["out_id", "hour", "type_of_day", "start_lon", "class"])
        found = {}
        for r in rows_of.collect():
            found.setdefault(r.r_key, set()).add((r.nb_key, r.pos))
        assert found == kept
    qtr, qte = train_features(tr, round_start=True).cache(), make_test_features(te, round_start=False).cache()
    want = brute_queue(qtr.collect(), qte.collect(), k)
    for i, predict in enumerate((N.knn_kth, N.knn_voted)):
        got = {r.r_key: (r.lat, r.lon) for r in predict(qtr, qte, k, distance="ellipsoid").collect()}
        assert got == {r: dests[i] for r, dests in want.items()}
    wtr, wte = train_features(tr, 8).cache(), make_test_features(te, round_start=False).cache()
    got = {(r.r_key, r.k): r.predict for r in N.knn_sweep(wtr, wte, (1, k), with_class=True).collect()}
    for kk in {1, k}:
        assert {r: c for (r, j), c in got.items() if j == kk} == brute_weighted(wtr.collect(), wte.collect(), kk)


SHAPES = [
    [110.0] * 15 + [109.9 - i / 100 for i in range(20)],      # the core, then one side
    [110.5] * 30 + [110.6 + i / 100 for i in range(5)],       # one run of ties
    [110.0] * 40,                                             # nothing but the core
    [111.0 + i / 100 for i in range(40)],
    [179.9, -179.9, -179.8, 179.8] * 8,                       # both sides of the date line
    [-70.0 + i / 1000 for i in range(30)],                    # around the antipode
]


def shaped_trips():
    """For each shape a person with past trips at these longitudes, each with a
    destination of its own, and trips to predict, all in one (hour, day type)."""
    rows = []
    for p, lons in enumerate(SHAPES):
        at = 10_000 * (p + 1)
        rows += [(at + i, 10 + p, "2018-06-05 08:00:00", None, 30.0, lon, 35.0 + i / 100, 105.0 + i / 100)
                 for i, lon in enumerate(lons)]
        rows += [(at + 5000 + i, 10 + p, "2018-06-26 08:00:00", None, 30.0, lon, 30.5, 110.5)
                 for i, lon in enumerate((110.0, 179.95, -179.95))]
    return rows


@pytest.mark.parametrize("page_bits,k", [(1, 10), (5, 3)])
def test_adversarial_persons_equal_brute_force(spark, monkeypatch, page_bits, k):
    """Hot, one-sided, all-tied and wrapped persons; also with pages of two
    rows under rows of four, so that a few hundred trips fill every level."""
    if page_bits == 1:
        monkeypatch.setattr(boxes, "PAGE_BITS", 1)
        monkeypatch.setattr(boxes, "FAN_BITS", 2)
    check(spark, adversarial_trips(seed=k) + shaped_trips(), k)


def test_rank_keeps_ties(spark):
    # four past trips at the same distance, k = 3: rank keeps all four
    rows = [(i, 1, "2018-06-04 08:00:00", None, 30.0, 111.0, 30.5 + i / 10, 110.5) for i in range(4)]
    rows.append((9, 1, "2018-06-25 08:00:00", None, 30.0, 110.0, 30.5, 110.5))
    tr, te = split_by_time(trips_frame(spark, rows))
    kept = N.kept_neighbours(train_features(tr), make_test_features(te), 3)
    assert kept.agg(F.sum("cnt")).first()[0] == 4


def test_distances_below_the_old_rounding_are_no_tie(spark):
    # two past trips whose root metrics agree in six decimals: the nearer wins
    rows = [(0, 1, "2018-06-05 08:00:00", None, 30.0, 111.0000001, 35.0, 105.0),
            (1, 1, "2018-06-05 08:00:00", None, 30.0, 111.0, 36.0, 106.0),
            (2, 1, "2018-06-05 08:00:00", None, 30.0, 111.0000001, 35.0, 105.0),
            (3, 1, "2018-06-26 08:00:00", None, 30.0, 110.0, 30.5, 110.5)]
    tr, te = split_by_time(trips_frame(spark, rows))
    got = N.knn_nearest_vote(train_features(tr), make_test_features(te), 3).first()
    assert abs(got.lon - 106.0) < 0.01


def test_weighted_zero_distance_only(spark):
    # an exact feature match votes alone, even against two closer-by-count others
    rows = [(0, 1, "2018-06-04 08:00:00", None, 30.0, 110.0, 35.0, 115.0),
            (1, 1, "2018-06-04 08:00:00", None, 30.0, 110.001, 31.0, 111.0),
            (2, 1, "2018-06-05 08:00:00", None, 30.0, 110.001, 31.0, 111.0),
            (9, 1, "2018-06-25 08:00:00", None, 30.0, 110.0, 30.5, 110.5)]
    tr, te = split_by_time(trips_frame(spark, rows))
    got = N.knn_weighted(train_features(tr, 8), make_test_features(te, round_start=False), 3).first()
    assert abs(got.end_lat_pre - 35.0) < 0.001 and abs(got.end_lon_pre - 115.0) < 0.001


def test_persons_with_short_history(spark):
    tr, te = split_by_time(trips_frame(spark, adversarial_trips(n=60)))
    res = N.knn_kth(train_features(tr, round_start=True), make_test_features(te, round_start=False), 10,
                    distance="ellipsoid").toPandas()
    # person 2 has no history: absent; persons 3 and 4 use what they have
    keys = set(te.filter("out_id in (3, 4)").toPandas().r_key)
    assert keys <= set(res.r_key)
    assert not set(te.filter("out_id = 2").toPandas().r_key) & set(res.r_key)


@pytest.mark.parametrize("metric", ["knn_nearest_vote", "knn_kth", "knn_weighted"])
def test_trip_without_a_start_never_wins(spark, metric):
    rows = [(0, 1, "2018-06-05 08:00:00", None, 30.0, None, 35.0, 105.0),
            (1, 1, "2018-06-05 08:00:00", None, 30.0, 110.001, 36.0, 106.0),
            (2, 1, "2018-06-26 08:00:00", None, 30.0, 110.0, 30.5, 110.5),
            (3, 1, "2018-06-26 08:00:00", None, 30.0, None, 30.5, 110.5)]
    tr, te = split_by_time(trips_frame(spark, rows))
    trf, tef = train_features(tr), make_test_features(te)
    assert trf.count() == 1 and tef.count() == 1
    got = getattr(N, metric)(trf, tef, 1).toPandas()
    assert len(got) == 1 and abs(got.filter(like="lon").iloc[0, 0] - 105.0) > 0.5


def hot_frames(spark, n, strip=False):
    """A person of ``n`` past trips and 40 trips to predict; with ``strip`` all
    at one longitude, apart in latitude only."""
    rnd = F.xxhash64("id")
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000003)) / F.lit(1000003.0)
    past = spark.range(n).select(
        F.col("id").alias("nb_key"), (F.col("id") % 1 + 1).alias("out_id"),
        (F.lit(8) if strip else F.pmod(rnd, F.lit(24))).cast("int").alias("hour"),
        F.lit(0).alias("type_of_day"), (20 + 20 * unit(1)).alias("start_lat"),
        (F.lit(110.0) if strip else 100 + 20 * unit(2)).alias("start_lon"),
        F.round(30 + F.floor(10 * unit(3)), 1).alias("end_lat"), F.lit(110.0).alias("end_lon"),
        F.concat(F.lit("wx4g0"), F.lpad(F.floor(1000 * unit(3)).cast("string"), 3, "0")).alias("class"))
    trips = spark.range(40).select(
        F.col("id").alias("r_key"), (F.col("id") % 1 + 1).alias("out_id2"), F.lit(8).alias("hour2"),
        F.lit(0).alias("type_of_day2"), (20 + F.col("id") / 2).alias("start_lat2"),
        (F.lit(110.0) if strip else 100 + F.col("id") / 2 + 0.001).alias("start_lon2"),
        F.lit(30.0).alias("end_lat2"), F.lit(110.0).alias("end_lon2"))
    return past, trips


@pytest.mark.parametrize("strip", [False, True])
def test_hot_person_reads_few_pages_and_is_exact(spark, strip):
    past, trips = hot_frames(spark, 100_000, strip)
    form = N.l2_form()
    index = boxes.build_index(form.place(N.make_entries(past.withColumn("end_lat_pre", F.lit(0.0)).withColumn(
        "end_lon_pre", F.lit(0.0)), form)), "out_id", form.order, form.boxes, "cnt")
    needed = boxes.descend(trips.withColumnRenamed("out_id2", "out_id"), index, form.bounds, 10, "r_key")
    pages = [r["count"] for r in needed.groupBy("r_key").count().collect()]
    assert len(pages) == 40 and max(pages) <= (8 if strip else 128) and index.pages.count() > 3000
    rows = past.collect()
    want = brute_weighted(rows, trips.collect(), 10)
    assert {r.r_key: r.predict for r in N.knn_sweep(past, trips, (10,), with_class=True).collect()} == want
    if not strip:
        past = past.withColumn("class", F.concat("class", F.lit("0000")))
        win, _ = brute_nearest(past.collect(), trips.collect(), 10)
        assert {r.r_key: r["class"] for r in N.nearest_vote_winners(past, trips, 10).collect()} == win


def test_no_pair_rows_and_no_driver_step(spark):
    past, trips = hot_frames(spark, 2000)
    plan = N.nearest_vote_winners(past, trips, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_folded_range_bounds_every_point(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(300):
        lo = rnd.uniform(-185, 185)
        rows.append((lo, lo + rnd.choice([0.0, rnd.uniform(0, 3), rnd.uniform(0, 300)]), rnd.uniform(-180, 180)))
    rows += [(-180.0, 180.0, 0.0), (10.0, 10.0, 10.0), (-180.0, -179.0, 179.5), (100.0, 400.0, 50.0)]
    df = spark.createDataFrame(rows, "lo double, hi double, x double")
    for r in df.select("*", *[c.alias(n) for c, n in zip(boxes.folded_range(F.col("lo"), F.col("hi"), F.col("x")), ("near", "far"))]).collect():
        inside = [_fold(r.lo + (r.hi - r.lo) * i / 200, r.x) for i in range(201)]
        assert r.near <= min(inside) + 1e-12 and r.far >= max(inside) - 1e-12
        if r.hi <= 360 and r.hi - r.lo < 3:
            assert r.near >= min(inside) - 0.02 and r.far <= max(inside) + 0.02


def test_small_blocks_equal_brute_force(spark, monkeypatch):
    """Persons on both sides of a small block, and pages of two rows."""
    for name, value in (("BLOCK", 32), ("BLOCK_PROBES", 12), ("PAGE_BITS", 1), ("FAN_BITS", 2)):
        monkeypatch.setattr(boxes, name, value)
    check(spark, adversarial_trips(seed=5, n=120) + shaped_trips(), 5)


def test_sides_part_persons_by_rows_and_probes(spark, monkeypatch):
    monkeypatch.setattr(boxes, "BLOCK", 3)
    monkeypatch.setattr(boxes, "BLOCK_PROBES", 2)
    rows = spark.createDataFrame([(p,) for p, n in ((1, 3), (2, 4), (3, 1), (None, 2)) for _ in range(n)], "p int")
    probes = spark.createDataFrame([(p,) for p, n in ((1, 2), (2, 1), (3, 3), (None, 9)) for _ in range(n)], "p int")
    few, many = boxes.sides(rows, probes, "p")
    got = [sorted(r.p for r in df.collect()) for df in (few.rows, few.probes, many.rows, many.probes)]
    assert got == [[1] * 3, [1] * 2, [2] * 4 + [3], [2] + [3] * 3]


@pytest.mark.parametrize("block", [2, 256])
def test_repeated_trip_has_the_neighbours_of_all_its_persons(spark, monkeypatch, block):
    """One ``r_key`` for trips of a person with one past trip and one with three."""
    monkeypatch.setattr(boxes, "BLOCK", block)
    rows = [(0, 1, "2018-06-05 08:00:00", None, 30.0, 110.3, 35.0, 105.0),
            *[(i, 2, "2018-06-05 08:00:00", None, 30.0, 110.0 + i / 10, 36.0 + i, 106.0) for i in (1, 2, 5)],
            *[(9, p, "2018-06-26 08:00:00", None, 30.0, 110.0, 30.5, 110.5) for p in (1, 2)],
            (8, 1, "2018-06-26 08:00:00", None, 30.0, 110.0, 30.5, 110.5)]
    tr, te = split_by_time(trips_frame(spark, rows))
    found = N.rank_neighbours(train_features(tr), make_test_features(te), 3).collect()
    assert {r.r_key: [round(e.start_lon, 1) for e in r.found] for r in found} == {8: [110.3], 9: [110.1, 110.2, 110.3]}
    assert len(found) == 2


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trips_of_few_are_found_in_one_join(spark):
    """A person's array meets its trips once: no list of neighbours is shuffled,
    and no winner is computed for each column of its row."""
    past, trips = hot_frames(spark, 20)
    assert "Window" not in _optimized(N.knn_sweep(past, trips, (5, 10)))
    past = past.withColumn("class", F.concat("class", F.lit("0000")))
    few = N.rank_neighbours(past, trips, 10)
    plan = _optimized(few)
    first = plan[plan.index("Union"):].split("Aggregate [r_key")[0]
    assert "Join Inner" in first and "flatten" not in first
    assert _optimized(N.knn_voted(past, trips, 10)).count("array_min(transform(spans") == 1
    assert _optimized(N.knn_nearest_vote(past, trips, 10)).count("array_min(transform(filter(found") == 1


@pytest.mark.parametrize("query", ["results_roundtrip", "results_for_run", "evaluate_buckets"])
def test_both_queue_forms_read_one_search(spark, monkeypatch, query):
    forms, search = [], N.nearest_entries
    monkeypatch.setattr(N, "nearest_entries", lambda *a, **kw: forms.append(a[3].order) or search(*a, **kw))
    assert Q.QUERIES[query](spark, SF_SMALL).count() > 0
    assert forms.count(N.log_form().order) == 1 and len(forms) == 2


def test_rerun_reads_one_search(spark, monkeypatch):
    forms, search = [], N.nearest_entries
    monkeypatch.setattr(N, "nearest_entries", lambda *a, **kw: forms.append(a[3].order) or search(*a, **kw))
    Q.QUERIES["results_rerun"](spark, SF_SMALL)
    assert forms == [N.log_form().order]
