"""Files, runs, layouts and scopes around the predictors."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.functions.geo import with_geohash, with_geohash_corner
from tripcast.functions.sql import register_sql_functions
from tripcast.operators import bayes, features, neighbours
from tripcast.plans import inputs, queries
from tripcast.session import scratch_path
from tripcast.sources import results as results_io
from tripcast.sources import stored
from tripcast.sources import trips as trips_io
from tripcast.sources.events import fixture_trips, read_events, trips_before, trips_since

from trip_helpers import SF_SMALL

CUTOFF = "2018-06-23 00:00:00"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def local_path(path):
    return path.removeprefix("file:")


def test_cutoff_reaches_the_scans_and_changes_nothing(spark):
    events = read_events(spark, SF_SMALL)
    whole = fixture_trips(spark, SF_SMALL)
    at = F.lit(CUTOFF).cast("timestamp_ntz")
    for part, want in ((trips_before(events, CUTOFF), whole.filter(F.col("start_time") < at)),
                       (trips_since(events, CUTOFF), whole.filter(F.col("start_time") >= at))):
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, want.collect()))
    before, since = plan_of(trips_before(events, CUTOFF)), plan_of(trips_since(events, CUTOFF))
    assert "LessThan(ts,2024-01-23T00:00)" in before and "GreaterThanOrEqual(ts,2024-01-23T00:00)" in before
    assert "GreaterThanOrEqual(ts,2024-01-23T00:00)" in since and "LessThan(ts" not in since


def test_look_ahead_of_persons_without_or_with_equal_later_events(spark):
    rows = [(1, "2024-01-22 10:00:00", 1), (2, "2024-01-23 00:00:00", 1), (3, "2024-01-23 00:00:00", 1),
            (4, "2024-01-22 23:59:59", 2), (5, "2024-01-24 00:00:00", 3), (6, "2024-01-22 01:00:00", None),
            (7, "2024-01-25 01:00:00", None)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long").select(
        "event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    got = {r.r_key: str(r.end_time) for r in trips_before(events, CUTOFF).collect()}
    assert got.pop(1) == "2018-06-23 00:00:00" and set(got) <= {6}  # person 2 has no later event, person 3 no earlier one
    assert {r.r_key for r in trips_since(events, CUTOFF).collect()} == {2}


def test_run_written_twice_is_there_once(spark):
    rows = [(1, 30.0, 110.0, 5.0, None, 10), (2, 30.0, 110.0, 6.0, "queue", 10), (3, 30.0, 110.0, 7.0, None, 5)]
    df = spark.createDataFrame(rows, "r_key long, lat double, lon double, dis double, type string, k int")
    path = scratch_path(spark, "rerun")
    results_io.write_results(df, path)
    results_io.write_results(df.filter("k = 10 and type is null").withColumn("dis", F.lit(9.0)), path)
    results_io.write_results(df.limit(0), path)
    got = {(r.r_key, r.dis, r.type, r.k) for r in results_io.read_results(spark, path, any_type=True, id_type=T.LongType()).collect()}
    assert got == {(1, 9.0, None, 10), (2, 6.0, "queue", 10), (3, 7.0, None, 5)}
    results_io.write_results(df, path, mode="append")
    assert results_io.read_results(spark, path, any_type=True, id_type=T.LongType()).count() == 6


def test_quarantine_keeps_good_rows_and_names_the_files(spark):
    path = local_path(scratch_path(spark, "quarantine"))
    os.makedirs(path)
    head = "r_key,out_id,start_time,end_time,start_lat,start_lon,end_lat,end_lon\n"
    good = "{},p,2018-06-01 08:00:00,2018-06-01 09:00:00,30.0,110.0,31.0,111.0\n"
    with open(f"{path}/a.csv", "w") as f:
        f.write(head + good.format("a1") + "a2,p,2018-06-01 08:00:00\n" + good.format("a3").replace("30.0", "north") + good.format("a4"))
    with open(f"{path}/b.csv", "w") as f:
        f.write(head + good.format("b1") + good.format("b2").replace("\n", ",one,more\n") + "b3,p,yesterday,2018-06-01 09:00:00,1,2,3,4\n")
    with open(f"{path}/c.csv", "w") as f:
        f.write(head + good.format("c1"))
    ok, bad = trips_io.read_trips_quarantined(spark, path)
    assert {r.r_key for r in ok.collect()} == {"a1", "a4", "b1", "c1"}
    assert {r.record.split(",")[0] for r in bad.collect()} == {"a2", "a3", "b2", "b3"}
    assert {os.path.basename(r.file): r.n_bad for r in trips_io.quarantine_counts(bad).collect()} == {"a.csv": 2, "b.csv": 2}
    with pytest.raises(Exception):
        trips_io.read_trips(spark, path).collect()


def test_prediction_file_has_the_test_columns(spark):
    tr, te = inputs.split(spark, SF_SMALL)
    trf, tef = inputs.weighted_features(spark, SF_SMALL, (tr, te))
    pred = neighbours.knn_sweep(trf, tef, (3, 5), with_class=True)
    path = scratch_path(spark, "prediction-file")
    trips_io.write_prediction_file(trips_io.prediction_file_rows(te, pred), path)
    trips_io.write_prediction_file(trips_io.prediction_file_rows(te, pred.filter("k = 5")), path)
    back = trips_io.read_prediction_file(spark, path, id_type=T.LongType())
    assert back.columns == [*te.columns, "period", "week_code", "start_code", "predict", "k"]
    assert {r.k: r["count"] for r in back.groupBy("k").count().collect()} == {3: te.count(), 5: te.count()}
    one = trips_io.read_prediction_file(spark, path, k=3, id_type=T.LongType())
    assert "PartitionFilters: [isnotnull(k" in plan_of(one)
    r = one.orderBy("r_key").first()
    t = te.filter(F.col("r_key") == r.r_key).first()
    assert r.start_time == t.start_time and r.period == t.start_time.hour and len(r.start_code) == len(r.predict) == 8


def test_sql_decode_is_exact_and_has_no_loop(spark):
    register_sql_functions(spark)
    points = spark.createDataFrame([(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (-45.0, -135.0), (-60.2, -170.1), (31.2, 121.5),
                                    (22.54321, 114.05432)], "lat double, lon double")
    codes = with_geohash(points, "lat", "lon", "code", 12).select("code").unionByName(
        with_geohash(points, "lat", "lon", "code", 7).select("code"))
    want = with_geohash_corner(codes, "code", "a", "o")
    want.createOrReplaceTempView("codes_sql")
    got = spark.sql("SELECT code, a, o, decodeLat(code) AS lat, decodeLon(code) AS lon FROM codes_sql")
    assert "aggregate(" not in plan_of(got) and "lambda" not in plan_of(got)
    rows = got.collect()
    assert len(rows) == 14 and all((r.lat, r.lon) == (r.a, r.o) for r in rows)
    assert spark.sql("SELECT decodeLat('wx4!') AS a, decodeLon(NULL) AS b").first() == (None, None)


def test_function_query_reads_every_trip(spark):
    df = queries.QUERIES["sql_function_names"](spark, SF_SMALL)
    assert df.count() == fixture_trips(spark, SF_SMALL).count()


def test_cached_scope_scans_once_and_releases(spark):
    with features.cached(inputs.trips(spark, SF_SMALL)) as trips:
        tr, te = features.split_by_time(trips)
        features.register_views(spark, tr, te)
        both = spark.sql("SELECT count(*) AS n FROM trip_record UNION ALL SELECT count(*) FROM test_record")
        plan = plan_of(both)
        assert plan.count("InMemoryTableScan") == 2 and trips.storageLevel.useMemory
        total = sum(r.n for r in both.collect())
    assert total == trips.count() and not trips.storageLevel.useMemory
    with pytest.raises(ValueError):
        with features.cached(trips):
            raise ValueError
    assert not trips.storageLevel.useMemory


def test_tables_by_person_need_no_exchange(spark):
    tr, te = queries._stored_by_person(spark, SF_SMALL)
    pairs = neighbours.candidate_counts(te.withColumnRenamed("out_id", "out_id2"), tr)
    rows = stored.store_by_person(bayes.nb_train_rows(inputs.split(spark, SF_SMALL)[0]), "nb_rows_test",
                                  scratch_path(spark, "nb-test"))
    for df in (pairs, bayes.nb_fit(rows), te.join(tr, "out_id").hint("merge")):
        df.collect()
        assert "Exchange hashpartitioning" not in plan_of(df)
    assert bayes.nb_fit(rows).count() == bayes.nb_fit(bayes.nb_train_rows(inputs.split(spark, SF_SMALL)[0])).count()
