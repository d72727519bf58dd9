"""Registered Spark queries: one per operator of the inventory.

Each callable takes ``(spark, sf_dir)``, reads the given tables and returns a
lazy DataFrame. Output doubles that come out of ``acos``/``log``/``exp`` are
rounded here (not inside the operators) so results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripcast.functions.geo import (ellipsoid_m, meridian_gap_m, pack_location, round5, unpack_lat, unpack_lon,
                                    with_geohash, with_geohash_center, with_geohash_corner)
from tripcast.functions.metrics import (L2_DIGITS, METRIC_DIGITS, pair_metric_l2, pair_metric_log, pair_metric_root,
                                        trip_score)
from tripcast.functions.sql import register_sql_functions
from tripcast.functions.time import day_type, hour_of
from tripcast.operators import bayes, evaluate, features, neighbours
from tripcast.plans import inputs
from tripcast.session import freeze, scratch_path
from tripcast.sources import results as results_io
from tripcast.sources import stored
from tripcast.sources import trips as trips_io

K = 10
SWEEP = (5, 10, 20, 30)

Query = Callable[[SparkSession, str], DataFrame]


def _r(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- split / projections

def q_split_train(spark, sf):
    return inputs.split(spark, sf)[0]


def q_split_test(spark, sf):
    return inputs.split(spark, sf)[1]


def q_split_sizes(spark, sf):
    return evaluate.split_sizes(inputs.trips(spark, sf))


def q_trip_features(spark, sf):
    return inputs.sql_form_features(spark, sf)[0]


def q_test_features(spark, sf):
    return inputs.sql_form_features(spark, sf)[1]


def q_trips_of_person(spark, sf):
    t = inputs.trips(spark, sf)
    busiest = evaluate.trip_counts(t).orderBy(F.col("n_trips").desc(), F.col("out_id").asc()).limit(1)
    return features.trips_of(t, busiest)


def q_valid_results(spark, sf):
    t = inputs.trips(spark, sf).select("r_key", meridian_gap_m("start_lon", "end_lon").alias("gap"))
    return _r(features.drop_invalid(t, ["gap"]), {"gap": 1})


def q_sql_view_counts(spark, sf):
    """Both views read one derivation of the trips, kept while they are counted."""
    with features.cached(inputs.trips(spark, sf)) as trips:
        tr, te = features.split_by_time(trips)
        features.register_views(spark, features.train_features(tr), features.test_features(te))
        return freeze(spark.sql(
            "SELECT 'trip_record' AS view_name, count(*) AS n FROM trip_record "
            "UNION ALL SELECT 'test_record' AS view_name, count(*) AS n FROM test_record"))


# ---------------------------------------------------------------- expressions

def q_hour_of_day(spark, sf):
    return inputs.trips(spark, sf).select("r_key", "start_time", hour_of("start_time").alias("hour"))


def q_day_type(spark, sf):
    return inputs.trips(spark, sf).select("r_key", "start_time", day_type("start_time").alias("type_of_day"))


def q_round_coords(spark, sf):
    t = inputs.trips(spark, sf)
    return t.select("r_key",
                    round5((F.col("start_lat") + F.col("end_lat")) / 2).alias("mid_lat"),
                    round5((F.col("start_lon") + F.col("end_lon")) / 2).alias("mid_lon"))


def q_distance_ellipsoid(spark, sf):
    t = inputs.trips(spark, sf)
    return _r(t.select("r_key", ellipsoid_m("start_lat", "start_lon", "end_lat", "end_lon").alias("dis")), {"dis": 1})


def q_distance_meridian_gap(spark, sf):
    t = inputs.trips(spark, sf).select(
        "r_key", meridian_gap_m("start_lon", "end_lon", "start_lat", "end_lat").alias("g"))
    return t.select("r_key", F.isnan("g").alias("is_nan"),
                    F.when(F.isnan("g"), F.lit(None)).otherwise(F.round("g", 1)).alias("gap"))


def q_pair_metric_root(spark, sf):
    p = inputs.consecutive_trip_pairs(spark, sf)
    return p.select("r_key", "next_r_key", pair_metric_root(
        "next_hour", "hour", "next_type_of_day", "type_of_day", "next_start_lon", "start_lon",
        digits=METRIC_DIGITS).alias("metric"))


def q_pair_metric_log(spark, sf):
    p = inputs.consecutive_trip_pairs(spark, sf)
    return p.select("r_key", "next_r_key", pair_metric_log(
        "hour", "next_hour", "type_of_day", "next_type_of_day", "start_lon", "next_start_lon",
        digits=METRIC_DIGITS).alias("metric"))


def q_pair_metric_l2(spark, sf):
    p = inputs.consecutive_trip_pairs(spark, sf)
    return p.select("r_key", "next_r_key", pair_metric_l2(
        "start_lat", "next_start_lat", "start_lon", "next_start_lon",
        "hour", "next_hour", "type_of_day", "next_type_of_day", digits=L2_DIGITS).alias("metric"))


def q_pack_unpack_location(spark, sf):
    t = inputs.trips(spark, sf).select("r_key", pack_location("end_lat", "end_lon").alias("packed"))
    return t.select("r_key", "packed", unpack_lat("packed").alias("lat"), unpack_lon("packed").alias("lon"))


def _geohash_both(spark, sf, precision):
    t = inputs.trips(spark, sf).select("r_key", "start_lat", "start_lon", "end_lat", "end_lon")
    t = with_geohash(t, "start_lat", "start_lon", "start_code", precision)
    t = with_geohash(t, "end_lat", "end_lon", "end_code", precision)
    return t.select("r_key", "start_code", "end_code")


def q_geohash_encode_12(spark, sf):
    return _geohash_both(spark, sf, 12)


def q_geohash_encode_8(spark, sf):
    return _geohash_both(spark, sf, 8)


def _decode(spark, sf, how):
    t = _geohash_both(spark, sf, 12 if how != "center" else 8)
    if how == "center":
        t = with_geohash_center(t, "end_code", "lat", "lon")
    else:
        t = with_geohash_corner(t, "end_code", "lat", "lon", 90 if how == "corner" else 180)
    return t.select("r_key", "end_code", "lat", "lon")


def q_geohash_decode_corner(spark, sf):
    return _decode(spark, sf, "corner")


def q_geohash_decode_wide(spark, sf):
    return _decode(spark, sf, "wide")


def q_geohash_decode_center(spark, sf):
    return _decode(spark, sf, "center")


def q_trip_score(spark, sf):
    t = inputs.trips(spark, sf).select("r_key", ellipsoid_m("start_lat", "start_lon", "end_lat", "end_lon").alias("d"))
    return _r(t.select("r_key", trip_score("d").alias("score")), {"score": 6})


# ---------------------------------------------------------------- candidates / neighbours

def q_candidate_pairs(spark, sf):
    tr, te = inputs.sql_form_features(spark, sf)
    return neighbours.candidate_counts(te, tr)


def q_candidate_pairs_broadcast(spark, sf):
    tr, te = inputs.sql_form_features(spark, sf)
    return neighbours.candidate_counts(te, tr, broadcast="auto")


def _stored_by_person(spark, sf):
    """Past and test features of the SQL form, stored in one layout."""
    tr, te = inputs.sql_form_features(spark, sf)
    suffix = uuid.uuid4().hex[:8]
    return (stored.store_by_person(tr, f"tripcast_past_{suffix}", scratch_path(spark, "past-by-person")),
            stored.store_by_person(te.withColumnRenamed("out_id2", "out_id"), f"tripcast_test_{suffix}",
                                   scratch_path(spark, "test-by-person")))


def q_candidate_pairs_stored(spark, sf):
    """The candidate join from tables that lie by person: no exchange."""
    tr, te = _stored_by_person(spark, sf)
    return neighbours.candidate_counts(te.withColumnRenamed("out_id", "out_id2"), tr)


def q_nb_model_stored(spark, sf):
    """The model of every person from the same layout."""
    tr = inputs.split(spark, sf)[0]
    rows = stored.store_by_person(bayes.nb_train_rows(tr), f"tripcast_nb_{uuid.uuid4().hex[:8]}",
                                  scratch_path(spark, "nb-by-person"))
    m = bayes.nb_fit(rows, 1.0).drop("n_classes")
    return _r(m, {c: 9 for c in m.columns if c == "pi" or c.startswith("theta_")})


def q_attach_truth(spark, sf):
    parts = inputs.split(spark, sf)
    tr, te = inputs.sql_form_features(spark, sf, parts)
    win = neighbours.nearest_vote_winners(tr, te, K).select("r_key", "class")
    return neighbours.attach_truth(win, parts[1])


def q_neighbours_ranked(spark, sf):
    """Kept neighbours as past-trip rows: kept entries joined back to the
    rows they stand for (output-sized)."""
    tr, te = inputs.sql_form_features(spark, sf)
    kept = neighbours.kept_neighbours(tr, te, K)
    rows = tr.select("nb_key", "out_id", "hour", "type_of_day", "start_lon", "class")
    out = kept.join(rows, ["out_id", "hour", "type_of_day", "start_lon", "class"]).select(
        "r_key", "nb_key", "class", "metric", "pos")
    return _r(out, {"metric": METRIC_DIGITS})


def q_neighbour_votes(spark, sf):
    tr, te = inputs.sql_form_features(spark, sf)
    return neighbours.with_votes(neighbours.rank_neighbours(tr, te, K)).select("r_key", "class", "votes").distinct()


def q_knn_nearest_vote(spark, sf):
    tr, te = inputs.sql_form_features(spark, sf)
    return _r(neighbours.knn_nearest_vote(tr, te, K), {"dis": 1})


def q_knn_kth(spark, sf):
    tr, te = inputs.queue_form_features(spark, sf)
    return _r(neighbours.knn_kth(tr, te, K), {"dis": 1})


def q_knn_voted(spark, sf):
    tr, te = inputs.queue_form_features(spark, sf)
    return _r(neighbours.knn_voted(tr, te, K), {"dis": 1})


def q_knn_weighted(spark, sf):
    tr, te = inputs.weighted_features(spark, sf)
    return neighbours.knn_weighted(tr, te, K)


def q_knn_sweep(spark, sf):
    tr, te = inputs.weighted_features(spark, sf)
    return neighbours.knn_sweep(tr, te, SWEEP)


def q_shuffled_trips(spark, sf):
    return neighbours.shuffle_rows(inputs.trips(spark, sf), seed=42)


# ---------------------------------------------------------------- naive Bayes

def _nb_model(spark, sf, parts=None):
    tr, _ = parts or inputs.split(spark, sf)
    return bayes.nb_fit(bayes.nb_train_rows(tr), 1.0)


def q_nb_model(spark, sf):
    m = _nb_model(spark, sf).drop("n_classes")
    return _r(m, {c: 9 for c in m.columns if c == "pi" or c.startswith("theta_")})


def q_nb_predict(spark, sf):
    parts = inputs.split(spark, sf)
    _, te = inputs.sql_form_features(spark, sf, parts)
    return _r(bayes.nb_predict(_nb_model(spark, sf, parts), te, K), {"dis": 1})


# ---------------------------------------------------------------- evaluation

def _all_results(spark, sf):
    parts = inputs.split(spark, sf)
    tr, te = inputs.sql_form_features(spark, sf, parts)
    qtr, qte = inputs.queue_form_features(spark, sf, parts)
    found = neighbours.queue_neighbours(qtr, qte, K)
    return (neighbours.knn_nearest_vote(tr, te, K)
            .unionByName(neighbours.knn_kth(qtr, qte, K, found=found))
            .unionByName(neighbours.knn_voted(qtr, qte, K, found=found))
            .unionByName(bayes.nb_predict(_nb_model(spark, sf, parts), te, K)))


def q_evaluate_by_k(spark, sf):
    tr, te = inputs.weighted_features(spark, sf)
    ev = evaluate.evaluate(neighbours.knn_sweep(tr, te, SWEEP), ["k"], test=te)
    return _r(ev, {"mean_dis": 3, "mean_score": 6, "lt_500_share": 6, "max_dis": 1, "coverage": 6})


def q_evaluate_buckets(spark, sf):
    return _r(evaluate.evaluate_buckets(_all_results(spark, sf)), {"mean_score": 6})


def q_distinct_persons(spark, sf):
    return evaluate.persons(inputs.split(spark, sf)[1])


def q_trips_per_person(spark, sf):
    return evaluate.trip_counts(inputs.split(spark, sf)[1])


def q_sql_function_names(spark, sf):
    """Every trip by the six SQL functions; the pair metric is to the person's
    next trip (null for the last one)."""
    register_sql_functions(spark)
    tr = inputs.with_next_trip(inputs.trips(spark, sf))
    tr = with_geohash(tr.withColumn("end_lat", round5("end_lat")).withColumn("end_lon", round5("end_lon")),
                      "end_lat", "end_lon", "class", 12)
    for side in ("", "next_"):
        tr = tr.withColumn(f"{side}text", F.col(f"{side}start_time").cast("string"))
    tr.createOrReplaceTempView("tripcast_sqlfn_trips")
    return spark.sql("""
        SELECT r_key, datetime_to_period(text) AS hour, date_to_period(text) AS type_of_day,
               nanvl(round(getDistance(start_lat, start_lon, end_lat, end_lon), 1), CAST(NULL AS DOUBLE)) AS gap,
               nanvl(round(calc_distance(datetime_to_period(text), datetime_to_period(next_text),
                                         date_to_period(text), date_to_period(next_text),
                                         start_lat, start_lon, next_start_lat, next_start_lon), 6),
                     CAST(NULL AS DOUBLE)) AS metric,
               decodeLat(class) AS lat, decodeLon(class) AS lon
        FROM tripcast_sqlfn_trips""")


# ---------------------------------------------------------------- sources and sinks

def q_csv_trips_roundtrip(spark, sf):
    t = inputs.trips(spark, sf)
    path = scratch_path(spark, "trips-csv")
    trips_io.write_trips(t, path)
    return trips_io.read_trips(spark, path, "train", id_type=T.LongType())


def q_split_roundtrip(spark, sf):
    tr, te = inputs.split(spark, sf)
    p_tr, p_te = trips_io.write_split(tr, te, scratch_path(spark, "split"))
    back_tr = trips_io.read_trips(spark, p_tr, "train", id_type=T.LongType()).drop("end_time")
    back_te = trips_io.read_trips(spark, p_te, "test", id_type=T.LongType())
    return (back_tr.withColumn("side", F.lit("train"))
            .unionByName(back_te.withColumn("side", F.lit("test"))))


def q_prediction_file_roundtrip(spark, sf):
    tr, te = inputs.weighted_features(spark, sf)
    path = scratch_path(spark, "predictions")
    trips_io.write_predictions(neighbours.knn_sweep(tr, te, SWEEP), path)
    return trips_io.read_predictions(spark, path, id_type=T.LongType())


def q_prediction_table_roundtrip(spark, sf):
    """The file with the columns of the trips to predict; the folder of one k is
    written twice and holds its rows once."""
    tr, te = inputs.split(spark, sf)
    trf, tef = inputs.weighted_features(spark, sf, (tr, te))
    rows = trips_io.prediction_file_rows(te, neighbours.knn_sweep(trf, tef, SWEEP, with_class=True))
    path = scratch_path(spark, "prediction-file")
    trips_io.write_prediction_file(rows, path)
    trips_io.write_prediction_file(trips_io.prediction_file_rows(
        te, neighbours.knn_sweep(trf, tef, (SWEEP[0],), with_class=True)), path)
    return trips_io.read_prediction_file(spark, path, id_type=T.LongType())


def q_csv_quarantine(spark, sf):
    """Trips of which every fiftieth is spoiled in its file, read back: which
    rows passed and which were set aside."""
    t = inputs.trips(spark, sf)
    path = scratch_path(spark, "trips-spoiled")
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start_time", "end_time")}
    rows = t.select(*[times.get(c, F.col(c).cast("string")).alias(c) for c in t.columns])
    spoiled = F.col("r_key").cast("long") % 50 == 0
    rows.withColumn("start_lat", F.when(spoiled, F.concat("start_lat", F.lit("north"))).otherwise(F.col("start_lat"))) \
        .write.option("header", True).csv(path)
    good, bad = trips_io.read_trips_quarantined(spark, path, "train", T.LongType())
    return good.select("r_key", F.lit(False).alias("set_aside")).unionByName(
        bad.select(F.split("record", ",")[0].cast("long").alias("r_key"), F.lit(True).alias("set_aside")))


def _stored_results(spark, sf):
    path = scratch_path(spark, "results")
    results_io.write_results(_all_results(spark, sf), path)
    return path


def q_results_roundtrip(spark, sf):
    path = _stored_results(spark, sf)
    return _r(results_io.read_results(spark, path, any_type=True, id_type=T.LongType()), {"dis": 1})


def q_results_rerun(spark, sf):
    """Two runs, one of them stored twice: its rows are there once, the other
    run is untouched."""
    parts = inputs.split(spark, sf)
    tr, te = inputs.sql_form_features(spark, sf, parts)
    qtr, qte = inputs.queue_form_features(spark, sf, parts)
    kth = neighbours.knn_kth(qtr, qte, K, found=neighbours.queue_neighbours(qtr, qte, K))
    path = scratch_path(spark, "results")
    results_io.write_results(bayes.nb_predict(_nb_model(spark, sf, parts), te, K).unionByName(kth), path)
    results_io.write_results(kth, path)
    return _r(results_io.read_results(spark, path, any_type=True, id_type=T.LongType()), {"dis": 1})


def q_results_for_run(spark, sf):
    path = _stored_results(spark, sf)
    return _r(results_io.read_results(spark, path, k=K, type_=None, id_type=T.LongType()), {"dis": 1})


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
