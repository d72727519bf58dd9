import pytest
from pyspark.sql import functions as F

from tripcast.operators import bayes, boxes, evaluate
from tripcast.operators.features import split_by_time
from tripcast.operators.features import test_features as make_test_features
from tripcast.plans import inputs
from tripcast.session import scratch_path
from tripcast.sources import results as results_io
from tripcast.sources import trips as trips_io

from trip_helpers import SF_SMALL, trips_frame


def test_nb_matches_spark_ml(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    tr, te = inputs.split(spark, SF_SMALL)
    person = tr.groupBy("out_id").count().orderBy(F.desc("count"), "out_id").first().out_id
    rows = bayes.nb_train_rows(tr).filter(F.col("out_id") == person)
    model = bayes.nb_fit(rows)
    test_f = make_test_features(te.filter(F.col("out_id") == person))
    ours = bayes.nb_predict(model, test_f, distance="ellipsoid").select("r_key", "lat", "lon").toPandas()
    # pyspark.ml with the labels indexed in ascending (lat, lon) order
    lab = rows.withColumn("label_s", F.format_string("%012.5f|%012.5f", "label_lat", "label_lon"))
    idx = StringIndexer(inputCol="label_s", outputCol="label", stringOrderType="alphabetAsc").fit(lab)
    va = VectorAssembler(inputCols=["hour", "type_of_day", "start_lat", "start_lon"], outputCol="features")
    ml = NaiveBayes(smoothing=1.0, modelType="multinomial").fit(va.transform(idx.transform(lab)))
    tv = va.transform(test_f.select("r_key", F.col("hour2").alias("hour"), F.col("type_of_day2").alias("type_of_day"),
                                    F.col("start_lat2").alias("start_lat"), F.col("start_lon2").alias("start_lon")))
    pred = ml.transform(tv).select("r_key", "prediction").toPandas()
    labels = idx.labels
    want = {r.r_key: tuple(float(x) for x in labels[int(r.prediction)].split("|")) for r in pred.itertuples()}
    got = {r.r_key: (r.lat, r.lon) for r in ours.itertuples()}
    assert got and all(want[k] == v for k, v in got.items())


def test_nb_small_pages_do_not_change_result(spark, monkeypatch):
    tr, te = inputs.split(spark, SF_SMALL)
    model = bayes.nb_fit(bayes.nb_train_rows(tr))
    tf = make_test_features(te)
    b = bayes.nb_predict(model, tf).toPandas().sort_values("r_key").reset_index(drop=True)
    monkeypatch.setattr(boxes, "PAGE_BITS", 1)
    monkeypatch.setattr(boxes, "FAN_BITS", 1)
    a = bayes.nb_predict(model, tf).toPandas().sort_values("r_key").reset_index(drop=True)
    assert a.equals(b)


def test_nb_scores_few_classes_of_a_person_with_many(spark):
    """10 000 classes, 400 trips of 100 distinct feature vectors."""
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000003)) / F.lit(1000003.0)
    rows = spark.range(30_000).select(
        (F.col("id") % 1 + 1).alias("out_id"), (20 + (F.col("id") % 100) / 10).alias("label_lat"),
        (100 + F.floor(F.col("id") / 100) % 100 / 10).alias("label_lon"), F.floor(24 * unit(1)).alias("hour"),
        F.floor(3 * unit(2)).alias("type_of_day"), (20 + 20 * unit(3)).alias("start_lat"), (100 + 20 * unit(4)).alias("start_lon"))
    model = bayes.nb_fit(rows).cache()
    assert model.count() == 10_000
    trips = spark.range(400).select(
        F.col("id").alias("r_key"), (F.col("id") % 1 + 1).alias("out_id2"), (F.col("id") % 20).cast("int").alias("hour2"),
        (F.col("id") % 2).cast("int").alias("type_of_day2"), (20 + F.col("id") % 100 / 5).alias("start_lat2"),
        (100 + F.col("id") % 100 / 5).alias("start_lon2"), F.lit(30.0).alias("end_lat2"), F.lit(110.0).alias("end_lon2"))
    tf = [f"{f}2" for f in bayes.FEATURES]
    vectors = trips.withColumnRenamed("out_id2", "out_id").select("out_id", *tf).distinct().withColumn(
        "vector", F.struct("out_id", *tf))
    index = bayes.class_index(model)
    met = boxes.page_rows(bayes.class_pages(index, vectors, bayes.FEATURES, tf), index)
    scored = met.agg(F.sum(F.size("rows"))).first()[0]
    assert vectors.count() == 100 and scored < 400 * 10_000 / 20
    classes = model.toPandas()
    for r in bayes.nb_best(model, trips).join(trips, "r_key").sample(0.1, 3).collect():
        s = classes.pi + sum(r[t] * classes[f"theta_{f}"] for f, t in zip(bayes.FEATURES, tf))
        best = classes.assign(s=-s.round(9)).sort_values(["s", "label_lat", "label_lon"]).iloc[0]
        assert (r.lat, r.lon) == (best.label_lat, best.label_lon) and abs(r.score + best.s) < 2e-9


def test_nb_hot_person_with_few_classes_scores_no_pairs(spark):
    rows = [(i, 1, "2018-06-01 08:00:00", None, 30.0, 110.0, 30.5 + i % 2, 110.5) for i in range(6)]
    test = [(100 + i, 1, "2018-06-24 08:00:00", None, 30.0, 110.0, 30.5, 110.5) for i in range(200)]
    model = bayes.nb_fit(bayes.nb_train_rows(trips_frame(spark, rows)))
    assert {r.n_classes for r in model.collect()} == {2}
    best = bayes.nb_best(model, make_test_features(trips_frame(spark, test)))
    got = best.collect()
    # equal scores would fall to the smallest label
    assert len(got) == 200 and {(r.lat, r.lon) for r in got} <= {(30.5, 110.5), (31.5, 110.5)}
    assert len({r.score for r in got}) == 1


def test_nb_chooses_no_class_beside_one_without_a_score(spark, monkeypatch):
    """Person 2 has a class whose starts are all null; in one array as in pages."""
    rows = [(i, 1 + i % 2, "2018-06-01 08:00:00", None, None if i == 1 else 30.0, 110.0, 30.5 + i, 110.5) for i in range(6)]
    test = [(100 + p, p, "2018-06-24 08:00:00", None, 30.0, 110.0, 30.5, 110.5) for p in (1, 2)]
    model = bayes.nb_fit(bayes.nb_train_rows(trips_frame(spark, rows)))
    for block in (256, 1):
        monkeypatch.setattr(boxes, "BLOCK", block)
        assert [r.r_key for r in bayes.nb_best(model, make_test_features(trips_frame(spark, test))).collect()] == [101]


def test_nb_rejects_negative_features(spark):
    t = trips_frame(spark, [(1, 1, "2018-06-01 08:00:00", None, 30.0, -110.0, 30.5, 110.5)])
    with pytest.raises(Exception, match="non-negative"):
        bayes.nb_fit(bayes.nb_train_rows(t)).collect()


def test_bucket_edges(spark):
    d = [100.0, 200.0, 500.0, 500.01, 1000.0, 1000.01]
    df = spark.createDataFrame([(i, x, "bayes_m", 10) for i, x in enumerate(d)], "r_key long, dis double, type string, k int")
    r = evaluate.evaluate_buckets(df).first()
    assert (r.le_100, r.le_200, r.le_500, r.le_1000, r.gt_1000, r.n) == (1, 2, 3, 5, 1, 6)
    assert evaluate.evaluate_buckets(df.limit(0)).count() == 0


def test_evaluate_counts_invalid(spark):
    df = spark.createDataFrame([(1, 30.0, 110.0, 30.0, 110.0, 10), (2, None, 110.0, 30.0, 110.0, 10),
                                (3, 30.0, 110.0, 30.01, 110.0, 10)],
                               "r_key long, end_lat double, end_lon double, end_lat_pre double, end_lon_pre double, k int")
    r = evaluate.evaluate(df).first()
    assert (r.n, r.invalid_count, r.lt_500_count) == (3, 1, 1)
    assert r.lt_500_share == 0.5


def test_csv_header_mismatch_fails(spark):
    t = inputs.trips(spark, SF_SMALL).select("out_id", "r_key")   # wrong order and width
    path = scratch_path(spark, "bad-csv")
    t.write.option("header", True).csv(path)
    with pytest.raises(Exception):
        trips_io.read_trips(spark, path, "train").collect()


def test_results_partition_pruning(spark):
    rows = [(1, 30.0, 110.0, 5.0, None, 10), (2, 30.0, 110.0, 6.0, "queue", 10), (3, 30.0, 110.0, 7.0, None, 5)]
    df = spark.createDataFrame(rows, "r_key long, lat double, lon double, dis double, type string, k int")
    path = scratch_path(spark, "results-test")
    results_io.write_results(df, path)
    from pyspark.sql import types as T
    got = results_io.read_results(spark, path, k=10, type_=None, id_type=T.LongType())
    assert [r.r_key for r in got.collect()] == [1]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "isnull(type" in plan


def test_split_roundtrip_keeps_rows(spark):
    t = trips_frame(spark, [(1, 1, "2018-06-01 08:00:00.123456", "2018-06-01 09:00:00", 30.0, 110.0, 30.5, 110.5),
                            (2, 1, "2018-06-24 08:00:00", None, 30.0, 110.0, 30.5, 110.5)])
    tr, te = split_by_time(t)
    p_tr, p_te = trips_io.write_split(tr, te, scratch_path(spark, "split-test"))
    from pyspark.sql import types as T
    back = trips_io.read_trips(spark, p_tr, "train", id_type=T.LongType()).collect()
    assert back[0].start_time == tr.first().start_time
    assert trips_io.read_trips(spark, p_te, "test", id_type=T.LongType()).count() == 1


def test_group_without_a_valid_row_and_coverage(spark):
    from tripcast.operators.evaluate import coverage, evaluate

    nan = float("nan")
    pred = spark.createDataFrame(
        [(1, 5, 30.0, 110.0, 30.0, 110.0), (1, 10, 30.0, 110.0, nan, nan), (2, 10, 30.0, 110.0, None, None)],
        "r_key long, k int, end_lat double, end_lon double, end_lat_pre double, end_lon_pre double")
    rows = {r.k: r for r in evaluate(pred).collect()}
    assert rows[5].lt_500_share == 1.0 and rows[10].lt_500_share is None and rows[10].invalid_count == 2
    test = spark.createDataFrame([(1,), (2,), (3,), (4,)], "r_key long")
    assert {r.k: r.coverage for r in coverage(pred, test).collect()} == {5: 0.25, 10: 0.5}
    assert {r.k: r.coverage for r in evaluate(pred, test=test).collect()} == {5: 0.25, 10: 0.5}
