"""Multinomial naive Bayes per person, trained for all persons in one job
(O-29, O-30).

The model is two aggregations: counts and feature sums per (person, class),
then the per-person totals. For prediction the classes of a person lie in a box
index (:mod:`tripcast.operators.boxes`) over their prior and feature shares. The
log posterior of a box's classes is bounded from above (shares add up to one), and
a page is read only if its bound reaches the score of the best class that any
box names. Each distinct feature vector of a person is scored once and
its trips join the result; no row per (trip, class) exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.functions.geo import round5
from tripcast.functions.time import day_type, hour_of
from tripcast.operators.boxes import Bounds, BoxIndex, blocks, build_index, descend, page_rows, sides
from tripcast.operators.neighbours import _results
from tripcast.session import stored

FEATURES = ("hour", "type_of_day", "start_lat", "start_lon")
SCORE_DIGITS = 9
# Above the rounding of a score and of its bounds.
SLACK = 1e-6


def nb_train_rows(train: DataFrame, round_end: bool = True) -> DataFrame:
    """Labelled rows: person, label (rounded end point) and the four
    features ``hour, type_of_day, start_lat, start_lon``."""
    end_lat = round5("end_lat") if round_end else F.col("end_lat")
    end_lon = round5("end_lon") if round_end else F.col("end_lon")
    return train.select(
        "out_id", end_lat.alias("label_lat"), end_lon.alias("label_lon"),
        hour_of("start_time").alias("hour"), day_type("start_time").alias("type_of_day"),
        "start_lat", "start_lon")


def nb_fit(rows: DataFrame, smoothing: float = 1.0, key: str = "out_id",
           features: Sequence[str] = FEATURES) -> DataFrame:
    """Per (person, class): ``pi = ln(n + l) - ln(N + C*l)`` and
    ``theta_j = ln(s_j + l) - ln(sum_j s_j + D*l)`` (O-29), with the person's
    number of classes ``n_classes``.

    Multinomial naive Bayes needs non-negative features; a negative value
    fails the job with a clear message instead of a silent wrong model.
    """
    feats = list(features)
    # the check sits inside the summed values, so it cannot be pruned away
    msg = F.lit("naive Bayes features must be non-negative")
    checked = rows.select(key, "label_lat", "label_lon", *[
        F.when(F.col(f) < 0, F.raise_error(msg)).otherwise(F.col(f)).alias(f) for f in feats])
    lam = F.lit(float(smoothing))
    agg = checked.groupBy(key, "label_lat", "label_lon").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f).cast("double")).alias(f"s_{f}") for f in feats])
    # per-person totals by a partial aggregation, not a window over a person
    totals = agg.groupBy(key).agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("n_classes"))
    agg = agg.join(totals, key)
    total = F.col("__total")
    n_classes = F.col("n_classes")
    feat_total = None
    for f in feats:
        feat_total = F.col(f"s_{f}") if feat_total is None else feat_total + F.col(f"s_{f}")
    d = F.lit(float(len(feats)))
    return agg.select(
        key, "label_lat", "label_lon", "n", "n_classes",
        (F.log(F.col("n") + lam) - F.log(total + n_classes * lam)).alias("pi"),
        *[(F.log(F.col(f"s_{f}") + lam) - F.log(feat_total + d * lam)).alias(f"theta_{f}") for f in feats])


def _interleaved(values: Sequence[Column], bits: int = 8) -> Column:
    """One number of whole numbers below ``2**bits``, their bits in turn."""
    out = F.lit(0).cast("long")
    for level in range(bits):
        for i, v in enumerate(values):
            bit = F.shiftright(v, level).bitwiseAND(F.lit(1)).cast("long")
            out = out.bitwiseOR(F.shiftleft(bit, level * len(values) + i))
    return out


def class_index(model: DataFrame, key: str = "out_id", features: Sequence[str] = FEATURES) -> BoxIndex:
    """Box index of each person's classes. Classes lie along a curve through
    prior and shares, each in units of what it adds to a score: a share's
    weight is its feature's size, which the person's mean shares give but for a
    factor. So a page is small in every direction that a score depends on."""
    shares = [f"theta_{f}" for f in features]
    mean = model.groupBy(key).agg(*[F.avg(F.exp(c)).alias(f"__mean_{c}") for c in shares])
    steps = {c: F.col(f"__mean_{c}") * F.col(c) * F.lit(-512.0) for c in shares} | {"pi": F.col("pi") * F.lit(-4.0)}
    rows = model.join(mean, key).select(
        key, "label_lat", "label_lon", "pi", *shares, F.lit(1).cast("long").alias("one"),
        *[F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)).cast("int").alias(f"__{c}") for c, v in steps.items()])
    rows = rows.withColumn("curve", _interleaved([F.col(f"__{c}") for c in steps])).drop(*[f"__{c}" for c in steps])
    return build_index(rows, key, ["curve", "label_lat", "label_lon"], ["pi", *shares], "one",
                       ["pi", *shares])


def class_pages(index: BoxIndex, vectors: DataFrame, features: Sequence[str], test_features: Sequence[str]) -> DataFrame:
    """The pages of classes that can hold the best one of each row of
    ``vectors`` (person, test features, ``vector``)."""
    pairs = [(F.col(t).cast("double"), f"theta_{f}") for f, t in zip(features, test_features)]
    size = pairs[0][0]
    for x, _ in pairs[1:]:
        size = size + x
    size = F.greatest(size, F.lit(1.0))

    def keys(c: Column, g: Column) -> tuple[Column, Column]:
        # A class's shares add up to one. With that constraint priced at the
        # vector's size, each share has its best value on its own: the one of
        # the vector itself, or the side of the box next to it.
        high, score = c["pi_hi"] + size, c["one"]["pi"]
        for x, share in pairs:
            best = F.least(F.greatest(x / size, F.exp(c[f"{share}_lo"])), F.exp(c[f"{share}_hi"]))
            high = high + x * F.log(best) - size * best
            score = score + x * c["one"][share]
        return F.struct((-high - F.lit(SLACK)).alias("b0")), F.struct((-score).alias("b0"))

    bounds = Bounds(lambda c: {"n": c["n"]}, keys)
    return descend(vectors, index, bounds, 1, "vector")


def nb_best(model: DataFrame, test_f: DataFrame, key: str = "out_id", features: Sequence[str] = FEATURES,
            test_features: Sequence[str] | None = None) -> DataFrame:
    """Per trip the class of its person with the largest log posterior, the
    smallest label on a tie: ``r_key, lat, lon, score, end_lat2, end_lon2``.
    Rows that repeat an ``r_key`` are one trip."""
    tf = list(test_features or [f"{f}2" for f in features])
    shares = [f"theta_{f}" for f in features]
    trips = stored(test_f.withColumnRenamed("out_id2", key).select("r_key", key, *tf, "end_lat2", "end_lon2"), "trips")
    few, many = sides(stored(model.select(key, "label_lat", "label_lon", "pi", *shares), "classes"), trips, key)
    index = class_index(many.rows, key, features)
    vectors = many.probes.select(key, *tf).distinct().withColumn("vector", F.struct(key, *tf))
    met = page_rows(class_pages(index, vectors, features, tf), index)

    def scored(c: Column) -> Column:
        s = c["pi"]
        for f, t in zip(features, tf):
            s = s + F.col(t).cast("double") * c[f"theta_{f}"]
        # a maximum over this takes the smallest label of equal scores
        return F.struct(F.round(s, SCORE_DIGITS).alias("score"), (-c["label_lat"]).alias("lat"), (-c["label_lon"]).alias("lon"))

    best = met.select("vector", F.array_max(F.transform("rows", scored)).alias("best")).groupBy("vector").agg(
        F.max("best").alias("best")).select("vector.*", "best")
    best = many.probes.join(best, [key, *tf]).select("r_key", "best", F.struct("end_lat2", "end_lon2").alias("truth"))
    # A person of few classes: all of them in one array, scored where it meets the
    # trip. Beside classes without a score (no sum of a feature) none is chosen.
    def lost(c: Column) -> Column:
        missing = F.lit(False)
        for share in shares:
            missing = missing | c[share].isNull()
        return missing

    sound = blocks(few.rows, key).filter(~F.exists("rows", lost) | F.forall("rows", lost))
    near = few.probes.join(sound, key).select(
        "r_key", F.array_max(F.transform("rows", scored)).alias("best"), F.struct("end_lat2", "end_lon2").alias("truth"))
    best = near.unionByName(best)
    best = best.groupBy("r_key").agg(F.max(F.struct("best", "truth")).alias("m"))
    return best.select("r_key", (-F.col("m.best.lat")).alias("lat"), (-F.col("m.best.lon")).alias("lon"),
                       F.col("m.best.score").alias("score"), "m.truth.end_lat2", "m.truth.end_lon2")


def nb_predict(model: DataFrame, test_f: DataFrame, k: int = 10, distance: str = "meridian",
               type_: str = "bayes_m") -> DataFrame:
    """Most probable class per trip, smallest label on a tie, written as
    result rows with the distance to the true end point (O-30)."""
    return _results(nb_best(model, test_f), k, type_, distance)
