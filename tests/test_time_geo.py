import math

import pytest
from pyspark.sql import functions as F

from tripcast.functions.geo import (ellipsoid_m, meridian_gap_m, pack_location, unpack_lat, unpack_lon,
                                    with_geohash, with_geohash_center, with_geohash_corner)
from tripcast.functions.time import calendar_frame, day_type, hour_of, with_day_type
from tripcast.schema import GEOHASH_ALPHABET


def bisect_bits(x, lo, hi, n=30):
    bits = []
    for _ in range(n):
        mid = (lo + hi) / 2
        if x >= mid:
            bits.append(1)
            lo = mid
        else:
            bits.append(0)
            hi = mid
    return bits


def ref_encode(lat, lon, precision=12):
    la, lo = bisect_bits(lat, -90.0, 90.0), bisect_bits(lon, -180.0, 180.0)
    bits = [b for pair in zip(lo, la) for b in pair]
    return "".join(GEOHASH_ALPHABET[int("".join(map(str, bits[i:i + 5])), 2)] for i in range(0, 60, 5))[:precision]


def ref_decode_lower(code, rng):
    bits = "".join(format(GEOHASH_ALPHABET.index(c), "05b") for c in code).ljust(60, "0")
    lon_bits, lat_bits = bits[0::2], bits[1::2]

    def dec(bs, lo, hi):
        mid = 0.0
        last = bs.rfind("1")
        for i in range(last + 1):
            mid = (lo + hi) / 2
            if bs[i] == "1":
                lo = mid
            else:
                hi = mid
        return mid
    return dec(lat_bits, -rng, rng), dec(lon_bits, -180.0, 180.0)


def test_hour_and_day_type(spark):
    rows = [("2018-06-16 12:30:00",), ("2018-02-11 00:00:00",), ("2018-06-24 23:59:59",),
            ("2018-06-25 08:00:00",), (None,)]
    df = spark.createDataFrame(rows, "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    got = df.select(hour_of("t").alias("h"), day_type("t").alias("d")).collect()
    assert [(r.h, r.d) for r in got] == [(12, 2), (0, 0), (23, 1), (8, 0), (None, None)]
    via_cal = with_day_type(df, "t", "d", calendar_frame(spark)).select("d").collect()
    assert sorted([r.d for r in via_cal], key=lambda v: (v is None, v)) == [0, 0, 1, 2, None]


def test_geohash_encode_matches_bisection(spark):
    pts = [(0.0, 0.0), (89.999999, 179.999999), (90.0, 180.0), (-90.0, -180.0), (-45.1, -135.2),
           (23.12345, 110.54321), (-33.8688, 151.2093), (51.5074, -0.1278)]
    # exact cell edges of the 30-bit grid
    pts += [(-90 + 180 * j / 2 ** 30, -180 + 360 * j / 2 ** 30) for j in (1, 12345, 2 ** 29, 2 ** 30 - 1)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    df = with_geohash(with_geohash(df, "lat", "lon", "g12", 12), "lat", "lon", "g8", 8)
    for r in df.collect():
        assert r.g12 == ref_encode(r.lat, r.lon), (r.lat, r.lon)
        assert r.g8 == ref_encode(r.lat, r.lon)[:8]
        assert len(r.g12) == 12  # leading '0' kept


def test_geohash_decode(spark):
    codes = ["wsgnq0bnzgkn", "000000000000", "zzzzzzzzzzzz", "s0000000", "7zzzzzzzzzzz", "ws0"]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    corner = with_geohash_corner(df, "code", "lat", "lon", 90).collect()
    wide = with_geohash_corner(df, "code", "lat", "lon", 180).collect()
    centre = with_geohash_center(df, "code", "lat", "lon").collect()
    for r, w, c in zip(corner, wide, centre):
        assert (r.lat, r.lon) == ref_decode_lower(r.code, 90.0)
        assert (w.lat, w.lon) == ref_decode_lower(w.code, 180.0)
        n = len(c.code) * 5
        lat_bits, lon_bits = n // 2, n - n // 2
        lo_lat = -90 + int("".join(format(GEOHASH_ALPHABET.index(ch), "05b") for ch in c.code)[1::2] or "0", 2) * 180 / 2 ** lat_bits
        assert c.lat == pytest.approx(lo_lat + 90 / 2 ** lat_bits, abs=1e-12)
        assert ref_encode(c.lat, c.lon)[:len(c.code)] == c.code


def test_distances(spark):
    rows = [(30.0, 110.0, 30.0, 110.0), (30.0, 110.0, 31.0, 110.0), (30.0, 110.0, 30.0, 111.0),
            (30.0, 110.0, 30.000000001, 110.0), (0.0, -170.0, 0.0, 170.0), (None, 1.0, 2.0, 3.0),
            (float("nan"), 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(meridian_gap_m("b", "d", "a", "c").alias("m"), ellipsoid_m("a", "b", "c", "d").alias("e"),
                    ellipsoid_m("c", "d", "a", "b").alias("e2")).collect()
    assert math.isnan(got[0].m) and got[0].e == 1e-7
    assert math.isnan(got[1].m)                       # same longitude: latitude drops out, 0/0
    assert got[1].e == pytest.approx(110_900, rel=0.01)
    assert got[2].m == pytest.approx(6378140 * math.radians(1.0), rel=1e-12)
    assert got[4].m == pytest.approx(6378140 * math.radians(20.0), rel=1e-9)   # folded over the date line
    assert got[5].e is None and got[6].e is None
    for r in got[:5]:
        assert r.e == pytest.approx(r.e2, rel=1e-12, abs=1e-9)


def test_pack_unpack(spark):
    df = spark.createDataFrame([(23.12345, 110.54321), (0.0, 0.00001)], "lat double, lon double")
    got = df.select(pack_location("lat", "lon").alias("p")).select(
        unpack_lat("p").alias("a"), unpack_lon("p").alias("o")).collect()
    assert [(r.a, r.o) for r in got] == [(23.12345, 110.54321), (0.0, 0.00001)]


def test_next_event_hot_key_across_partitions(spark):
    from pyspark.sql import Window

    from tripcast.sources.events import next_event
    rows = [(i, 1 if i % 10 else 2 + i % 3, i // 7, i % 5) for i in range(3000)]   # key 1 holds 90% of rows
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long, v long")
    got = next_event(df, "user_id", ["t", "event_id"], ["event_id", "v"], piece=F.date_from_unix_date((F.col("t") / 20).cast("int")))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    want = df.select("*", F.lead("event_id").over(w).alias("next_event_id"), F.lead("v").over(w).alias("next_v"))
    a = got.toPandas().sort_values("event_id").reset_index(drop=True)
    b = want.toPandas().sort_values("event_id").reset_index(drop=True)
    assert a[b.columns].equals(b)
    small = next_event(df, "user_id", ["t", "event_id"], ["event_id", "v"],
                       piece=F.date_from_unix_date(F.lit(0))).toPandas()
    assert small.sort_values("event_id").reset_index(drop=True)[b.columns].equals(b)
