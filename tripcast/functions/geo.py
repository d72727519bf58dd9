"""Geometry expressions: rounding, the two distance formulas, location
packing and geohash cells (O-18 ... O-25).

Geohash work is done on integers: a coordinate's 30-bit cell index comes from
one ``floor`` plus a one-step correction against the exact (dyadic) cell
edges, the two indexes are interleaved with shift / mask steps, and the
60-bit number is cut into base32 characters. Intermediate values are kept in
separate columns so that the expression trees stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripcast.schema import EQUATOR_RADIUS_M, GEOHASH_ALPHABET, POLAR_RADIUS_M

BITS = 30                      # bits per coordinate in a 12-character code
FULL = 1 << BITS
NAN = float("nan")

# (shift, mask) steps spreading a 32-bit value to the even bits of 64.
SPREAD_STEPS = [
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
]
# (shift, mask) steps gathering the even bits of 64 back to 32.
COMPACT_STEPS = [
    (1, 0x3333333333333333),
    (2, 0x0F0F0F0F0F0F0F0F),
    (4, 0x00FF00FF00FF00FF),
    (8, 0x0000FFFF0000FFFF),
    (16, 0x00000000FFFFFFFF),
]
EVEN_BITS = 0x5555555555555555


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nan() -> Column:
    return F.lit(NAN).cast("double")


def round5(c: str | Column) -> Column:
    """Half-up rounding to 5 decimals (about 1 m)."""
    return F.round(_col(c), 5)


# --------------------------------------------------------------------------
# distances

def meridian_gap_m(lon_a: str | Column, lon_b: str | Column,
                   lat_a: str | Column | None = None, lat_b: str | Column | None = None) -> Column:
    """Distance of the reference's integer-division formula (O-20).

    With integer radii the latitude terms vanish and the value is
    ``6378140 * acos(cos(dlon))``: the longitude gap folded to [0, pi]. A
    zero angle divides 0 by 0, so the result is NaN there (it is never an
    error). A NaN latitude also gives NaN.
    """
    x = F.acos(F.cos(F.radians(_col(lon_a)) - F.radians(_col(lon_b))))
    out = F.when(x == 0.0, _nan()).otherwise(F.lit(EQUATOR_RADIUS_M) * x)
    for lat in (lat_a, lat_b):
        if lat is not None:
            out = F.when(F.isnan(_col(lat)), _nan()).otherwise(out)
    return out


def ellipsoid_m(lat_a: str | Column, lon_a: str | Column,
                lat_b: str | Column, lon_b: str | Column) -> Column:
    """Ellipsoid distance in metres with the flattening correction (O-19).

    The central angle ``x`` between the reduced latitudes is the reference's
    ``acos(sin pA sin pB + cos pA cos pB cos dlon)``, evaluated in its
    well-conditioned haversine form (the ``acos`` form loses about half the
    digits at short range). Equal points, ``x = 0`` and a failed angle give
    1e-7 m as in the reference. Null or NaN input gives null, so such rows
    can be counted and excluded rather than silently poisoning a mean.
    """
    la, oa, lb, ob = (_col(c) for c in (lat_a, lon_a, lat_b, lon_b))
    ra, rb = F.lit(EQUATOR_RADIUS_M), F.lit(POLAR_RADIUS_M)
    flatten = F.lit((EQUATOR_RADIUS_M - POLAR_RADIUS_M) / EQUATOR_RADIUS_M)
    pa = F.atan(rb / ra * F.tan(F.radians(la)))
    pb = F.atan(rb / ra * F.tan(F.radians(lb)))
    s_p = F.sin((pa - pb) / 2)
    s_l = F.sin((F.radians(oa) - F.radians(ob)) / 2)
    h = s_p * s_p + F.cos(pa) * F.cos(pb) * (s_l * s_l)
    x = F.lit(2.0) * F.asin(F.sqrt(h))
    s_sum = F.sin(pa) + F.sin(pb)
    s_dif = F.sin(pa) - F.sin(pb)
    half_cos = F.cos(x / 2)
    half_sin = F.sin(x / 2)
    c1 = (F.sin(x) - x) * (s_sum * s_sum) / (half_cos * half_cos)
    c2 = (F.sin(x) + x) * (s_dif * s_dif) / (half_sin * half_sin)
    dr = flatten / 8 * (c1 - c2)
    bad_input = F.lit(False)
    for c in (la, oa, lb, ob):
        bad_input = bad_input | c.isNull() | F.isnan(c)
    return (
        F.when(bad_input, F.lit(None).cast("double"))
        .when((la == lb) & (oa == ob), F.lit(1e-7))
        .when(F.isnan(h) | (h > 1.0), F.lit(1e-7))
        .when(x == 0.0, F.lit(1e-7))
        .otherwise(ra * (x + dr))
    )


# --------------------------------------------------------------------------
# location packing (one double per location, exact for lat, lon >= 0)

def pack_location(lat: str | Column, lon: str | Column) -> Column:
    """``round5(lat) * 1e8 + round5(lon)`` (O-22)."""
    return round5(lat) * F.lit(1e8) + round5(lon)


def unpack_lat(packed: str | Column) -> Column:
    return round5(_col(packed) / F.lit(1e8))


def unpack_lon(packed: str | Column) -> Column:
    """Remainder by 1000 keeps the sign, so negative coordinates do not
    survive packing; the pipelines carry a struct instead."""
    return round5(_col(packed) % F.lit(1e3))


# --------------------------------------------------------------------------
# geohash

def _edge(idx: Column, lo: float, span: float) -> Column:
    return F.lit(lo) + idx.cast("double") * F.lit(span) / F.lit(float(FULL))


def _cell_index_rough(x: Column, lo: float, span: float) -> Column:
    raw = F.floor((x - F.lit(lo)) / F.lit(span) * F.lit(float(FULL)))
    return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(
        F.least(F.greatest(raw, F.lit(0)), F.lit(FULL - 1))).cast("long")


def _cell_index_fix(x: Column, rough: Column, lo: float, span: float) -> Column:
    """Largest j with edge(j) <= x, i.e. the bits of the bisection."""
    return (
        F.when((rough > 0) & (x < _edge(rough, lo, span)), rough - 1)
        .when((rough < FULL - 1) & (x >= _edge(rough + 1, lo, span)), rough + 1)
        .otherwise(rough)
    )


def _spread(x: Column) -> Column:
    """Bits of a 30-bit value moved to the even positions of 60. ``x`` should
    be a column reference: each step doubles the references to it."""
    for shift, mask in SPREAD_STEPS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _compact(x: Column) -> Column:
    """Inverse of ``_spread``: the even bits of a 60-bit value."""
    x = x.bitwiseAND(F.lit(EVEN_BITS))
    for shift, mask in COMPACT_STEPS:
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def with_geohash(df: DataFrame, lat: str, lon: str, out: str, precision: int = 12) -> DataFrame:
    """Add the geohash of (lat, lon) with ``precision`` characters (O-23).

    Longitude bit first, 30 bits each; latitude >= a cell middle sets the bit.
    Codes always have ``precision`` characters (leading '0' kept). A null
    coordinate gives a null code.
    """
    if not 1 <= precision <= 12:
        raise ValueError("precision must be 1..12")
    p = f"__gh_{out}_"
    la, lo = F.col(lat), F.col(lon)
    df = (
        df.withColumn(p + "ra", _cell_index_rough(la, -90.0, 180.0))
        .withColumn(p + "ro", _cell_index_rough(lo, -180.0, 360.0))
        .withColumn(p + "ia", _cell_index_fix(la, F.col(p + "ra"), -90.0, 180.0))
        .withColumn(p + "io", _cell_index_fix(lo, F.col(p + "ro"), -180.0, 360.0))
    )
    df = df.withColumn(p + "code", F.shiftleft(_spread(F.col(p + "io")), 1).bitwiseOR(_spread(F.col(p + "ia"))))
    alphabet = F.lit(GEOHASH_ALPHABET)
    chars = [
        alphabet.substr(F.shiftright(F.col(p + "code"), 5 * (11 - i)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
        for i in range(precision)
    ]
    code = F.when(la.isNull() | lo.isNull(), F.lit(None).cast("string")).otherwise(F.concat(*chars))
    df = df.withColumn(out, code)
    return df.drop(*[c for c in df.columns if c.startswith(p)])


def _with_code_indexes(df: DataFrame, code: str, p: str) -> DataFrame:
    """30-bit longitude and latitude indexes of a code padded with '0'."""
    df = df.withColumn(p + "pad", F.rpad(F.col(code), 12, "0"))
    padded = F.col(p + "pad")
    alphabet = F.lit(GEOHASH_ALPHABET)
    value = F.lit(0).cast("long")
    valid = F.lit(True)
    for i in range(12):
        digit = F.instr(alphabet, padded.substr(i + 1, 1))
        valid = valid & (digit > 0)
        value = value.bitwiseOR(F.shiftleft((digit - 1).cast("long"), 5 * (11 - i)))
    df = df.withColumn(p + "v", F.when(valid & (F.length(F.col(code)) <= 12), value))
    return (df.withColumn(p + "io", _compact(F.shiftright(F.col(p + "v"), 1)))
            .withColumn(p + "ia", _compact(F.col(p + "v"))))


def with_geohash_corner(df: DataFrame, code: str, lat_out: str, lon_out: str, lat_range: int = 90) -> DataFrame:
    """Lower cell edge of a geohash, as the reference decodes it (O-24).

    A coordinate whose bits are all zero decodes to 0. ``lat_range=180``
    reproduces the reference's ``decode`` that bisects latitude over
    -180..180 (doubling it); 90 is the true latitude.
    """
    if lat_range not in (90, 180):
        raise ValueError("lat_range must be 90 or 180")
    p = f"__gd_{lat_out}_"
    df = _with_code_indexes(df, code, p)
    lat = F.when(F.col(p + "ia") == 0, F.lit(0.0)).otherwise(
        _edge(F.col(p + "ia"), -float(lat_range), 2.0 * lat_range))
    lon = F.when(F.col(p + "io") == 0, F.lit(0.0)).otherwise(_edge(F.col(p + "io"), -180.0, 360.0))
    df = df.withColumn(lat_out, lat).withColumn(lon_out, lon)
    return df.drop(*[c for c in df.columns if c.startswith(p)])


def with_geohash_center(df: DataFrame, code: str, lat_out: str, lon_out: str) -> DataFrame:
    """Centre of the cell of a geohash of any length 1..12 (O-25)."""
    p = f"__gc_{lat_out}_"
    df = _with_code_indexes(df, code, p)
    n_bits = F.length(F.col(code)) * 5
    lon_bits = F.ceil(n_bits / 2).cast("int")
    lat_bits = F.floor(n_bits / 2).cast("int")

    def centre(idx30: Column, bits: Column, lo: float, span: float) -> Column:
        idx = F.floor(idx30.cast("double") / F.pow(F.lit(2.0), (F.lit(BITS) - bits).cast("double")))
        return F.lit(lo) + (idx.cast("double") + F.lit(0.5)) * F.lit(span) / F.pow(F.lit(2.0), bits.cast("double"))

    df = df.withColumn(lat_out, centre(F.col(p + "ia"), lat_bits, -90.0, 180.0))
    df = df.withColumn(lon_out, centre(F.col(p + "io"), lon_bits, -180.0, 360.0))
    return df.drop(*[c for c in df.columns if c.startswith(p)])
