"""Pair metrics between a trip to predict and a past trip (O-21a/b/c) and the
trip score (O-33).

Spark returns null for ``log10(0)`` and raises on ``0/0``; the reference's
JVM arithmetic gives -Infinity and NaN there. Both are written out with
``CASE`` so a null never reaches a ranking. Metrics are rounded for
output; rankings ask for the exact value with ``digits=None``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripcast.functions.geo import _col, _nan, meridian_gap_m

NEG_INF = float("-inf")
METRIC_DIGITS = 6
L2_DIGITS = 9


def _sq_int_gap(a: Column, b: Column) -> Column:
    d = F.abs(a - b).cast("double")
    return d * d


def pair_metric_root(h: str | Column, h2: str | Column, d: str | Column, d2: str | Column,
                     lon: str | Column, lon2: str | Column, clamp: bool = False,
                     digits: int | None = METRIC_DIGITS) -> Column:
    """``sqrt(dh^2 + dd^2 + log10(gap^2))`` with the meridian gap (O-21a).

    A NaN gap (same longitude) gives NaN, which ranks last. A sum below zero
    (gap under 1 m) gives NaN as in the reference, or 0 with ``clamp``.
    """
    gap = meridian_gap_m(lon, lon2)
    s = _sq_int_gap(_col(h), _col(h2)) + _sq_int_gap(_col(d), _col(d2)) + F.log10(gap * gap)
    m = (
        F.when(F.isnan(gap), _nan())
        .when(s < 0, F.lit(0.0) if clamp else _nan())
        .otherwise(F.sqrt(s))
    )
    m = F.coalesce(m, _nan())  # a null never ranks before a number
    return F.round(m, digits) if digits is not None else m


def pair_metric_log(h: str | Column, h2: str | Column, d: str | Column, d2: str | Column,
                    lon: str | Column, lon2: str | Column, digits: int | None = METRIC_DIGITS) -> Column:
    """``log10(dh^2) + log10(dd^2) + log10(gap^2)`` (O-21b).

    Equal hour or equal day type gives -Infinity; a NaN gap gives NaN.
    """
    gap = meridian_gap_m(lon, lon2)
    dh2 = _sq_int_gap(_col(h), _col(h2))
    dd2 = _sq_int_gap(_col(d), _col(d2))
    m = (
        F.when(F.isnan(gap), _nan())
        .when((dh2 == 0) | (dd2 == 0), F.lit(NEG_INF))
        .otherwise(F.log10(dh2) + F.log10(dd2) + F.log10(gap * gap))
    )
    m = F.coalesce(m, _nan())  # a null never ranks before a number
    return F.round(m, digits) if digits is not None else m


def pair_metric_l2(lat: str | Column, lat2: str | Column, lon: str | Column, lon2: str | Column,
                   h: str | Column, h2: str | Column, d: str | Column, d2: str | Column,
                   digits: int | None = L2_DIGITS) -> Column:
    """Plain Euclidean distance over (start_lat, start_lon, hour, day type)
    (O-21c): degrees and hours mixed, unscaled."""
    dla = _col(lat) - _col(lat2)
    dlo = _col(lon) - _col(lon2)
    dh = (_col(h) - _col(h2)).cast("double")
    dd = (_col(d) - _col(d2)).cast("double")
    m = F.sqrt(dla * dla + dlo * dlo + dh * dh + dd * dd)
    m = F.coalesce(m, _nan())  # a null never ranks before a number
    return F.round(m, digits) if digits is not None else m


def trip_score(dist_m: str | Column) -> Column:
    """Logistic score of a distance in metres; lower is better (O-33)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp((F.lit(1000.0) - _col(dist_m)) / F.lit(250.0)))
