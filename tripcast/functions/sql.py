"""The reference's SQL function names as Spark SQL functions (O-37).

``CREATE TEMPORARY FUNCTION ... RETURN <expr>`` functions are inlined by
Catalyst, so a SQL user gets the same built-in expressions (and codegen) as
the DataFrame operators, not a black-box UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tripcast.schema import EQUATOR_RADIUS_M, GEOHASH_ALPHABET, HOLIDAYS_2018, MAKEUP_WORKDAYS_2018

FUNCTION_NAMES = ("datetime_to_period", "date_to_period", "getDistance", "calc_distance", "decodeLat", "decodeLon")


def _digits(parity: int, odd_place: bool) -> str:
    """For each character of the alphabet, in order, the number made of the
    bits of one coordinate among its five: the 1st, 3rd and 5th, or the 2nd and
    4th. Longitude (parity 0) has three bits in the even places of a code and
    two in the odd ones, latitude (1) the other way round."""
    picks = (4, 2, 0) if odd_place == bool(parity) else (3, 1)
    return "".join(str(sum((v >> p & 1) << (len(picks) - 1 - i) for i, p in enumerate(picks))) for v in range(32))


def _index(parity: int) -> str:
    """The coordinate's 30-bit index of a code padded to 12: characters become
    octal digits, and two of them hold five bits. Other characters give null."""
    padded = "rpad(code, 12, '0')"
    even, odd = (f"translate({padded}, '{GEOHASH_ALPHABET}', '{_digits(parity, o)}')" for o in (False, True))
    second = 4 if parity == 0 else 8  # values of the odd place's digit
    terms = []
    for pair in range(6):
        scale = 32 ** (5 - pair)
        terms.append(f"try_cast(substr({even}, {2 * pair + 1}, 1) AS BIGINT) * {scale * second}L")
        terms.append(f"try_cast(substr({odd}, {2 * pair + 2}, 1) AS BIGINT) * {scale}L")
    return "(" + " + ".join(terms) + ")"


def _decode(parity: int, lo: float, span: float) -> str:
    idx = _index(parity)
    return f"CASE WHEN {idx} = 0 THEN 0.0D ELSE {lo}D + CAST({idx} AS DOUBLE) * {span}D / 1073741824.0D END"


def _gap(lon_a: str, lon_b: str) -> str:
    x = f"acos(cos(radians({lon_a}) - radians({lon_b})))"
    return f"CASE WHEN {x} = 0 THEN double('NaN') ELSE {EQUATOR_RADIUS_M}D * {x} END"


def function_sql() -> dict[str, str]:
    hol = ", ".join(f"'{x}'" for x in HOLIDAYS_2018)
    wrk = ", ".join(f"'{x}'" for x in MAKEUP_WORKDAYS_2018)
    gap = _gap("lonA", "lonB")
    gap2 = _gap("lon", "lon2")
    return {
        "datetime_to_period": (
            "datetime_to_period(date_str STRING) RETURNS INT "
            "RETURN CAST(split(split(date_str, ' ')[1], ':')[0] AS INT)"),
        "date_to_period": (
            "date_to_period(date_str STRING) RETURNS INT RETURN CASE "
            f"WHEN substr(date_str, 1, 10) IN ({hol}) THEN 2 "
            f"WHEN substr(date_str, 1, 10) IN ({wrk}) THEN 0 "
            "WHEN dayofweek(to_date(substr(date_str, 1, 10))) IN (1, 7) THEN 1 ELSE 0 END"),
        "getDistance": (
            "getDistance(latA DOUBLE, lonA DOUBLE, latB DOUBLE, lonB DOUBLE) RETURNS DOUBLE "
            f"RETURN CASE WHEN isnan(latA) OR isnan(latB) THEN double('NaN') ELSE {gap} END"),
        "calc_distance": (
            "calc_distance(h INT, h2 INT, d INT, d2 INT, lat DOUBLE, lon DOUBLE, lat2 DOUBLE, lon2 DOUBLE) "
            "RETURNS DOUBLE RETURN CASE "
            f"WHEN isnan({gap2}) THEN double('NaN') "
            f"WHEN CAST((h - h2) * (h - h2) + (d - d2) * (d - d2) AS DOUBLE) + log10(({gap2}) * ({gap2})) < 0 "
            "THEN double('NaN') "
            f"ELSE sqrt(CAST((h - h2) * (h - h2) + (d - d2) * (d - d2) AS DOUBLE) + log10(({gap2}) * ({gap2}))) END"),
        "decodeLat": f"decodeLat(code STRING) RETURNS DOUBLE RETURN {_decode(1, -90.0, 180.0)}",
        "decodeLon": f"decodeLon(code STRING) RETURNS DOUBLE RETURN {_decode(0, -180.0, 360.0)}",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register the six functions as temporary SQL functions; returns names."""
    for body in function_sql().values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return list(FUNCTION_NAMES)
