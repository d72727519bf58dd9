"""SQL text (DuckDB dialect) for the oracle twin of every registered query.

Each builder mirrors one Spark operator expression by expression: the same
integer geohash steps, the same explicit NaN / -Infinity cases and the same
rounding before ranking, so both engines choose the same neighbours.
"""

from __future__ import annotations

from tripcast.functions.geo import BITS, COMPACT_STEPS, EVEN_BITS, FULL, SPREAD_STEPS
from tripcast.schema import (EQUATOR_RADIUS_M, GEOHASH_ALPHABET, HOLIDAYS_2018, MAKEUP_WORKDAYS_2018,
                             POLAR_RADIUS_M, SPLIT_CUTOFF)
from tripcast.sources.events import (EVENT_TYPE_CODES, LAT_BASE, LAT_JITTER_MOD, LAT_JITTER_OFF, LAT_MOD,
                                     LAT_MUL_C, LAT_MUL_U, LON_BASE, LON_JITTER_MOD, LON_JITTER_OFF, LON_MOD,
                                     LON_MUL_C, LON_MUL_U, SHIFT_DAYS)

NAN = "'NaN'::DOUBLE"
NEG_INF = "'-Infinity'::DOUBLE"


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"{float(x)!r}::DOUBLE"


# --------------------------------------------------------------------------
# fixture trips and split

def _event_code() -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_TYPE_CODES.items())
    return f"(CASE event_type {whens} END)::BIGINT"


def _coord(base: int, mul_u: int, mul_c: int, mod: int, code: str, jitter: tuple[int, int] | None) -> str:
    expr = f"{base} + (user_id * {mul_u} + {code} * {mul_c}) % {mod}"
    if jitter:
        expr += f" + m % {jitter[0]} - {jitter[1]}"
    return f"(({expr})::DOUBLE / {d(1e5)})"


BASE_CTES = f"""
ev AS (
  SELECT event_id, user_id, ts::TIMESTAMP AS ts, {_event_code()} AS code,
         floor(value * {d(100.0)})::BIGINT AS m
  FROM events),
nx AS (
  SELECT *, lead(ts) OVER w AS next_ts, lead(code) OVER w AS next_code
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
trips AS (
  SELECT event_id AS r_key, user_id AS out_id,
         ts - INTERVAL {SHIFT_DAYS} DAY AS start_time,
         next_ts - INTERVAL {SHIFT_DAYS} DAY AS end_time,
         {_coord(LAT_BASE, LAT_MUL_U, LAT_MUL_C, LAT_MOD, 'code', (LAT_JITTER_MOD, LAT_JITTER_OFF))} AS start_lat,
         {_coord(LON_BASE, LON_MUL_U, LON_MUL_C, LON_MOD, 'code', (LON_JITTER_MOD, LON_JITTER_OFF))} AS start_lon,
         {_coord(LAT_BASE, LAT_MUL_U, LAT_MUL_C, LAT_MOD, 'next_code', None)} AS end_lat,
         {_coord(LON_BASE, LON_MUL_U, LON_MUL_C, LON_MOD, 'next_code', None)} AS end_lon
  FROM nx WHERE next_ts IS NOT NULL),
train AS (SELECT * FROM trips WHERE start_time < TIMESTAMP '{SPLIT_CUTOFF}'),
test AS (SELECT * EXCLUDE (end_time) FROM trips WHERE start_time >= TIMESTAMP '{SPLIT_CUTOFF}')"""


def with_ctes(*ctes: str, body: str) -> str:
    parts = [BASE_CTES.strip()] + [c.strip() for c in ctes if c]
    return spark_semantics("WITH " + ",\n".join(parts) + "\n" + body)


def _call_spans(sql: str, name: str):
    """(start, open_paren, close_paren) of each top-level-or-nested call."""
    i = 0
    n = len(name)
    while True:
        i = sql.find(name + "(", i)
        if i < 0:
            return
        if i > 0 and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            i += n
            continue
        depth, j = 0, i + n
        while j < len(sql):
            if sql[j] == "(":
                depth += 1
            elif sql[j] == ")":
                depth -= 1
                if depth == 0:
                    break
            elif sql[j] == "'":
                j = sql.index("'", j + 1)
            j += 1
        yield i, i + n, j
        i += n


def _split_args(text: str) -> list[str]:
    out, depth, cur, q = [], 0, [], False
    for ch in text:
        if ch == "'":
            q = not q
        if not q and ch in "([":
            depth += 1
        elif not q and ch in ")]":
            depth -= 1
        if ch == "," and depth == 0 and not q:
            out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    out.append("".join(cur))
    return out


def spark_semantics(sql: str) -> str:
    """Rewrite DuckDB calls whose result differs from Spark's: ``round(x, n)``
    becomes Spark's half-up rounding (``rnd``) and ``count_if`` is cast to
    BIGINT (DuckDB returns HUGEINT)."""
    for name in ("round", "count_if"):
        while True:
            spans = [s for s in _call_spans(sql, name)
                     if not (name == "round" and sql[s[1] + 1:].startswith("TRY_CAST("))
                     and not (name == "count_if" and sql[s[2] + 1:].startswith("::BIGINT"))]
            if not spans:
                break
            start, op, close = spans[-1]
            inner = sql[op + 1:close]
            if name == "round":
                args = _split_args(inner)
                new = rnd(args[0].strip(), int(args[1])) if len(args) == 2 else f"round({inner})"
                if new.startswith("round("):
                    new = f"round({inner})"
            else:
                new = f"(count_if({inner})::BIGINT)"
            sql = sql[:start] + new + sql[close + 1:]
    return sql


# --------------------------------------------------------------------------
# scalar expressions

def day_type(ts: str) -> str:
    hol = ", ".join(f"DATE '{x}'" for x in HOLIDAYS_2018)
    wrk = ", ".join(f"DATE '{x}'" for x in MAKEUP_WORKDAYS_2018)
    return (f"(CASE WHEN {ts} IS NULL THEN NULL WHEN {ts}::DATE IN ({hol}) THEN 2 "
            f"WHEN {ts}::DATE IN ({wrk}) THEN 0 WHEN isodow({ts}) IN (6, 7) THEN 1 ELSE 0 END)::INTEGER")


def hour_of(ts: str) -> str:
    return f"hour({ts})::INTEGER"


def rnd(x: str, digits: int) -> str:
    """Spark's ``round``: half-up on the shortest decimal text of the double
    (DuckDB's own ``round`` scales in binary first and can differ on ties)."""
    return f"coalesce(round(TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 27)), {digits})::DOUBLE, {x})"


def round5(x: str) -> str:
    return rnd(x, 5)


def meridian(lon_a: str, lon_b: str, lat_a: str | None = None, lat_b: str | None = None) -> str:
    x = f"acos(cos(radians({lon_a}) - radians({lon_b})))"
    out = f"(CASE WHEN {x} = 0 THEN {NAN} ELSE {d(EQUATOR_RADIUS_M)} * {x} END)"
    for lat in (lat_a, lat_b):
        if lat is not None:
            out = f"(CASE WHEN isnan({lat}) THEN {NAN} ELSE {out} END)"
    return out


def ellipsoid(la: str, oa: str, lb: str, ob: str) -> str:
    ra, rb = d(EQUATOR_RADIUS_M), d(POLAR_RADIUS_M)
    flatten = d((EQUATOR_RADIUS_M - POLAR_RADIUS_M) / EQUATOR_RADIUS_M)
    pa = f"atan({rb} / {ra} * tan(radians({la})))"
    pb = f"atan({rb} / {ra} * tan(radians({lb})))"
    s_p = f"sin(({pa} - {pb}) / 2)"
    s_l = f"sin((radians({oa}) - radians({ob})) / 2)"
    h = f"({s_p} * {s_p} + cos({pa}) * cos({pb}) * ({s_l} * {s_l}))"
    x = f"(2.0::DOUBLE * asin(sqrt({h})))"
    s_sum = f"(sin({pa}) + sin({pb}))"
    s_dif = f"(sin({pa}) - sin({pb}))"
    c1 = f"((sin({x}) - {x}) * ({s_sum} * {s_sum}) / (cos({x} / 2) * cos({x} / 2)))"
    c2 = f"((sin({x}) + {x}) * ({s_dif} * {s_dif}) / (sin({x} / 2) * sin({x} / 2)))"
    dr = f"({flatten} / 8 * ({c1} - {c2}))"
    bad = " OR ".join(f"{c} IS NULL OR isnan({c})" for c in (la, oa, lb, ob))
    return (f"(CASE WHEN {bad} THEN NULL::DOUBLE WHEN {la} = {lb} AND {oa} = {ob} THEN {d(1e-7)} "
            f"WHEN isnan({h}) OR {h} > 1 THEN {d(1e-7)} "
            f"WHEN {x} = 0 THEN {d(1e-7)} ELSE {ra} * ({x} + {dr}) END)")


def metric_root(h: str, h2: str, dd: str, dd2: str, lon: str, lon2: str, clamp: bool = False, digits: int = 6) -> str:
    gap = meridian(lon, lon2)
    s = (f"(abs({h} - {h2})::DOUBLE * abs({h} - {h2})::DOUBLE + abs({dd} - {dd2})::DOUBLE * abs({dd} - {dd2})::DOUBLE"
         f" + log10({gap} * {gap}))")
    neg = "0.0::DOUBLE" if clamp else NAN
    m = f"(CASE WHEN isnan({gap}) THEN {NAN} WHEN {s} < 0 THEN {neg} ELSE sqrt({s}) END)"
    return rnd(m, digits)


def metric_log(h: str, h2: str, dd: str, dd2: str, lon: str, lon2: str, digits: int = 6) -> str:
    gap = meridian(lon, lon2)
    dh2 = f"(abs({h} - {h2})::DOUBLE * abs({h} - {h2})::DOUBLE)"
    dd2s = f"(abs({dd} - {dd2})::DOUBLE * abs({dd} - {dd2})::DOUBLE)"
    m = (f"(CASE WHEN isnan({gap}) THEN {NAN} WHEN {dh2} = 0 OR {dd2s} = 0 THEN {NEG_INF} "
         f"ELSE log10({dh2}) + log10({dd2s}) + log10({gap} * {gap}) END)")
    return rnd(m, digits)


def metric_l2(lat: str, lat2: str, lon: str, lon2: str, h: str, h2: str, dd: str, dd2: str, digits: int | None = 9) -> str:
    m = (f"sqrt(({lat} - {lat2}) * ({lat} - {lat2}) + ({lon} - {lon2}) * ({lon} - {lon2})"
               f" + ({h} - {h2})::DOUBLE * ({h} - {h2})::DOUBLE + ({dd} - {dd2})::DOUBLE * ({dd} - {dd2})::DOUBLE)")
    return m if digits is None else rnd(m, digits)


def folded(a: str, x: str) -> str:
    """Degrees between two longitudes on the circle."""
    gap = f"(abs({a} - {x}) % {d(360.0)})"
    return f"least({gap}, {d(360.0)} - {gap})"


def score(dist: str) -> str:
    return f"({d(1.0)} / ({d(1.0)} + exp(({d(1000.0)} - {dist}) / {d(250.0)})))"


# --------------------------------------------------------------------------
# geohash, as layered sub-selects (intermediates as columns, as in Spark)

def _spread(x: str) -> str:
    for shift, mask in SPREAD_STEPS:
        x = f"(({x} | ({x} << {shift})) & {mask})"
    return x


def _compact(x: str) -> str:
    x = f"({x} & {EVEN_BITS})"
    for shift, mask in COMPACT_STEPS:
        x = f"(({x} | ({x} >> {shift})) & {mask})"
    return x


def _edge(idx: str, lo: float, span: float) -> str:
    return f"({d(lo)} + {idx}::DOUBLE * {d(span)} / {d(FULL)})"


def _rough(x: str, lo: float, span: float) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 0 ELSE "
            f"least(greatest(floor(({x} - {d(lo)}) / {d(span)} * {d(FULL)}), 0), {FULL - 1}) END)::BIGINT")


def _fix(x: str, r: str, lo: float, span: float) -> str:
    return (f"(CASE WHEN {r} > 0 AND {x} < {_edge(r, lo, span)} THEN {r} - 1 "
            f"WHEN {r} < {FULL - 1} AND {x} >= {_edge(f'({r} + 1)', lo, span)} THEN {r} + 1 ELSE {r} END)")


def geohash(src: str, lat: str, lon: str, out: str, precision: int = 12) -> str:
    """``SELECT *, <geohash> AS out FROM (src)``."""
    p = f"__gh_{out}_"
    s1 = f"SELECT *, {_rough(lat, -90.0, 180.0)} AS {p}ra, {_rough(lon, -180.0, 360.0)} AS {p}ro FROM ({src})"
    s2 = (f"SELECT *, {_fix(lat, p + 'ra', -90.0, 180.0)} AS {p}ia, {_fix(lon, p + 'ro', -180.0, 360.0)} AS {p}io "
          f"FROM ({s1})")
    s3 = f"SELECT *, (({_spread(p + 'io')} << 1) | {_spread(p + 'ia')}) AS {p}code FROM ({s2})"
    chars = ", ".join(
        f"substr('{GEOHASH_ALPHABET}', ((({p}code) >> {5 * (11 - i)}) & 31)::INTEGER + 1, 1)" for i in range(precision))
    s4 = (f"SELECT * EXCLUDE ({p}ra, {p}ro, {p}ia, {p}io, {p}code), "
          f"CASE WHEN {lat} IS NULL OR {lon} IS NULL THEN NULL ELSE concat({chars}) END AS {out} FROM ({s3})")
    return s4


def _code_indexes(src: str, code: str, p: str) -> str:
    s1 = f"SELECT *, rpad({code}, 12, '0') AS {p}pad FROM ({src})"
    digits = [f"instr('{GEOHASH_ALPHABET}', substr({p}pad, {i + 1}, 1))" for i in range(12)]
    valid = " AND ".join(f"{x} > 0" for x in digits) + f" AND length({code}) <= 12"
    value = " | ".join(f"(({x} - 1)::BIGINT << {5 * (11 - i)})" for i, x in enumerate(digits))
    s2 = f"SELECT *, CASE WHEN {valid} THEN ({value}) END AS {p}v FROM ({s1})"
    s3 = f"SELECT *, {_compact(f'({p}v >> 1)')} AS {p}io, {_compact(p + 'v')} AS {p}ia FROM ({s2})"
    return s3


def geohash_corner(src: str, code: str, lat_out: str, lon_out: str, lat_range: int = 90) -> str:
    p = f"__gd_{lat_out}_"
    s = _code_indexes(src, code, p)
    lat = f"CASE WHEN {p}ia = 0 THEN 0.0::DOUBLE ELSE {_edge(p + 'ia', -float(lat_range), 2.0 * lat_range)} END"
    lon = f"CASE WHEN {p}io = 0 THEN 0.0::DOUBLE ELSE {_edge(p + 'io', -180.0, 360.0)} END"
    return f"SELECT * EXCLUDE ({p}pad, {p}v, {p}io, {p}ia), {lat} AS {lat_out}, {lon} AS {lon_out} FROM ({s})"


def geohash_center(src: str, code: str, lat_out: str, lon_out: str) -> str:
    p = f"__gc_{lat_out}_"
    s = _code_indexes(src, code, p)
    nb = f"(length({code}) * 5)"
    lon_bits = f"ceil({nb} / 2)::INTEGER"
    lat_bits = f"floor({nb} / 2)::INTEGER"

    def centre(idx: str, bits: str, lo: float, span: float) -> str:
        i = f"floor({idx}::DOUBLE / pow({d(2.0)}, ({BITS} - {bits})::DOUBLE))"
        return f"({d(lo)} + ({i} + {d(0.5)}) * {d(span)} / pow({d(2.0)}, {bits}::DOUBLE))"

    return (f"SELECT * EXCLUDE ({p}pad, {p}v, {p}io, {p}ia), {centre(p + 'ia', lat_bits, -90.0, 180.0)} AS {lat_out}, "
            f"{centre(p + 'io', lon_bits, -180.0, 360.0)} AS {lon_out} FROM ({s})")


# --------------------------------------------------------------------------
# feature tables

def train_features(precision: int = 12, round_start: bool = False, src: str = "train") -> str:
    la = round5("start_lat") if round_start else "start_lat"
    lo = round5("start_lon") if round_start else "start_lon"
    base = (f"SELECT r_key AS nb_key, out_id, {la} AS start_lat, {lo} AS start_lon, "
            f"{round5('end_lat')} AS end_lat, {round5('end_lon')} AS end_lon, "
            f"{hour_of('start_time')} AS hour, {day_type('start_time')} AS type_of_day FROM {src}")
    return geohash(base, "end_lat", "end_lon", "class", precision)


def test_features(round_start: bool = True, src: str = "test") -> str:
    la = round5("start_lat") if round_start else "start_lat"
    lo = round5("start_lon") if round_start else "start_lon"
    return (f"SELECT r_key, out_id AS out_id2, {la} AS start_lat2, {lo} AS start_lon2, "
            f"end_lat AS end_lat2, end_lon AS end_lon2, {hour_of('start_time')} AS hour2, "
            f"{day_type('start_time')} AS type_of_day2 FROM {src}")
