"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every string reads only the pre-registered ``events`` view and derives the
same trips, features and predictions as the Spark plan, with the same
explicit NaN cases, rounding and tie-break keys.
"""

from __future__ import annotations

from tripcast.plans import sqltext as S

K = 10
SWEEP = (5, 10, 20, 30)

TRF12 = f"trf12 AS ({S.train_features(12, round_start=False)})"
TRF12Q = f"trf12q AS ({S.train_features(12, round_start=True)})"
TRF8 = f"trf8 AS ({S.train_features(8, round_start=False)})"
TEF_R = f"tef_r AS ({S.test_features(round_start=True)})"
TEF_RAW = f"tef_raw AS ({S.test_features(round_start=False)})"


def _q(*ctes: str, body: str) -> str:
    return S.with_ctes(*ctes, body=body)


# ------------------------------------------------------------------ SQL form kNN

ROOT_PAIRS = f"""root_pairs AS (
  SELECT a.r_key, b.class, b.nb_key, a.end_lat2, a.end_lon2,
         {S.metric_root('b.hour', 'a.hour2', 'b.type_of_day', 'a.type_of_day2', 'b.start_lon', 'a.start_lon2')} AS metric,
         {S.folded('b.start_lon', 'a.start_lon2')} AS gap_deg,
         ((b.hour - a.hour2)::DOUBLE * (b.hour - a.hour2)::DOUBLE
          + (b.type_of_day - a.type_of_day2)::DOUBLE * (b.type_of_day - a.type_of_day2)::DOUBLE) AS dt2
  FROM tef_r a JOIN trf12 b ON a.out_id2 = b.out_id),
root_keys AS (
  SELECT * EXCLUDE (gap_deg), CASE WHEN isnan(metric) THEN 'Infinity'::DOUBLE ELSE dt2 + 2.0::DOUBLE * log10(gap_deg) END AS s,
         CASE WHEN isnan(metric) THEN 0.0::DOUBLE ELSE gap_deg END AS gap_deg FROM root_pairs)"""
ROOT_KEPT = f"""root_kept AS (
  SELECT *, (rank() OVER (PARTITION BY r_key ORDER BY s, gap_deg))::INTEGER AS pos FROM root_keys
  QUALIFY pos <= {K})"""
ROOT_WIN = """root_win AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r_key, class) AS votes FROM root_kept)
  QUALIFY row_number() OVER (PARTITION BY r_key ORDER BY s, gap_deg, votes DESC, class) = 1)"""
NEAREST_CTES = (TRF12, TEF_R, ROOT_PAIRS, ROOT_KEPT, ROOT_WIN)


def _results(src: str, type_sql: str, k: int = K) -> str:
    """Result rows from ``src`` (r_key, lat, lon, end_lat2, end_lon2)."""
    dis = S.meridian("lon", "end_lon2", "lat", "end_lat2")
    valid = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("end_lat2", "end_lon2", "lat", "lon", "dis"))
    return (f"SELECT r_key, lat, lon, dis, {type_sql} AS type, {k}::INTEGER AS k FROM "
            f"(SELECT *, {dis} AS dis FROM ({src})) WHERE {valid}")


NEAREST_RESULTS = "nearest_results AS (" + _results(
    S.geohash_corner("SELECT r_key, class, end_lat2, end_lon2 FROM root_win", "class", "lat", "lon", 90),
    "NULL::VARCHAR") + ")"

# ------------------------------------------------------------------ queue form

QUEUE_PAIRS = f"""queue_pairs AS (
  SELECT a.r_key, a.end_lat2, a.end_lon2, b.end_lat AS dest_lat, b.end_lon AS dest_lon,
         isnan({S.meridian('a.start_lon2', 'b.start_lon')}) AS lost,
         {S.folded('b.start_lon', 'a.start_lon2')} AS gap_deg,
         abs(a.hour2 - b.hour)::DOUBLE * abs(a.type_of_day2 - b.type_of_day)::DOUBLE AS dt
  FROM tef_raw a JOIN trf12q b ON a.out_id2 = b.out_id)"""
QUEUE_KEPT = f"""queue_kept AS (
  SELECT *, row_number() OVER (PARTITION BY r_key ORDER BY lost,
           CASE WHEN lost THEN 0 ELSE dt * gap_deg END, CASE WHEN lost THEN 0 ELSE gap_deg END, dest_lat, dest_lon) AS rn
  FROM queue_pairs
  QUALIFY rn <= {K})"""
KTH_RESULTS = "kth_results AS (" + _results(
    "SELECT r_key, dest_lat AS lat, dest_lon AS lon, end_lat2, end_lon2 FROM queue_kept "
    "QUALIFY row_number() OVER (PARTITION BY r_key ORDER BY rn DESC) = 1", "'queue'") + ")"
VOTED_RESULTS = "voted_results AS (" + _results(
    "SELECT r_key, dest_lat AS lat, dest_lon AS lon, end_lat2, end_lon2 FROM ("
    "SELECT r_key, dest_lat, dest_lon, count(*) AS votes, min(rn) AS first_rn, first(end_lat2) AS end_lat2, "
    "first(end_lon2) AS end_lon2 FROM queue_kept GROUP BY r_key, dest_lat, dest_lon) "
    "QUALIFY row_number() OVER (PARTITION BY r_key ORDER BY votes DESC, first_rn) = 1", "'queue_voted'") + ")"
QUEUE_CTES = (TRF12Q, TEF_RAW, QUEUE_PAIRS, QUEUE_KEPT)

# ------------------------------------------------------------------ weighted vote


def _weighted_ctes(ks) -> tuple[str, ...]:
    values = ", ".join(f"({k})" for k in ks)
    pairs = f"""w_pairs AS (
  SELECT a.r_key, b.class, b.nb_key, a.end_lat2, a.end_lon2,
         {S.metric_l2('a.start_lat2', 'b.start_lat', 'a.start_lon2', 'b.start_lon', 'a.hour2', 'b.hour',
                      'a.type_of_day2', 'b.type_of_day', digits=None)} AS metric
  FROM tef_raw a JOIN trf8 b ON a.out_id2 = b.out_id)"""
    ranked = f"""w_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r_key ORDER BY metric, class, nb_key) AS rn FROM w_pairs
  QUALIFY rn <= {max(ks)})"""
    per_k = f"""w_k AS (
  SELECT r.*, kk.k, max(CASE WHEN r.metric = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.r_key, kk.k) AS has_zero
  FROM w_ranked r JOIN (VALUES {values}) kk(k) ON r.rn <= kk.k)"""
    sums = """w_sum AS (
  SELECT r_key, k, class,
         round(sum(CASE WHEN has_zero = 1 THEN (CASE WHEN metric = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                        ELSE 1.0::DOUBLE / metric END), 6) AS wsum,
         first(end_lat2) AS end_lat, first(end_lon2) AS end_lon
  FROM w_k GROUP BY r_key, k, class)"""
    win = "w_win AS (SELECT * FROM w_sum QUALIFY row_number() OVER (PARTITION BY r_key, k ORDER BY wsum DESC, class) = 1)"
    pred = ("w_pred AS (SELECT r_key, end_lat, end_lon, end_lat_pre, end_lon_pre, k::INTEGER AS k FROM ("
            + S.geohash_center("SELECT * FROM w_win", "class", "end_lat_pre", "end_lon_pre") + "))")
    return (TRF8, TEF_RAW, pairs, ranked, per_k, sums, win, pred)


# ------------------------------------------------------------------ naive Bayes

NB_MODEL = f"""nb_rows AS (
  SELECT out_id, round(end_lat, 5) AS label_lat, round(end_lon, 5) AS label_lon,
         {S.hour_of('start_time')} AS hour, {S.day_type('start_time')} AS type_of_day, start_lat, start_lon
  FROM train),
nb_agg AS (
  SELECT out_id, label_lat, label_lon, count(*) AS n, sum(hour::DOUBLE) AS s_hour,
         sum(type_of_day::DOUBLE) AS s_type_of_day, sum(start_lat) AS s_start_lat, sum(start_lon) AS s_start_lon
  FROM nb_rows GROUP BY out_id, label_lat, label_lon),
nb_model AS (
  SELECT out_id, label_lat, label_lon, n,
         ln(n + 1.0::DOUBLE) - ln(sum(n) OVER (PARTITION BY out_id) + count(*) OVER (PARTITION BY out_id) * 1.0::DOUBLE) AS pi,
         ln(s_hour + 1.0::DOUBLE) - ln(s_hour + s_type_of_day + s_start_lat + s_start_lon + 4.0::DOUBLE * 1.0::DOUBLE) AS theta_hour,
         ln(s_type_of_day + 1.0::DOUBLE) - ln(s_hour + s_type_of_day + s_start_lat + s_start_lon + 4.0::DOUBLE * 1.0::DOUBLE) AS theta_type_of_day,
         ln(s_start_lat + 1.0::DOUBLE) - ln(s_hour + s_type_of_day + s_start_lat + s_start_lon + 4.0::DOUBLE * 1.0::DOUBLE) AS theta_start_lat,
         ln(s_start_lon + 1.0::DOUBLE) - ln(s_hour + s_type_of_day + s_start_lat + s_start_lon + 4.0::DOUBLE * 1.0::DOUBLE) AS theta_start_lon
  FROM nb_agg)"""
NB_RESULTS = "nb_results AS (" + _results(
    "SELECT r_key, label_lat AS lat, label_lon AS lon, end_lat2, end_lon2 FROM ("
    "SELECT a.r_key, a.end_lat2, a.end_lon2, m.label_lat, m.label_lon, "
    "round(m.pi + a.hour2::DOUBLE * m.theta_hour + a.type_of_day2::DOUBLE * m.theta_type_of_day "
    "+ a.start_lat2 * m.theta_start_lat + a.start_lon2 * m.theta_start_lon, 9) AS score "
    "FROM tef_r a JOIN nb_model m ON a.out_id2 = m.out_id) "
    "QUALIFY row_number() OVER (PARTITION BY r_key ORDER BY score DESC, label_lat, label_lon) = 1", "'bayes_m'") + ")"

ALL_RESULTS_CTES = (TRF12, TEF_R, ROOT_PAIRS, ROOT_KEPT, ROOT_WIN, NEAREST_RESULTS,
                    TRF12Q, TEF_RAW, QUEUE_PAIRS, QUEUE_KEPT, KTH_RESULTS, VOTED_RESULTS, NB_MODEL, NB_RESULTS,
                    """all_results AS (
  SELECT * FROM nearest_results UNION ALL SELECT * FROM kth_results
  UNION ALL SELECT * FROM voted_results UNION ALL SELECT * FROM nb_results)""")

# ------------------------------------------------------------------ consecutive trip pairs

CONSECUTIVE = f"""cp AS (
  SELECT * FROM (
    SELECT r_key, start_lat, start_lon, {S.hour_of('start_time')} AS hour, {S.day_type('start_time')} AS type_of_day,
           lead(r_key) OVER w AS next_r_key, lead(start_lat) OVER w AS next_start_lat,
           lead(start_lon) OVER w AS next_start_lon, lead(start_time) OVER w AS next_start_time
    FROM trips WINDOW w AS (PARTITION BY out_id ORDER BY start_time, r_key))
  WHERE next_r_key IS NOT NULL),
cpf AS (SELECT *, {S.hour_of('next_start_time')} AS next_hour, {S.day_type('next_start_time')} AS next_type_of_day FROM cp)"""

GH_BOTH_12 = "gh12 AS (" + S.geohash(S.geohash("SELECT r_key, start_lat, start_lon, end_lat, end_lon FROM trips",
                                               "start_lat", "start_lon", "start_code", 12),
                                      "end_lat", "end_lon", "end_code", 12) + ")"
GH_BOTH_8 = "gh8 AS (" + S.geohash(S.geohash("SELECT r_key, start_lat, start_lon, end_lat, end_lon FROM trips",
                                             "start_lat", "start_lon", "start_code", 8),
                                    "end_lat", "end_lon", "end_code", 8) + ")"

ELL_TRIPS = S.ellipsoid("start_lat", "start_lon", "end_lat", "end_lon")


def _fn_sql() -> str:
    both = ("SELECT r_key, start_time, start_lat, start_lon, round(end_lat, 5) AS end_lat, round(end_lon, 5) AS end_lon, "
            "lead(start_time) OVER w AS next_start_time, lead(start_lon) OVER w AS next_start_lon FROM trips "
            "WINDOW w AS (PARTITION BY out_id ORDER BY start_time, r_key)")
    dec = S.geohash_corner(S.geohash(both, "end_lat", "end_lon", "class", 12), "class", "lat", "lon", 90)
    gap = S.meridian("start_lon", "end_lon", "start_lat", "end_lat")
    hh, dt = S.hour_of("start_time"), S.day_type("start_time")
    calc = S.metric_root(hh, S.hour_of("next_start_time"), dt, S.day_type("next_start_time"), "start_lon", "next_start_lon")
    return (f"SELECT r_key, {hh} AS hour, {dt} AS type_of_day, "
            f"CASE WHEN isnan({gap}) THEN NULL ELSE round({gap}, 1) END AS gap, "
            f"CASE WHEN next_start_lon IS NULL OR isnan({calc}) THEN NULL ELSE {calc} END AS metric, lat, lon FROM ({dec})")


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    # the same results from another layout
    return found | {f"{name}_stored": found[name] for name in ("candidate_pairs", "nb_model")}


def _oracle_sql() -> dict[str, str]:
    w_all = _weighted_ctes(SWEEP)
    w_10 = _weighted_ctes((K,))
    busiest = "(SELECT out_id FROM trips GROUP BY out_id ORDER BY count(*) DESC, out_id LIMIT 1)"
    return {
        "split_train": _q(body="SELECT * FROM train"),
        "split_test": _q(body="SELECT * FROM test"),
        "split_sizes": _q(body=(
            f"SELECT count(*) AS n_rows, count_if(start_time < TIMESTAMP '{S.SPLIT_CUTOFF}') AS n_train, "
            f"count_if(start_time >= TIMESTAMP '{S.SPLIT_CUTOFF}') AS n_test, 8::INTEGER AS n_cols, "
            "7::INTEGER AS n_test_cols FROM trips")),
        "trip_features": _q(TRF12, body="SELECT * FROM trf12"),
        "test_features": _q(TEF_R, body="SELECT * FROM tef_r"),
        "trips_of_person": _q(body=f"SELECT * FROM trips WHERE out_id = {busiest}"),
        "valid_results": _q(body=(
            f"SELECT r_key, round(gap, 1) AS gap FROM (SELECT r_key, {S.meridian('start_lon', 'end_lon')} AS gap "
            "FROM trips) WHERE gap IS NOT NULL AND NOT isnan(gap)")),
        "sql_view_counts": _q(body=(
            "SELECT 'trip_record' AS view_name, count(*) AS n FROM train "
            "UNION ALL SELECT 'test_record' AS view_name, count(*) AS n FROM test")),
        "hour_of_day": _q(body=f"SELECT r_key, start_time, {S.hour_of('start_time')} AS hour FROM trips"),
        "day_type": _q(body=f"SELECT r_key, start_time, {S.day_type('start_time')} AS type_of_day FROM trips"),
        "round_coords": _q(body=(
            "SELECT r_key, round((start_lat + end_lat) / 2, 5) AS mid_lat, "
            "round((start_lon + end_lon) / 2, 5) AS mid_lon FROM trips")),
        "distance_ellipsoid": _q(body=f"SELECT r_key, round({ELL_TRIPS}, 1) AS dis FROM trips"),
        "distance_meridian_gap": _q(body=(
            "SELECT r_key, isnan(g) AS is_nan, CASE WHEN isnan(g) THEN NULL ELSE round(g, 1) END AS gap FROM ("
            f"SELECT r_key, {S.meridian('start_lon', 'end_lon', 'start_lat', 'end_lat')} AS g FROM trips)")),
        "pair_metric_root": _q(CONSECUTIVE, body=(
            f"SELECT r_key, next_r_key, {S.metric_root('next_hour', 'hour', 'next_type_of_day', 'type_of_day', 'next_start_lon', 'start_lon')} AS metric FROM cpf")),
        "pair_metric_log": _q(CONSECUTIVE, body=(
            f"SELECT r_key, next_r_key, {S.metric_log('hour', 'next_hour', 'type_of_day', 'next_type_of_day', 'start_lon', 'next_start_lon')} AS metric FROM cpf")),
        "pair_metric_l2": _q(CONSECUTIVE, body=(
            f"SELECT r_key, next_r_key, {S.metric_l2('start_lat', 'next_start_lat', 'start_lon', 'next_start_lon', 'hour', 'next_hour', 'type_of_day', 'next_type_of_day')} AS metric FROM cpf")),
        "pack_unpack_location": _q(body=(
            "SELECT r_key, packed, round(packed / 1e8::DOUBLE, 5) AS lat, round(packed % 1e3::DOUBLE, 5) AS lon FROM ("
            "SELECT r_key, round(end_lat, 5) * 1e8::DOUBLE + round(end_lon, 5) AS packed FROM trips)")),
        "geohash_encode_12": _q(GH_BOTH_12, body="SELECT r_key, start_code, end_code FROM gh12"),
        "geohash_encode_8": _q(GH_BOTH_8, body="SELECT r_key, start_code, end_code FROM gh8"),
        "geohash_decode_corner": _q(GH_BOTH_12, body="SELECT r_key, end_code, lat, lon FROM ("
                                    + S.geohash_corner("SELECT * FROM gh12", "end_code", "lat", "lon", 90) + ")"),
        "geohash_decode_wide": _q(GH_BOTH_12, body="SELECT r_key, end_code, lat, lon FROM ("
                                  + S.geohash_corner("SELECT * FROM gh12", "end_code", "lat", "lon", 180) + ")"),
        "geohash_decode_center": _q(GH_BOTH_8, body="SELECT r_key, end_code, lat, lon FROM ("
                                    + S.geohash_center("SELECT * FROM gh8", "end_code", "lat", "lon") + ")"),
        "trip_score": _q(body=f"SELECT r_key, round({S.score(ELL_TRIPS)}, 6) AS score FROM trips"),
        "candidate_pairs": _q(TEF_R, body=(
            "SELECT a.r_key, b.out_id, b.n_candidates FROM tef_r a JOIN "
            "(SELECT out_id, count(*) AS n_candidates FROM train GROUP BY out_id) b ON a.out_id2 = b.out_id")),
        "candidate_pairs_broadcast": _q(TEF_R, body=(
            "SELECT a.r_key, b.out_id, b.n_candidates FROM tef_r a JOIN "
            "(SELECT out_id, count(*) AS n_candidates FROM train GROUP BY out_id) b ON a.out_id2 = b.out_id")),
        "attach_truth": _q(*NEAREST_CTES, body=(
            "SELECT w.r_key, w.class, t.end_lat, t.end_lon FROM root_win w JOIN "
            "(SELECT r_key, end_lat, end_lon FROM test "
            "QUALIFY row_number() OVER (PARTITION BY r_key ORDER BY end_lat, end_lon) = 1) t ON w.r_key = t.r_key")),
        "neighbours_ranked": _q(TRF12, TEF_R, ROOT_PAIRS, ROOT_KEPT,
                                body="SELECT r_key, nb_key, class, metric, pos FROM root_kept"),
        "neighbour_votes": _q(TRF12, TEF_R, ROOT_PAIRS, ROOT_KEPT,
                              body="SELECT r_key, class, count(*) AS votes FROM root_kept GROUP BY r_key, class"),
        "knn_nearest_vote": _q(*NEAREST_CTES, NEAREST_RESULTS,
                               body="SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM nearest_results"),
        "knn_kth": _q(*QUEUE_CTES, KTH_RESULTS,
                      body="SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM kth_results"),
        "knn_voted": _q(*QUEUE_CTES, VOTED_RESULTS,
                        body="SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM voted_results"),
        "knn_weighted": _q(*w_10, body="SELECT * FROM w_pred"),
        "knn_sweep": _q(*w_all, body="SELECT * FROM w_pred"),
        "shuffled_trips": _q(body="SELECT * FROM trips"),
        "nb_model": _q(NB_MODEL, body=(
            "SELECT out_id, label_lat, label_lon, n, round(pi, 9) AS pi, round(theta_hour, 9) AS theta_hour, "
            "round(theta_type_of_day, 9) AS theta_type_of_day, round(theta_start_lat, 9) AS theta_start_lat, "
            "round(theta_start_lon, 9) AS theta_start_lon FROM nb_model")),
        "nb_predict": _q(TEF_R, NB_MODEL, NB_RESULTS,
                         body="SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM nb_results"),
        "evaluate_by_k": _q(*w_all, body=(
            "SELECT k, count(*) AS n, count(*) - count(dis) AS invalid_count, round(avg(dis), 3) AS mean_dis, "
            f"round(avg({S.score('dis')}), 6) AS mean_score, count_if(dis < 500) AS lt_500_count, "
            "round(count_if(dis < 500) / count(dis), 6) AS lt_500_share, round(max(dis), 1) AS max_dis, "
            "round(count(*) / (SELECT count(*) FROM tef_raw), 6) AS coverage FROM ("
            f"SELECT *, {S.ellipsoid('end_lat', 'end_lon', 'end_lat_pre', 'end_lon_pre')} AS dis FROM w_pred) "
            "GROUP BY k")),
        "evaluate_buckets": _q(*ALL_RESULTS_CTES, body=(
            f"SELECT type, k, count(*) AS n, round(avg({S.score('dis')}), 6) AS mean_score, "
            "count_if(dis <= 100) AS le_100, count_if(dis <= 200) AS le_200, count_if(dis <= 500) AS le_500, "
            "count_if(dis <= 1000) AS le_1000, count_if(dis > 1000) AS gt_1000 FROM all_results GROUP BY type, k")),
        "distinct_persons": _q(body="SELECT DISTINCT out_id FROM test"),
        "trips_per_person": _q(body="SELECT out_id, count(*) AS n_trips FROM test GROUP BY out_id"),
        "sql_function_names": _q(body=_fn_sql()),
        "csv_trips_roundtrip": _q(body="SELECT * FROM trips"),
        "split_roundtrip": _q(body=(
            "SELECT * EXCLUDE (end_time), 'train' AS side FROM train UNION ALL SELECT *, 'test' AS side FROM test")),
        "prediction_file_roundtrip": _q(*w_all, body="SELECT * FROM w_pred"),
        "results_roundtrip": _q(*ALL_RESULTS_CTES, body=(
            "SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM all_results")),
        "prediction_table_roundtrip": _q(*w_all, body=(
            "SELECT t.*, w.class AS predict, w.k::INTEGER AS k FROM ("
            + S.geohash(f"SELECT *, {S.hour_of('start_time')} AS period, {S.day_type('start_time')} AS week_code FROM test",
                        "start_lat", "start_lon", "start_code", 8) + ") t JOIN w_win w ON t.r_key = w.r_key")),
        "csv_quarantine": _q(body="SELECT r_key, r_key % 50 = 0 AS set_aside FROM trips"),
        "results_rerun": _q(TEF_R, *QUEUE_CTES, KTH_RESULTS, NB_MODEL, NB_RESULTS, body=(
            "SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM "
            "(SELECT * FROM nb_results UNION ALL SELECT * FROM kth_results)")),
        "results_for_run": _q(*ALL_RESULTS_CTES, body=(
            f"SELECT r_key, lat, lon, round(dis, 1) AS dis, type, k FROM all_results WHERE k = {K} AND type IS NULL")),
    }
