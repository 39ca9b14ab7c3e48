"""DuckDB SQL for profiles, validation, ingestion, merges, runs, health, KPIs and slices."""

from __future__ import annotations

from checks.oracle_base import AS_OF, CTES, IN10, TODAY, VALID, R, big, initcap, pct, strip, title
from checks.oracle_views import LATE, N, ONT, hourly_refresh, routes, since, st

EARLY, LATE_DAY = "TIMESTAMP '2024-01-20'", "TIMESTAMP '2024-01-15'"

BUCKET_EXACT = """CASE WHEN coalesce(delay_minutes, 0) = 0 THEN 'on_time' WHEN delay_minutes <= 15 THEN 'minor_delay'
  WHEN delay_minutes <= 60 THEN 'moderate_delay' WHEN delay_minutes <= 180 THEN 'major_delay' ELSE 'severe_delay' END"""
BUCKET = BUCKET_EXACT
PHASE = """CASE WHEN coalesce(altitude, 0) < 1000 THEN 'ground' WHEN altitude < 15000 THEN 'climbing'
  WHEN altitude < 32000 THEN 'mid_altitude' ELSE 'cruise' END"""
REGION = """CASE WHEN latitude BETWEEN 8 AND 37 AND longitude BETWEEN 68 AND 97 THEN 'India' WHEN latitude >= 35 THEN 'Europe_Asia'
  WHEN latitude <= 0 THEN 'Southern' ELSE 'Middle_East_SE_Asia' END"""
ABROAD10 = f"NOT (coalesce(upper(source_airport) IN {IN10}, FALSE) AND coalesce(upper(dest_airport) IN {IN10}, FALSE))"

MORE: dict[str, str] = {}

MORE["clean_warehouse"] = f"""
SELECT * REPLACE (trim({initcap('airline')}) AS airline, upper(trim(airline_iata)) AS airline_iata,
    upper(trim(source_airport)) AS source_airport, upper(trim(dest_airport)) AS dest_airport,
    coalesce(latitude, 0) AS latitude, coalesce(longitude, 0) AS longitude,
    CAST(greatest(coalesce(altitude, 0), 0) AS BIGINT) AS altitude,
    CAST(greatest(least(coalesce(speed, 0), 1200), 0) AS DOUBLE) AS speed,
    lower(coalesce(status, 'unknown')) AS status, CAST(greatest(coalesce(delay_minutes, 0), 0) AS BIGINT) AS delay_minutes),
  {ABROAD10} AS is_international, {BUCKET_EXACT} AS delay_bucket, {PHASE} AS flight_phase, {REGION} AS region,
  (latitude IS NULL OR longitude IS NULL OR source_airport IN ('???', '') OR coalesce(altitude < 0, FALSE)
    OR coalesce(speed < 0, FALSE)) AS data_quality_flag, {AS_OF} AS transformed_at
FROM d1 WHERE flight_id IS NOT NULL AND event_timestamp IS NOT NULL"""

MORE["clean_scheduled"] = f"""
SELECT *, {ABROAD10} AS is_international, {BUCKET} AS delay_bucket, {PHASE} AS flight_phase, {REGION} AS region,
  (latitude IS NULL OR longitude IS NULL OR (speed = 0 AND status = 'active') OR source_airport = '???') AS data_quality_flag,
  {AS_OF} AS transformed_at
FROM (SELECT * REPLACE ({title(strip('airline'))} AS airline, upper({strip('airline_iata')}) AS airline_iata,
    upper({strip('source_airport')}) AS source_airport, upper({strip('dest_airport')}) AS dest_airport,
    lower({strip('status')}) AS status, CAST(least(greatest(coalesce(altitude, 0), 0), 60000) AS BIGINT) AS altitude,
    CAST(least(greatest(coalesce(speed, 0), 0), 1200) AS DOUBLE) AS speed,
    CAST(greatest(coalesce(delay_minutes, 0), 0) AS BIGINT) AS delay_minutes) FROM d1)"""

MORE["clean_quick_load"] = f"""
SELECT * REPLACE ({initcap('trim(airline)')} AS airline, upper(trim(coalesce(airline_iata, ''))) AS airline_iata,
    upper(trim(source_airport)) AS source_airport, upper(trim(dest_airport)) AS dest_airport,
    coalesce(latitude, 0) AS latitude, coalesce(longitude, 0) AS longitude,
    CAST(greatest(coalesce(altitude, 0), 0) AS BIGINT) AS altitude,
    CAST(greatest(least(coalesce(speed, 0), 1200), 0) AS DOUBLE) AS speed,
    lower(coalesce(status, 'active')) AS status, CAST(greatest(coalesce(delay_minutes, 0), 0) AS BIGINT) AS delay_minutes,
    coalesce(source, 'simulator') AS source, {AS_OF} AS event_timestamp),
  {ABROAD10} AS is_international, {BUCKET_EXACT} AS delay_bucket, {PHASE} AS flight_phase, {REGION} AS region,
  upper(trim(source_airport)) || '→' || upper(trim(dest_airport)) AS route_key, FALSE AS data_quality_flag,
  {AS_OF} AS transformed_at
FROM raw"""

MORE["clean_layer"] = "SELECT * EXCLUDE (event_hour, day_of_week, transformer_version) FROM clean"
MORE["transform_report"] = f"""SELECT {N} AS records_in, {N} AS records_out, count(*) FILTER (WHERE data_quality_flag) AS records_flagged,
  {pct('count(*) FILTER (WHERE data_quality_flag)', N, 2)} AS flag_rate_pct FROM clean"""
MORE["dedup_report"] = f"""
SELECT o AS original, o - x AS exact_duplicates_removed, x - f AS fuzzy_duplicates_removed, f AS final_count,
       o - f AS total_removed, {pct('o - f', 'o', 2)} AS dedup_rate_pct
FROM (SELECT (SELECT count(*) FROM raw) AS o, (SELECT count(*) FROM d1) AS x, (SELECT count(*) FROM d2) AS f)"""
CTES["dups"] = "SELECT event_id AS k, count(*) AS copies, min(loaded_at) AS first_seen_at FROM raw GROUP BY event_id HAVING count(*) > 1"
MORE["duplicate_events"] = "SELECT raw.*, copies, first_seen_at FROM raw JOIN dups ON event_id = k"
MORE["duplicate_events_log"] = """SELECT event_id, flight_id, first_seen_at, loaded_at AS duplicate_seen_at, source
FROM raw JOIN dups ON event_id = k"""

# --- validation
REQUIRED = ["flight_id", "source_airport", "dest_airport", "latitude", "longitude", "event_timestamp"]
AIRPORT = "'^[A-Z]{2,4}$'"


def validation(source: str) -> str:
    bad = [
        ("required_fields_present", "error", 0.05, " OR ".join(f"{c} IS NULL" for c in REQUIRED), "miss a required field"),
        ("coordinate_bounds_valid", "error", 0.05, "latitude IS NULL OR longitude IS NULL OR abs(latitude) > 90 OR abs(longitude) > 180",
         "have no valid coordinates"),
        ("altitude_in_valid_range", "warning", 0.10, "altitude < 0 OR altitude > 60000", "have an altitude out of range"),
        ("speed_in_valid_range", "warning", 0.10, "speed < 0 OR speed > 1200", "have a speed out of range"),
        ("status_is_valid_enum", "error", 0.05, f"coalesce(status NOT IN {VALID}, TRUE)", "have an unknown status"),
        ("timestamp_is_fresh", "warning", 0.10,
         f"event_timestamp IS NULL OR event_timestamp > {AS_OF} OR event_timestamp < {AS_OF} - INTERVAL 24 HOUR",
         "are stale or in the future"),
        ("airport_code_format_valid", "error", 0.05, None, "have a malformed airport code"),
        ("no_duplicate_event_ids", "error", 0.0, None, "share an event id"),
        ("no_route_self_loop", "warning", 0.10, "source_airport = dest_airport", "have equal source and destination"),
        ("speed_altitude_consistent", "warning", 0.10, "coalesce(altitude, 0) < 500 AND coalesce(speed, 0) > 400",
         "are fast at ground level"),
    ]
    airport = lambda c: f"(SELECT count(*) FROM {source} WHERE coalesce(NOT regexp_matches({c}, {AIRPORT}), TRUE))"
    src, dst = airport("source_airport"), airport("dest_airport")
    total = f"(SELECT count(*) FROM {source})"
    special = {
        "airport_code_format_valid": f"CASE WHEN {src} > 0.05 * {total} THEN {src} WHEN {dst} > 0.05 * {total} THEN {dst} ELSE 0 END",
        "no_duplicate_event_ids": f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {source} GROUP BY event_id) WHERE n > 1)",
    }
    rows = []
    for i, (name, severity, limit, cond, problem) in enumerate(bad, 1):
        count = special.get(name) or f"(SELECT count(*) FROM {source} WHERE {cond})"
        rows.append(f"SELECT {i} AS position, '{name}' AS rule_name, '{severity}' AS severity, {limit}::DOUBLE AS lim, "
                    f"CAST({count} AS BIGINT) AS affected_count, '{problem}' AS problem")
    return f"""
SELECT position, rule_name, affected_count / t <= lim AS passed, severity, affected_count, affected_count / t AS affected_pct,
       affected_count || ' records ' || problem AS message, CAST(t AS BIGINT) AS total_records
FROM ({' UNION ALL '.join(rows)}), (SELECT count(*) AS t FROM {source})"""


CTES["v_raw"] = validation("raw")
MORE["validation_raw"] = "SELECT * FROM v_raw"
MORE["validation_clean"] = validation("clean")
MORE["validation_summary"] = f"""
SELECT max(total_records) AS total_records, {N} AS checks_run, count(*) FILTER (WHERE passed) AS checks_passed,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') AS checks_failed,
  count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS checks_warned,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS is_healthy,
  {pct('count(*) FILTER (WHERE passed)', N, 2)} AS pass_rate_pct FROM v_raw"""
MISSING = " OR ".join(f"{c} IS NULL" for c in REQUIRED)
MORE["validation_samples"] = f"""
SELECT rule_name, value, CAST(row_number() OVER (PARTITION BY rule_name ORDER BY value NULLS LAST) AS INTEGER) AS sample_rank
FROM (SELECT 'required_fields_present' AS rule_name, flight_id AS value FROM raw
        WHERE {MISSING}
      UNION ALL SELECT DISTINCT 'status_is_valid_enum', status FROM raw WHERE status NOT IN {VALID}
      UNION ALL SELECT 'no_route_self_loop', source_airport FROM raw WHERE source_airport = dest_airport
      UNION ALL SELECT 'no_duplicate_event_ids', event_id FROM raw WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1
      UNION ALL SELECT 'coordinate_bounds_valid', '{{' || concat_ws(',', '"flight_id":"' || flight_id || '"', '"latitude":' || latitude, '"longitude":' || longitude) || '}}'
        FROM raw WHERE latitude IS NULL OR longitude IS NULL OR latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180)
QUALIFY sample_rank <= 5"""

CODES = [("flight_id", "s"), ("source_airport", "s"), ("dest_airport", "s"), ("latitude", "n"), ("longitude", "n"), ("status", "s")]
ERRORS = "list_filter([" + ", ".join(
    [f"CASE WHEN {c} IS NULL{' OR ' + c + chr(32) + '= ' + chr(39) * 2 if k == 's' else ''} THEN 'missing_{c}' END" for c, k in CODES]
    + [f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}_out_of_range' END" for c, lo, hi in
       [("altitude", 0, 60000), ("speed", 0, 1200), ("latitude", -90, 90), ("longitude", -180, 180)]]
    + [f"CASE WHEN coalesce(status NOT IN {VALID}, TRUE) THEN 'invalid_status' END"]) + "], lambda x: x IS NOT NULL)"
CTES["rawe"] = f"SELECT *, {ERRORS} AS errors FROM raw"
MORE["row_errors"] = "SELECT event_id, loaded_at, array_to_string(errors, ',') AS errors FROM rawe"
MORE["error_breakdown"] = "SELECT error, count(*) AS occurrences FROM (SELECT unnest(errors) AS error FROM rawe) GROUP BY error"
MORE["quality_gate"] = f"""
SELECT t AS total_records, t - b AS valid_count, b AS invalid_count, {R('b / t', 4)} AS fail_rate, t >= 1 AND {R('b / t', 4)} <= 0.05 AS load_allowed
FROM (SELECT count(*) AS t, count(*) FILTER (WHERE len(errors) > 0) AS b FROM rawe)"""


def suite(source: str) -> str:
    rows: list[tuple[str, str, str]] = []
    for c in ["event_id", "flight_id", "airline", "airline_iata", "source_airport", "dest_airport", "latitude",
              "longitude", "altitude", "speed", "status", "event_timestamp"]:
        rows.append(("schema", c, "count(*) >= 0"))
    mostly = lambda good, c, m: f"coalesce(count(*) FILTER (WHERE {good}) / nullif(count({c}), 0) >= {m}, TRUE)"
    rows += [("not_null_critical", c, f"count({c}) = count(*)") for c in ("event_id", "flight_id", "event_timestamp")]
    rows += [("not_null_95pct", c, f"count({c}) >= 0.95 * count(*)") for c in ("source_airport", "dest_airport", "latitude", "longitude")]
    for c, cond, m in [("altitude", "altitude BETWEEN 0 AND 60000", 0.95), ("speed", "speed BETWEEN 0 AND 1200", 0.95),
                       ("latitude", "latitude BETWEEN -90 AND 90", 0.99), ("longitude", "longitude BETWEEN -180 AND 180", 0.99),
                       ("delay_minutes", "delay_minutes >= 0", 0.99)]:
        rows.append(("range", c, mostly(cond, c, m)))
    rows.append(("enum", "status", mostly(f"status IN {VALID}", "status", 0.95)))
    rows.append(("unique", "event_id", "count(event_id) = count(DISTINCT event_id)"))
    for c in ("source_airport", "dest_airport"):
        rows.append(("format", c, mostly(f"regexp_matches({c}, {AIRPORT})", c, 0.95)))
    rows.append(("format", "airline_iata", mostly("regexp_matches(airline_iata, '^[A-Z0-9]{2}$')", "airline_iata", 0.95)))
    rows.append(("statistical", "speed_mean", "avg(speed) BETWEEN 50 AND 950"))
    rows.append(("statistical", "altitude_max", "max(altitude) >= 10000"))
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{cat}' AS category, '{c}' AS column_name, {ok} AS success FROM {source}"
        for i, (cat, c, ok) in enumerate(rows, 1))


CTES["x_clean"] = suite("clean")
MORE["expectation_suite"] = suite("raw")
MORE["expectation_summary"] = f"""
SELECT bool_and(success) AS success, {N} AS total_checks, count(*) FILTER (WHERE success) AS checks_passed,
  count(*) FILTER (WHERE NOT success) AS checks_failed, {pct('count(*) FILTER (WHERE success)', N, 2)} AS pass_rate_pct,
  coalesce(string_agg(category || ':' || column_name, ',' ORDER BY category || ':' || column_name) FILTER (WHERE NOT success), '') AS failed_checks
FROM x_clean"""
MORE["numeric_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n, {R(f'avg({c})', 6)} AS mean, {R(f'stddev_samp({c})', 6)} AS stddev, "
    f"CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum, "
    + ", ".join(f"CAST(quantile_disc({c}, {q}) AS DOUBLE) AS {name}" for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM raw"
    for c in ["latitude", "longitude", "altitude", "speed", "heading", "delay_minutes"])

# --- payloads and ingestion
STAGED = """flight_id, airline, flight_number, source_airport, dest_airport, altitude, speed, latitude, longitude, status,
  loaded_at AS ingested_at"""
MORE["publish_messages"] = f"SELECT coalesce(flight_id, 'unknown') AS key, {N} AS messages, {N} AS succeeded, {big('0')} AS failed FROM raw GROUP BY 1"
MORE["payload_projection"] = f"SELECT {STAGED} FROM raw"
MORE["payload_paths"] = """SELECT * EXCLUDE (loaded_at) REPLACE (CAST(altitude AS INTEGER) AS altitude,
  CAST(delay_minutes AS INTEGER) AS delay_minutes) FROM raw"""
RECENT = f"loaded_at >= {AS_OF} - INTERVAL 6 HOUR AND loaded_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTE"
MORE["unprocessed_recent"] = f"SELECT {STAGED}, FALSE AS processed FROM raw WHERE {RECENT}"
MORE["data_present_gate"] = f"SELECT {N} AS waiting, {N} > 0 AS ready FROM raw WHERE {RECENT}"
CTES["api"] = f"""
SELECT coalesce(flight_id, 'UNKNOWN') AS flight_id, coalesce(airline, 'Unknown Airline') AS airline,
  coalesce(airline_iata, '??') AS airline_iata, flight_number, source_airport, dest_airport, source_city, dest_city,
  latitude, longitude, coalesce(altitude, 0) AS altitude, coalesce(speed, 0) AS speed, coalesce(heading, 0) AS heading,
  status, departure_time, arrival_time, coalesce(delay_minutes, 0) AS delay_minutes, aircraft_type,
  {AS_OF} AS event_timestamp, 'aviationstack_api' AS source
FROM raw WHERE latitude <> 0 AND longitude <> 0"""
MORE["api_flatten"] = "SELECT * FROM api"
MORE["api_request_filter"] = "SELECT * FROM api WHERE airline_iata = 'AI' AND status = 'active' AND source_airport = 'DEL'"
MORE["bulk_load_json"] = 'SELECT * EXCLUDE (loaded_at, event_timestamp), event_timestamp AS "timestamp" FROM raw'
CTES["untidy"] = """SELECT n % 10 = 7 AS broken, CASE WHEN n % 4 < 2 THEN altitude END AS altitude
FROM (SELECT *, CAST(regexp_extract(event_id, '([0-9]+)$', 1) AS BIGINT) AS n FROM raw)"""
MORE["bulk_load_untidy_json"] = f"""
SELECT kind, {N} FILTER (WHERE NOT broken) AS rows_loaded, {N} FILTER (WHERE broken AND kind = 'lines') AS errors_seen,
  count(altitude) FILTER (WHERE NOT broken) AS with_altitude, {big('sum(altitude) FILTER (WHERE NOT broken)')} AS altitude_sum
FROM untidy, (SELECT unnest(['lines', 'arrays']) AS kind) GROUP BY kind"""
MORE["written_results"] = f"""SELECT f AS format, s.* FROM (
  SELECT airline_iata, count(DISTINCT aircraft_type) AS aircraft_types, {N} AS events,
  array_to_string(list_sort(list(DISTINCT aircraft_type)), ',') AS types FROM fact GROUP BY airline_iata) s, (SELECT unnest(['json', 'csv']) AS f)"""
DAY = "CAST(event_timestamp AS DATE) AS event_date"
MORE["raw_merge_batch"] = f"""SELECT *, {DAY}, FALSE AS is_transformed,
  CASE WHEN event_timestamp >= {LATE_DAY} THEN 'batch-2' ELSE 'batch-1' END AS ingestion_batch_id FROM d1"""
NARROW = "CAST(altitude AS INTEGER) AS altitude, CAST(delay_minutes AS INTEGER) AS delay_minutes"
MORE["raw_insert_from_payload"] = f"SELECT * REPLACE ({NARROW}, {AS_OF} AS loaded_at), {DAY} FROM d1"
MORE["quick_load_raw"] = f"""
SELECT event_id, coalesce(flight_id, '') AS flight_id, airline, airline_iata, flight_number, source_airport, dest_airport,
  source_city, dest_city, coalesce(latitude, 0) AS latitude, longitude, CAST(coalesce(altitude, 0) AS INTEGER) AS altitude,
  coalesce(speed, 0) AS speed, coalesce(heading, 0) AS heading, status,
  CAST(coalesce(delay_minutes, 0) AS INTEGER) AS delay_minutes, aircraft_type, {AS_OF} AS event_timestamp, source,
  {AS_OF} AS loaded_at FROM d1"""
MORE["clean_insert"] = MORE["clean_layer"]
CTES["clean_early"] = f"SELECT * FROM clean WHERE event_date < CAST({EARLY} AS DATE)"
MORE["pending_raw"] = """SELECT event_id, flight_id, event_timestamp, loaded_at FROM raw
WHERE event_id NOT IN (SELECT event_id FROM clean_early)"""
MORE["raw_transformed_flag"] = """SELECT r.event_id, r.loaded_at, c.transformed_at, c.event_id IS NOT NULL AS is_transformed
FROM (SELECT event_id, loaded_at FROM raw) r LEFT JOIN (SELECT event_id, transformed_at FROM clean) c ON r.event_id = c.event_id"""

# --- merges
CUT = "TIMESTAMP '2024-01-25 12:00:00'"
CTES["hourly_old"] = CTES["hourly"].replace(f"event_date >= {TODAY} - 7", f"event_date >= DATE '2024-01-25' - 7 AND event_timestamp < {CUT}").replace(
    f"{AS_OF} AS summary_created_at", f"{CUT} AS summary_created_at")
MORE["hourly_merge"] = """SELECT * FROM hourly UNION ALL
SELECT o.* FROM hourly_old o ANTI JOIN hourly h USING (event_date, event_hour, airline_iata)"""
MORE["hourly_replace_day"] = f"""SELECT *, CAST(NULL AS BIGINT) AS domestic_flights FROM hourly WHERE event_date NOT IN ({TODAY}, {TODAY} - 1)
UNION ALL BY NAME {hourly_refresh(f"event_date = {TODAY}")}"""
CTES["routes_today"] = routes("fact", f"event_date = {TODAY} AND source_airport <> dest_airport")
MORE["route_merge"] = """SELECT t.* REPLACE (coalesce(r.is_international, t.is_international) AS is_international)
FROM routes_today t LEFT JOIN (SELECT event_date, source_airport, dest_airport, is_international FROM routes) r
  USING (event_date, source_airport, dest_airport)
UNION ALL BY NAME SELECT r.* FROM routes r ANTI JOIN routes_today t USING (event_date, source_airport, dest_airport)"""
MORE["airline_dim_merge"] = "SELECT * FROM dim_airlines"


def airports(where: str) -> str:
    return CTES["dim_airports"].replace("FROM clean\n", f"FROM clean WHERE {where}\n").replace("FROM clean)", f"FROM clean WHERE {where})")


CTES["airports_early"] = airports(f"event_date < CAST({LATE_DAY} AS DATE)")
CTES["airports_late"] = airports(f"event_date >= CAST({LATE_DAY} AS DATE)")
MORE["airport_dim_merge"] = """SELECT * FROM airports_early UNION ALL SELECT l.* FROM airports_late l
WHERE NOT EXISTS (SELECT 1 FROM airports_early e WHERE e.airport_code IS NOT DISTINCT FROM l.airport_code)"""

# --- incremental
WINDOW = f"loaded_at > TIMESTAMP '2024-01-10' AND loaded_at <= {AS_OF}"
MORE["incremental_window"] = f"SELECT * FROM raw WHERE {WINDOW}"
MORE["incremental_window_batch"] = f"SELECT * FROM raw WHERE {WINDOW} QUALIFY rank() OVER (ORDER BY loaded_at) <= 500"
MORE["watermarks_after_run"] = f"""
SELECT p AS process_name, CASE WHEN p = 'raw_to_clean' THEN m ELSE TIMESTAMP '2024-01-01' END AS last_processed_at,
  CASE WHEN p = 'raw_to_clean' THEN n ELSE 0 END AS last_run_count,
  CASE WHEN p = 'raw_to_clean' THEN {AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at,
  CASE WHEN p = 'raw_to_clean' THEN 'run-1' END AS last_run_id
FROM (SELECT unnest(['raw_to_clean', 'clean_to_analytics', 'route_aggregation', 'hourly_aggregation']) AS p),
     (SELECT max(loaded_at) AS m, count(*) AS n FROM raw WHERE loaded_at > TIMESTAMP '2024-01-01' AND loaded_at <= {AS_OF})"""
ARRIVAL = "epoch_us(event_timestamp) // 1000000 % 6"  # the batch a message arrives in
CTES["delivered"] = f"""
SELECT k, len(errors) > 0 AS bad, len(errors) = 0 AND row_number() OVER (PARTITION BY event_id, len(errors) = 0 ORDER BY k, event_timestamp) = 1 AS kept
FROM (SELECT *, {ARRIVAL} AS k FROM rawe)"""
RUNS = f"""
SELECT nth, run_id, dag_id, records_read, records_written, records_failed, {R('100.0::DOUBLE * records_failed / greatest(records_read, 1)', 4)} AS error_rate_pct, status
FROM (SELECT 6 - k AS nth, 'ingestion-' || k AS run_id, 'ingestion' AS dag_id, {N} AS records_read, count(*) FILTER (WHERE kept) AS records_written,
        count(*) FILTER (WHERE bad) AS records_failed, 'success' AS status FROM delivered WHERE k < 4 GROUP BY k
      UNION ALL SELECT CASE run_id WHEN 'run-2' THEN 1 ELSE 2 END, run_id, dag_id, records_read, records_written, records_failed, status FROM clean_runs)"""
MORE["run_metrics"] = "SELECT * EXCLUDE (nth), TRUE AS in_order, records_written > 0 AS wrote FROM runs"
MORE["recent_runs"] = "SELECT * FROM runs"
CTES["load_runs"] = f"""
SELECT *, {R("records_written / greatest(date_diff('microsecond', started_at, finished_at) / 1000000, 0.001::DOUBLE)", 2)} AS throughput_rps
FROM (SELECT CASE WHEN hour(h) % 2 = 0 THEN 'ingestion' ELSE 'transform' END AS dag_id, h AS started_at,
        h + to_seconds(5 + n % 17 + hour(h)) AS finished_at, n - b AS records_written
      FROM (SELECT date_trunc('hour', loaded_at) AS h, count(*) AS n, count(*) FILTER (WHERE len(errors) > 0) AS b FROM rawe GROUP BY 1))"""
MORE["throughput_trend"] = f"""
SELECT {R('a', 2)} AS avg_rps, CASE WHEN n < 2 THEN 'stable' WHEN r > o * 1.10::DOUBLE THEN 'improving'
    WHEN r < o * 0.90::DOUBLE THEN 'degrading' ELSE 'stable' END AS trend, n AS loads, {R('r', 2)} AS recent_avg, {R('o', 2)} AS older_avg,
  runs, TRUE AS judged, TRUE AS moving, TRUE AS recently, TRUE AS before
FROM (SELECT avg(throughput_rps) AS a, count(*) AS n, avg(throughput_rps) FILTER (WHERE i >= c // 2) AS r,
        avg(throughput_rps) FILTER (WHERE i < c // 2) AS o
      FROM (SELECT throughput_rps, row_number() OVER (ORDER BY started_at) - 1 AS i, count(*) OVER () AS c
            FROM (SELECT * FROM load_runs WHERE dag_id = 'ingestion' ORDER BY started_at DESC LIMIT 10)
            WHERE throughput_rps > 0)),
  (SELECT {N} AS runs FROM runs WHERE dag_id = 'ingestion')"""
MORE["run_audit"] = f"SELECT dag_id, status, {N} AS runs, {big('sum(records_read)')} AS records_read FROM runs GROUP BY dag_id, status"

# --- dead letters
CTES["letters"] = """
SELECT event_id, coalesce(flight_id, 'unknown') AS flight_id, 'ingestion' AS source, 'unknown' AS dag_id, 'unknown' AS run_id,
  array_to_string(errors, ',') AS error_message, CAST(0 AS INTEGER) AS retry_count, loaded_at AS created_at, 'pending' AS status
FROM rawe WHERE len(errors) > 0"""
MORE["dead_letter_rows"] = "SELECT * FROM letters"
MORE["dead_letters_pending"] = """SELECT * FROM letters
ORDER BY created_at, event_id || '|' || CAST(epoch_us(created_at) AS VARCHAR) LIMIT 100"""
MORE["dead_letter_stats"] = f"""SELECT CASE WHEN error_message = 'invalid_status' THEN 'replayed' ELSE 'pending' END AS status,
  {N} AS letters, max(created_at) AS latest, min(created_at) AS oldest FROM letters GROUP BY 1"""
MORE["dead_letter_replay"] = f"SELECT flight_id AS key, {N} AS messages FROM letters WHERE error_message = 'invalid_status' GROUP BY 1"
MORE["dead_letter_alert"] = f"SELECT {N} AS pending, {N} >= 50 AS alert FROM letters"

# --- health
HOUR = f"transformed_at >= {AS_OF} - INTERVAL 60 MINUTE"
CTES["checks"] = f"""
SELECT check_name, CAST(value AS DOUBLE) AS value,
  CASE WHEN ok THEN 'PASS' WHEN severity = 'warn' THEN 'WARN' ELSE 'FAIL' END AS status, severity
FROM (
  SELECT 'raw_records_last_hour' AS check_name, count(*)::DOUBLE AS value, count(*) >= 10 AS ok, 'error' AS severity
    FROM raw WHERE loaded_at >= {AS_OF} - INTERVAL 60 MINUTE
  UNION ALL SELECT 'data_freshness_minutes', date_diff('minute', max(loaded_at), {AS_OF}),
    date_diff('minute', max(loaded_at), {AS_OF}) <= 30, 'error' FROM raw
  UNION ALL SELECT 'flight_id_completeness', count(flight_id) / nullif(count(*), 0),
    coalesce(count(flight_id) / nullif(count(*), 0), 0) >= 0.9, 'error' FROM clean WHERE {HOUR}
  UNION ALL SELECT 'coordinates_completeness', count(latitude + longitude) / nullif(count(*), 0),
    coalesce(count(latitude + longitude) / nullif(count(*), 0), 0) >= 0.9, 'error' FROM clean WHERE {HOUR}
  UNION ALL SELECT 'avg_delay_minutes', avg(delay_minutes), coalesce(avg(delay_minutes), 0) <= 300, 'warn' FROM clean WHERE {HOUR}
  UNION ALL SELECT 'raw_clean_drift', abs(r - c) / nullif(r, 0), coalesce(abs(r - c) / nullif(r, 0), 0) <= 0.1, 'warn'
    FROM (SELECT (SELECT count(*) FROM raw WHERE loaded_at >= {AS_OF} - INTERVAL 120 MINUTE) AS r,
                 (SELECT count(*) FROM clean WHERE transformed_at >= {AS_OF} - INTERVAL 120 MINUTE) AS c)
  UNION ALL SELECT 'fact_table_populated', count(*), count(*) >= 10, 'error' FROM fact WHERE event_date = {TODAY})"""
MORE["layer_checks"] = "SELECT * FROM checks"
MORE["quality_log"] = f"""
SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS overall_status,
  count(*) FILTER (WHERE status = 'PASS') AS checks_passed, count(*) FILTER (WHERE status = 'FAIL') AS checks_failed,
  count(*) FILTER (WHERE status = 'WARN') AS checks_warned, {AS_OF} AS check_run_time, {AS_OF} AS created_at FROM checks"""


def grade(v: str, ok: str, down: str) -> str:
    return f"CASE WHEN {v} <= {ok} THEN 'healthy' WHEN {v} <= {down} THEN 'degraded' ELSE 'down' END"


def freshness(layer: str, source: str, stamp: str, limit: int) -> str:
    lag = f"date_diff('minute', max({stamp}), {AS_OF})"
    return (f"SELECT '{layer}_freshness' AS component, CASE WHEN max({stamp}) IS NULL THEN 'degraded' ELSE "
            f"{grade(lag, str(limit), str(2 * limit))} END AS status, CAST({lag} AS DOUBLE) AS value, {limit}::DOUBLE AS threshold FROM {source}")


CTES["c_fresh"] = " UNION ALL ".join([
    freshness("raw", "raw", "loaded_at", 15), freshness("clean", "clean", "transformed_at", 30),
    freshness("analytics", "fact", "transformed_at", 60)])
RATE = f"coalesce({pct('count(*) FILTER (WHERE data_quality_flag)', N, 2)}, 0)"
CTES["c_rate"] = f"""SELECT 'data_quality_rate' AS component, {grade(RATE, '5', '10')} AS status, {RATE} AS value, 5::DOUBLE AS threshold
FROM clean WHERE CAST(transformed_at AS DATE) = {TODAY}"""
CTES["c_lag"] = f"""SELECT 'kafka_consumer_lag' AS component, {grade('l', '100', '1000')} AS status, l::DOUBLE AS value, 1000::DOUBLE AS threshold
FROM (SELECT {N} AS l FROM raw WHERE {ARRIVAL} >= 4)"""
CTES["c_dlq"] = f"""SELECT 'dead_letter_queue' AS component, {grade('n', '0', '49')} AS status, n::DOUBLE AS value, 50::DOUBLE AS threshold
FROM (SELECT count(*) AS n FROM letters)"""
CTES["components"] = "SELECT * FROM c_fresh UNION ALL SELECT * FROM c_rate UNION ALL SELECT * FROM c_lag UNION ALL SELECT * FROM c_dlq"
MORE["layer_freshness"] = "SELECT * FROM c_fresh"
MORE["quality_rate"] = "SELECT * FROM c_rate"
MORE["consumer_lag"] = "SELECT * FROM c_lag"
MORE["dead_letter_health"] = "SELECT * FROM c_dlq"
MORE["overall_health"] = f"""SELECT CASE WHEN bool_or(status = 'down') THEN 'DOWN' WHEN bool_or(status = 'degraded') THEN 'DEGRADED'
  ELSE 'HEALTHY' END AS overall_status, count(*) FILTER (WHERE status = 'healthy') AS healthy, {N} AS total FROM components"""
MORE["health_alerts"] = """SELECT component, CASE
    WHEN component = 'data_quality_rate' THEN CASE WHEN value > 20 THEN 'CRITICAL' WHEN value > 10 THEN 'ERROR' ELSE 'WARNING' END
    WHEN component LIKE '%_freshness' THEN CASE WHEN value > 120 THEN 'CRITICAL' WHEN value > 60 THEN 'ERROR' ELSE 'WARNING' END
    WHEN status = 'down' THEN 'ERROR' ELSE 'WARNING' END AS severity, value, threshold
FROM components WHERE status <> 'healthy'"""

# --- KPIs
MORE["kpi_summary"] = f"""
SELECT (SELECT {big('coalesce(sum(active_flights), 0)')} FROM q1) AS active_flights_now,
  (SELECT coalesce({R('avg(otp_rate_pct)', 1)}, 0) FROM q3) AS fleet_otp_rate_pct,
  (SELECT coalesce({R('avg(avg_delay_minutes)', 1)}, 0) FROM q1) AS avg_delay_minutes_now,
  a.airport_code AS most_congested_code, a.city AS most_congested_city, a.congestion_index AS most_congested_index,
  (SELECT airline_name FROM q3 ORDER BY otp_rank, airline_iata LIMIT 1) AS best_airline,
  (SELECT otp_rate_pct FROM q3 ORDER BY otp_rank, airline_iata LIMIT 1) AS best_airline_otp_pct,
  overall_health AS health, coalesce(clean_record_pct, 0) AS clean_record_pct, raw_lag_minutes AS lag_minutes, {AS_OF} AS generated_at
FROM q10, (SELECT * FROM q5 ORDER BY congestion_rank, airport_code LIMIT 1) a"""
VOLUME = """SELECT '{0}' AS layer, count(*) AS total_rows, count(DISTINCT flight_id) AS unique_flights, min(event_timestamp) AS oldest_record,
  max(event_timestamp) AS newest_record, date_diff('minute', max(event_timestamp), {2}) AS minutes_since_last_record FROM {1}"""
MORE["layer_volume"] = " UNION ALL ".join(VOLUME.format(n, t, AS_OF) for n, t in [("RAW", "raw"), ("CLEAN", "clean"), ("FACT", "fact")])
MORE["layer_funnel"] = f"""SELECT r AS raw_count, c AS clean_count, f AS fact_count, {pct('c', 'r', 2)} AS raw_to_clean_pct,
  {pct('f', 'c', 2)} AS clean_to_fact_pct
FROM (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean) AS c, (SELECT count(*) FROM fact) AS f)"""
MORE["airline_summary"] = f"""SELECT airline_code AS airline_iata, airline_name, total_flights, {R('avg_delay_minutes', 1)} AS avg_delay_mins,
  active_flights, last_seen_at FROM dim_airlines ORDER BY total_flights DESC, airline_code LIMIT 15"""
MORE["delay_distribution"] = f"""SELECT delay_bucket, {N} AS flights, {R('avg(delay_minutes)', 1)} AS avg_delay_in_bucket,
  {pct(N, 'sum(count(*)) OVER ()', 2)} AS pct_of_total FROM clean GROUP BY delay_bucket"""
MORE["busiest_routes"] = f"""SELECT route_key, total_flights, {R('avg_delay_minutes', 1)} AS avg_delay_mins,
  {R('pct_on_time * 100', 1)} AS pct_on_time, is_international FROM routes WHERE event_date = {TODAY}
ORDER BY total_flights DESC, route_key LIMIT 10"""
MORE["hourly_traffic"] = f"""SELECT event_hour, {big('sum(unique_flights)')} AS flights_this_hour, {R('avg(avg_delay)', 1)} AS avg_delay_mins,
  {big('sum(active_count)')} AS active_flights, {big('sum(cancelled_count)')} AS cancellations
FROM hourly WHERE event_date >= {TODAY} - 7 GROUP BY event_hour"""
MORE["daily_error_rate"] = f"""SELECT CAST(transformed_at AS DATE) AS check_date, {N} AS total_records,
  count(*) FILTER (WHERE data_quality_flag) AS flagged_records, {pct('count(*) FILTER (WHERE data_quality_flag)', N, 2)} AS error_rate_pct
FROM clean GROUP BY 1 ORDER BY 1 DESC LIMIT 14"""
MORE["raw_load_stats"] = f"""SELECT {N} AS total_raw_records,
  count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM clean_early)) AS pending_transformation,
  max(loaded_at) AS latest_record, date_diff('minute', max(loaded_at), {AS_OF}) AS minutes_since_last_load FROM raw"""
MEANS = f"SELECT {N} AS events, avg(speed) AS avg_speed, avg(delay_minutes) AS avg_delay FROM fact"
MORE["speed_and_delay_all"] = MEANS
MORE["speed_and_delay_pruned"] = f"{MEANS} WHERE event_date = {TODAY} AND airline_iata = 'AI'"
MORE["speed_and_delay_of_airline"] = f"{MEANS} WHERE airline_iata = 'AI'"
MORE["speed_and_delay_of_route"] = f"{MEANS} WHERE route_key = 'DXB→BLR'"
MORE["speed_and_delay_of_hours"] = f"{MEANS} WHERE event_hour BETWEEN 6 AND 9"
MORE["daily_summary"] = f"""SELECT {TODAY} AS report_date, count(DISTINCT flight_id) AS unique_flights, {N} AS total_events,
  {R('avg(delay_minutes)', 1)} AS avg_delay_mins, {pct(ONT, N, 1)} AS otp_rate_pct, {st('cancelled')} AS cancellations,
  count(DISTINCT airline_iata) AS active_airlines, count(DISTINCT route_key) AS routes_flown FROM fact WHERE event_date = {TODAY}"""
MORE["airline_fleet_summary"] = f"""SELECT airline_iata, count(DISTINCT aircraft_type) AS aircraft_types, {N} AS events,
  array_to_string(list_sort(list(DISTINCT aircraft_type)), ',') AS types FROM fact GROUP BY airline_iata"""
MORE["arrival_performance"] = f"""SELECT dest_airport, count(DISTINCT flight_id) AS arriving_flights, {R('avg(delay_minutes)', 2)} AS avg_delay_minutes,
  max(delay_minutes) AS max_delay_minutes, {pct(ONT, N, 2)} AS otp_rate_pct FROM fact WHERE dest_airport IS NOT NULL GROUP BY dest_airport"""
MORE["weekly_patterns"] = f"""SELECT day_of_week, count(DISTINCT flight_id) AS flights, {N} AS events,
  {R('avg(delay_minutes)', 2)} AS avg_delay_minutes FROM fact GROUP BY day_of_week"""
MORE["real_time_status"] = f"""SELECT status, {N} AS flights, {pct(N, 'sum(count(*)) OVER ()', 2)} AS pct_of_flights
FROM (SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY event_timestamp DESC, event_id) = 1) GROUP BY status"""
REPORT_TABLES = [
    ("active_airlines_now", "Operations", 20, None, 13), ("delay_patterns", "Operations", 200, "q2", 18),
    ("airline_league", "Management", 50, "q3", 22), ("peak_hours", "Infrastructure", 24, "q4", 13),
    ("airport_congestion", "Ground Operations", 30, "q5", 13), ("route_efficiency", "Network Planning", 100, "q6", 18),
    ("aircraft_performance", "Fleet Planning", 30, "q7", 12), ("weekly_trends", "Executive", 30, "q8", 17),
    ("intl_vs_domestic", "Revenue Management", 10, "q9", 13), ("pipeline_health", "Data Engineering", 1, "q10", 13),
]
LIVE30 = f"""(SELECT DISTINCT airline_iata FROM fact WHERE event_date = {TODAY} AND status = 'active'
  AND event_timestamp >= {AS_OF} - INTERVAL 30 MINUTE)"""
MORE["report_run_summary"] = "SELECT *, CASE WHEN row_count > 0 THEN 'success' ELSE 'empty' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS name, '{team}' AS team, count(*) AS row_count, CAST({cols} AS INTEGER) AS column_count FROM {src or LIVE30}"
    for n, team, lim, src, cols in REPORT_TABLES) + ")"
MORE["fact_rolling_views"] = f"""SELECT 'all' AS view_name, {N} AS row_count FROM fact
UNION ALL SELECT 'recent', {N} FROM fact WHERE event_date >= {TODAY} - 7
UNION ALL SELECT 'today', {N} FROM fact WHERE event_date = {TODAY} UNION ALL SELECT 'clean', {N} FROM fact WHERE NOT data_quality_flag"""

# --- slices
MORE["worst_delay_hours"] = f"""SELECT event_hour, {R('avg(avg_delay)', 1)} AS avg_delay_all_airlines, max(max_delay) AS worst_single_delay,
  {big('sum(severe_delays)')} AS total_severe_delays FROM q2 WHERE event_date >= {TODAY} - 7 GROUP BY event_hour"""
MORE["league_extremes"] = """(SELECT *, 'TOP 5' AS tier FROM q3 ORDER BY composite_score DESC, airline_iata LIMIT 5)
UNION ALL (SELECT *, 'BOTTOM 5' FROM q3 ORDER BY composite_score, airline_iata LIMIT 5)"""
MORE["peak_hours_ranked"] = "SELECT hour_label, total_flights, pct_of_daily_traffic, traffic_band FROM q4"
EXTREME = "route_key, otp_rate_pct, avg_delay_minutes, route_health FROM q6 ORDER BY efficiency_score"
MORE["route_extremes"] = f"""(SELECT 'BEST' AS category, {EXTREME} DESC, route_key LIMIT 5)
UNION ALL (SELECT 'WORST', {EXTREME}, route_key LIMIT 5)"""
MORE["recent_trend"] = f"""SELECT event_date, daily_flights, otp_rate_pct, otp_last_week, otp_pp_change, otp_trend, avg_delay, delay_wow_pct
FROM q8 WHERE event_date >= {TODAY} - 14"""
MORE["league_slice"] = """SELECT otp_rank, airline_iata, airline_name, total_unique_flights, otp_rate_pct, avg_delay_minutes, median_delay_minutes,
  worst_single_delay, pct_minor_delay, pct_moderate_delay, pct_major_delay, pct_severe_delay, avg_speed_kmh, pct_international_flights,
  composite_score, performance_quartile FROM q3"""
CTES["q2_week"] = f"SELECT * FROM q2 WHERE event_date >= {TODAY} - 7"
MORE["delay_slice"] = """SELECT event_date, event_hour, airline_iata, avg_delay, otp_rate_pct, on_time, minor_delays, moderate_delays,
  major_delays, severe_delays, delay_signal FROM q2_week"""
MORE["peak_slice"] = """SELECT event_hour, hour_label, total_flights, pct_of_daily_traffic, avg_delay_minutes, active_flights, landings,
  traffic_band, traffic_rank FROM q4"""
MORE["route_slice"] = """SELECT route_key, source_airport, dest_airport, is_international, total_flights, otp_rate_pct, avg_delay_minutes,
  avg_speed_kmh, cancellation_rate_pct, efficiency_score, route_health FROM q6 ORDER BY efficiency_score DESC, route_key LIMIT 100"""
MORE["trend_slice"] = f"""SELECT event_date, daily_flights, otp_rate_pct, avg_delay, cancellations, otp_last_week, otp_pp_change, delay_wow_pct,
  otp_7day_rolling_avg, otp_trend FROM q8 WHERE event_date >= {TODAY} - 30"""
MORE["airport_slice"] = """SELECT airport_code, city, total_movements, departures, arrivals, avg_delay_minutes, delay_rate_pct, congestion_rank
FROM q5 ORDER BY congestion_rank, airport_code LIMIT 20"""
MORE["segment_slice"] = """SELECT segment, total_flights, traffic_share_pct, avg_delay_minutes, avg_otp_rate_pct, cancellation_rate_pct,
  unique_routes FROM q9"""
CTES["l1_all"] = f"""SELECT s.*, coalesce(airline_name, airline_iata) AS airline_name FROM (
  SELECT airline_iata, count(DISTINCT flight_id) AS active_flights, {R('avg(altitude)', 0)} AS avg_altitude_ft, {R('avg(speed)', 1)} AS avg_speed_kmh,
    {R('avg(delay_minutes)', 1)} AS avg_delay_minutes, {pct(LATE, N, 1)} AS pct_delayed, max(event_timestamp) AS last_seen_at
  FROM fact WHERE event_date = {TODAY} GROUP BY airline_iata) s
LEFT JOIN (SELECT airline_code, airline_name FROM dim_airlines) ON airline_iata = airline_code"""
CTES["l1"] = "SELECT * FROM l1_all ORDER BY active_flights DESC, airline_iata LIMIT 20"
MORE["active_today"] = "SELECT * FROM l1"
CTES["l2"] = f"""SELECT flight_id, airline_iata, source_airport, dest_airport, route_key, latitude, longitude, altitude, speed, status,
  delay_minutes, delay_bucket, flight_phase, is_international, event_timestamp
FROM fact WHERE event_date = {TODAY} AND NOT data_quality_flag AND latitude <> 0 AND longitude <> 0
QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY event_timestamp DESC, event_id) = 1"""
MORE["live_positions"] = "SELECT * FROM l2 ORDER BY event_timestamp DESC, flight_id LIMIT 500"
MORE["flights_today"] = f"SELECT count(DISTINCT flight_id) AS total_active FROM fact WHERE {since(0)}"
MORE["map_kpis"] = f"""SELECT count(DISTINCT flight_id) AS tracked_flights, {st('active')} AS active_flights, avg(altitude) AS avg_altitude,
  avg(speed) AS avg_speed FROM l2"""
MORE["map_filtered"] = """SELECT * FROM l2 WHERE status IN ('active', 'landed') AND flight_phase IN ('cruise', 'mid_altitude') AND is_international"""
MORE["map_marks"] = """SELECT flight_id, longitude, latitude, status, (CAST(altitude AS DOUBLE) / 1000 + 5) * 1500 AS radius,
  CASE WHEN altitude > 25000 THEN airline_iata END AS label FROM l2"""
MORE["delay_heatmap"] = "SELECT airline_iata, " + ", ".join(
    f"coalesce({R(f'avg(avg_delay) FILTER (WHERE event_hour = {h})', 6)}, 0) AS h{h:02d}" for h in range(24)) + " FROM q2_week GROUP BY airline_iata"
MORE["top_by_otp"] = "SELECT airline_iata, airline_name, otp_rate_pct FROM q3 ORDER BY otp_rate_pct DESC, airline_iata LIMIT 15"
MORE["fleet_means"] = f"""SELECT (SELECT airline_name FROM q3 ORDER BY otp_rank, airline_iata LIMIT 1) AS best_airline,
  (SELECT airline_name FROM q3 ORDER BY otp_rank DESC, airline_iata DESC LIMIT 1) AS worst_airline, """ + ", ".join(
    f"{R(f'avg({c})', 6)} AS {c}" for c in ["otp_rate_pct", "avg_delay_minutes", "pct_minor_delay", "pct_moderate_delay",
                                           "pct_major_delay", "pct_severe_delay"]) + " FROM q3"
MORE["route_bubbles"] = f"""SELECT route_key, otp_rate_pct, avg_delay_minutes, route_health,
  {R("least(greatest(total_flights / (SELECT greatest(max(total_flights), 1) FROM q6) * 40 + 5, 5), 45)", 6)} AS size FROM q6"""
MORE["run_bubbles"] = f"""SELECT run_id, status, TRUE AS timed,
  {R("least(greatest(records_written / (SELECT greatest(max(records_written), 1) FROM runs) * 20 + 5, 5), 25)", 6)} AS size FROM runs"""
MORE["home_kpis"] = f"""SELECT (SELECT {big('sum(active_flights)')} FROM l1_all) AS total_active, raw_records_today, clean_record_pct, raw_lag_minutes,
  overall_health FROM q10"""
MORE["health_page"] = """SELECT clean_record_pct, CASE WHEN clean_record_pct >= 95 THEN 'Healthy' ELSE 'Below threshold' END AS clean_label,
  flagged_records_today, CASE WHEN flagged_records_today < 50 THEN 'Low' ELSE 'High' END AS flagged_label,
  CASE WHEN clean_record_pct < 80 THEN 'red' WHEN clean_record_pct < 95 THEN 'amber' ELSE 'green' END AS gauge_band, raw_to_analytics_pct FROM q10"""
AGE = f"(epoch_us({AS_OF}) // 1000000 - epoch_us(event_timestamp) // 1000000)"
COLOURS = """CASE {0} WHEN 'on_time' THEN '#22c55e' WHEN 'minor_delay' THEN '#3b82f6' WHEN 'moderate_delay' THEN '#f59e0b'
  WHEN 'major_delay' THEN '#f97316' WHEN 'severe_delay' THEN '#ef4444' ELSE '#94a3b8' END"""
MORE["display_text"] = f"""
SELECT event_id, format('{{:,}}', altitude) AS altitude_number, format('{{:,}}', altitude) || ' ft' AS altitude,
  printf('%.1f', CAST(round(CAST(CAST(speed AS VARCHAR) AS DECIMAL(38,15)), 1) AS DOUBLE)) || ' km/h' AS speed,
  CASE WHEN delay_minutes < 60 THEN delay_minutes || 'm'
       ELSE (delay_minutes // 60) || 'h' || CASE WHEN delay_minutes % 60 > 0 THEN ' ' || (delay_minutes % 60) || 'm' ELSE '' END END AS delay,
  CASE WHEN heading IS NULL THEN 'N/A' ELSE printf('%.1f', CASE WHEN heading <= 1 THEN heading * 100 ELSE heading END) || '%' END AS heading_pct,
  CASE WHEN {AGE} < 60 THEN {AGE} || 's ago' WHEN {AGE} < 3600 THEN ({AGE} // 60) || 'm ago' ELSE ({AGE} // 3600) || 'h ago' END AS age,
  {COLOURS.format('delay_bucket')} AS delay_colour
FROM clean"""
MORE["report_colours"] = """SELECT route_key, CASE route_health WHEN 'EXCELLENT' THEN '🟢' WHEN 'GOOD' THEN '🔵' WHEN 'AVERAGE' THEN '🟡'
  WHEN 'POOR' THEN '🟠' WHEN 'CRITICAL' THEN '🔴' ELSE '⚪' END AS mark,
  CASE route_health WHEN 'CRITICAL' THEN '#ef4444' ELSE '#94a3b8' END AS colour FROM q6"""


# --- two incremental runs
def window_ctes(tag: str, where: str, run_time: str) -> None:
    from checks.oracle_base import clean_ctes

    CTES[f"{tag}_d1"] = CTES["d1"].replace("FROM raw)", f"FROM raw WHERE {where})")
    CTES[f"{tag}_d2"] = CTES["d2"].replace("FROM d1)", f"FROM {tag}_d1)")
    CTES.update(clean_ctes(f"{tag}_d2", f"{tag}_c", run_time))


window_ctes("w1", f"loaded_at > TIMESTAMP '2024-01-01' AND loaded_at <= {EARLY}", EARLY)
window_ctes("w2", f"loaded_at > (SELECT max(loaded_at) FROM w1_c) AND loaded_at <= {AS_OF}", AS_OF)
MORE["incremental_runs"] = """SELECT * EXCLUDE (event_hour, day_of_week, transformer_version) FROM (
  SELECT * FROM w1_c UNION ALL SELECT * FROM w2_c WHERE event_id NOT IN (SELECT event_id FROM w1_c))"""

MORE["incremental_run_rows"] = f"""
SELECT run_id, 'raw_to_clean' AS dag_id, n AS records_read, w AS records_written, n - w AS records_failed,
  {R('100.0::DOUBLE * (n - w) / n', 4)} AS error_rate_pct, 'success' AS status, TRUE AS in_order
FROM (SELECT 'run-1' AS run_id, (SELECT count(*) FROM raw WHERE loaded_at > TIMESTAMP '2024-01-01' AND loaded_at <= {EARLY}) AS n,
        (SELECT count(*) FROM w1_c) AS w
      UNION ALL SELECT 'run-2', (SELECT count(*) FROM raw WHERE loaded_at > (SELECT max(loaded_at) FROM w1_c) AND loaded_at <= {AS_OF}),
        (SELECT count(*) FROM w2_c WHERE event_id NOT IN (SELECT event_id FROM w1_c)))"""

CTES["clean_runs"] = MORE["incremental_run_rows"]
CTES["runs"] = RUNS

# --- streams
PAYLOAD = """event_id, flight_id, airline, airline_iata, flight_number, source_airport, dest_airport, source_city, dest_city, latitude,
  longitude, altitude, speed, heading, status, departure_time, arrival_time, delay_minutes, aircraft_type, event_timestamp, source"""
MORE["stream_ingest_raw"] = f"""
SELECT {PAYLOAD}, {AS_OF} AS loaded_at, CAST(event_timestamp AS DATE) AS event_date FROM rawe WHERE len(errors) = 0
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {ARRIVAL}, event_timestamp) = 1"""
MORE["stream_dead_letters"] = f"""SELECT array_to_string(errors, ',') AS error_message, {N} AS letters
FROM rawe WHERE len(errors) > 0 GROUP BY 1"""
MORE["stream_gate_closed"] = f"""SELECT CASE WHEN len(errors) > 0 THEN array_to_string(errors, ',') ELSE 'batch_rejected' END AS error_message, {N} AS letters
FROM rawe GROUP BY 1"""
MORE["stream_quality_gate"] = f"""SELECT {big('sum(t)')} AS total_records, {big('sum(b)')} AS invalid_count
FROM (SELECT count(*) AS t, count(*) FILTER (WHERE len(errors) > 0) AS b FROM rawe)"""
MORE["stream_dedup_ids"] = f"""
SELECT {PAYLOAD} FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {ARRIVAL}, event_timestamp) = 1"""
CTES["around_midnight"] = """SELECT side || event_id AS event_id, flight_id,
  TIMESTAMP '2020-01-01' + to_days(CAST(3 * (n // 500 % 100 + 1) AS INTEGER)) + to_seconds(CASE side WHEN 'V' THEN 2 ELSE -1 END) AS event_timestamp
FROM (SELECT event_id, flight_id, CAST(substr(event_id, 2, 9) AS INTEGER) AS n FROM raw WHERE event_id LIKE 'E%' AND flight_id IS NOT NULL),
  (SELECT unnest(['U', 'V']) AS side) WHERE n % 500 = 0"""
MORE["stream_fuzzy_dedup"] = """
SELECT event_id, flight_id, event_timestamp FROM (
  SELECT *, lag(event_timestamp) OVER (PARTITION BY flight_id ORDER BY event_timestamp, event_id) AS prev FROM (
    SELECT event_id, flight_id, event_timestamp FROM raw WHERE flight_id IS NOT NULL UNION ALL SELECT * FROM around_midnight))
WHERE prev IS NULL OR event_timestamp - prev >= INTERVAL 5 SECOND
UNION ALL SELECT event_id, flight_id, event_timestamp FROM raw WHERE flight_id IS NULL"""
MORE["stream_latest_positions"] = """SELECT flight_id, airline_iata, latitude, longitude, altitude, speed, status, event_timestamp, event_id
FROM raw WHERE flight_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY event_timestamp DESC, event_id DESC) = 1"""
MORE["stream_hourly_summary"] = hourly_refresh("NOT data_quality_flag")
