"""DuckDB SQL for the star tables and the ten reports."""

from __future__ import annotations

from checks.oracle_base import AS_OF, CTES, TODAY, R, big, pct

ONT = "count(*) FILTER (WHERE delay_bucket = 'on_time')"
LATE = "count(*) FILTER (WHERE delay_bucket <> 'on_time')"
N = "count(*)"


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def st(name: str) -> str:
    return cnt(f"status = '{name}'")


def bucket(name: str) -> str:
    return cnt(f"delay_bucket = '{name}'")


def since(days: int) -> str:
    return f"event_date >= {TODAY} - {days} AND NOT data_quality_flag"


CTES["hourly"] = f"""
SELECT event_date, event_hour, airline_iata, count(DISTINCT flight_id) AS unique_flights, {N} AS total_events,
       avg(altitude) AS avg_altitude, avg(speed) AS avg_speed, avg(delay_minutes) AS avg_delay,
       max(delay_minutes) AS max_delay, {st('active')} AS active_count, {st('landed')} AS landed_count,
       {st('cancelled')} AS cancelled_count, {cnt('is_international')} AS intl_flights,
       {AS_OF} AS summary_created_at
FROM fact WHERE event_date >= {TODAY} - 7 GROUP BY ALL"""


def hourly_refresh(where: str) -> str:
    return f"""
SELECT event_date, event_hour, airline_iata, count(DISTINCT flight_id) AS unique_flights, {N} AS total_events,
       {R('avg(altitude)', 0)} AS avg_altitude, {R('avg(speed)', 1)} AS avg_speed, {R('avg(delay_minutes)', 1)} AS avg_delay,
       max(delay_minutes) AS max_delay, {st('active')} AS active_count, {st('landed')} AS landed_count,
       {st('cancelled')} AS cancelled_count, {cnt('is_international')} AS intl_flights,
       {cnt('NOT is_international')} AS domestic_flights, {AS_OF} AS summary_created_at
FROM fact WHERE {where} GROUP BY event_date, event_hour, airline_iata"""


def routes(source: str, where: str) -> str:
    return f"""
SELECT event_date, source_airport, dest_airport, source_airport || '→' || dest_airport AS route_key,
       count(DISTINCT flight_id) AS total_flights, {N} AS total_events,
       {R('avg(delay_minutes)', 2)} AS avg_delay_minutes, max(delay_minutes) AS max_delay_minutes,
       {R(f'CAST({ONT} AS DOUBLE) / {N}', 4)} AS pct_on_time, {R(f'CAST({LATE} AS DOUBLE) / {N}', 4)} AS pct_delayed,
       {R('avg(speed)', 2)} AS avg_speed,
       {R("avg(altitude) FILTER (WHERE flight_phase = 'cruise')", 0)} AS avg_cruise_altitude,
       bool_or(is_international) AS is_international, {AS_OF} AS summary_created_at
FROM {source} WHERE NOT data_quality_flag AND {where} GROUP BY event_date, source_airport, dest_airport"""


CTES["routes"] = routes("clean", f"event_timestamp >= {AS_OF} - INTERVAL 7 DAY")

CTES["q1_latest"] = f"""
SELECT * FROM fact WHERE event_date = {TODAY} AND status = 'active' AND NOT data_quality_flag
  AND event_timestamp >= {AS_OF} - INTERVAL 30 MINUTE
QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY event_timestamp DESC, event_id) = 1"""
CTES["q1"] = f"""
SELECT rank() OVER (ORDER BY active_flights DESC) AS activity_rank, airline_iata,
       coalesce(airline_name, airline_iata) AS airline_name, s.* EXCLUDE (airline_iata)
FROM (SELECT airline_iata, {N} AS active_flights, {R('avg(altitude)', 0)} AS avg_altitude_ft,
        {R('avg(speed)', 1)} AS avg_speed_kmh, {R('avg(delay_minutes)', 1)} AS avg_delay_minutes,
        max(delay_minutes) AS max_delay_minutes, {ONT} AS on_time_count, {LATE} AS delayed_count,
        {pct(LATE, N, 1)} AS pct_delayed, count(DISTINCT route_key) AS active_routes,
        max(event_timestamp) AS last_seen_at
      FROM q1_latest GROUP BY airline_iata) s
LEFT JOIN (SELECT airline_code, airline_name FROM dim_airlines) ON airline_iata = airline_code"""

CTES["q2_hours"] = f"""
SELECT event_date, event_hour, airline_iata, count(DISTINCT flight_id) AS flights, {R('avg(delay_minutes)', 2)} AS avg_delay,
       {R('median(delay_minutes)', 2)} AS median_delay, max(delay_minutes) AS max_delay,
       {R('quantile_cont(delay_minutes, 0.9)', 2)} AS p90_delay, {ONT} AS on_time, {bucket('minor_delay')} AS minor_delays,
       {bucket('moderate_delay')} AS moderate_delays, {bucket('major_delay')} AS major_delays,
       {bucket('severe_delay')} AS severe_delays, {pct(ONT, N, 2)} AS otp_rate_pct
FROM fact WHERE {since(30)} GROUP BY event_date, event_hour, airline_iata"""
CTES["q2"] = f"""
SELECT * EXCLUDE (roll), {R('avg_delay - prev_hour_avg_delay', 2)} AS delay_delta_vs_prev_hour,
       {R('roll', 2)} AS rolling_3h_avg_delay,
       CASE WHEN avg_delay > roll * CAST(1.5 AS DOUBLE) THEN 'DELAY_SPIKE'
            WHEN avg_delay < roll * CAST(0.7 AS DOUBLE) THEN 'IMPROVING' ELSE 'NORMAL' END AS delay_signal
FROM (SELECT *, lag(avg_delay) OVER w AS prev_hour_avg_delay,
             avg(avg_delay) OVER (PARTITION BY airline_iata, event_date ORDER BY event_hour
                                  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS roll
      FROM q2_hours WINDOW w AS (PARTITION BY airline_iata, event_date ORDER BY event_hour))"""

CTES["q3_stats"] = f"""
SELECT airline_iata, count(DISTINCT flight_id) AS total_unique_flights, count(DISTINCT event_date) AS days_of_data,
       count(DISTINCT route_key) AS unique_routes_flown, {pct(ONT, N, 2)} AS otp_rate_pct,
       {R('avg(delay_minutes)', 2)} AS avg_delay_minutes, {R('median(delay_minutes)', 2)} AS median_delay_minutes,
       max(delay_minutes) AS worst_single_delay, {pct(bucket('minor_delay'), N, 1)} AS pct_minor_delay,
       {pct(bucket('moderate_delay'), N, 1)} AS pct_moderate_delay, {pct(bucket('major_delay'), N, 1)} AS pct_major_delay,
       {pct(bucket('severe_delay'), N, 1)} AS pct_severe_delay, {R('avg(speed)', 1)} AS avg_speed_kmh,
       {R('avg(altitude)', 0)} AS avg_altitude_ft, {pct(cnt('is_international'), N, 1)} AS pct_international_flights,
       {R('stddev_samp(delay_minutes)', 2)} AS delay_stddev_minutes
FROM fact WHERE {since(30)} GROUP BY airline_iata HAVING count(DISTINCT flight_id) >= 5"""
D = lambda x: f"CAST({x} AS DOUBLE)"
CTES["q3"] = f"""
SELECT rank() OVER (ORDER BY otp_rate_pct DESC) AS otp_rank, rank() OVER (ORDER BY avg_delay_minutes) AS delay_rank,
       rank() OVER (ORDER BY delay_stddev_minutes NULLS LAST) AS consistency_rank,
       ntile(4) OVER (ORDER BY otp_rate_pct DESC, airline_iata) AS performance_quartile,
       s.* EXCLUDE (total_events), coalesce(airline_name, airline_iata) AS airline_name,
       {R(f"otp_rate_pct * {D('0.6')} + (100 - least(avg_delay_minutes, 100)) * {D('0.3')}"
          f" + CASE WHEN delay_stddev_minutes IS NOT NULL THEN (100 - least(delay_stddev_minutes, 100)) * {D('0.1')} END", 2)} AS composite_score
FROM (SELECT *, 0 AS total_events FROM q3_stats) s
LEFT JOIN (SELECT airline_code, airline_name FROM dim_airlines) ON airline_iata = airline_code"""

CTES["q4_hours"] = f"""
SELECT event_hour, {big('sum(f)')} AS total_flights, {big('sum(n)')} AS total_events, {R('avg(sp)', 1)} AS avg_speed,
       {R('avg(al)', 0)} AS avg_altitude, {R('avg(de)', 2)} AS avg_delay_minutes, {big('sum(a)')} AS active_flights,
       {big('sum(l)')} AS landings, {big('sum(c)')} AS cancellations
FROM (SELECT event_hour, day_of_week, count(DISTINCT flight_id) AS f, {N} AS n, {R('avg(speed)', 1)} AS sp,
             {R('avg(altitude)', 0)} AS al, {R('avg(delay_minutes)', 2)} AS de, {st('active')} AS a,
             {st('landed')} AS l, {st('cancelled')} AS c
      FROM fact WHERE {since(30)} GROUP BY event_hour, day_of_week)
GROUP BY event_hour"""
CTES["q4"] = f"""
SELECT h.*, lpad(CAST(event_hour AS VARCHAR), 2, '0') || ':00' AS hour_label,
       {pct('total_flights', '(SELECT sum(total_flights) FROM q4_hours)', 2)} AS pct_of_daily_traffic,
       CASE WHEN total_flights >= p[1] THEN 'PEAK' WHEN total_flights >= p[2] THEN 'BUSY'
            WHEN total_flights >= p[3] THEN 'MODERATE' ELSE 'QUIET' END AS traffic_band,
       rank() OVER (ORDER BY total_flights DESC) AS traffic_rank
FROM q4_hours h, (SELECT [quantile_cont(total_flights, 0.8), quantile_cont(total_flights, 0.5),
                          quantile_cont(total_flights, 0.25)] AS p FROM q4_hours)"""
CTES["q4"] = CTES["q4"].replace("SELECT h.*,", "SELECT h.*,")

CTES["q5_moves"] = f"""
SELECT port AS airport_code, kind, count(DISTINCT flight_id) AS f, {R('avg(delay_minutes)', 2)} AS d,
       max(delay_minutes) AS mx, {LATE} AS late
FROM (SELECT source_airport AS port, 'departure' AS kind, * FROM fact UNION ALL SELECT dest_airport, 'arrival', * FROM fact)
WHERE event_date >= {TODAY} - 7 AND NOT data_quality_flag AND port IS NOT NULL GROUP BY port, kind"""
CTES["q5"] = f"""
SELECT rank() OVER (ORDER BY total_movements DESC) AS traffic_rank, rank() OVER (ORDER BY delay_rate_pct DESC) AS delay_rank,
       rank() OVER (ORDER BY congestion_index DESC) AS congestion_rank, s.*, coalesce(c.city, s.airport_code) AS city
FROM (SELECT airport_code, {big('sum(f)')} AS total_movements,
        {big("coalesce(sum(f) FILTER (WHERE kind = 'departure'), 0)")} AS departures,
        {big("coalesce(sum(f) FILTER (WHERE kind = 'arrival'), 0)")} AS arrivals,
        {R('avg(d)', 2)} AS avg_delay_minutes, max(mx) AS max_delay_minutes, {big('sum(late)')} AS total_delayed,
        {pct('sum(late)', 'sum(f)', 2)} AS delay_rate_pct,
        {R(f"CAST(sum(f) AS DOUBLE) * {D('0.5')} + avg(d) * {D('0.5')}", 2)} AS congestion_index
      FROM q5_moves GROUP BY airport_code) s
LEFT JOIN (SELECT airport_code AS code, city FROM dim_airports) c ON s.airport_code = c.code"""

CTES["q6_stats"] = f"""
SELECT route_key, source_airport, dest_airport, is_international, count(DISTINCT flight_id) AS total_flights,
       count(DISTINCT event_date) AS days_operated, count(DISTINCT airline_iata) AS airlines_on_route,
       {R('avg(speed)', 1)} AS avg_speed_kmh, {R('avg(altitude)', 0)} AS avg_altitude_ft,
       {R('avg(delay_minutes)', 2)} AS avg_delay_minutes, {R('median(delay_minutes)', 2)} AS median_delay_minutes,
       max(delay_minutes) AS worst_delay_minutes, {pct(ONT, N, 2)} AS otp_rate_pct, {st('cancelled')} AS cancellations,
       {pct(st('cancelled'), N, 2)} AS cancellation_rate_pct
FROM fact WHERE {since(30)} AND route_key NOT LIKE '%???%' AND source_airport <> dest_airport
GROUP BY ALL HAVING count(DISTINCT flight_id) >= 3"""
CTES["q6"] = f"""
SELECT *, rank() OVER (ORDER BY otp_rate_pct DESC, avg_delay_minutes) AS efficiency_rank,
       {R(f"otp_rate_pct * {D('0.5')} + least(avg_speed_kmh / 10, 100) * {D('0.3')}"
          f" + (100 - cancellation_rate_pct) * {D('0.2')}", 2)} AS efficiency_score,
       CASE WHEN otp_rate_pct >= 90 AND cancellation_rate_pct < 2 THEN 'EXCELLENT'
            WHEN otp_rate_pct >= 75 AND cancellation_rate_pct < 5 THEN 'GOOD'
            WHEN otp_rate_pct >= 60 THEN 'AVERAGE' WHEN otp_rate_pct >= 40 THEN 'POOR' ELSE 'CRITICAL' END AS route_health
FROM q6_stats"""

CTES["q7"] = f"""
SELECT * EXCLUDE (sd), {R('otp_rate_pct - sd', 2)} AS reliability_index,
       rank() OVER (ORDER BY otp_rate_pct DESC) AS otp_rank, rank() OVER (ORDER BY avg_cruise_speed_kmh DESC) AS speed_rank
FROM (SELECT aircraft_type, count(DISTINCT flight_id) AS flights_operated, count(DISTINCT airline_iata) AS airlines_using,
        {R('avg(speed)', 1)} AS avg_cruise_speed_kmh, {R('avg(altitude)', 0)} AS avg_cruise_altitude_ft,
        {R('avg(delay_minutes)', 2)} AS avg_delay_minutes, {R('median(delay_minutes)', 2)} AS median_delay_minutes,
        {pct(ONT, N, 2)} AS otp_rate_pct, {pct(cnt('is_international'), N, 1)} AS pct_intl_routes,
        stddev_samp(delay_minutes) AS sd
      FROM fact WHERE {since(30)} AND flight_phase = 'cruise' AND aircraft_type NOT IN ('UNKN', 'UNKNOWN', '')
      GROUP BY aircraft_type HAVING count(DISTINCT flight_id) >= 3)"""

CTES["q8_days"] = f"""
SELECT event_date, count(DISTINCT flight_id) AS daily_flights, {R('avg(delay_minutes)', 2)} AS avg_delay,
       {pct(ONT, N, 2)} AS otp_rate_pct, {st('cancelled')} AS cancellations, {R('avg(speed)', 1)} AS avg_speed,
       {cnt('is_international')} AS intl_flights, count(DISTINCT airline_iata) AS active_airlines
FROM fact WHERE {since(60)} GROUP BY event_date"""
CTES["q8"] = f"""
SELECT * EXCLUDE (roll),
       {pct('daily_flights - flights_last_week', 'flights_last_week', 2)} AS flights_wow_pct,
       {pct('avg_delay - avg_delay_last_week', 'avg_delay_last_week', 2)} AS delay_wow_pct,
       {R('otp_rate_pct - otp_last_week', 2)} AS otp_pp_change, {R('roll', 2)} AS otp_7day_rolling_avg,
       CASE WHEN otp_rate_pct > otp_last_week + 2 THEN 'IMPROVING' WHEN otp_rate_pct < otp_last_week - 2 THEN 'DEGRADING'
            ELSE 'STABLE' END AS otp_trend
FROM (SELECT *, lag(daily_flights, 7) OVER w AS flights_last_week, lag(avg_delay, 7) OVER w AS avg_delay_last_week,
             lag(otp_rate_pct, 7) OVER w AS otp_last_week, lag(cancellations, 7) OVER w AS cancellations_last_week,
             avg(otp_rate_pct) OVER (ORDER BY event_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll
      FROM q8_days WINDOW w AS (ORDER BY event_date))"""

CTES["q9"] = f"""
SELECT segment, {N} AS days_of_data, {big('sum(f)')} AS total_flights,
       {pct('sum(f)', 'sum(sum(f)) OVER ()', 2)} AS traffic_share_pct, max(r) AS unique_routes, max(a) AS airlines,
       {R('avg(CAST(d AS DECIMAL(18,2)))', 2)} AS avg_delay_minutes, {R('avg(CAST(sp AS DECIMAL(18,1)))', 1)} AS avg_speed_kmh, {R('avg(al)', 0)} AS avg_altitude_ft,
       {R('avg(CAST(o AS DECIMAL(18,2)))', 2)} AS avg_otp_rate_pct, {big('sum(sv)')} AS total_severe_delays, {big('sum(c)')} AS total_cancellations,
       {pct('sum(c)', 'sum(f)', 2)} AS cancellation_rate_pct
FROM (SELECT CASE WHEN is_international THEN 'International' ELSE 'Domestic' END AS segment, event_date,
             count(DISTINCT flight_id) AS f, count(DISTINCT route_key) AS r, count(DISTINCT airline_iata) AS a,
             {R('avg(delay_minutes)', 2)} AS d, {R('avg(speed)', 1)} AS sp, {R('avg(altitude)', 0)} AS al,
             {pct(ONT, N, 2)} AS o, {bucket('severe_delay')} AS sv, {st('cancelled')} AS c
      FROM fact WHERE {since(30)} GROUP BY ALL)
GROUP BY segment"""


def fresh(minutes: str) -> str:
    return (f"CASE WHEN {minutes} <= 10 THEN 'FRESH' WHEN {minutes} <= 30 THEN 'ACCEPTABLE' "
            f"WHEN {minutes} <= 60 THEN 'STALE' ELSE 'CRITICAL' END")


CTES["q10_raw"] = f"SELECT count(*) AS n, date_diff('minute', max(loaded_at), {AS_OF}) AS lag FROM raw WHERE CAST(loaded_at AS DATE) = {TODAY}"
CTES["q10_clean"] = f"""SELECT count(*) AS n, date_diff('minute', max(transformed_at), {AS_OF}) AS lag,
  count(*) FILTER (WHERE data_quality_flag) AS flagged FROM clean WHERE CAST(transformed_at AS DATE) = {TODAY}"""
CTES["q10_fact"] = f"SELECT count(*) AS n, date_diff('minute', max(transformed_at), {AS_OF}) AS lag FROM fact WHERE event_date = {TODAY}"
CTES["q10"] = f"""
SELECT *, CASE WHEN raw_freshness IN ('CRITICAL', 'STALE') THEN 'PIPELINE_DEGRADED'
               WHEN clean_record_pct < 90 THEN 'QUALITY_DEGRADED' ELSE 'HEALTHY' END AS overall_health
FROM (SELECT r.n AS raw_records_today, c.n AS clean_records_today, f.n AS analytics_records_today,
             {fresh('r.lag')} AS raw_freshness, {fresh('c.lag')} AS clean_freshness, {fresh('f.lag')} AS analytics_freshness,
             r.lag AS raw_lag_minutes, c.lag AS clean_lag_minutes, {pct('c.n - c.flagged', 'c.n', 2)} AS clean_record_pct,
             c.flagged AS flagged_records_today, {pct('f.n', 'r.n', 2)} AS raw_to_analytics_pct,
             {AS_OF} AS report_generated_at
      FROM q10_raw r CROSS JOIN q10_clean c CROSS JOIN q10_fact f)"""
CTES["q10"] = CTES["q10"]

STAR = {
    "fact_rows": "SELECT * FROM fact",
    "fact_recent_build": f"SELECT * FROM fact WHERE transformed_at >= {AS_OF} - INTERVAL 20 MINUTE",
    "dim_airlines": "SELECT * FROM dim_airlines",
    "dim_airports": "SELECT * FROM dim_airports",
    "hourly_summary": "SELECT * FROM hourly",
    "hourly_refresh": hourly_refresh(f"event_date = {TODAY}"),
    "routes_from_clean": "SELECT * FROM routes",
    "routes_from_fact": routes("fact", f"event_date = {TODAY} AND source_airport <> dest_airport"),
}
REPORTS = {
    "active_airlines_now": "SELECT * FROM q1",
    "delay_patterns": "SELECT * FROM q2",
    "airline_league": "SELECT * FROM q3",
    "peak_hours": "SELECT * FROM q4",
    "airport_congestion": "SELECT * FROM q5",
    "route_efficiency": "SELECT * FROM q6",
    "aircraft_performance": "SELECT * FROM q7",
    "weekly_trends": "SELECT * FROM q8",
    "intl_vs_domestic": "SELECT * FROM q9",
    "health_scorecard": "SELECT * FROM q10",
}
