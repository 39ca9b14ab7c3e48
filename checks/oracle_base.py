"""Shared CTEs of the DuckDB oracle: events -> raw -> deduplicated -> clean -> fact."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-30 23:59:59'"
TODAY = "DATE '2024-01-30'"


def R(expr: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal form of a double."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,15)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int) -> str:
    return R(f"CAST(100.0 AS DOUBLE) * ({part}) / nullif({whole}, 0)", digits)


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def mapping(pairs: dict[str, str], key: str, otherwise: str = "NULL") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {key} {cases} ELSE {otherwise} END"


def pick(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} AS BIGINT) + 1]"


def title(expr: str) -> str:
    return _runs(expr, r"\p{L}+|\P{L}+")


def initcap(expr: str) -> str:
    breaks = r"""\s!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>"""
    return _runs(expr, f"[^{breaks}]+|[{breaks}]+")


def _runs(expr: str, pattern: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({expr}, '{pattern}'), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), '')"
    )


WHITESPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip(expr: str) -> str:
    return f"trim({expr}, {WHITESPACE})"


AL = pick(["AI", "6E", "SG", "EK", "ZZ"], "u % 5")
NAME = pick(["Air India", "IndiGo", "SpiceJet", "Emirates", "zed air-line"], "u % 5")
PORTS = ["DEL", "BOM", "BLR", "NAG", "DXB", "SIN"]
CITY = ["new delhi", "MUMBAI", " Bengaluru ", "nagpur", "dubai", "singapore city"]
SRC = pick(PORTS, "u % 6")
STATUS = mapping({"view": "active", "click": "EN-ROUTE", "purchase": "landed", "error": "cancelled"}, "et", "'ghost'")

CTES: dict[str, str] = {}

CTES["ev"] = "SELECT event_id AS e, user_id AS u, ts, event_type AS et FROM events"

CTES["raw"] = f"""
SELECT pre || lpad(CAST(CASE WHEN e % 50 = 49 THEN e - 1 ELSE e END AS VARCHAR), 9, '0') AS event_id,
       CASE WHEN e % 97 <> 0 THEN {AL} || CAST(u + 100 AS VARCHAR) END AS flight_id,
       CASE WHEN e % 3 = 0 THEN '  ' || lower({NAME}) || ' ' ELSE {NAME} END AS airline,
       {AL} AS airline_iata,
       CAST(u + 100 AS VARCHAR) AS flight_number,
       CASE WHEN e % 61 = 0 THEN '???' WHEN e % 7 = 0 THEN lower({SRC}) ELSE {SRC} END AS source_airport,
       {pick(PORTS, "(u * 7 + e) % 6")} AS dest_airport,
       CASE WHEN e % 59 = 0 THEN '' ELSE {pick(CITY, "u % 6")} END AS source_city,
       {pick(CITY, "(u * 7 + e) % 6")} AS dest_city,
       CASE WHEN e % 53 = 0 THEN NULL WHEN e % 211 = 0 THEN 999.0::DOUBLE
            ELSE CAST((e * 37) % 1000 AS DOUBLE) / 16 - 10 END AS latitude,
       CAST((e * 53) % 2000 AS DOUBLE) / 16 + 30 AS longitude,
       CASE WHEN e % 41 <> 0 THEN CAST((e * 7919) % 45000 - 1000 AS BIGINT) END AS altitude,
       CASE WHEN e % 43 <> 0 THEN CAST((e * 104729) % 10000 AS DOUBLE) / 8 - 20 END AS speed,
       CASE WHEN e % 71 <> 0 THEN CAST((e * 13) % 360 AS DOUBLE) END AS heading,
       {STATUS} AS status,
       ts - to_minutes(CAST(e % 180 AS BIGINT)) AS departure_time,
       ts + to_minutes(CAST((e * 3) % 240 AS BIGINT)) AS arrival_time,
       CASE WHEN e % 47 = 0 THEN NULL WHEN e % 10 < 6 THEN 0::BIGINT ELSE CAST((e * 31) % 260 - 5 AS BIGINT) END AS delay_minutes,
       {pick(["A320", "B788", "B738", "A350", "UNKN"], "e % 5")} AS aircraft_type,
       CASE WHEN pre = 'N' THEN ts + INTERVAL 2 SECOND ELSE ts END AS event_timestamp,
       'simulator' AS source,
       ts + INTERVAL 5 MINUTE AS loaded_at
FROM (SELECT *, 'E' AS pre FROM ev UNION ALL SELECT *, 'N' FROM ev WHERE (CASE WHEN e % 50 = 49 THEN e - 1 ELSE e END) % 83 = 0)"""

CTES["d1"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at NULLS LAST, event_timestamp NULLS LAST, flight_id) AS rn
  FROM raw) WHERE rn = 1"""

CTES["d2"] = """
SELECT * EXCLUDE (prev) FROM (
  SELECT *, CASE WHEN flight_id IS NOT NULL THEN
              lag(event_timestamp) OVER (PARTITION BY flight_id ORDER BY event_timestamp, loaded_at, event_id) END AS prev
  FROM d1)
WHERE prev IS NULL OR event_timestamp - prev >= INTERVAL 5 SECOND"""

IN18 = "('DEL','BOM','BLR','MAA','CCU','HYD','AMD','COK','GOI','JAI','PNQ','NAG','IXC','ATQ','SXR','IXB','GAU','IMF')"
IN10 = "('DEL','BOM','BLR','MAA','CCU','HYD','AMD','COK','GOI','JAI')"
VALID = "('active','scheduled','landed','cancelled','diverted','unknown')"
NAMES = {
    "AI": "Air India", "6E": "IndiGo", "SG": "SpiceJet", "UK": "Vistara", "G8": "GoFirst", "EK": "Emirates",
    "SQ": "Singapore Airlines", "BA": "British Airways", "QR": "Qatar Airways", "G9": "Air Arabia",
    "IX": "Air India Express", "I5": "AIX Connect",
}
SYNONYMS = {
    "en-route": "active", "en_route": "active", "in_air": "active", "airborne": "active", "in-flight": "active",
    "arrived": "landed", "arrival": "landed", "on_ground": "landed", "canceled": "cancelled", "cncl": "cancelled",
    "divrt": "diverted", "divert": "diverted",
}


def _tidy(col: str, blanks: str, fold: str = "upper") -> str:
    value = f"{fold}({strip(col)})" if fold else title(strip(col))
    return f"CASE WHEN {value} NOT IN ({blanks}) THEN {value} END"


def clean_ctes(source: str, out: str = "clean", transformed_at: str = "loaded_at + INTERVAL 5 MINUTE") -> dict[str, str]:
    """CTEs of the canonical cleaner over ``source``."""
    s1, s2 = f"{out}_s1", f"{out}_s2"
    return {
        s1: f"""
SELECT * REPLACE (
  {_tidy('source_airport', "'NAN','NONE','???','','N/A'")} AS source_airport,
  {_tidy('dest_airport', "'NAN','NONE','???','','N/A'")} AS dest_airport,
  coalesce({mapping(NAMES, 'airline_iata')}, {title(strip('airline'))}) AS airline,
  {_tidy('airline_iata', "'NAN','NONE','??',''")} AS airline_iata,
  lower({strip('status')}) AS status,
  {_tidy('source_city', "'Nan','None',''", '')} AS source_city,
  {_tidy('dest_city', "'Nan','None',''", '')} AS dest_city)
FROM {source}""",
        s2: f"""
SELECT * REPLACE (
  CAST(least(greatest(coalesce(altitude, 0), 0), 60000) AS BIGINT) AS altitude,
  CAST(least(greatest(coalesce(speed, 0), 0), 1200) AS DOUBLE) AS speed,
  CASE WHEN latitude IS NOT NULL THEN CAST(least(greatest(latitude, -90), 90) AS DOUBLE) END AS latitude,
  CASE WHEN longitude IS NOT NULL THEN CAST(least(greatest(longitude, -180), 180) AS DOUBLE) END AS longitude,
  CAST(greatest(coalesce(delay_minutes, 0), 0) AS BIGINT) AS delay_minutes,
  CASE WHEN status IN {VALID} THEN status ELSE {mapping(SYNONYMS, 'status', "'unknown'")} END AS status),
  list_filter([
    CASE WHEN altitude IS NULL THEN 'imputed_altitude' END,
    CASE WHEN speed IS NULL THEN 'imputed_speed' END,
    CASE WHEN delay_minutes IS NULL THEN 'imputed_delay_minutes' END,
    CASE WHEN altitude NOT BETWEEN 0 AND 60000 THEN 'capped_altitude' END,
    CASE WHEN speed NOT BETWEEN 0 AND 1200 THEN 'capped_speed' END,
    CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'capped_latitude' END,
    CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'capped_longitude' END,
    CASE WHEN delay_minutes < 0 THEN 'capped_delay_minutes' END,
    CASE WHEN coalesce(status NOT IN {VALID}, TRUE) THEN 'normalised_status' END], lambda x: x IS NOT NULL) AS notes
FROM {s1}""",
        out: f"""
SELECT * EXCLUDE (notes, hit), hit IS NOT NULL AS data_quality_flag,
       array_to_string(list_filter(list_append(notes, hit), lambda x: x IS NOT NULL), ',') AS transformation_log
FROM (SELECT *,
  NOT (coalesce(source_airport IN {IN18}, FALSE) AND coalesce(dest_airport IN {IN18}, FALSE)) AS is_international,
  CASE WHEN delay_minutes <= 0 THEN 'on_time' WHEN delay_minutes <= 15 THEN 'minor_delay'
       WHEN delay_minutes <= 60 THEN 'moderate_delay' WHEN delay_minutes <= 180 THEN 'major_delay'
       ELSE 'severe_delay' END AS delay_bucket,
  CASE WHEN altitude <= 999 THEN 'ground' WHEN altitude <= 14999 THEN 'climbing'
       WHEN altitude <= 31999 THEN 'mid_altitude' ELSE 'cruise' END AS flight_phase,
  CASE WHEN latitude BETWEEN 8 AND 37 AND longitude BETWEEN 68 AND 97 THEN 'India'
       WHEN latitude >= 35 THEN 'Europe_Asia' WHEN latitude <= 0 THEN 'Southern'
       ELSE 'Middle_East_SE_Asia' END AS region,
  coalesce(source_airport, '???') || '→' || coalesce(dest_airport, '???') AS route_key,
  CAST(event_timestamp AS DATE) AS event_date,
  CAST(hour(event_timestamp) AS INTEGER) AS event_hour,
  CAST(isodow(event_timestamp) - 1 AS INTEGER) AS day_of_week,
  CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'flag:missing_coordinates'
       WHEN flight_id IS NULL THEN 'flag:missing_flight_id'
       WHEN status = 'active' AND speed = 0 THEN 'flag:active_with_zero_speed'
       WHEN source_airport IN ('???','UNK','') OR dest_airport IN ('???','UNK','') THEN 'flag:unknown_airport'
       WHEN altitude < 1000 AND speed > 500 THEN 'flag:speed_altitude_mismatch' END AS hit,
  {transformed_at} AS transformed_at,
  '1.0.0' AS transformer_version
FROM {s2})""",
    }


CTES.update(clean_ctes("d2"))

CTES["fact"] = """
SELECT event_id, flight_id, airline_iata, source_airport, dest_airport,
       coalesce(route_key, source_airport || '→' || dest_airport) AS route_key, aircraft_type,
       latitude, longitude, altitude, speed, status, delay_minutes, delay_bucket, flight_phase,
       is_international, region, data_quality_flag, CAST(event_timestamp AS DATE) AS event_date,
       CAST(hour(event_timestamp) AS INTEGER) AS event_hour,
       CAST(dayofweek(event_timestamp) AS INTEGER) AS day_of_week, event_timestamp, transformed_at
FROM clean WHERE NOT data_quality_flag"""

CTES["dim_airlines"] = f"""
SELECT airline_iata AS airline_code, max(airline) AS airline_name, {big('count(DISTINCT flight_id)')} AS total_flights,
       avg(delay_minutes) AS avg_delay_minutes, {big("count(*) FILTER (WHERE status = 'active')")} AS active_flights,
       max(transformed_at) AS last_seen_at
FROM clean GROUP BY airline_iata"""

CTES["dim_airports"] = f"""
SELECT airport_code, max(city) AS city, {big('sum(dep)')} AS total_departures, {big('sum(arr)')} AS total_arrivals,
       max(seen) AS last_activity
FROM (SELECT source_airport AS airport_code, source_city AS city, 1 AS dep, 0 AS arr, transformed_at AS seen FROM clean
      UNION ALL SELECT dest_airport, dest_city, 0, 1, transformed_at FROM clean)
GROUP BY airport_code"""


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the CTEs it needs, in dependency order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in known and word not in needed and re.search(rf"\b(FROM|JOIN)\s+{word}\b", text):
                visit(known[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{body.strip()}"
