"""Explicit schemas, so that no reader has to infer one from the data."""

from __future__ import annotations

from pyspark.sql import types as T


_STRING, _DOUBLE, _BIGINT, _TIMESTAMP = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def _strings(*names: str) -> T.StructType:
    return _struct(**dict.fromkeys(names, _STRING))


# One flight-position event as published on the topic (flat JSON object).
FLIGHT_EVENT = _struct(
    event_id=_STRING, flight_id=_STRING, airline=_STRING, airline_iata=_STRING, flight_number=_STRING,
    source_airport=_STRING, dest_airport=_STRING, source_city=_STRING, dest_city=_STRING,
    latitude=_DOUBLE, longitude=_DOUBLE, altitude=_BIGINT, speed=_DOUBLE, heading=_DOUBLE, status=_STRING,
    departure_time=_TIMESTAMP, arrival_time=_TIMESTAMP, delay_minutes=_BIGINT, aircraft_type=_STRING,
    timestamp=_TIMESTAMP, source=_STRING,
)

# Nested record returned by the flight-tracking web API; numbers are cast later, so
# that one malformed value does not cost the whole record.
API_RECORD = _struct(
    flight=_strings("iata", "icao", "number"),
    airline=_strings("name", "iata"),
    departure=_strings("iata", "airport", "scheduled", "delay"),
    arrival=_strings("iata", "airport", "scheduled"),
    live=_strings("latitude", "longitude", "altitude", "speed_horizontal", "direction"),
    aircraft=_strings("icao"),
    flight_status=_STRING,
)

RAW_COLUMNS = [
    "event_id", "flight_id", "airline", "airline_iata", "flight_number",
    "source_airport", "dest_airport", "source_city", "dest_city",
    "latitude", "longitude", "altitude", "speed", "heading", "status",
    "departure_time", "arrival_time", "delay_minutes", "aircraft_type",
    "event_timestamp", "source",
]

CLEAN_COLUMNS = RAW_COLUMNS + [
    "is_international", "delay_bucket", "flight_phase", "region", "route_key",
    "data_quality_flag", "transformation_log", "loaded_at", "transformed_at",
]

FACT_COLUMNS = [
    "event_id", "flight_id", "airline_iata", "source_airport", "dest_airport",
    "route_key", "aircraft_type", "latitude", "longitude", "altitude", "speed",
    "status", "delay_minutes", "delay_bucket", "flight_phase", "is_international",
    "region", "data_quality_flag", "event_date", "event_hour", "day_of_week",
    "event_timestamp", "transformed_at",
]

STAGING_COLUMNS = [
    "flight_id", "airline", "flight_number", "source_airport", "dest_airport",
    "altitude", "speed", "latitude", "longitude", "status",
]

WATERMARKS = _struct(
    process_name=_STRING, last_processed_at=_TIMESTAMP, last_run_count=_BIGINT,
    updated_at=_TIMESTAMP, last_run_id=_STRING, comment_text=_STRING,
)
