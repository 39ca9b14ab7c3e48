"""JSON payloads: parse, promote, extract and flatten."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyledger.functions import times
from skyledger.schemas import FLIGHT_EVENT, RAW_COLUMNS, STAGING_COLUMNS
from skyledger.settings import AS_OF

EVENT_TIME_KEY = "timestamp"  # name of the event time inside the payload


def to_payload(flights: DataFrame) -> DataFrame:
    """(key, value) as published: key = flight id, value = the event as JSON."""
    fields = [F.col("event_timestamp").alias(EVENT_TIME_KEY) if c == "event_timestamp" else F.col(c)
              for c in RAW_COLUMNS]
    value = F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    others = [c for c in flights.columns if c not in RAW_COLUMNS]
    return flights.select(F.coalesce("flight_id", F.lit("unknown")).alias("key"), value.alias("value"), *others)


def typed(text: Column, kind: str) -> Column:
    """A field's text as its type: numbers may be fractional or quoted, whole ones are cut toward zero; what is unusable is NULL."""
    if kind == "bigint":
        exact, whole = text.try_cast("bigint"), text.try_cast("double")
        fits = F.abs(whole) < 2.0**63
        return F.coalesce(exact, F.when(fits, whole.try_cast("bigint")))
    return text if kind == "string" else text.try_cast(kind)


_KINDS = {f.name: f.dataType.simpleString() for f in FLIGHT_EVENT.fields}
TEXT_EVENT = T.StructType([T.StructField(name, T.StringType()) for name in _KINDS])


def typed_event(field) -> list[Column]:
    """The typed columns of an event whose fields are texts; ``field`` gives the column of a key."""
    return [typed(field(key), kind).alias("event_timestamp" if key == EVENT_TIME_KEY else key) for key, kind in _KINDS.items()]


def parse_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed event columns beside the payload; all NULL where it is not a JSON object."""
    parsed = messages.withColumn("_event", F.from_json(value, TEXT_EVENT))
    return parsed.select("*", *typed_event(lambda key: F.col(f"_event.{key}"))).drop("_event")


def staging_rows(messages: DataFrame, ingested_at: Column | datetime) -> DataFrame:
    """Ten promoted fields, the whole payload and the time of arrival."""
    parsed = parse_events(messages)
    return parsed.select(*STAGING_COLUMNS, F.col("value").alias("raw_payload"),
                         times.as_timestamp(ingested_at).alias("ingested_at"))


def extract_paths(payloads: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """The 21 payload paths as typed columns through VARIANT, by the same rules as ``parse_events``; whole numbers as int."""
    taken = typed_event(lambda key: F.try_variant_get("_v", f"$.{key}", "string"))
    narrow = {name: F.col(name).try_cast("int") for name, kind in _KINDS.items() if kind == "bigint"}
    found = payloads.withColumn("_v", F.try_parse_json(payload)).select(*[c for c in payloads.columns if c not in _KINDS], *taken)
    return found.withColumns(narrow)


def publish_counts(messages: DataFrame) -> DataFrame:
    """Per key: messages, those that can be published, and those that cannot because their value is no JSON object."""
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return messages.groupBy("key").agg(F.count("*").alias("messages"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


# --- Nested records of the flight-tracking API ---------------------------------------

_API_OBJECTS = ["flight", "airline", "departure", "arrival", "live", "aircraft"]
_API_SCHEMA = ", ".join([f"{name} map<string,string>" for name in _API_OBJECTS] + ["flight_status string"])


def flatten_api_records(records: DataFrame, value: str = "value", fetched_at: datetime | Column = AS_OF) -> DataFrame:
    """Flat events from nested API records.

    A default stands in for an absent field; an explicit null stays NULL in text
    fields. Records without a live position, and records with an unusable number,
    are left out. The id is a digest of the record, so that reading it again gives
    the same event.
    """
    r = "_r"
    parsed = records.select(F.col(value).alias("_text"), F.from_json(value, _API_SCHEMA).alias(r))

    def field(obj: str, key: str, default: str | None = None) -> Column:
        source = F.col(f"{r}.{obj}")
        given = F.try_element_at(source, F.lit(key))
        has = F.coalesce(F.map_contains_key(source, key), F.lit(False))
        return F.when(has, given).otherwise(F.lit(default))

    def number(key: str) -> Column:
        return field("live", key, "0").try_cast("double")

    lat, lon = number("latitude"), number("longitude")
    numeric = [number(k) for k in ("latitude", "longitude", "altitude", "speed_horizontal", "direction")]
    usable = F.col(r).isNotNull() & (lat != 0) & (lon != 0)
    for value_ in numeric:
        usable = usable & value_.isNotNull()
    iata = F.nullif(field("flight", "iata"), F.lit(""))
    delay = F.coalesce(field("departure", "delay").try_cast("bigint"), F.lit(0).cast("bigint"))
    return parsed.filter(F.coalesce(usable, F.lit(False))).select(
        F.sha2("_text", 256).alias("event_id"),
        F.coalesce(iata, field("flight", "icao", "UNKNOWN")).alias("flight_id"),
        field("airline", "name", "Unknown Airline").alias("airline"),
        field("airline", "iata", "??").alias("airline_iata"),
        field("flight", "number", "0").alias("flight_number"),
        field("departure", "iata", "???").alias("source_airport"),
        field("arrival", "iata", "???").alias("dest_airport"),
        field("departure", "airport", "").alias("source_city"),
        field("arrival", "airport", "").alias("dest_city"),
        lat.alias("latitude"), lon.alias("longitude"),
        number("altitude").cast("bigint").alias("altitude"),
        number("speed_horizontal").alias("speed"), number("direction").alias("heading"),
        F.coalesce(F.col(f"{r}.flight_status"), F.lit("unknown")).alias("status"),
        field("departure", "scheduled", "").try_cast("timestamp").alias("departure_time"),
        field("arrival", "scheduled", "").try_cast("timestamp").alias("arrival_time"),
        delay.alias("delay_minutes"),
        field("aircraft", "icao", "UNKN").alias("aircraft_type"),
        times.as_timestamp(fetched_at).alias("event_timestamp"),
        F.lit("aviationstack_api").alias("source"),
    )


def request_filter(flights: DataFrame, airline_iata: str | None = None, status: str | None = None,
                   departure: str | None = None, limit: int | None = None) -> DataFrame:
    """The API's request parameters, applied to flattened records."""
    wanted = {"airline_iata": airline_iata, "status": status, "source_airport": departure}
    for name, value in wanted.items():
        if value is not None:
            flights = flights.filter(F.col(name) == value)
    return flights if limit is None else flights.orderBy("event_id").limit(limit)
