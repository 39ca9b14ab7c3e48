"""Reads the generic ``events`` table as raw flight-position rows.

Every column is a deterministic function of the event row, so any engine can
reproduce it: about 2 % repeated ids, near-duplicates two seconds apart,
placeholders, out-of-range numbers and unknown statuses are all present. It is one
projection over one scan; near-duplicates come from ``explode``, not a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions.text import lookup
from skyledger.schemas import RAW_COLUMNS

# Fixed values of the mapping (position in the list = remainder).
AIRLINE_CODES = ["AI", "6E", "SG", "EK", "ZZ"]
AIRLINES = ["Air India", "IndiGo", "SpiceJet", "Emirates", "zed air-line"]
AIRPORTS = ["DEL", "BOM", "BLR", "NAG", "DXB", "SIN"]
CITIES = ["new delhi", "MUMBAI", " Bengaluru ", "nagpur", "dubai", "singapore city"]
AIRCRAFT = ["A320", "B788", "B738", "A350", "UNKN"]
STATUSES = {
    "view": "active", "click": "EN-ROUTE", "purchase": "landed", "error": "cancelled", "signup": "ghost",
}


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _unless(absent: Column, col: Column) -> Column:
    return F.when(~absent, col)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flights_from_events(events: DataFrame) -> DataFrame:
    """RAW-shaped flight rows plus ``loaded_at``."""
    e, u = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    source_index, dest_index = u % 6, (u * 7 + e) % 6
    code = _pick(AIRLINE_CODES, u % 5)
    name = _pick(AIRLINES, u % 5)
    airport = _pick(AIRPORTS, source_index)

    number = F.when(e % 50 == 49, e - 1).otherwise(e)
    copies = F.when(number % 83 == 0, F.array(F.lit("E"), F.lit("N"))).otherwise(F.array(F.lit("E")))
    shifted = F.when(F.col("prefix") == "N", ts + F.expr("INTERVAL 2 SECONDS")).otherwise(ts)

    return events.withColumn("prefix", F.explode(copies)).select(
        F.concat("prefix", F.lpad(number.cast("string"), 9, "0")).alias("event_id"),
        _unless(e % 97 == 0, F.concat(code, (u + 100).cast("string"))).alias("flight_id"),
        F.when(e % 3 == 0, F.concat(F.lit("  "), F.lower(name), F.lit(" "))).otherwise(name).alias("airline"),
        code.alias("airline_iata"),
        (u + 100).cast("string").alias("flight_number"),
        F.when(e % 61 == 0, "???").when(e % 7 == 0, F.lower(airport)).otherwise(airport).alias("source_airport"),
        _pick(AIRPORTS, dest_index).alias("dest_airport"),
        F.when(e % 59 == 0, "").otherwise(_pick(CITIES, source_index)).alias("source_city"),
        _pick(CITIES, dest_index).alias("dest_city"),
        F.when(e % 53 == 0, F.lit(None).cast("double")).when(e % 211 == 0, 999.0)
        .otherwise(((e * 37) % 1000).cast("double") / 16 - 10).alias("latitude"),
        (((e * 53) % 2000).cast("double") / 16 + 30).alias("longitude"),
        _unless(e % 41 == 0, (e * 7919) % 45000 - 1000).alias("altitude"),
        _unless(e % 43 == 0, ((e * 104729) % 10000).cast("double") / 8 - 20).alias("speed"),
        _unless(e % 71 == 0, ((e * 13) % 360).cast("double")).alias("heading"),
        lookup(STATUSES, F.col("event_type")).alias("status"),
        (ts - F.make_dt_interval(mins=(e % 180).cast("int"))).alias("departure_time"),
        (ts + F.make_dt_interval(mins=((e * 3) % 240).cast("int"))).alias("arrival_time"),
        F.when(e % 47 == 0, F.lit(None).cast("bigint")).when(e % 10 < 6, F.lit(0).cast("bigint"))
        .otherwise((e * 31) % 260 - 5).alias("delay_minutes"),
        _pick(AIRCRAFT, e % 5).alias("aircraft_type"),
        shifted.alias("event_timestamp"),
        F.lit("simulator").alias("source"),
        (ts + F.expr("INTERVAL 5 MINUTES")).alias("loaded_at"),
    ).select(*RAW_COLUMNS, "loaded_at")


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flights_from_events(read_events(spark, sf_dir))
