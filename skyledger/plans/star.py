"""Star schema: fact rows, dimensions and pre-aggregated tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import flight, times
from skyledger.functions.numbers import count_where, fraction
from skyledger.schemas import FACT_COLUMNS
from skyledger.settings import AS_OF

HOURLY_KEYS = ["event_date", "event_hour", "airline_iata"]
ROUTE_KEYS = ["event_date", "source_airport", "dest_airport"]
ROUTE_UPDATES = [
    "total_flights", "total_events", "avg_delay_minutes", "max_delay_minutes", "pct_on_time",
    "pct_delayed", "avg_speed", "avg_cruise_altitude", "summary_created_at",
]


def is_status(name: str) -> Column:
    return F.col("status") == name


def in_bucket(name: str) -> Column:
    return F.col("delay_bucket") == name


def fact_rows(clean: DataFrame, as_of: datetime = AS_OF, lookback_minutes: int | None = None) -> DataFrame:
    """Unflagged clean rows with date parts (Sunday = 0); optionally only recent ones."""
    rows = clean.filter(~F.col("data_quality_flag"))
    if lookback_minutes is not None:
        rows = rows.filter(F.col("transformed_at") >= times.ago(as_of, minutes=lookback_minutes))
    ts = F.col("event_timestamp")
    fallback = flight.route_key(F.col("source_airport"), F.col("dest_airport"))
    return rows.withColumns({
        "route_key": F.coalesce("route_key", fallback),
        "event_date": F.to_date(ts),
        "event_hour": F.hour(ts),
        "day_of_week": times.sunday_zero(ts),
    }).select(*FACT_COLUMNS)


def dim_airlines(clean: DataFrame) -> DataFrame:
    return clean.groupBy(F.col("airline_iata").alias("airline_code")).agg(
        F.max("airline").alias("airline_name"),
        F.countDistinct("flight_id").alias("total_flights"),
        F.avg("delay_minutes").alias("avg_delay_minutes"),
        count_where(is_status("active")).alias("active_flights"),
        F.max("transformed_at").alias("last_seen_at"),
    )


def dim_airports(clean: DataFrame) -> DataFrame:
    """Both ends of each row in one scan and one aggregation."""
    ends = F.explode(F.array(
        F.struct(F.col("source_airport").alias("code"), F.col("source_city").alias("city"),
                 F.lit(1).alias("dep"), F.lit(0).alias("arr")),
        F.struct(F.col("dest_airport").alias("code"), F.col("dest_city").alias("city"),
                 F.lit(0).alias("dep"), F.lit(1).alias("arr")),
    ))
    return clean.select(ends.alias("end"), "transformed_at").groupBy(F.col("end.code").alias("airport_code")).agg(
        F.max("end.city").alias("city"),
        F.sum("end.dep").alias("total_departures"),
        F.sum("end.arr").alias("total_arrivals"),
        F.max("transformed_at").alias("last_activity"),
    )


def _hourly(fact: DataFrame, created_at: datetime, rounded: bool) -> DataFrame:
    digits = (lambda col, n: F.round(col, n)) if rounded else (lambda col, n: col)
    extra = [count_where(~F.col("is_international")).alias("domestic_flights")] if rounded else []
    return fact.groupBy(*HOURLY_KEYS).agg(
        F.countDistinct("flight_id").alias("unique_flights"),
        F.count("*").alias("total_events"),
        digits(F.avg("altitude"), 0).alias("avg_altitude"),
        digits(F.avg("speed"), 1).alias("avg_speed"),
        digits(F.avg("delay_minutes"), 1).alias("avg_delay"),
        F.max("delay_minutes").alias("max_delay"),
        count_where(is_status("active")).alias("active_count"),
        count_where(is_status("landed")).alias("landed_count"),
        count_where(is_status("cancelled")).alias("cancelled_count"),
        count_where(F.col("is_international")).alias("intl_flights"),
        *extra,
    ).withColumn("summary_created_at", times.as_timestamp(created_at))


def hourly_summary(fact: DataFrame, as_of: datetime = AS_OF, days: int = 7) -> DataFrame:
    """Per day, hour and airline over the look-back, unrounded."""
    return _hourly(fact.filter(F.col("event_date") >= times.days_before(as_of, days)), as_of, rounded=False)


def hourly_of_days(fact: DataFrame, as_of: datetime = AS_OF) -> DataFrame:
    """The rounded summary of every day in ``fact``."""
    return _hourly(fact, as_of, rounded=True)


def hourly_refresh(fact: DataFrame, day: date | Column, as_of: datetime = AS_OF) -> DataFrame:
    """The rounded summary of one day, to replace that day."""
    wanted = (F.col("event_date") == day) & ~F.col("data_quality_flag")
    return _hourly(fact.filter(wanted), as_of, rounded=True)


def _routes(rows: DataFrame, as_of: datetime) -> DataFrame:
    late = F.col("delay_bucket") != "on_time"
    return rows.groupBy(*ROUTE_KEYS).agg(
        F.countDistinct("flight_id").alias("total_flights"),
        F.count("*").alias("total_events"),
        F.round(F.avg("delay_minutes"), 2).alias("avg_delay_minutes"),
        F.max("delay_minutes").alias("max_delay_minutes"),
        fraction(count_where(in_bucket("on_time")), F.count("*"), 4).alias("pct_on_time"),
        fraction(count_where(late), F.count("*"), 4).alias("pct_delayed"),
        F.round(F.avg("speed"), 2).alias("avg_speed"),
        F.round(F.avg(F.when(F.col("flight_phase") == "cruise", F.col("altitude"))), 0).alias("avg_cruise_altitude"),
        F.max("is_international").alias("is_international"),
    ).withColumns({
        "route_key": flight.route_key(F.col("source_airport"), F.col("dest_airport")),
        "summary_created_at": times.as_timestamp(as_of),
    })


def routes_from_clean(clean: DataFrame, as_of: datetime = AS_OF, days: int = 7) -> DataFrame:
    """Daily route performance over the look-back; the day filter prunes partitions."""
    start = times.ago(as_of, days=days)
    recent = (F.col("event_date") >= F.to_date(start)) & (F.col("event_timestamp") >= start)
    return _routes(clean.filter(~F.col("data_quality_flag") & recent), as_of)


def routes_from_fact(fact: DataFrame, as_of: datetime = AS_OF) -> DataFrame:
    """Today's route performance without self-loops."""
    today = (F.col("event_date") == times.day_of(as_of)) & ~F.col("data_quality_flag")
    return _routes(fact.filter(today & (F.col("source_airport") != F.col("dest_airport"))), as_of)
