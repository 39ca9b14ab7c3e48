"""Headline figures and verification summaries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.functions import times
from skyledger.functions.flight import DELAY_BUCKETS
from skyledger.functions.numbers import count_where, percent
from skyledger.operators.ranking import latest_per
from skyledger.plans.star import in_bucket, is_status
from skyledger.plans.views import verified_today
from skyledger.settings import AS_OF


def kpi_summary(active: DataFrame, league: DataFrame, congestion: DataFrame, health: DataFrame,
                as_of: datetime = AS_OF) -> DataFrame:
    """One row of headline numbers over four reports; missing figures read as 0 or NULL."""
    zero = lambda col: F.coalesce(col, F.lit(0.0))
    busiest = F.min_by(F.struct("airport_code", "city", "congestion_index"),
                       F.struct("congestion_rank", "airport_code"))
    best = F.min_by(F.struct("airline_name", "otp_rate_pct"), F.struct("otp_rank", "airline_iata"))
    now = active.agg(F.struct(F.coalesce(F.sum("active_flights"), F.lit(0)).alias("flights"),
                              zero(F.round(F.avg("avg_delay_minutes"), 1)).alias("delay")).alias("now"))
    fleet = league.agg(F.struct(zero(F.round(F.avg("otp_rate_pct"), 1)).alias("otp"), best.alias("best")).alias("fleet"))
    places = congestion.agg(busiest.alias("busiest"))
    figures = health.select("*", now.scalar().alias("now"), fleet.scalar().alias("fleet"), places.scalar().alias("busiest"))  # each report once
    return figures.select(
        F.col("now.flights").alias("active_flights_now"), F.col("fleet.otp").alias("fleet_otp_rate_pct"),
        F.col("now.delay").alias("avg_delay_minutes_now"), "busiest", F.col("fleet.best").alias("best"),
        F.col("overall_health").alias("health"),
        zero(F.col("clean_record_pct")).alias("clean_record_pct"),
        F.col("raw_lag_minutes").alias("lag_minutes"),
        times.as_timestamp(as_of).alias("generated_at"),
    ).select(
        "active_flights_now", "fleet_otp_rate_pct", "avg_delay_minutes_now",
        F.col("busiest.airport_code").alias("most_congested_code"),
        F.col("busiest.city").alias("most_congested_city"),
        F.col("busiest.congestion_index").alias("most_congested_index"),
        F.col("best.airline_name").alias("best_airline"), F.col("best.otp_rate_pct").alias("best_airline_otp_pct"),
        "health", "clean_record_pct", "lag_minutes", "generated_at")


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def volumes_of(raw: DataFrame, clean: DataFrame, fact: DataFrame) -> DataFrame:
    """What ``LayerStatistics.volumes`` gives, by scanning the layers."""
    def volume(layer: str, rows: DataFrame) -> DataFrame:
        return rows.agg(
            F.count("*").alias("total_rows"), F.countDistinct("flight_id").alias("unique_flights"),
            F.min("event_timestamp").alias("oldest"), F.max("event_timestamp").alias("newest"),
            F.max("loaded_at" if layer == "RAW" else "transformed_at").alias("stamp"),
        ).select(F.lit(layer).alias("layer"), "*")

    return _stack([volume("RAW", raw), volume("CLEAN", clean), volume("FACT", fact)])


def layer_volume(volumes: DataFrame, as_of: datetime = AS_OF) -> DataFrame:
    """Rows, distinct flights and event-time span of each layer, from its figures."""
    lag = times.minutes_between(F.col("newest"), times.as_timestamp(as_of))
    return volumes.select("layer", "total_rows", "unique_flights", F.col("oldest").alias("oldest_record"),
                          F.col("newest").alias("newest_record"), lag.alias("minutes_since_last_record"))


def layer_funnel(volumes: DataFrame) -> DataFrame:
    """Row counts of the layers and the share that reaches the next one, from their figures."""
    sizes = volumes.select(F.lower("layer").alias("layer"), F.col("total_rows").alias("n"))
    of = lambda name: F.max(F.when(F.col("layer") == name, F.col("n")))
    return sizes.agg(of("raw").alias("raw_count"), of("clean").alias("clean_count"), of("fact").alias("fact_count")).select(
        "*", percent(F.col("clean_count"), F.col("raw_count"), 2).alias("raw_to_clean_pct"),
        percent(F.col("fact_count"), F.col("clean_count"), 2).alias("clean_to_fact_pct"))


def airline_summary(airlines: DataFrame, n: int = 15) -> DataFrame:
    return airlines.select(
        F.col("airline_code").alias("airline_iata"), "airline_name", "total_flights",
        F.round("avg_delay_minutes", 1).alias("avg_delay_mins"), "active_flights", "last_seen_at",
    ).orderBy(F.desc("total_flights"), F.asc_nulls_last("airline_iata")).limit(n)


def delay_distribution(clean: DataFrame) -> DataFrame:
    """Rows per delay bucket with their share, from on time to severe."""
    buckets = clean.groupBy("delay_bucket").agg(
        F.count("*").alias("flights"), F.round(F.avg("delay_minutes"), 1).alias("avg_delay_in_bucket"))
    everything = F.sum("flights").over(W.partitionBy())  # five rows
    order = F.array_position(F.array(*[F.lit(b) for b in DELAY_BUCKETS]), F.col("delay_bucket"))
    return buckets.withColumn("pct_of_total", percent(F.col("flights"), everything, 2)).orderBy(order)


def busiest_routes(routes: DataFrame, as_of: datetime = AS_OF, n: int = 10) -> DataFrame:
    return routes.filter(F.col("event_date") == times.day_of(as_of)).select(
        "route_key", "total_flights", F.round("avg_delay_minutes", 1).alias("avg_delay_mins"),
        F.round(F.col("pct_on_time") * 100, 1).alias("pct_on_time"), "is_international",
    ).orderBy(F.desc("total_flights"), F.asc_nulls_last("route_key")).limit(n)


def hourly_traffic(hourly: DataFrame, as_of: datetime = AS_OF, days: int = 7) -> DataFrame:
    return hourly.filter(F.col("event_date") >= times.days_before(as_of, days)).groupBy("event_hour").agg(
        F.sum("unique_flights").alias("flights_this_hour"), F.round(F.avg("avg_delay"), 1).alias("avg_delay_mins"),
        F.sum("active_count").alias("active_flights"), F.sum("cancelled_count").alias("cancellations"),
    ).orderBy("event_hour")


def daily_error_rate(clean: DataFrame, n: int = 14) -> DataFrame:
    flagged = F.col("data_quality_flag")
    return clean.groupBy(F.to_date("transformed_at").alias("check_date")).agg(
        F.count("*").alias("total_records"), count_where(flagged).alias("flagged_records"),
        percent(count_where(flagged), F.count("*"), 2).alias("error_rate_pct"),
    ).orderBy(F.desc("check_date")).limit(n)


def raw_load_stats(volumes: DataFrame, done: Column, as_of: datetime = AS_OF) -> DataFrame:
    """RAW rows, those not transformed yet (``done`` are), and the newest load, from the figures of the layers."""
    newest = F.col("stamp")
    return volumes.filter("layer = 'RAW'").select(
        F.col("total_rows").alias("total_raw_records"), (F.col("total_rows") - done).alias("pending_transformation"),
        newest.alias("latest_record"), times.minutes_between(newest, times.as_timestamp(as_of)).alias("minutes_since_last_load"))


def speed_and_delay(fact: DataFrame, day: Column | None = None, airline: str | None = None) -> DataFrame:
    """Row count and means, of the whole table or of one day and airline (pruned)."""
    if day is not None:
        fact = fact.filter(F.col("event_date") == day)
    if airline is not None:
        fact = fact.filter(F.col("airline_iata") == airline)
    return fact.agg(F.count("*").alias("events"), F.avg("speed").alias("avg_speed"),
                    F.avg("delay_minutes").alias("avg_delay"))


def daily_summary(fact: DataFrame, as_of: datetime = AS_OF) -> DataFrame:
    return verified_today(fact, as_of).agg(
        F.countDistinct("flight_id").alias("unique_flights"), F.count("*").alias("total_events"),
        F.coalesce(F.round(F.avg("delay_minutes"), 1), F.lit(0.0)).alias("avg_delay_mins"),
        F.coalesce(percent(count_where(in_bucket("on_time")), F.count("*"), 1), F.lit(0.0)).alias("otp_rate_pct"),
        count_where(is_status("cancelled")).alias("cancellations"),
        F.countDistinct("airline_iata").alias("active_airlines"), F.countDistinct("route_key").alias("routes_flown"),
    ).select(times.day_of(as_of).alias("report_date"), "*")


# --- Views named in the documentation only ---------------------------------------------

def airline_fleet_summary(fact: DataFrame) -> DataFrame:
    """Aircraft types per airline; the inner grouping bounds the set to one entry per type."""
    pairs = fact.filter(F.col("aircraft_type").isNotNull()).groupBy("airline_iata", "aircraft_type").agg(
        F.count("*").alias("n"))
    return pairs.groupBy("airline_iata").agg(
        F.count("*").alias("aircraft_types"), F.sum("n").alias("events"),
        F.array_join(F.sort_array(F.collect_list("aircraft_type")), ",").alias("types"))


def arrival_performance(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("dest_airport").isNotNull()).groupBy("dest_airport").agg(
        F.countDistinct("flight_id").alias("arriving_flights"),
        F.round(F.avg("delay_minutes"), 2).alias("avg_delay_minutes"),
        F.max("delay_minutes").alias("max_delay_minutes"),
        percent(count_where(in_bucket("on_time")), F.count("*"), 2).alias("otp_rate_pct"))


def weekly_patterns(fact: DataFrame) -> DataFrame:
    return fact.groupBy("day_of_week").agg(
        F.countDistinct("flight_id").alias("flights"), F.count("*").alias("events"),
        F.round(F.avg("delay_minutes"), 2).alias("avg_delay_minutes"))


def real_time_status(fact: DataFrame) -> DataFrame:
    """Flights by the status of their newest event."""
    newest = latest_per(fact.select("flight_id", "status", "event_timestamp", "event_id"), "flight_id",
                        [F.desc("event_timestamp"), F.asc("event_id")])
    counts = newest.groupBy("status").agg(F.count("*").alias("flights"))
    return counts.withColumn("pct_of_flights", percent(F.col("flights"), F.sum("flights").over(W.partitionBy()), 2))
