"""Dashboard slices: column subsets, top lists and map data over reports and FACT."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.functions import flight, numbers, times
from skyledger.functions.numbers import count_where, percent
from skyledger.operators.ranking import latest_per
from skyledger.plans.star import is_status
from skyledger.plans.views import _with_names, verified_today
from skyledger.settings import AS_OF

# The columns that each dashboard table shows, in its order.
LEAGUE_COLUMNS = [
    "otp_rank", "airline_iata", "airline_name", "total_unique_flights", "otp_rate_pct", "avg_delay_minutes",
    "median_delay_minutes", "worst_single_delay", "pct_minor_delay", "pct_moderate_delay", "pct_major_delay",
    "pct_severe_delay", "avg_speed_kmh", "pct_international_flights", "composite_score", "performance_quartile",
]
DELAY_COLUMNS = [
    "event_date", "event_hour", "airline_iata", "avg_delay", "otp_rate_pct", "on_time", "minor_delays",
    "moderate_delays", "major_delays", "severe_delays", "delay_signal",
]
PEAK_COLUMNS = [
    "event_hour", "hour_label", "total_flights", "pct_of_daily_traffic", "avg_delay_minutes", "active_flights",
    "landings", "traffic_band", "traffic_rank",
]
ROUTE_COLUMNS = [
    "route_key", "source_airport", "dest_airport", "is_international", "total_flights", "otp_rate_pct",
    "avg_delay_minutes", "avg_speed_kmh", "cancellation_rate_pct", "efficiency_score", "route_health",
]
TREND_COLUMNS = [
    "event_date", "daily_flights", "otp_rate_pct", "avg_delay", "cancellations", "otp_last_week", "otp_pp_change",
    "delay_wow_pct", "otp_7day_rolling_avg", "otp_trend",
]
AIRPORT_COLUMNS = [
    "airport_code", "city", "total_movements", "departures", "arrivals", "avg_delay_minutes", "delay_rate_pct",
    "congestion_rank",
]
SEGMENT_COLUMNS = [
    "segment", "total_flights", "traffic_share_pct", "avg_delay_minutes", "avg_otp_rate_pct",
    "cancellation_rate_pct", "unique_routes",
]


def _best_and_worst(report: DataFrame, score: str, key: str, label: str, names: tuple[str, str], n: int) -> DataFrame:
    top = report.orderBy(F.desc(score), F.asc_nulls_last(key)).limit(n).withColumn(label, F.lit(names[0]))
    bottom = report.orderBy(F.asc(score), F.asc_nulls_last(key)).limit(n).withColumn(label, F.lit(names[1]))
    return top.unionByName(bottom)


def worst_hours(patterns: DataFrame, as_of: datetime = AS_OF, days: int = 7) -> DataFrame:
    return patterns.filter(F.col("event_date") >= times.days_before(as_of, days)).groupBy("event_hour").agg(
        F.round(F.avg("avg_delay"), 1).alias("avg_delay_all_airlines"),
        F.max("max_delay").alias("worst_single_delay"), F.sum("severe_delays").alias("total_severe_delays"),
    ).orderBy(F.desc("avg_delay_all_airlines"), "event_hour")


def league_extremes(league: DataFrame, n: int = 5) -> DataFrame:
    return _best_and_worst(league, "composite_score", "airline_iata", "tier", ("TOP 5", "BOTTOM 5"), n)


def peak_hours_ranked(peaks: DataFrame) -> DataFrame:
    return peaks.select("hour_label", "total_flights", "pct_of_daily_traffic", "traffic_band").orderBy(
        F.desc("total_flights"), "hour_label")


def route_extremes(routes: DataFrame, n: int = 5) -> DataFrame:
    return _best_and_worst(routes, "efficiency_score", "route_key", "category", ("BEST", "WORST"), n).select(
        "category", "route_key", "otp_rate_pct", "avg_delay_minutes", "route_health")


def recent_trend(trends: DataFrame, as_of: datetime = AS_OF, days: int = 14) -> DataFrame:
    return trends.filter(F.col("event_date") >= times.days_before(as_of, days)).select(
        "event_date", "daily_flights", "otp_rate_pct", "otp_last_week", "otp_pp_change", "otp_trend", "avg_delay",
        "delay_wow_pct").orderBy(F.desc("event_date"))


def league_slice(league: DataFrame) -> DataFrame:
    return league.select(LEAGUE_COLUMNS).orderBy("otp_rank", F.asc_nulls_last("airline_iata"))


def delay_slice(patterns: DataFrame, as_of: datetime = AS_OF, days: int = 7) -> DataFrame:
    return patterns.filter(F.col("event_date") >= times.days_before(as_of, days)).select(DELAY_COLUMNS).orderBy(
        "event_date", "event_hour")


def peak_slice(peaks: DataFrame) -> DataFrame:
    return peaks.select(PEAK_COLUMNS).orderBy("event_hour")


def route_slice(routes: DataFrame, n: int = 100) -> DataFrame:
    return routes.select(ROUTE_COLUMNS).orderBy(F.desc("efficiency_score"), F.asc_nulls_last("route_key")).limit(n)


def trend_slice(trends: DataFrame, as_of: datetime = AS_OF, days: int = 30) -> DataFrame:
    return trends.filter(F.col("event_date") >= times.days_before(as_of, days)).select(TREND_COLUMNS).orderBy("event_date")


def airport_slice(congestion: DataFrame, n: int = 20) -> DataFrame:
    return congestion.select(AIRPORT_COLUMNS).orderBy("congestion_rank", F.asc_nulls_last("airport_code")).limit(n)


def segment_slice(segments: DataFrame) -> DataFrame:
    return segments.select(SEGMENT_COLUMNS)


def active_today(fact: DataFrame, airlines: DataFrame, as_of: datetime = AS_OF, n: int | None = 20) -> DataFrame:
    """Airlines by distinct flights over the whole day, any status; all of them, or the first ``n``."""
    late = F.col("delay_bucket") != "on_time"
    stats = verified_today(fact, as_of).groupBy("airline_iata").agg(
        F.countDistinct("flight_id").alias("active_flights"),
        F.round(F.avg("altitude"), 0).alias("avg_altitude_ft"),
        F.round(F.avg("speed"), 1).alias("avg_speed_kmh"),
        F.round(F.avg("delay_minutes"), 1).alias("avg_delay_minutes"),
        percent(count_where(late), F.count("*"), 1).alias("pct_delayed"),
        F.max("event_timestamp").alias("last_seen_at"),
    ).filter("active_flights >= 1")
    ordered = _with_names(stats, airlines).orderBy(F.desc("active_flights"), F.asc_nulls_last("airline_iata"))
    return ordered if n is None else ordered.limit(n)


def live_positions(fact: DataFrame, as_of: datetime = AS_OF, n: int | None = 500) -> DataFrame:
    """Newest usable position of each flight today, newest first."""
    usable = verified_today(fact, as_of).filter((F.col("latitude") != 0) & (F.col("longitude") != 0))
    fallback = flight.route_key(F.col("source_airport"), F.col("dest_airport"))
    narrow = usable.select(
        "event_id", "flight_id", "airline_iata", "source_airport", "dest_airport",
        F.coalesce("route_key", fallback).alias("route_key"), "latitude", "longitude", "altitude", "speed", "status",
        "delay_minutes", F.coalesce("delay_bucket", F.lit("on_time")).alias("delay_bucket"),
        F.coalesce("flight_phase", F.lit("cruise")).alias("flight_phase"), "is_international", "event_timestamp")
    newest = latest_per(narrow, "flight_id", [F.desc("event_timestamp"), F.asc("event_id")]).drop("event_id")
    ordered = newest.orderBy(F.desc("event_timestamp"), "flight_id")
    return ordered if n is None else ordered.limit(n)


def flights_today(fact: DataFrame, as_of: datetime = AS_OF) -> DataFrame:
    return verified_today(fact, as_of).agg(F.countDistinct("flight_id").alias("total_active"))


def map_filter(positions: DataFrame, statuses: list[str] | None = None, phases: list[str] | None = None,
               international: bool | None = None) -> DataFrame:
    if statuses:
        positions = positions.filter(F.col("status").isin(statuses))
    if phases:
        positions = positions.filter(F.col("flight_phase").isin(phases))
    if international is not None:
        positions = positions.filter(F.col("is_international") == international)
    return positions


def map_kpis(positions: DataFrame) -> DataFrame:
    return positions.agg(
        F.countDistinct("flight_id").alias("tracked_flights"), count_where(is_status("active")).alias("active_flights"),
        F.avg("altitude").alias("avg_altitude"), F.avg("speed").alias("avg_speed"))


def map_marks(positions: DataFrame) -> DataFrame:
    """Dot radius grows with altitude; only high flights carry a label."""
    radius = (F.coalesce("altitude", F.lit(0)) / 1000 + 5) * 1500
    label = F.when(F.col("altitude") > 25000, F.col("airline_iata"))
    return positions.select("flight_id", "longitude", "latitude", "status", radius.alias("radius"), label.alias("label"))


def delay_heatmap(patterns: DataFrame) -> DataFrame:
    """Airline by hour, mean of the hourly mean delays; the 24 columns are known up front."""
    grid = patterns.groupBy("airline_iata").pivot("event_hour", list(range(24))).agg(F.round(F.avg("avg_delay"), 6))
    renamed = grid.select("airline_iata", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    return renamed.na.fill(0.0)


def top_by_otp(league: DataFrame, n: int = 15) -> DataFrame:
    return league.orderBy(F.desc("otp_rate_pct"), F.asc_nulls_last("airline_iata")).limit(n).select("airline_iata", "airline_name", "otp_rate_pct")


def fleet_means(league: DataFrame) -> DataFrame:
    """Fleet averages, best and worst airline by punctuality rank, mean bucket shares."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    by_rank = F.struct("otp_rank", "airline_iata")
    return league.agg(
        F.min_by("airline_name", by_rank).alias("best_airline"), F.max_by("airline_name", by_rank).alias("worst_airline"),
        mean("otp_rate_pct"), mean("avg_delay_minutes"), mean("pct_minor_delay"), mean("pct_moderate_delay"),
        mean("pct_major_delay"), mean("pct_severe_delay"))


def bubble_size(value: Column, largest: Column, scale: float, low: float, high: float) -> Column:
    return numbers.clip(F.coalesce(value, F.lit(0)) / F.greatest(largest, F.lit(1)) * scale + 5, low, high)


def route_bubbles(routes: DataFrame) -> DataFrame:
    """Bubble per route, sized against the busiest route (a scalar, not a global window)."""
    largest = routes.agg(F.max("total_flights")).scalar()
    size = bubble_size(F.col("total_flights"), largest, 40, 5.0, 45.0)
    return routes.select("route_key", "otp_rate_pct", "avg_delay_minutes", "route_health",
                         F.round(size, 6).alias("size"))


def run_bubbles(runs: DataFrame) -> DataFrame:
    largest = runs.agg(F.max("records_written")).scalar()
    size = bubble_size(F.col("records_written"), largest, 20, 5.0, 25.0)
    return runs.select("run_id", "status", "elapsed_seconds", F.round(size, 6).alias("size"))


def home_kpis(active: DataFrame, health: DataFrame) -> DataFrame:
    total = active.agg(F.coalesce(F.sum("active_flights"), F.lit(0))).scalar()
    return health.select(
        total.alias("total_active"), "raw_records_today", "clean_record_pct", "raw_lag_minutes", "overall_health")


def health_page(health: DataFrame) -> DataFrame:
    """Threshold labels of the health page."""
    clean, flagged = F.coalesce("clean_record_pct", F.lit(0.0)), F.coalesce("flagged_records_today", F.lit(0))
    return health.select(
        clean.alias("clean_record_pct"), F.when(clean >= 95, "Healthy").otherwise("Below threshold").alias("clean_label"),
        flagged.alias("flagged_records_today"), F.when(flagged < 50, "Low").otherwise("High").alias("flagged_label"),
        F.when(clean < 80, "red").when(clean < 95, "amber").otherwise("green").alias("gauge_band"),
        "raw_to_analytics_pct")
