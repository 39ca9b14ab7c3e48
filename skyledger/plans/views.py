"""The ten business reports.

Every report prunes days on the partition column, aggregates to report grain first
and only then joins dimensions or ranks, so windows and joins see a few rows per
airline, airport, hour or day. Ties are broken by natural key where the report needs
one definite row. Four of them need a distribution or distinct counts over their
look-back; they read FACT or the day partials of their profile.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.functions import times
from skyledger.functions.numbers import count_where, percent
from skyledger.operators import aggregates as A
from skyledger.operators.ranking import latest_per, rank_desc_then_asc
from skyledger.plans.profiles import Profile, verified
from skyledger.plans.star import in_bucket, is_status
from skyledger.settings import AS_OF, UNKNOWN_AIRCRAFT
from skyledger.sources.snapshots import DayTable

Source = DataFrame | DayTable  # FACT, or the table of a profile's day partials


def _on_time() -> Column:
    return in_bucket("on_time")


def _late() -> Column:
    return F.col("delay_bucket") != "on_time"


def _abroad() -> Column:
    return F.col("is_international")


def verified_today(fact: DataFrame, as_of: datetime) -> DataFrame:
    return fact.filter((F.col("event_date") == times.day_of(as_of)) & ~F.col("data_quality_flag"))


def _rank(by: Column) -> Column:
    return F.rank().over(W.orderBy(by))


def _with_names(stats: DataFrame, airlines: DataFrame) -> DataFrame:
    """Add airline_name; the dimension is one row per code and joins report rows only."""
    names = airlines.select(F.col("airline_code").alias("_code"), F.col("airline_name").alias("_name"))
    joined = stats.join(names, F.col("airline_iata") == F.col("_code"), "left")
    return joined.withColumn("airline_name", F.coalesce("_name", "airline_iata")).drop("_code", "_name")


def active_airlines_now(fact: DataFrame, airlines: DataFrame, as_of: datetime = AS_OF, minutes: int = 30) -> DataFrame:
    """Airlines by flights in the air, from each flight's newest active position."""
    live = verified_today(fact, as_of).filter(
        is_status("active") & (F.col("event_timestamp") >= times.ago(as_of, minutes=minutes)))
    narrow = live.select("flight_id", "airline_iata", "altitude", "speed", "delay_minutes", "delay_bucket",
                         "route_key", "event_timestamp", "event_id")
    positions = latest_per(narrow, "flight_id", [F.desc("event_timestamp"), F.asc("event_id")])
    stats = positions.groupBy("airline_iata").agg(
        F.count("*").alias("active_flights"),
        F.round(F.avg("altitude"), 0).alias("avg_altitude_ft"),
        F.round(F.avg("speed"), 1).alias("avg_speed_kmh"),
        F.round(F.avg("delay_minutes"), 1).alias("avg_delay_minutes"),
        F.max("delay_minutes").alias("max_delay_minutes"),
        count_where(_on_time()).alias("on_time_count"),
        count_where(_late()).alias("delayed_count"),
        percent(count_where(_late()), F.count("*"), 1).alias("pct_delayed"),
        F.countDistinct("route_key").alias("active_routes"),
        F.max("event_timestamp").alias("last_seen_at"),
    )
    return _with_names(stats, airlines).select(
        _rank(F.desc("active_flights")).cast("bigint").alias("activity_rank"), "airline_iata", "airline_name",
        "active_flights", "avg_altitude_ft", "avg_speed_kmh", "avg_delay_minutes", "max_delay_minutes",
        "on_time_count", "delayed_count", "pct_delayed", "active_routes", "last_seen_at",
    ).orderBy(F.desc("active_flights"), F.asc_nulls_last("airline_iata"))


DELAYS = Profile(
    "delays", ("event_date", "event_hour", "airline_iata"), {"flights": "flight_id"},
    lambda: [
        A.mean("avg_delay", F.col("delay_minutes"), 2),
        A.quantile("median_delay", 0.5, 2),
        A.largest("max_delay", F.col("delay_minutes")),
        A.quantile("p90_delay", 0.9, 2),  # tenths at most, so two digits lose nothing
        A.occurrences("on_time", _on_time()),
        A.occurrences("minor_delays", in_bucket("minor_delay")),
        A.occurrences("moderate_delays", in_bucket("moderate_delay")),
        A.occurrences("major_delays", in_bucket("major_delay")),
        A.occurrences("severe_delays", in_bucket("severe_delay")),
        A.share("otp_rate_pct", _on_time(), 2),
    ])


def delay_patterns(fact: Source, as_of: datetime = AS_OF, days: int = 30) -> DataFrame:
    """Hourly delay profile per airline with change, rolling mean and spike signal."""
    hourly = DELAYS.summary(fact, as_of, days)
    hours = W.partitionBy("airline_iata", "event_date").orderBy("event_hour")
    trend = hourly.withColumns({
        "prev_hour_avg_delay": F.lag("avg_delay").over(hours),
        "_rolling": F.avg("avg_delay").over(hours.rowsBetween(-2, 0)),
    })
    signal = (F.when(F.col("avg_delay") > F.col("_rolling") * 1.5, "DELAY_SPIKE")
              .when(F.col("avg_delay") < F.col("_rolling") * 0.7, "IMPROVING").otherwise("NORMAL"))
    return trend.select(
        "event_date", "event_hour", "airline_iata", "flights", "avg_delay", "median_delay", "max_delay",
        "p90_delay", "on_time", "minor_delays", "moderate_delays", "major_delays", "severe_delays",
        "otp_rate_pct", "prev_hour_avg_delay",
        F.round(F.col("avg_delay") - F.col("prev_hour_avg_delay"), 2).alias("delay_delta_vs_prev_hour"),
        F.round("_rolling", 2).alias("rolling_3h_avg_delay"), signal.alias("delay_signal"),
    ).orderBy(F.desc("event_date"), "event_hour", F.asc_nulls_last("airline_iata"))


LEAGUE = Profile(
    "league", ("airline_iata",), {"total_unique_flights": "flight_id", "days_of_data": "event_date", "unique_routes_flown": "route_key"},
    lambda: [
        A.share("otp_rate_pct", _on_time(), 2),
        A.mean("avg_delay_minutes", F.col("delay_minutes"), 2),
        A.quantile("median_delay_minutes", 0.5, 2),
        A.largest("worst_single_delay", F.col("delay_minutes")),
        A.share("pct_minor_delay", in_bucket("minor_delay"), 1),
        A.share("pct_moderate_delay", in_bucket("moderate_delay"), 1),
        A.share("pct_major_delay", in_bucket("major_delay"), 1),
        A.share("pct_severe_delay", in_bucket("severe_delay"), 1),
        A.mean("avg_speed_kmh", F.col("speed"), 1),
        A.mean("avg_altitude_ft", F.col("altitude"), 0),
        A.share("pct_international_flights", _abroad(), 1),
        A.deviation("delay_stddev_minutes", 2),
    ])


def airline_league(fact: Source, airlines: DataFrame, as_of: datetime = AS_OF, days: int = 30,
                   min_flights: int = 5) -> DataFrame:
    """Airlines with enough flights, ranked by punctuality, delay and consistency."""
    stats = LEAGUE.summary(fact, as_of, days).filter(F.col("total_unique_flights") >= min_flights)
    score = (F.col("otp_rate_pct") * 0.6
             + (100 - F.least("avg_delay_minutes", F.lit(100.0))) * 0.3
             + F.when(F.col("delay_stddev_minutes").isNotNull(),
                      (100 - F.least("delay_stddev_minutes", F.lit(100.0))) * 0.1))
    quartile = F.ntile(4).over(W.orderBy(F.desc("otp_rate_pct"), F.asc_nulls_last("airline_iata")))
    return _with_names(stats, airlines).select(
        _rank(F.desc("otp_rate_pct")).cast("bigint").alias("otp_rank"),
        _rank(F.asc("avg_delay_minutes")).cast("bigint").alias("delay_rank"),
        _rank(F.asc_nulls_last("delay_stddev_minutes")).cast("bigint").alias("consistency_rank"),
        quartile.cast("bigint").alias("performance_quartile"),
        "airline_iata", "airline_name", "total_unique_flights", "days_of_data", "unique_routes_flown",
        "otp_rate_pct", "avg_delay_minutes", "median_delay_minutes", "worst_single_delay",
        "pct_minor_delay", "pct_moderate_delay", "pct_major_delay", "pct_severe_delay",
        "avg_speed_kmh", "avg_altitude_ft", "pct_international_flights", "delay_stddev_minutes",
        F.round(score, 2).alias("composite_score"),
    ).orderBy(F.desc("composite_score"), F.asc_nulls_last("airline_iata"))


def peak_hours(fact: DataFrame, as_of: datetime = AS_OF, days: int = 30) -> DataFrame:
    """Hours of the day by traffic. Hour totals add up the distinct flights of each weekday."""
    by_weekday = verified(fact, as_of, days).groupBy("event_hour", "day_of_week").agg(
        F.countDistinct("flight_id").alias("flights"),
        F.count("*").alias("events"),
        F.round(F.avg("speed"), 1).alias("speed"),
        F.round(F.avg("altitude"), 0).alias("altitude"),
        F.round(F.avg("delay_minutes"), 2).alias("delay"),
        count_where(is_status("active")).alias("active"),
        count_where(is_status("landed")).alias("landed"),
        count_where(is_status("cancelled")).alias("cancelled"),
    )
    hours = by_weekday.groupBy("event_hour").agg(
        F.sum("flights").alias("total_flights"),
        F.sum("events").alias("total_events"),
        F.round(F.avg("speed"), 1).alias("avg_speed"),
        F.round(F.avg("altitude"), 0).alias("avg_altitude"),
        F.round(F.avg("delay"), 2).alias("avg_delay_minutes"),
        F.sum("active").alias("active_flights"),
        F.sum("landed").alias("landings"),
        F.sum("cancelled").alias("cancellations"),
    )
    everything = W.partitionBy()  # 24 rows
    edge = lambda p: F.percentile("total_flights", p).over(everything)
    band = (F.when(F.col("total_flights") >= edge(0.80), "PEAK")
            .when(F.col("total_flights") >= edge(0.50), "BUSY")
            .when(F.col("total_flights") >= edge(0.25), "MODERATE").otherwise("QUIET"))
    return hours.select(
        "event_hour",
        F.concat(F.lpad(F.col("event_hour").cast("string"), 2, "0"), F.lit(":00")).alias("hour_label"),
        "total_flights", "total_events",
        percent(F.col("total_flights"), F.sum("total_flights").over(everything), 2).alias("pct_of_daily_traffic"),
        "avg_speed", "avg_altitude", "avg_delay_minutes", "active_flights", "landings", "cancellations",
        band.alias("traffic_band"),
        _rank(F.desc("total_flights")).cast("bigint").alias("traffic_rank"),
    ).orderBy("event_hour")


def airport_congestion(fact: DataFrame, airports: DataFrame, as_of: datetime = AS_OF, days: int = 7) -> DataFrame:
    """Airports by movements and delay; departures and arrivals come from one scan."""
    ends = F.explode(F.array(
        F.struct(F.col("source_airport").alias("code"), F.lit("departure").alias("kind")),
        F.struct(F.col("dest_airport").alias("code"), F.lit("arrival").alias("kind")),
    )).alias("end")
    movements = verified(fact, as_of, days).select(ends, "flight_id", "delay_minutes", "delay_bucket")
    per_kind = movements.filter("end.code IS NOT NULL").groupBy(
        F.col("end.code").alias("airport_code"), F.col("end.kind").alias("kind")).agg(
        F.countDistinct("flight_id").alias("flights"),
        F.round(F.avg("delay_minutes"), 2).alias("delay"),
        F.max("delay_minutes").alias("worst"),
        count_where(_late()).alias("late"),
    )
    flights_of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("flights"))), F.lit(0))
    stats = per_kind.groupBy("airport_code").agg(
        F.sum("flights").alias("total_movements"),
        flights_of("departure").alias("departures"),
        flights_of("arrival").alias("arrivals"),
        F.round(F.avg("delay"), 2).alias("avg_delay_minutes"),
        F.max("worst").alias("max_delay_minutes"),
        F.sum("late").alias("total_delayed"),
        percent(F.sum("late"), F.sum("flights"), 2).alias("delay_rate_pct"),
        F.round(F.sum("flights") * 0.5 + F.avg("delay") * 0.5, 2).alias("congestion_index"),
    )
    cities = airports.select(F.col("airport_code").alias("_code"), F.col("city").alias("_city"))
    return stats.join(cities, F.col("airport_code") == F.col("_code"), "left").select(
        _rank(F.desc("total_movements")).cast("bigint").alias("traffic_rank"),
        _rank(F.desc("delay_rate_pct")).cast("bigint").alias("delay_rank"),
        _rank(F.desc("congestion_index")).cast("bigint").alias("congestion_rank"),
        "airport_code", F.coalesce("_city", "airport_code").alias("city"), "total_movements", "departures",
        "arrivals", "avg_delay_minutes", "max_delay_minutes", "total_delayed", "delay_rate_pct", "congestion_index",
    ).orderBy(F.desc("congestion_index"), F.asc_nulls_last("airport_code"))


ROUTES = Profile(
    "routes", ("route_key", "source_airport", "dest_airport", "is_international"),
    {"total_flights": "flight_id", "days_operated": "event_date", "airlines_on_route": "airline_iata"},
    lambda: [
        A.mean("avg_speed_kmh", F.col("speed"), 1),
        A.mean("avg_altitude_ft", F.col("altitude"), 0),
        A.mean("avg_delay_minutes", F.col("delay_minutes"), 2),
        A.quantile("median_delay_minutes", 0.5, 2),
        A.largest("worst_delay_minutes", F.col("delay_minutes")),
        A.share("otp_rate_pct", _on_time(), 2),
        A.occurrences("cancellations", is_status("cancelled")),
        A.share("cancellation_rate_pct", is_status("cancelled"), 2),
    ],
    lambda rows: rows.filter(~F.col("route_key").contains("???") & (F.col("source_airport") != F.col("dest_airport"))))


def route_efficiency(fact: Source, as_of: datetime = AS_OF, days: int = 30, min_flights: int = 3) -> DataFrame:
    """Routes between known, different airports, scored on punctuality, speed and cancellations."""
    stats = ROUTES.summary(fact, as_of, days).filter(F.col("total_flights") >= min_flights)
    otp, cancel = F.col("otp_rate_pct"), F.col("cancellation_rate_pct")
    score = otp * 0.5 + F.least(F.col("avg_speed_kmh") / 10, F.lit(100.0)) * 0.3 + (100 - cancel) * 0.2
    health = (F.when((otp >= 90) & (cancel < 2), "EXCELLENT").when((otp >= 75) & (cancel < 5), "GOOD")
              .when(otp >= 60, "AVERAGE").when(otp >= 40, "POOR").otherwise("CRITICAL"))
    ranked = rank_desc_then_asc(stats, "efficiency_rank", "otp_rate_pct", "avg_delay_minutes")
    return ranked.select(
        F.col("efficiency_rank").cast("bigint").alias("efficiency_rank"), "route_key", "source_airport",
        "dest_airport", "is_international", "total_flights", "days_operated", "airlines_on_route",
        "avg_speed_kmh", "avg_altitude_ft", "avg_delay_minutes", "median_delay_minutes", "worst_delay_minutes",
        "otp_rate_pct", "cancellations", "cancellation_rate_pct",
        F.round(score, 2).alias("efficiency_score"), health.alias("route_health"),
    ).orderBy(F.desc("efficiency_score"), F.asc_nulls_last("route_key"))


AIRCRAFT = Profile(
    "aircraft", ("aircraft_type",), {"flights_operated": "flight_id", "airlines_using": "airline_iata"},
    lambda: [
        A.mean("avg_cruise_speed_kmh", F.col("speed"), 1),
        A.mean("avg_cruise_altitude_ft", F.col("altitude"), 0),
        A.mean("avg_delay_minutes", F.col("delay_minutes"), 2),
        A.quantile("median_delay_minutes", 0.5, 2),
        A.share("otp_rate_pct", _on_time(), 2),
        A.share("pct_intl_routes", _abroad(), 1),
        A.deviation("_deviation"),
    ],
    lambda rows: rows.filter((F.col("flight_phase") == "cruise") & F.col("aircraft_type").isNotNull()
                             & ~F.col("aircraft_type").isin(UNKNOWN_AIRCRAFT)))

PROFILES = [DELAYS, LEAGUE, ROUTES, AIRCRAFT]


def aircraft_performance(fact: Source, as_of: datetime = AS_OF, days: int = 30, min_flights: int = 3) -> DataFrame:
    """Known aircraft types in cruise."""
    stats = AIRCRAFT.summary(fact, as_of, days).filter(F.col("flights_operated") >= min_flights)
    return stats.select(
        "aircraft_type", "flights_operated", "airlines_using", "avg_cruise_speed_kmh", "avg_cruise_altitude_ft",
        "avg_delay_minutes", "median_delay_minutes", "otp_rate_pct", "pct_intl_routes",
        F.round(F.col("otp_rate_pct") - F.col("_deviation"), 2).alias("reliability_index"),
        _rank(F.desc("otp_rate_pct")).cast("bigint").alias("otp_rank"),
        _rank(F.desc("avg_cruise_speed_kmh")).cast("bigint").alias("speed_rank"),
    ).orderBy(F.desc("otp_rate_pct"), "aircraft_type")


def weekly_trends(fact: DataFrame, as_of: datetime = AS_OF, days: int = 60) -> DataFrame:
    """Daily figures against seven rows earlier, with a seven-row rolling punctuality."""
    daily = verified(fact, as_of, days).groupBy("event_date").agg(
        F.countDistinct("flight_id").alias("daily_flights"),
        F.round(F.avg("delay_minutes"), 2).alias("avg_delay"),
        percent(count_where(_on_time()), F.count("*"), 2).alias("otp_rate_pct"),
        count_where(is_status("cancelled")).alias("cancellations"),
        F.round(F.avg("speed"), 1).alias("avg_speed"),
        count_where(_abroad()).alias("intl_flights"),
        F.countDistinct("airline_iata").alias("active_airlines"),
    )
    by_day = W.orderBy("event_date")  # at most one row per day of the look-back
    before = daily.withColumns({
        "flights_last_week": F.lag("daily_flights", 7).over(by_day),
        "avg_delay_last_week": F.lag("avg_delay", 7).over(by_day),
        "otp_last_week": F.lag("otp_rate_pct", 7).over(by_day),
        "cancellations_last_week": F.lag("cancellations", 7).over(by_day),
        "_rolling": F.avg("otp_rate_pct").over(by_day.rowsBetween(-6, 0)),
    })
    change = F.col("otp_rate_pct") - F.col("otp_last_week")
    trend = (F.when(F.col("otp_rate_pct") > F.col("otp_last_week") + 2, "IMPROVING")
             .when(F.col("otp_rate_pct") < F.col("otp_last_week") - 2, "DEGRADING").otherwise("STABLE"))
    growth = lambda now, then: percent(F.col(now) - F.col(then), F.col(then), 2)
    return before.select(
        "event_date", "daily_flights", "avg_delay", "otp_rate_pct", "cancellations", "avg_speed", "intl_flights",
        "active_airlines", "flights_last_week", "avg_delay_last_week", "otp_last_week", "cancellations_last_week",
        growth("daily_flights", "flights_last_week").alias("flights_wow_pct"),
        growth("avg_delay", "avg_delay_last_week").alias("delay_wow_pct"),
        F.round(change, 2).alias("otp_pp_change"),
        F.round("_rolling", 2).alias("otp_7day_rolling_avg"),
        trend.alias("otp_trend"),
    ).orderBy(F.desc("event_date"))


def intl_vs_domestic(fact: DataFrame, as_of: datetime = AS_OF, days: int = 30) -> DataFrame:
    """The two segments: daily figures first, then averages of the daily figures.

    Rounded figures are averaged as decimals: their mean often lies just between two
    results, and sums of doubles would decide by the order of the rows.
    """
    def exact_mean(name: str, digits: int) -> Column:
        return F.round(F.avg(F.col(name).cast(f"decimal(18,{digits})")), digits).cast("double")

    segment = F.when(_abroad(), "International").otherwise("Domestic")
    daily = verified(fact, as_of, days).groupBy(segment.alias("segment"), "event_date").agg(
        F.countDistinct("flight_id").alias("flights"),
        F.countDistinct("route_key").alias("routes"),
        F.countDistinct("airline_iata").alias("carriers"),
        F.round(F.avg("delay_minutes"), 2).alias("delay"),
        F.round(F.avg("speed"), 1).alias("speed"),
        F.round(F.avg("altitude"), 0).alias("altitude"),
        percent(count_where(_on_time()), F.count("*"), 2).alias("otp"),
        count_where(in_bucket("severe_delay")).alias("severe"),
        count_where(is_status("cancelled")).alias("cancelled"),
    )
    totals = daily.groupBy("segment").agg(
        F.count("*").alias("days_of_data"),
        F.sum("flights").alias("total_flights"),
        F.max("routes").alias("unique_routes"),
        F.max("carriers").alias("airlines"),
        exact_mean("delay", 2).alias("avg_delay_minutes"),
        exact_mean("speed", 1).alias("avg_speed_kmh"),
        F.round(F.avg("altitude"), 0).alias("avg_altitude_ft"),
        exact_mean("otp", 2).alias("avg_otp_rate_pct"),
        F.sum("severe").alias("total_severe_delays"),
        F.sum("cancelled").alias("total_cancellations"),
        percent(F.sum("cancelled"), F.sum("flights"), 2).alias("cancellation_rate_pct"),
    )
    all_flights = F.sum("total_flights").over(W.partitionBy())  # two rows
    return totals.withColumn("traffic_share_pct", percent(F.col("total_flights"), all_flights, 2)).orderBy(
        F.desc("total_flights"), "segment")


def freshness_label(minutes: Column) -> Column:
    return (F.when(minutes <= 10, "FRESH").when(minutes <= 30, "ACCEPTABLE")
            .when(minutes <= 60, "STALE").otherwise("CRITICAL"))


def health_scorecard(raw: DataFrame, clean: DataFrame, fact: DataFrame, as_of: datetime = AS_OF) -> DataFrame:
    """One row: today's volume and freshness per layer, quality, and a verdict.

    The verdict reads RAW's own freshness. (A text maximum over all layers would
    make an ACCEPTABLE raw layer read as degraded.)
    """
    today, now = times.day_of(as_of), times.as_timestamp(as_of)
    none = F.lit(None).cast("bigint")

    def layer(name: str, rows: DataFrame, stamp: str, *quality: Column) -> DataFrame:
        clean_rows, flagged = quality or (none, none)
        return rows.agg(F.count("*").alias("records"), F.max(stamp).alias("latest"),
                        clean_rows.alias("unflagged"), flagged.alias("flagged")).withColumn("layer", F.lit(name))

    flag = F.col("data_quality_flag")
    stats = (layer("RAW", raw.filter(F.to_date("loaded_at") == today), "loaded_at")
             .unionByName(layer("CLEAN", clean.filter(F.to_date("transformed_at") == today), "transformed_at",
                                count_where(~flag), count_where(flag)))
             .unionByName(layer("ANALYTICS", fact.filter(F.col("event_date") == today), "transformed_at")))
    lag = times.minutes_between(F.col("latest"), now)
    rated = stats.withColumns({"lag": lag, "freshness": freshness_label(lag)})
    of = lambda name, col: F.max(F.when(F.col("layer") == name, F.col(col)))
    wide = rated.agg(
        of("RAW", "records").alias("raw_records_today"),
        of("CLEAN", "records").alias("clean_records_today"),
        of("ANALYTICS", "records").alias("analytics_records_today"),
        of("RAW", "freshness").alias("raw_freshness"),
        of("CLEAN", "freshness").alias("clean_freshness"),
        of("ANALYTICS", "freshness").alias("analytics_freshness"),
        F.coalesce(of("RAW", "lag"), F.lit(0)).alias("raw_lag_minutes"),
        F.coalesce(of("CLEAN", "lag"), F.lit(0)).alias("clean_lag_minutes"),
        of("CLEAN", "unflagged").alias("_unflagged"),
        of("CLEAN", "flagged").alias("flagged_records_today"),
    )
    scored = wide.withColumns({
        "clean_record_pct": percent(F.col("_unflagged"), F.col("clean_records_today"), 2),
        "raw_to_analytics_pct": percent(F.col("analytics_records_today"), F.col("raw_records_today"), 2),
        "report_generated_at": now,
    }).drop("_unflagged")
    verdict = (F.when(F.col("raw_freshness").isin("CRITICAL", "STALE"), "PIPELINE_DEGRADED")
               .when(F.col("clean_record_pct") < 90, "QUALITY_DEGRADED").otherwise("HEALTHY"))
    return scored.withColumn("overall_health", verdict)
