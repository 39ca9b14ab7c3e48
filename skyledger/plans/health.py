"""Checks across layers, component health and alert levels.

Each layer is read by one aggregation; the one-row results are stacked, never
cross-joined.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger import settings as S
from skyledger.functions import times
from skyledger.functions.numbers import percent

HEALTH_RANK = ["healthy", "degraded", "down"]


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check(name: str, value: Column, passes: Column, severity: str = "error") -> Column:
    """One check as a struct: give any aggregate and the condition it must meet."""
    status = F.when(F.coalesce(passes, F.lit(False)), "PASS").otherwise("WARN" if severity == "warn" else "FAIL")
    return F.struct(F.lit(name).alias("check_name"), value.cast("double").alias("value"),
                    status.alias("status"), F.lit(severity).alias("severity"))


def run_checks(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """Evaluate checks over ``rows`` in one aggregation, one result row each."""
    named = [c.alias(f"c{i}") for i, c in enumerate(checks)]
    return rows.agg(*named).select(F.explode(F.array(*[f"c{i}" for i in range(len(checks))])).alias("c")).select("c.*")


def layer_checks(raw: DataFrame, clean: DataFrame, fact: DataFrame, as_of: datetime = S.AS_OF,
                 recent_minutes: int = 60) -> DataFrame:
    """Seven checks: volume, freshness, completeness (two), drift, plausibility and fact rows today.

    ``raw`` and ``clean`` need hold no more than their newest day and the last
    2 * ``recent_minutes``.
    """
    now = times.as_timestamp(as_of)
    since = lambda col, minutes: F.col(col) >= times.ago(as_of, minutes=minutes)
    none_means = lambda col, value: F.coalesce(col, F.lit(value))

    volume = F.count_if(since("loaded_at", recent_minutes))
    age = times.minutes_between(F.max("loaded_at"), now)
    raw_rows = run_checks(raw, [
        check("raw_records_last_hour", volume, volume >= S.MIN_RECORDS_PER_HOUR),
        check("data_freshness_minutes", age, age <= S.MAX_DATA_AGE_MINUTES),
    ])
    recent = since("transformed_at", recent_minutes)
    n = F.nullif(F.count_if(recent), F.lit(0))
    complete = lambda *cols: 1.0 - F.count_if(recent & reduce(Column.__or__, [F.col(c).isNull() for c in cols])) / n
    ids, places = complete("flight_id"), complete("latitude", "longitude")
    delay = F.avg(F.when(recent, F.col("delay_minutes")))
    clean_rows = run_checks(clean.select("flight_id", "latitude", "longitude", "delay_minutes", "transformed_at"), [
        check("flight_id_completeness", ids, none_means(ids, 0.0) >= S.MIN_COMPLETENESS),
        check("coordinates_completeness", places, none_means(places, 0.0) >= S.MIN_COMPLETENESS),
        check("avg_delay_minutes", delay, none_means(delay, 0.0) <= S.MAX_AVG_DELAY_MINUTES, "warn"),
    ])
    both = raw.select(F.col("loaded_at").alias("at"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        clean.select(F.col("transformed_at").alias("at"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    window = both.filter(F.col("at") >= times.ago(as_of, minutes=2 * recent_minutes))
    drift = F.abs(F.sum("r") - F.sum("c")) / F.nullif(F.sum("r"), F.lit(0))
    drift_row = run_checks(window, [
        check("raw_clean_drift", drift, none_means(drift, 0.0) <= S.MAX_LAYER_DRIFT, "warn")])
    rows_today = F.count("*")
    fact_row = run_checks(fact.filter(F.col("event_date") == times.day_of(as_of)), [
        check("fact_table_populated", rows_today, rows_today >= S.MIN_RECORDS_PER_HOUR)])
    return _stack([raw_rows, clean_rows, drift_row, fact_row])


def quality_log_entry(checks: DataFrame, as_of: datetime = S.AS_OF) -> DataFrame:
    """One row for the quality log: HEALTHY unless a check failed."""
    failed = F.count_if(F.col("status") == "FAIL")
    return checks.agg(
        F.when(failed == 0, "HEALTHY").otherwise("DEGRADED").alias("overall_status"),
        F.count_if(F.col("status") == "PASS").alias("checks_passed"), failed.alias("checks_failed"),
        F.count_if(F.col("status") == "WARN").alias("checks_warned"),
    ).withColumns({"check_run_time": times.as_timestamp(as_of), "created_at": times.as_timestamp(as_of)})


def graded(value: Column, limit, down_beyond) -> Column:
    return F.when(value <= limit, "healthy").when(value <= down_beyond, "degraded").otherwise("down")


def _component(name: Column, status: Column, value: Column, threshold: Column) -> list[Column]:
    return [name.alias("component"), status.alias("status"), value.cast("double").alias("value"),
            threshold.cast("double").alias("threshold")]


def layer_freshness(raw: DataFrame, clean: DataFrame, fact: DataFrame, as_of: datetime = S.AS_OF) -> DataFrame:
    """Age of each layer against its objective, by its rows; an empty layer is degraded."""
    def newest(layer: str, rows: DataFrame, stamp: str) -> DataFrame:
        return rows.agg(F.max(stamp).alias("stamp")).select(F.lit(layer).alias("layer"), "stamp")

    return freshness_of(_stack([newest("RAW", raw, "loaded_at"), newest("CLEAN", clean, "transformed_at"), newest("FACT", fact, "transformed_at")]), as_of)


def freshness_of(stamps: DataFrame, as_of: datetime = S.AS_OF) -> DataFrame:
    """Age of each layer against its objective, from its newest stamp."""
    named = F.when(F.col("layer") == "FACT", "ANALYTICS").otherwise(F.col("layer"))
    ages = stamps.select(named.alias("layer"), F.col("stamp").alias("latest"))
    lag = times.minutes_between(F.col("latest"), times.as_timestamp(as_of))
    limits = F.create_map(*[F.lit(x) for item in S.FRESHNESS_SLO_MINUTES.items() for x in item])
    limit = limits[F.col("layer")]
    status = F.when(lag.isNull(), "degraded").otherwise(graded(lag, limit, limit * 2))
    return ages.select(*_component(F.concat(F.lower("layer"), F.lit("_freshness")), status, lag, limit))


def quality_rate(clean: DataFrame, as_of: datetime = S.AS_OF) -> DataFrame:
    today = clean.filter(F.to_date("transformed_at") == times.day_of(as_of))
    rate = F.coalesce(percent(F.count_if("data_quality_flag"), F.count("*"), 2), F.lit(0.0))
    limit = S.QUALITY_FLAG_THRESHOLD_PCT
    return today.agg(rate.alias("rate")).select(*_component(
        F.lit("data_quality_rate"), graded(F.col("rate"), limit, 2 * limit), F.col("rate"), F.lit(limit)))


def consumer_lag(offsets: DataFrame, threshold: int = S.CONSUMER_LAG_THRESHOLD) -> DataFrame:
    """From (topic, partition, end_offset, committed) rows; an uncommitted partition lags fully."""
    behind = F.greatest(F.col("end_offset") - F.coalesce("committed", F.lit(0)), F.lit(0))
    return offsets.agg(F.coalesce(F.sum(behind), F.lit(0)).alias("lag")).select(*_component(
        F.lit("kafka_consumer_lag"), graded(F.col("lag"), threshold // 10, threshold), F.col("lag"), F.lit(threshold)))


def dead_letter_health(letters: DataFrame, threshold: int = S.DLQ_ALERT_THRESHOLD) -> DataFrame:
    waiting = letters.agg(F.count_if(F.col("status") == "pending").alias("n"))
    return waiting.select(*_component(F.lit("dead_letter_queue"), graded(F.col("n"), 0, threshold - 1),
                                      F.col("n"), F.lit(threshold)))


def overall_health(components: DataFrame) -> DataFrame:
    """The worst component decides."""
    rank = F.array_position(F.array(*[F.lit(s) for s in HEALTH_RANK]), F.col("status"))
    worst = F.max(rank)
    return components.agg(
        F.when(worst == 3, "DOWN").when(worst == 2, "DEGRADED").otherwise("HEALTHY").alias("overall_status"),
        F.count_if(F.col("status") == "healthy").alias("healthy"), F.count("*").alias("total"))


def quality_alert_severity(fail_rate_pct: Column) -> Column:
    return F.when(fail_rate_pct > 20, "CRITICAL").when(fail_rate_pct > 10, "ERROR").otherwise("WARNING")


def freshness_alert_severity(lag_minutes: Column) -> Column:
    return F.when(lag_minutes > 120, "CRITICAL").when(lag_minutes > 60, "ERROR").otherwise("WARNING")


def alerts(components: DataFrame) -> DataFrame:
    """One alert per component that is not healthy, graded by its number."""
    severity = (F.when(F.col("component") == "data_quality_rate", quality_alert_severity(F.col("value")))
                .when(F.col("component").endswith("_freshness"), freshness_alert_severity(F.col("value")))
                .when(F.col("status") == "down", "ERROR").otherwise("WARNING"))
    return components.filter("status <> 'healthy'").select("component", severity.alias("severity"), "value", "threshold")
