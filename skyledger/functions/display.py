"""Display text and colours as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from skyledger.functions.text import lookup
from skyledger.functions.times import as_timestamp

# Colours and marks of the dashboard.
HEALTH_COLOURS = {
    "HEALTHY": "#22c55e", "DEGRADED": "#f59e0b", "DOWN": "#ef4444", "PIPELINE_DEGRADED": "#f59e0b",
    "QUALITY_DEGRADED": "#f59e0b", "FRESH": "#22c55e", "ACCEPTABLE": "#3b82f6", "STALE": "#f59e0b",
    "CRITICAL": "#ef4444",
}
DELAY_COLOURS = {
    "on_time": "#22c55e", "minor_delay": "#3b82f6", "moderate_delay": "#f59e0b",
    "major_delay": "#f97316", "severe_delay": "#ef4444",
}
OTHER_COLOUR = "#94a3b8"
ROUTE_MARKS = {"EXCELLENT": "🟢", "GOOD": "🔵", "AVERAGE": "🟡", "POOR": "🟠", "CRITICAL": "🔴"}
OTHER_MARK = "⚪"
MISSING = "N/A"


def _or_missing(source: Column, text: Column) -> Column:
    return F.when(source.isNull(), MISSING).otherwise(text)


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def number_text(value: Column, digits: int = 0) -> Column:
    return _or_missing(value, F.format_number(value.cast("double"), digits))


def percent_text(value: Column, digits: int = 1) -> Column:
    """A value up to 1 is read as a fraction."""
    scaled = F.when(value <= 1.0, value * 100).otherwise(value)
    return _or_missing(value, F.concat(_fixed(scaled, digits), F.lit("%")))


def minutes_text(value: Column) -> Column:
    whole = value.cast("bigint")
    hours, rest = F.floor(whole / 60).cast("string"), F.pmod(whole, F.lit(60))
    long = F.concat(hours, F.lit("h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("m"))).otherwise(""))
    return _or_missing(value, F.when(whole < 60, F.concat(whole.cast("string"), F.lit("m"))).otherwise(long))


def speed_text(value: Column) -> Column:
    return _or_missing(value, F.concat(_fixed(value, 1), F.lit(" km/h")))


def altitude_text(value: Column) -> Column:
    return _or_missing(value, F.concat(F.format_number(value.cast("bigint"), 0), F.lit(" ft")))


def age_text(ts: Column, now: datetime | Column) -> Column:
    age = F.unix_seconds(as_timestamp(now)) - F.unix_seconds(ts)
    part = lambda unit, letter: F.concat(F.floor(age / unit).cast("string"), F.lit(f"{letter} ago"))
    return _or_missing(ts, F.when(age < 60, part(1, "s")).when(age < 3600, part(60, "m")).otherwise(part(3600, "h")))


def health_colour(status: Column) -> Column:
    return F.coalesce(lookup(HEALTH_COLOURS, F.upper(status)), F.lit(OTHER_COLOUR))


def delay_colour(bucket: Column) -> Column:
    return F.coalesce(lookup(DELAY_COLOURS, F.lower(bucket)), F.lit(OTHER_COLOUR))


def route_mark(health: Column) -> Column:
    return F.coalesce(lookup(ROUTE_MARKS, F.upper(health)), F.lit(OTHER_MARK))
