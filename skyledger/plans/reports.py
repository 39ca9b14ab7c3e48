"""Named reports over a set of layered tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skyledger.functions import times
from skyledger.plans import views
from skyledger.plans.layers import Layers


@dataclass(frozen=True)
class Report:
    build: Callable[[Layers], DataFrame]
    description: str
    team: str
    limit: int


# The team each report is for and its usual number of rows.
REPORTS: dict[str, Report] = {
    "active_airlines_now": Report(
        lambda t: views.active_airlines_now(t.fact, t.airlines, t.as_of), "Flights in the air per airline, by each flight's newest active position", "Operations", 20),
    "delay_patterns": Report(
        lambda t: views.delay_patterns(t.daily(views.DELAYS), t.as_of), "Mean delay, punctuality and delay classes per day, hour and airline, with a signal", "Operations", 200),
    "airline_league": Report(
        lambda t: views.airline_league(t.daily(views.LEAGUE), t.airlines, t.as_of), "Airlines by punctuality, with delay shares and a combined score", "Management", 50),
    "peak_hours": Report(
        lambda t: views.peak_hours(t.fact, t.as_of), "Share of the day's traffic in each hour, with its rank and band", "Infrastructure", 24),
    "airport_congestion": Report(
        lambda t: views.airport_congestion(t.fact, t.airports, t.as_of), "Movements and delays at each airport, combined to an index", "Ground Operations", 30),
    "route_efficiency": Report(
        lambda t: views.route_efficiency(t.daily(views.ROUTES), t.as_of), "Punctuality, speed and cancellations per route, combined to a score", "Network Planning", 100),
    "aircraft_performance": Report(
        lambda t: views.aircraft_performance(t.daily(views.AIRCRAFT), t.as_of), "Use, speed and delays of each type of aircraft", "Fleet Planning", 30),
    "weekly_trends": Report(
        lambda t: views.weekly_trends(t.fact, t.as_of), "Each day against the same day a week before, with a rolling mean", "Executive", 30),
    "intl_vs_domestic": Report(
        lambda t: views.intl_vs_domestic(t.fact, t.as_of), "Traffic, delays and cancellations inside the country and across its border", "Revenue Management", 10),
    "pipeline_health": Report(
        lambda t: views.health_scorecard(t.raw_loaded(today := times.day_of(t.as_of), today), t.clean_made(today, today), t.fact, t.as_of), "Today's rows and age of every layer, and a verdict", "Data Engineering", 1),
}


USUAL = -1


def run_report(tables: Layers, name: str, limit: int | None = USUAL) -> DataFrame:
    """One named report: cut to its usual length, to ``limit`` rows, or whole (None)."""
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; available: {sorted(REPORTS)}")
    report = REPORTS[name]
    rows = report.build(tables)
    return rows if limit is None else rows.limit(report.limit if limit == USUAL else limit)


def run_all(tables: Layers) -> dict[str, DataFrame]:
    return {name: run_report(tables, name) for name in REPORTS}


def run_summary(tables: Layers) -> DataFrame:
    """Rows before any cut, columns and state of every report, as one DataFrame."""
    def line(name: str) -> DataFrame:
        report = run_report(tables, name, None)
        return report.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("name"), F.lit(REPORTS[name].team).alias("team"), "row_count",
            F.lit(len(report.columns)).alias("column_count"),
            F.when(F.col("row_count") > 0, "success").otherwise("empty").alias("status"))

    return reduce(DataFrame.unionByName, [line(name) for name in REPORTS])


def register_views(tables: Layers) -> None:
    """FACT as temporary views: whole, last seven days, today and verified rows only."""
    fact, day = tables.fact, F.col("event_date")
    fact.createOrReplaceTempView("fact_flights")
    fact.filter(day >= times.days_before(tables.as_of, 7)).createOrReplaceTempView("fact_flights_recent")
    fact.filter(day == times.day_of(tables.as_of)).createOrReplaceTempView("fact_flights_today")
    fact.filter(~F.col("data_quality_flag")).createOrReplaceTempView("fact_flights_clean")
