"""The layered tables of one data set, each written once per application.

Deriving, deduplicating and cleaning 100 TB for every report would be waste, so RAW,
CLEAN and FACT are written by day (the files of a FACT day are laid out by airline, route
and hour together) and every job reads only the days, files and columns it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger import session
from skyledger.operators.clean import clean_flights
from skyledger.operators.dedup import deduplicate
from skyledger.operators.validate import with_row_errors
from skyledger.plans import dead_letters, star
from skyledger.plans.layer_stats import LayerStatistics
from skyledger.plans.profiles import Profile
from skyledger.schemas import CLEAN_COLUMNS
from skyledger.settings import AS_OF
from skyledger.sources import tables
from skyledger.sources.clustering import ClusteredTable
from skyledger.sources.flights_from_events import flights_from_events, read_events

FACT_CLUSTERS = ["airline_iata", "route_key", "event_hour"]  # what reports and pages filter FACT by, beside the day


LIES, LIES_TOO = "_lies", "_lies_too"  # the days rows are dealt by before they are widened


def cleaned(raw: DataFrame) -> DataFrame:
    """RAW to CLEAN, dealt by the days of the run and of the event while rows are narrow. Each row counts as transformed five minutes after it was loaded."""
    run_time = F.col("loaded_at") + F.expr("INTERVAL 5 MINUTES")
    single = deduplicate(raw).withColumns({LIES: F.to_date(run_time), LIES_TOO: F.to_date("event_timestamp")})
    return clean_flights(tables.dealt(single, LIES, LIES_TOO).drop(LIES, LIES_TOO), run_time)


def _between(table: DataFrame, day: str, since: Column, until: Column | None) -> DataFrame:
    rows = table.filter(F.col(day) >= since)
    return rows if until is None else rows.filter(F.col(day) <= until)


class Layers:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.as_of = session.configure(spark), sf_dir, AS_OF
        self.paths: dict[str, str] = {}
        self._profiles: dict[str, tables.DayTable] = {}

    def _days(self, label: str, df: DataFrame, sort_by: str | None = None, days: tuple[str, ...] = (tables.DAY,), lie_so: bool = False) -> DataFrame:
        path = session.new_path(self.spark, label)
        tables.write_days(df, path, sort_by, days, lie_so=lie_so)
        self.paths[label] = path
        return tables.read(self.spark, path, df.schema)

    def _whole(self, label: str, df: DataFrame) -> DataFrame:
        """A table that no day partitions."""
        table = tables.VersionedTable(self.spark, session.new_path(self.spark, label), df.schema)
        table.write(df)
        return table.read()

    @cached_property
    def raw_table(self) -> DataFrame:
        """RAW with its partition column: the day a row was loaded, which is what incremental jobs ask for."""
        events = read_events(self.spark, self.sf_dir)
        events = events.select("event_id", "user_id", "ts", "event_type", F.to_date(F.expr("CAST(ts AS TIMESTAMP) + INTERVAL 5 MINUTES")).alias(LIES))
        rows = flights_from_events(tables.dealt(events, LIES))  # events are narrower than the rows they become
        return self._days("raw", rows.withColumn(tables.LOAD_DAY, F.to_date("loaded_at")), days=(tables.LOAD_DAY,), lie_so=True)

    @property
    def raw(self) -> DataFrame:
        return self.raw_table.drop(tables.LOAD_DAY)

    @cached_property
    def clean_table(self) -> DataFrame:
        """CLEAN with both partition columns: the day of the run that made a row, and of its event."""
        rows = cleaned(self.raw).select(*CLEAN_COLUMNS, "event_date")
        return self._days("clean", rows.withColumn(tables.MADE_DAY, F.to_date("transformed_at")), days=(tables.MADE_DAY, tables.DAY), lie_so=True)

    @property
    def clean(self) -> DataFrame:
        return self.clean_table.drop(tables.MADE_DAY)

    def raw_loaded(self, since: Column, until: Column | None = None) -> DataFrame:
        """RAW rows of these load days; other days' files are not opened."""
        return _between(self.raw_table, tables.LOAD_DAY, since, until).drop(tables.LOAD_DAY)

    def clean_made(self, since: Column, until: Column | None = None) -> DataFrame:
        """CLEAN rows of runs on these days; other days' files are not opened."""
        return _between(self.clean_table, tables.MADE_DAY, since, until).drop(tables.MADE_DAY)

    def newest_raw(self, at_least_since: Column) -> DataFrame:
        """RAW rows of the newest load day, and of all days since ``at_least_since``."""
        return self.raw_loaded(F.least(F.lit(self._newest("raw", self.raw_table, tables.LOAD_DAY)), at_least_since))

    def newest_clean(self, at_least_since: Column) -> DataFrame:
        return self.clean_made(F.least(F.lit(self._newest("clean", self.clean_table, tables.MADE_DAY)), at_least_since))

    def clean_of_newest_days(self, n: int) -> DataFrame:
        """CLEAN rows of the ``n`` newest days of runs; of fewer, all rows, those without a day included."""
        clean, days = self.clean_table, tables.newest_days(self.spark, self.paths["clean"], tables.MADE_DAY, n)
        return self.clean_made(F.lit(days[-1])) if len(days) == n else clean.drop(tables.MADE_DAY)

    def _newest(self, label: str, table: DataFrame, day: str):
        return tables.newest_day(self.spark, self.paths[label], day)

    @cached_property
    def fact_table(self) -> ClusteredTable:
        rows = star.fact_rows(self.clean)
        table = ClusteredTable(self.spark, session.new_path(self.spark, "fact"), rows.schema, FACT_CLUSTERS)
        table.write(rows)
        return table

    @cached_property
    def fact(self) -> DataFrame:
        return self.fact_table.rows()

    def fact_where(self, **filters) -> DataFrame:
        """FACT rows of a day, airline, route or hour, or of several of these; files without such rows are not opened."""
        return self.fact_table.where(**filters)

    @cached_property
    def statistics(self) -> LayerStatistics:
        """Figures of the three layers, counted once when they are built and kept."""
        table = LayerStatistics(self.spark, session.new_path(self.spark, "layer-statistics"))
        table.add("RAW", self.raw_table, tables.LOAD_DAY)
        table.add("CLEAN", self.clean)
        table.add("FACT", self.fact)
        table.add_done(self.raw, self.clean)
        return table

    def daily(self, profile: Profile) -> tables.DayTable:
        """The day partials of a profile, counted once from FACT and kept."""
        if profile.name not in self._profiles:
            table = profile.table(self.spark, session.new_path(self.spark, f"daily-{profile.name}"), self.fact)
            table.append(profile.by_day(self.fact))
            self._profiles[profile.name] = table
        return self._profiles[profile.name]

    @cached_property
    def airlines(self) -> DataFrame:
        return self._whole("dim-airlines", star.dim_airlines(self.clean))

    @cached_property
    def airports(self) -> DataFrame:
        return self._whole("dim-airports", star.dim_airports(self.clean))

    @cached_property
    def hourly(self) -> DataFrame:
        return self._days("hourly", star.hourly_summary(self.fact, self.as_of))

    @cached_property
    def letter_table(self) -> dead_letters.Letters:
        """Dead letters of every RAW row that fails a row check."""
        table = dead_letters.Letters(self.spark, session.new_path(self.spark, "dead-letters"))
        invalid = with_row_errors(self.raw).filter(F.size("errors") > 0)
        table.publish(dead_letters.dead_letters(invalid, F.array_join("errors", ","), "ingestion", F.col("loaded_at")), large=True)
        return table

    @property
    def letters(self) -> DataFrame:
        return self.letter_table.current()

    @cached_property
    def routes(self) -> DataFrame:
        return self._days("routes", star.routes_from_clean(self.clean, self.as_of))


_built: dict[tuple[str, str], Layers] = {}


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Layers(spark, sf_dir)
    return _built[key]
