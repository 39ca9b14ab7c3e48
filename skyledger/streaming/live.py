"""Live tables kept by streams: newest position per flight and the hourly summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyledger.operators import merge
from skyledger.plans import star
from skyledger.plans.profiles import Profile
from skyledger.settings import AS_OF
from skyledger.sources import tables
from skyledger.sources.snapshots import KeyedTable, batch_name

POSITION_COLUMNS = ["airline_iata", "latitude", "longitude", "altitude", "speed", "status", "event_timestamp", "event_id"]


def newest_positions(events: DataFrame) -> DataFrame:
    """One row per flight: its newest position."""
    position = F.struct(*POSITION_COLUMNS)
    known = events.filter(F.col("flight_id").isNotNull())
    newest = known.groupBy("flight_id").agg(F.max_by(position, F.struct("event_timestamp", "event_id")).alias("p"))
    return newest.select("flight_id", "p.*")


def positions_table(spark: SparkSession, path: str, schema: T.StructType) -> KeyedTable:
    """The live positions: a row per flight, the newest in event time whatever the order of arrival."""
    return KeyedTable(spark, path, schema, "flight_id", ["event_timestamp", "event_id"])


def keep_latest(events: DataFrame, table: KeyedTable, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Add the newest position of each flight in a batch, which is all that a batch writes.

    Newest wins whatever the order of arrival, so late rows and repeated batches are harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(newest_positions(batch), batch_name(batch, batch_id))

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "60 seconds"}
    return writer.trigger(**trigger).start()


def hourly_windows(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running hourly figures per airline in event time. Distinct flights are approximate,
    since a stream cannot count them exactly; ``keep_hourly`` can."""
    hours = F.window("event_timestamp", "1 hour")
    return events.withWatermark("event_timestamp", delay).groupBy(hours.alias("hour"), "airline_iata").agg(
        F.approx_count_distinct("flight_id", 0.02).alias("unique_flights"), F.count("*").alias("total_events"),
        F.round(F.avg("delay_minutes"), 1).alias("avg_delay"), F.max("delay_minutes").alias("max_delay"),
    ).select(F.col("hour.start").alias("hour_start"), "airline_iata", "unique_flights", "total_events", "avg_delay", "max_delay")


def keep_hourly(spark: SparkSession, fact_rows: DataFrame, fact_path: str, summary_path: str, checkpoint: str,
                as_of: datetime = AS_OF, available_now: bool = False, profiles: dict[str, Profile] | None = None) -> StreamingQuery:
    """Add each batch to FACT, then replace the summary of exactly the days it touched, and their
    partials in the tables of ``profiles`` (path -> profile).

    A batch holds few days, and only their folders are read; recomputing a
    whole day keeps the distinct counts exact and a repeated batch harmless.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            merge.insert_only(spark, fact_path, rows, batch=batch_name(batch, batch_id))
            days = tables.days_of(rows)
            changed = tables.DayTable(spark, fact_path, rows.schema).rows(days)
            summary = star.hourly_of_days(changed.filter(~F.col("data_quality_flag")), as_of)
            tables.DayTable(spark, summary_path, summary.schema).replace(summary, days)
            for path, profile in (profiles or {}).items():
                profile.refresh(profile.table(spark, path, changed), changed, days)
        finally:
            rows.unpersist()

    writer = fact_rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 minutes"}
    return writer.trigger(**trigger).start()
