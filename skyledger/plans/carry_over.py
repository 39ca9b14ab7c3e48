"""What an incremental run must know of earlier windows to remove near-duplicates as one run over all rows would.

The rule drops a row that comes less than the window after another row of its flight. For
rows of earlier windows two times for each (flight, cell of the window's length) say
enough: a row falls if its own cell holds an earlier time, or the cell before a time close enough. These
are kept by event day, so a run reads the days of its own rows. Each entry says up to which load
time its run went; a run takes only entries that end where it begins, so one that is repeated
after a failure does not meet its own rows.

Rows of earlier windows stay as they were decided: a row that is loaded later but lies before one that
is cleaned already does not remove it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.settings import FUZZY_WINDOW_SECONDS
from skyledger.sources import tables

_SEEN = T.StructType([
    T.StructField("flight_id", T.StringType()), T.StructField("cell", T.LongType()), T.StructField("oldest", T.LongType()), T.StructField("newest", T.LongType()),
    T.StructField("upto", T.TimestampType()), T.StructField(tables.DAY, T.DateType())])


class SeenPositions:
    """Times of the positions that earlier runs have read."""

    def __init__(self, spark: SparkSession, path: str, seconds: int = FUZZY_WINDOW_SECONDS):
        self.table, self.width = tables.DayTable(spark, path, _SEEN), seconds * 1_000_000

    def _timed(self, rows: DataFrame) -> DataFrame:
        micros = F.unix_micros("event_timestamp")
        known = rows.filter(F.col("flight_id").isNotNull() & F.col("event_timestamp").isNotNull())
        return known.withColumns({"_at": micros, "_cell": micros - F.pmod(micros, F.lit(self.width))})

    def unseen(self, rows: DataFrame, since: Column) -> DataFrame:
        """``rows`` (near-duplicates among themselves removed) without those that follow a row of a window up to ``since`` too closely."""
        days = {r[0] for r in rows.select(F.explode(F.array(F.to_date("event_timestamp"), F.date_sub(F.to_date("event_timestamp"), 1)))).distinct().collect()}
        held = self.table.rows(days).filter(F.col("upto") <= since).groupBy(F.col("flight_id").alias("_flight"), "cell").agg(
            F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
        same = held.select("_flight", F.col("cell").alias("_of"), F.col("oldest").alias("_least"), F.lit(None).cast("long").alias("_most"))
        before = held.select("_flight", (F.col("cell") + self.width).alias("_of"), F.lit(None).cast("long").alias("_least"), F.col("newest").alias("_most"))
        close = same.unionByName(before)
        falls = (F.col("flight_id") == F.col("_flight")) & (F.col("_cell") == F.col("_of")) & (
            (F.col("_least") <= F.col("_at")) | (F.col("_at") - F.col("_most") < self.width))
        kept = self._timed(rows).join(close, falls, "left_anti").drop("_at", "_cell")
        return kept.unionByName(rows.filter(F.col("flight_id").isNull() | F.col("event_timestamp").isNull()))

    def add(self, rows: DataFrame, upto: Column) -> None:
        """Note the times of a window's rows (each event once)."""
        cells = self._timed(rows).groupBy("flight_id", F.col("_cell").alias("cell")).agg(F.min("_at").alias("oldest"), F.max("_at").alias("newest"))
        self.table.append(cells.select("*", upto.alias("upto"), F.to_date(F.timestamp_micros("cell")).alias(tables.DAY)))
