"""Deduplication of streams that loses nothing, in whatever order and however late rows arrive.

Both sinks keep what has arrived in a table and decide from it, not from state that a
watermark ends. Each batch reads only the part of the table its own rows can touch, adds
one piece to each part, and pieces are merged as they gather. A batch that runs again is
known by its number.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skyledger.operators import dedup, merge
from skyledger.settings import FUZZY_WINDOW_SECONDS
from skyledger.sources import snapshots, tables


@dataclass(frozen=True)
class FirstArrivals:
    """First arrival of every event id; of several in one batch, the earliest row.

    A batch compares its ids with the recent batches and the buckets of the id's hash that they fall into.
    """

    spark: SparkSession
    path: str
    key: str = "event_id"
    buckets: int = 64

    def table(self, schema: T.StructType) -> snapshots.KeyedTable:
        return snapshots.KeyedTable(self.spark, self.path, schema, self.key, buckets=self.buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        table = self.table(batch.schema)
        base = table.state()
        fresh = merge.one_row_per_key(batch, [self.key]).persist()
        try:
            table.write(table.unknown(fresh, base), snapshots.batch_name(batch, batch_id), base)
        finally:
            fresh.unpersist()

    def read(self, schema: T.StructType) -> DataFrame:
        return self.table(schema).changes().select(*schema.names)  # a key is written once


@dataclass(frozen=True)
class NearDuplicates:
    """The batch rule on a stream: a row within ``seconds`` of its flight's previous row goes.

    Every arrival is kept by day. A batch can change its own days and the first seconds of
    the days after them; these days are decided anew, from their arrivals and those of the
    day before, and replaced by name, so one that loses its last row becomes empty. The
    result is always that of the batch operator over all that has arrived. Rows without a
    time form a day of their own.
    """

    spark: SparkSession
    arrivals_path: str
    kept_path: str
    seconds: int = FUZZY_WINDOW_SECONDS

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(tables.DAY, F.to_date("event_timestamp")).persist()
        try:
            arrivals = tables.DayTable(self.spark, self.arrivals_path, rows.schema)
            arrivals.append(rows, snapshots.batch_name(batch, batch_id))
            days = set(tables.days_of(rows))
            if not days:
                return
            known = {d for d in days if d is not None}
            changed = days | {d + timedelta(days=1) for d in known}
            needed = changed | {d - timedelta(days=1) for d in known}
            kept = dedup.fuzzy_dedup(arrivals.rows(needed), self.seconds)
            day = F.col(tables.DAY)
            wanted = F.coalesce(day.isin(sorted(d for d in changed if d is not None)), F.lit(None in changed))
            tables.DayTable(self.spark, self.kept_path, rows.schema).replace(kept.filter(wanted), changed)
        finally:
            rows.unpersist()

    def read(self, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField(tables.DAY, T.DateType())])
        return tables.read(self.spark, self.kept_path, whole).select(*schema.names)


def start(events: DataFrame, sink: FirstArrivals | NearDuplicates, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return writer.trigger(**trigger).start()
