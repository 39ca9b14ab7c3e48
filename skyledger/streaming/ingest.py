"""Continuous ingestion: messages -> checked events -> RAW, dead letters and gate verdicts.

The checkpoint holds the source offsets and moves on only after ``foreachBatch``
returns, so a batch may run twice but none is lost. Every write of a batch is
therefore repeatable: RAW takes only unknown event ids, a dead letter's id is a
digest of its content, and a verdict lives in a folder of its batch number. Of an
event that is delivered in several batches the first valid delivery stays; of several
in one batch, the earliest row.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skyledger.functions import times
from skyledger.operators import merge, validate
from skyledger.plans.dead_letters import Letters, dead_letters
from skyledger.plans.incremental import RUN_COLUMNS, finalise_runs
from skyledger.settings import QUALITY_GATE_MAX_FAIL_RATE
from skyledger.sources.payload import parse_events
from skyledger.sources.snapshots import batch_name

FLUSH_EVERY = "10 seconds"  # fixed value


def read_message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages as JSON lines in files: the same shape as the topic source."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


@dataclass(frozen=True)
class IngestSink:
    spark: SparkSession
    raw_path: str
    letters_path: str
    verdicts_path: str
    loaded_at: datetime | None = None  # None: the time of the batch
    max_fail_rate: float = QUALITY_GATE_MAX_FAIL_RATE
    runs_path: str | None = None  # where each batch leaves its row of the run metrics

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        started = datetime.now(timezone.utc)
        arrived = F.current_timestamp() if self.loaded_at is None else times.as_timestamp(self.loaded_at)
        checked = validate.with_row_errors(parse_events(batch)).withColumn("loaded_at", arrived).persist()
        try:
            verdict = validate.quality_gate(checked, self.max_fail_rate).withColumn("decided_at", arrived)
            decision = verdict.first()
            self.spark.createDataFrame([decision], verdict.schema).write.mode("overwrite").parquet(f"{self.verdicts_path}/batch_id={batch_id}")
            good, bad = F.size("errors") == 0, F.size("errors") > 0
            inserted = 0
            if decision.load_allowed:
                rows = checked.filter(good).drop("errors", "value", "key")
                rows = rows.withColumn("event_date", F.to_date("event_timestamp"))
                inserted = merge.insert_only(self.spark, self.raw_path, rows, batch=batch_name(batch, batch_id))
                self._publish(checked.filter(bad), F.array_join("errors", ","))
            elif decision.total_records:
                reason = F.when(bad, F.array_join("errors", ",")).otherwise("batch_rejected")
                self._publish(checked, reason)
            if self.runs_path is not None:
                run = (f"ingestion-{batch_id}", "ingestion", started, datetime.now(timezone.utc), decision.total_records, inserted,
                       decision.invalid_count, "success" if decision.load_allowed else "rejected")
                rows = finalise_runs(self.spark.createDataFrame([run], RUN_COLUMNS))
                rows.write.mode("overwrite").parquet(f"{self.runs_path}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    def _publish(self, rows: DataFrame, reason) -> None:
        self.letters.publish(dead_letters(rows, reason, "ingestion", F.col("loaded_at"), payload=F.col("value")))

    @property
    def letters(self) -> Letters:
        return Letters(self.spark, self.letters_path)


def start_ingest(messages: DataFrame, sink: IngestSink, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Micro-batches every ten seconds, or everything available and stop."""
    writer = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=FLUSH_EVERY).start()
