"""Dead letters: publish, list, replay and statistics.

The table holds a row per change of a letter, and the last one counts: publishing adds
letters that are not there, a replay adds the letters whose status it changes. Both read
only the buckets their ids fall into.
"""

from __future__ import annotations

from datetime import datetime

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.functions import times
from skyledger.operators.merge import one_row_per_key
from skyledger.settings import AS_OF, DLQ_ALERT_THRESHOLD, MAX_ERROR_MESSAGE_CHARS
from skyledger.sources.snapshots import KeyedTable

LETTER = T.StructType([
    *(T.StructField(name, T.StringType()) for name in ("id", "event_id", "flight_id", "source", "dag_id", "run_id", "error_message")),
    T.StructField("retry_count", T.IntegerType()), T.StructField("raw_payload", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("status", T.StringType())])
STATUSES = ["pending", "replayed", "replay_failed"]


def dead_letters(failed: DataFrame, error: Column, source: str, created_at: datetime | Column = AS_OF,
                 dag_id: str = "unknown", run_id: str = "unknown", payload: Column | None = None) -> DataFrame:
    """Failed rows as pending dead letters with their payload and whole error text.

    The id is a digest of the payload and the error, so publishing a batch again
    yields the same letters, and equal rows with the same error are one letter.
    """
    text = payload if payload is not None else F.to_json(F.struct(*failed.columns))
    letters = failed.select(
        F.sha2(F.concat_ws("|", text, error), 256).alias("id"),
        F.coalesce("event_id", F.lit("unknown")).alias("event_id"),
        F.coalesce("flight_id", F.lit("unknown")).alias("flight_id"),
        F.lit(source).alias("source"), F.lit(dag_id).alias("dag_id"), F.lit(run_id).alias("run_id"),
        error.alias("error_message"), F.lit(0).alias("retry_count"), text.alias("raw_payload"),
        times.as_timestamp(created_at).alias("created_at"), F.lit("pending").alias("status"),
    )
    return one_row_per_key(letters, ["id"])


def display_error(error: Column) -> Column:
    """Error text cut to the length a page shows."""
    return F.substring(error, 1, MAX_ERROR_MESSAGE_CHARS)


def pending_letters(letters: DataFrame, limit: int | None = None) -> DataFrame:
    """Oldest pending letters first; all of them, or the first ``limit``."""
    ordered = letters.filter("status = 'pending'").orderBy("created_at", "id")
    return ordered if limit is None else ordered.limit(limit)


def judged(letters: DataFrame, ids: DataFrame) -> DataFrame:
    """The pending letters in ``ids`` with their status after a replay.

    A payload that is a JSON object can be published again; any other letter is marked as failed.
    """
    wanted = ids.select(F.col("id").alias("_id")).distinct()
    chosen = letters.filter("status = 'pending'").join(wanted, F.col("id") == F.col("_id"), "left_semi")
    usable = F.schema_of_variant(F.try_parse_json("raw_payload")).startswith("OBJECT")
    return chosen.withColumn("status", F.when(F.coalesce(usable, F.lit(False)), "replayed").otherwise("replay_failed"))


def messages_of(letters: DataFrame) -> DataFrame:
    """Replayed letters as messages under their flight id."""
    return letters.filter("status = 'replayed'").select(F.col("flight_id").alias("key"), F.col("raw_payload").alias("value"))


class Letters(KeyedTable):
    """The table of dead letters."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, LETTER, "id")

    def publish(self, letters: DataFrame, large: bool = False) -> None:
        """Add the letters (one for each id) that are not there; publishing a batch again changes nothing."""
        base = self.state()
        self.write(self.unknown(letters, base), base=base, large=large)

    def replay(self, ids: DataFrame, send: Callable[[DataFrame, int], None], attempt: int) -> bool:
        """Send the pending letters in ``ids`` again and write their new status; returns False for an attempt that is through.

        The letters of an attempt are first written down, then sent, then marked. After a failure the same number is
        given again: the letters written down are sent, whatever ``ids`` says now, and ``send`` gets the number,
        so that a sink that replaces its output for a number (as ``files.write_messages`` does) holds no message twice.
        """
        marked = ("marked", attempt)
        if self.state().batches.get("marked", -1) >= attempt:
            return False
        outbox = f"{self.path}/_attempts/{attempt:09d}"
        done = self._hadoop.fs.Path(f"{outbox}/_SUCCESS")
        if not self._fs.exists(done):
            judged(self.current(ids), ids).write.mode("overwrite").parquet(outbox)
        letters = self.spark.read.schema(self.schema).parquet(outbox)
        send(messages_of(letters), attempt)
        self.write(letters, batch=marked)
        return True


def letter_stats(letters: DataFrame) -> DataFrame:
    return letters.groupBy("status").agg(
        F.count("*").alias("letters"), F.max("created_at").alias("latest"), F.min("created_at").alias("oldest"))


def volume_alert(letters: DataFrame, threshold: int = DLQ_ALERT_THRESHOLD) -> DataFrame:
    waiting = F.count_if(F.col("status") == "pending")
    return letters.agg(waiting.alias("pending"), (waiting >= threshold).alias("alert"))
