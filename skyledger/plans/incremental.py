"""Watermarks, incremental windows, the RAW to CLEAN run, and run metrics."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from skyledger.functions import times
from skyledger.operators import clean, dedup, merge, validate
from skyledger.plans import ingest
from skyledger.plans.carry_over import SeenPositions
from skyledger.plans.layer_stats import LayerStatistics
from skyledger.schemas import CLEAN_COLUMNS, WATERMARKS
from skyledger.settings import AS_OF, WATERMARK_EPOCH, WATERMARK_PROCESSES
from skyledger.sources import tables


def initial_watermarks(spark: SparkSession) -> DataFrame:
    rows = [(name, WATERMARK_EPOCH, 0, WATERMARK_EPOCH, None, "initial watermark") for name in WATERMARK_PROCESSES]
    return spark.createDataFrame(rows, WATERMARKS)


def get_watermark(watermarks: DataFrame, process: str) -> Column:
    """The process's watermark as a scalar; the epoch when it has none."""
    found = watermarks.filter(F.col("process_name") == process).agg(F.max("last_processed_at").alias("w"))
    return F.coalesce(found.scalar(), times.as_timestamp(WATERMARK_EPOCH))


def incremental_window(rows: DataFrame, watermark: Column | datetime, upper: Column | datetime = AS_OF,
                       stamp: str = "loaded_at", extra: Column | None = None, limit: int | None = None,
                       day: str | None = None) -> DataFrame:
    """Rows with watermark < stamp <= upper.

    ``day`` names the partition column that holds the stamp's day: only those days are
    opened, and the column is left out of the result.

    With ``limit`` the batch ends at the limit-th stamp but takes every row that
    shares it. Cutting inside equal stamps would lose the rest for good, because the
    next window starts strictly after the last stamp.
    """
    inside = (F.col(stamp) > times.as_timestamp(watermark)) & (F.col(stamp) <= times.as_timestamp(upper))
    if day is not None:
        rows = rows.filter((F.col(day) >= times.day_of(watermark)) & (F.col(day) <= times.day_of(upper))).drop(day)
    window = rows.filter(inside if extra is None else inside & extra)
    if limit is None:
        return window
    last = window.select(stamp).orderBy(stamp).limit(limit).agg(F.max(stamp).alias("last")).scalar()
    return window.filter(F.col(stamp) <= last)


def updated_watermark(watermarks: DataFrame, process: str, batch: DataFrame, count: Column | int, run_id: str,
                      now: datetime = AS_OF, stamp: str = "loaded_at") -> DataFrame:
    """The control table after a successful run; unchanged when the batch was empty."""
    news = batch.agg(F.max(stamp).alias("last_processed_at"), F.count("*").alias("_n")).select(
        F.lit(process).alias("process_name"), "last_processed_at",
        (F.col("_n") if count is None else F.lit(count).cast("bigint")).alias("last_run_count"),
        times.as_timestamp(now).alias("updated_at"), F.lit(run_id).alias("last_run_id"),
        F.lit(None).cast("string").alias("comment_text"),
    ).filter(F.col("last_processed_at").isNotNull())
    return merge.upsert_rows(watermarks, news, ["process_name"],
                             ["last_processed_at", "last_run_count", "updated_at", "last_run_id"])


def run_raw_to_clean(spark: SparkSession, raw: DataFrame, clean_path: str, watermarks: tables.VersionedTable,
                     as_of: datetime = AS_OF, run_id: str = "manual", limit: int | None = None, day: str | None = None,
                     runs_path: str | None = None, statistics: LayerStatistics | None = None, seen: SeenPositions | None = None) -> dict:
    """One incremental run: window, validate, deduplicate, clean, validate, insert, advance.

    The window and the cleaned batch are each written once beside CLEAN and everything
    after reads those copies. The watermark moves last; a failure before it only means the
    batch runs again, and the insert skips what is there already. With ``runs_path`` the
    run adds its row to the run metrics, with ``statistics`` the figures of what it read and wrote. With ``seen``
    near-duplicates of rows of earlier windows go, too, and events that CLEAN holds are left out before anything else.
    """
    begun, started_at = time.time(), datetime.now(timezone.utc)
    control = watermarks.read()
    window = incremental_window(raw, get_watermark(control, "raw_to_clean"), as_of, limit=limit, day=day)
    window_path = f"{clean_path}-window-{run_id}"
    window.write.mode("overwrite").parquet(window_path)
    batch = tables.read(spark, window_path, window.schema)
    records_in = batch.count()

    def finished(status: str, written: int, failed: int) -> None:
        if runs_path is not None:
            row = (run_id, "raw_to_clean", started_at, datetime.now(timezone.utc), records_in, written, failed, status)
            append_runs(runs_path, finalise_runs(spark.createDataFrame([row], RUN_COLUMNS)))

    if records_in == 0:
        finished("no_data", 0, 0)
        return {"run_id": run_id, "status": "no_data", "records_in": 0, "records_out": 0}
    pre = validate.validation_summary(validate.validate(batch, as_of)).first()

    staged_path = f"{clean_path}-batch-{run_id}"
    since = get_watermark(control, "raw_to_clean")
    if seen is None:
        single = dedup.deduplicate(batch)
    else:
        fresh = dedup.exact_dedup(batch)
        held = tables.DayTable(spark, clean_path, T.StructType([T.StructField("event_id", T.StringType()), T.StructField(tables.DAY, T.DateType())]), ["event_id"])
        fresh = merge.unknown_rows(held, fresh, held.state())
        single = seen.unseen(dedup.fuzzy_dedup(fresh), since)
    cleaned = clean.clean_flights(single, as_of).select(*CLEAN_COLUMNS, "event_date")
    tables.write_days(cleaned, staged_path, anew=True)
    if seen is not None:
        seen.add(fresh, batch.agg(F.max("loaded_at").alias("m")).scalar())
    staged = tables.read(spark, staged_path, cleaned.schema)
    post = validate.validation_summary(validate.validate(staged, as_of)).first()
    totals = staged.agg(F.count("*").alias("n"), F.count_if("data_quality_flag").alias("flagged")).first()

    def counted(inserted: DataFrame) -> None:
        statistics.add("RAW", batch, F.to_date("loaded_at"))
        statistics.add("CLEAN", inserted)
        statistics.add_done(batch, inserted)

    written = ingest.write_clean(spark, clean_path, staged, counted if statistics else None, unique=True)  # cleaning leaves ids as they are

    watermarks.write(updated_watermark(control, "raw_to_clean", staged, written, run_id, as_of))
    finished("success", written, records_in - written)
    return {
        "run_id": run_id, "status": "success", "records_in": records_in, "records_after_dedup": totals.n,
        "records_out": written, "dedup_removed": records_in - totals.n, "quality_flagged": totals.flagged,
        "pre_validation_ok": pre.is_healthy, "post_validation_ok": post.is_healthy,
        "elapsed_seconds": round(time.time() - begun, 2),
    }


# --- Run metrics ---------------------------------------------------------------------

RUN_COLUMNS = ("run_id string, dag_id string, started_at timestamp, finished_at timestamp, records_read long, "
               "records_written long, records_failed long, status string")


def finalise_runs(runs: DataFrame) -> DataFrame:
    """Elapsed seconds, throughput and error rate of finished runs."""
    elapsed = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
    return runs.withColumn("elapsed_seconds", elapsed).withColumns({
        "throughput_rps": F.round(F.col("records_written") / F.greatest("elapsed_seconds", F.lit(0.001)), 2),
        "error_rate_pct": F.round(
            F.lit(100.0) * F.col("records_failed") / F.greatest("records_read", F.lit(1)), 4),
    })


def recent_runs(runs: DataFrame, n: int = 20, dag_id: str | None = None) -> DataFrame:
    chosen = runs if dag_id is None else runs.filter(F.col("dag_id") == dag_id)
    return chosen.orderBy(F.desc("started_at"), "run_id").limit(n)


def throughput_trend(runs: DataFrame, dag_id: str, n: int = 10) -> DataFrame:
    """Newer half of the last n runs against the older half, by positive throughput."""
    last = recent_runs(runs, n, dag_id)
    positive = last.filter(F.col("throughput_rps") > 0)
    by_age = W.orderBy("started_at", "run_id")  # at most n rows
    numbered = positive.select("throughput_rps", (F.row_number().over(by_age) - 1).alias("i"))
    half = F.floor(F.col("size") / 2)
    sized = numbered.withColumn("size", F.count("*").over(W.partitionBy()))
    halves = sized.agg(
        F.count("*").alias("runs"), F.avg("throughput_rps").alias("avg_rps"),
        F.avg(F.when(F.col("i") >= half, F.col("throughput_rps"))).alias("recent"),
        F.avg(F.when(F.col("i") < half, F.col("throughput_rps"))).alias("older"))
    seen = last.agg(F.count("*").alias("n")).scalar()
    few = F.col("runs") < 2
    trend = (F.when(F.col("seen") == 0, "no_data").when(few, "stable")
             .when(F.col("recent") > F.col("older") * 1.10, "improving")
             .when(F.col("recent") < F.col("older") * 0.90, "degrading").otherwise("stable"))
    return halves.withColumn("seen", seen).select(
        F.round(F.coalesce("avg_rps", F.lit(0.0)), 2).alias("avg_rps"), trend.alias("trend"),
        F.when((F.col("seen") > 0) & few, F.lit(1).cast("bigint")).otherwise(F.col("runs")).alias("runs"),
        F.when(~few, F.round("recent", 2)).alias("recent_avg"), F.when(~few, F.round("older", 2)).alias("older_avg"))


def hourly_load_runs(raw: DataFrame, errors: Column) -> DataFrame:
    """One ingestion run per load hour of RAW, as run-metrics rows.

    Start, end and job name derive from the hour and the row count, so the table
    grows with the data and stays reproducible.
    """
    hour = F.date_trunc("hour", F.col("loaded_at"))
    failed = F.size(errors) > 0
    per_hour = raw.groupBy(hour.alias("started_at")).agg(
        F.count("*").alias("records_read"), F.count_if(~failed).alias("records_written"),
        F.count_if(failed).alias("records_failed"))
    job = F.when(F.hour("started_at") % 2 == 0, "ingestion").otherwise("transform")
    seconds = (F.lit(5) + F.col("records_read") % 17 + F.hour("started_at")).cast("int")
    return finalise_runs(per_hour.select(
        F.concat(F.lit("run-"), F.date_format("started_at", "yyyyMMddHH")).alias("run_id"), job.alias("dag_id"),
        "started_at", (F.col("started_at") + F.make_dt_interval(secs=seconds)).alias("finished_at"),
        "records_read", "records_written", "records_failed",
        F.when(F.col("records_written") > 0, "success").otherwise("failed").alias("status")))


def append_runs(path: str, runs: DataFrame) -> None:
    """Add finished runs to the metrics or audit history."""
    runs.write.mode("append").parquet(path)

