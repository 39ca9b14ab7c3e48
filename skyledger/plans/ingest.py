"""Batch ingestion: staging, RAW and CLEAN writes, and what is still pending."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger.functions import times
from skyledger.operators import merge
from skyledger.schemas import CLEAN_COLUMNS, RAW_COLUMNS
from skyledger.settings import AS_OF
from skyledger.sources import payload


def unprocessed_recent(staging: DataFrame, as_of: datetime = AS_OF, minutes: int = 10,
                       limit: int | None = None) -> DataFrame:
    """Staging rows not processed yet, oldest first. Spark needs no row cap; one may be set."""
    rows = staging.filter(~F.col("processed") & (F.col("ingested_at") >= times.ago(as_of, minutes=minutes)))
    ordered = rows.orderBy("ingested_at")
    return ordered if limit is None else ordered.limit(limit)


def has_rows(rows: DataFrame) -> bool:
    """Stops at the first row found."""
    return not rows.limit(1).isEmpty()


def merge_batch_into_raw(spark: SparkSession, raw_path: str, staging: DataFrame) -> None:
    """Known events only take the newest batch id; new events are inserted untransformed."""
    batch = merge.one_row_per_key(staging, ["event_id"])
    merge.upsert_days(spark, raw_path, batch, ["event_id"], update=["ingestion_batch_id"])


def raw_rows_from_payload(staging: DataFrame, loaded_at: datetime | Column) -> DataFrame:
    """Typed RAW rows from staging payloads, with the day they belong to."""
    typed = payload.extract_paths(staging.select("raw_payload"))
    return typed.select(*RAW_COLUMNS, F.col("raw_payload").alias("raw_json"),
                        times.as_timestamp(loaded_at).alias("loaded_at"),
                        F.to_date("event_timestamp").alias("event_date"))


# What the quick loader writes where the payload has no value.
QUICK_TEXT_DEFAULTS = {c: "" for c in (
    "flight_id", "airline", "airline_iata", "flight_number", "source_airport", "dest_airport",
    "source_city", "dest_city", "aircraft_type")} | {"status": "active", "source": "simulator"}
QUICK_NUMBER_DEFAULTS = ["latitude", "longitude", "altitude", "speed", "heading", "delay_minutes"]


def quick_raw_rows(staging: DataFrame, loaded_at: datetime = AS_OF) -> DataFrame:
    """Quick load: gaps take defaults, a missing event id falls back to the staging row id."""
    typed = payload.extract_paths(staging.select("id", "raw_payload"))
    changes: dict[str, Column] = {"event_id": F.coalesce("event_id", F.col("id").cast("string"))}
    changes |= {c: F.coalesce(c, F.lit(v)) for c, v in QUICK_TEXT_DEFAULTS.items()}
    changes |= {c: F.coalesce(c, F.lit(0).cast(dict(typed.dtypes)[c])) for c in QUICK_NUMBER_DEFAULTS}
    now = times.as_timestamp(loaded_at)
    changes |= {"event_timestamp": now, "loaded_at": now}
    kept = [c for c in RAW_COLUMNS if c not in ("departure_time", "arrival_time")]
    return typed.withColumns(changes).select(*kept, "loaded_at")


def write_clean(spark: SparkSession, clean_path: str, rows: DataFrame, then: Callable[[DataFrame], None] | None = None, unique: bool = False) -> int:
    """Insert cleaned rows that CLEAN does not hold yet, with the columns it knows; returns how many. ``then`` gets these rows.

    ``unique``: no event id is there twice, as after ``exact_dedup``; otherwise the earliest row of each is inserted.
    """
    known = [c for c in CLEAN_COLUMNS if c in rows.columns]
    return merge.insert_only(spark, clean_path, rows.select(*known, "event_date"), dedupe_source=not unique, then=then)


def pending(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """RAW rows without a CLEAN row: the untransformed ones, derived instead of flagged."""
    done = clean.select(F.col("event_id").alias("_done"))
    return raw.join(done, F.col("event_id") == F.col("_done"), "left_anti")


def with_transformed_flag(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """RAW rows with ``is_transformed`` and the time of transformation."""
    done = clean.groupBy(F.col("event_id").alias("_done")).agg(F.max("transformed_at").alias("transformed_at"))
    return (raw.join(done, F.col("event_id") == F.col("_done"), "left")
            .withColumn("is_transformed", F.col("_done").isNotNull()).drop("_done"))
