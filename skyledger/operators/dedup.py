"""Removal of repeated events.

Both operators stay whole when one key holds a third of the data: every map task
first reduces its own rows per key, so a hot key reaches the shuffle as at most one
row (exact) or one row per time cell (near-duplicates) from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger.functions.numbers import percent
from skyledger.settings import FUZZY_WINDOW_SECONDS


def _tie_break(df: DataFrame, leading: list[str]) -> list[Column]:
    """Total order: the leading columns, NULL last, then every other column."""
    rest = [c for c in df.columns if c not in leading]
    return [F.col(c).asc_nulls_last() for c in leading + rest if c in df.columns]


def exact_dedup(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Keep the earliest-loaded row per id; all rows without an id count as one.

    ``row_number() = 1`` is planned with a group limit below the exchange, so each
    task passes on one row per id.
    """
    if key not in df.columns:
        return df
    order = W.partitionBy(key).orderBy(*_tie_break(df.drop(key), ["loaded_at", "event_timestamp"]))
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def _first_in_cells(df: DataFrame, seconds: int, extra: list[Column] | None = None, kept: list[str] | None = None) -> DataFrame:
    """One candidate row per (flight, cell of ``seconds``), with the latest time in the cell before.

    Two rows in the same cell are closer than the window, so only the first can
    survive, and it does exactly when the newest row of the previous cell is at
    least a window older; rows of earlier cells are further away than that. Each row
    therefore reports to its own cell and, as a bare time, to the next one, and a
    single aggregation decides everything. Of the candidate the columns ``kept`` are returned (all, if not named).
    """
    micros = F.unix_micros("event_timestamp")
    width = seconds * 1_000_000
    cell = micros - F.pmod(micros, F.lit(width))
    row = F.struct(
        F.col("event_timestamp"),
        *[F.struct(F.col(c).isNull(), F.col(c)).alias(c) for c in ["loaded_at"] if c in df.columns],
        F.struct(*[F.col(c) for c in kept or df.columns]).alias("row"),
    )
    slots = F.explode(F.array(
        F.struct(cell.alias("cell"), row.alias("candidate"), F.lit(None).cast("timestamp").alias("earlier")),
        F.struct((cell + width).alias("cell"), F.lit(None).cast(df.select(row).schema[0].dataType).alias("candidate"),
                 F.col("event_timestamp").alias("earlier")),
    ))
    spread = df.select(F.col("flight_id").alias("_flight"), slots.alias("slot"))
    return spread.groupBy("_flight", F.col("slot.cell").alias("_cell")).agg(
        F.min("slot.candidate").alias("first"), F.max("slot.earlier").alias("earlier"),
        F.count("slot.candidate").alias("members"), *(extra or []),
    )


def _survives(seconds: int) -> Column:
    gap = F.unix_micros("first.event_timestamp") - F.unix_micros("earlier")
    return F.col("first").isNotNull() & (F.col("earlier").isNull() | (gap >= seconds * 1_000_000))


def _has_position(df: DataFrame) -> Column:
    return F.col("flight_id").isNotNull() & F.col("event_timestamp").isNotNull()


def fuzzy_dedup(df: DataFrame, seconds: int = FUZZY_WINDOW_SECONDS) -> DataFrame:
    """Drop a row less than ``seconds`` after the previous row of its flight.

    "Previous" means the row before it in time, kept or not, so a burst collapses to
    its first row. Rows without flight or time are kept and never shuffled.
    """
    if not {"flight_id", "event_timestamp"} <= set(df.columns):
        return df
    known = _first_in_cells(df.filter(_has_position(df)), seconds)
    kept = known.filter(_survives(seconds)).select("first.row.*")
    return kept.unionByName(df.filter(~_has_position(df)))


def deduplicate(df: DataFrame, seconds: int = FUZZY_WINDOW_SECONDS, key: str = "event_id") -> DataFrame:
    """Both removals. Whole rows are shuffled once, by their id.

    Ids are unique after the first removal, so the second one moves ids and times only and its survivors are joined
    back by id, as the rows lie. The id leads the columns and so decides between equal times, as it does in ``fuzzy_dedup``.
    """
    if df.columns[:1] != [key] or dict(df.dtypes)[key] != "string" or not {"flight_id", "event_timestamp"} <= set(df.columns):
        return fuzzy_dedup(exact_dedup(df, key), seconds)
    tag = F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit(""))  # no null: rows without an id are one, and joined like any other
    unique = exact_dedup(df.select(tag.alias("_tag"), *df.columns[1:]), "_tag")
    placed = unique.filter(_has_position(unique)).select("_tag", *(c for c in ("flight_id", "event_timestamp", "loaded_at") if c in df.columns))
    survivors = _first_in_cells(placed, seconds, kept=["_tag"]).filter(_survives(seconds)).select(F.col("first.row._tag").alias("_kept"))
    judged = unique.join(survivors, F.col("_tag") == F.col("_kept"), "left")
    own = F.when(F.col("_tag") != "", F.substr("_tag", F.lit(2))).alias(key)
    return judged.filter(F.col("_kept").isNotNull() | ~_has_position(unique)).select(own, *df.columns[1:])


def dedup_report(df: DataFrame, seconds: int = FUZZY_WINDOW_SECONDS) -> DataFrame:
    """One row: how many rows each strategy removed."""
    unique = exact_dedup(df.select("event_id", "flight_id", "event_timestamp", "loaded_at"))
    cells = _first_in_cells(unique.filter(_has_position(unique)), seconds)
    before = df.agg(F.count("*").alias("original"), F.lit(0).cast("bigint").alias("after_exact"),
                    F.lit(0).cast("bigint").alias("final_count"))
    placed = cells.agg(F.lit(0).cast("bigint").alias("original"), F.sum("members").alias("after_exact"),
                       F.count_if(_survives(seconds)).alias("final_count"))
    unplaced = unique.filter(~_has_position(unique)).agg(
        F.lit(0).cast("bigint").alias("original"), F.count("*").alias("after_exact"), F.count("*").alias("final_count"))
    totals = before.unionByName(placed).unionByName(unplaced).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("original", "after_exact", "final_count")])
    removed = F.col("original") - F.col("final_count")
    return totals.select(
        "original",
        (F.col("original") - F.col("after_exact")).alias("exact_duplicates_removed"),
        (F.col("after_exact") - F.col("final_count")).alias("fuzzy_duplicates_removed"),
        "final_count",
        removed.alias("total_removed"),
        F.coalesce(percent(removed, F.col("original"), 2), F.lit(0.0)).alias("dedup_rate_pct"),
    )


def repeated_ids(df: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per id that occurs more than once: copies and first load time."""
    counted = df.groupBy(key).agg(F.count("*").alias("copies"), F.min("loaded_at").alias("first_seen_at"))
    return counted.filter("copies > 1")


def find_duplicates(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Every member of every repeated id, with the id's copies and first load time.

    A join on the few repeated ids instead of a window over each id: AQE can split
    the side of a hot id, a window could not.
    """
    repeats = repeated_ids(df, key).withColumnRenamed(key, "_key")
    return df.join(repeats, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def duplicate_events_log(df: DataFrame) -> DataFrame:
    return find_duplicates(df).select(
        "event_id", "flight_id", "first_seen_at", F.col("loaded_at").alias("duplicate_seen_at"), "source")
