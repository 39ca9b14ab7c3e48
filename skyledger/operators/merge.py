"""MERGE on plain Parquet: upsert, insert-only and day replacement.

Parquet has no row updates, so a merge rewrites the days it touches and nothing
else. Where keys are, an index says (``snapshots.DayTable``): a merge reads the entries
its keys' hashes lead to, never a column of the table. Keys compare NULL-safe, which
keeps a repeated merge idempotent for rows without a key as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from skyledger.sources import tables
from skyledger.sources.snapshots import HELD, KEY, ROWS, Conflict, DayTable, State, seen


def _all_equal(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def one_row_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest row per key: by load time, event time, then every other column, NULL last."""
    times = [c for c in ("loaded_at", "event_timestamp") if c in df.columns]
    others = [c for c in df.columns if c not in keys + times]
    by = [F.col(c).asc_nulls_last() for c in times + others]
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert_rows(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Target after MERGE: matched rows take ``update`` columns, new keys are inserted whole.

    Of source rows with the same key the earliest counts, so a target row never multiplies.
    """
    source = one_row_per_key(source, keys)
    update = [c for c in target.columns if c not in keys] if update is None else update
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = source.select(*target.columns).withColumn("_in_source", F.lit(True)).alias("s")
    joined = t.join(s, _all_equal([f"t.{k}" for k in keys], [f"s.{k}" for k in keys]), "full_outer")
    in_target, in_source = F.col("t._in_target").isNotNull(), F.col("s._in_source").isNotNull()

    def merged(name: str) -> Column:
        from_source = ~in_target | in_source if name in update else ~in_target
        return F.when(from_source, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)

    return joined.select(*[merged(c) for c in target.columns])


def rows_to_insert(source: DataFrame, target: DataFrame, key: str = "event_id", dedupe_source: bool = True) -> DataFrame:
    """Source rows whose key the target lacks. Only the key column of the target is read."""
    fresh = one_row_per_key(source, [key]) if dedupe_source else source
    known = target.select(F.col(key).alias("_known"))
    return fresh.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


ATTEMPTS = 5  # writers that meet start again from the newest state


def _again(change: Callable[[], int]) -> int:
    for attempt in range(ATTEMPTS):
        try:
            return change()
        except Conflict:
            if attempt + 1 == ATTEMPTS:
                raise
    return 0


def unknown_rows(table: DayTable, rows: DataFrame, state: State) -> DataFrame:
    """Rows whose key the table lacks; only its index is read, and of that the prefixes that the rows hit."""
    known = table.entries(rows.select(table.key_of()), state).select(F.col(KEY).alias("_known"))
    return rows.join(known, table.key_of().eqNullSafe(F.col("_known")), "left_anti")


def insert_only(spark: SparkSession, path: str, source: DataFrame, key: str = "event_id",
                dedupe_source: bool = True, sort_by: str | None = None, batch: tuple[str, int] | None = None,
                then: Callable[[DataFrame], None] | None = None) -> int:
    """MERGE ... WHEN NOT MATCHED THEN INSERT, as an append of the missing rows; returns how many were written.

    ``batch`` names a stream and its batch: one that was inserted already is not inserted again. ``then`` is
    given the rows that were inserted.
    """
    table = DayTable(spark, path, source.schema, [key], sort_by=sort_by)
    candidates = (one_row_per_key(source, [key]) if dedupe_source else source).persist()  # what an executor loses is computed again

    def attempt() -> int:
        base = table.state()
        if seen(base, batch):
            return 0
        fresh = unknown_rows(table, candidates, base).persist() if base.pieces else candidates
        try:
            inserted = fresh.count()
            added = [*table.stage(ROWS, fresh), *table.stage_keys(fresh, inserted)] if inserted else []
            if added or batch or not base.number:
                table.commit(base, added, batch=batch)
            if then is not None and inserted:
                then(fresh)
            return inserted
        finally:
            if fresh is not candidates:
                fresh.unpersist()

    try:
        inserted = _again(attempt)
        table.upkeep()
        return inserted
    finally:
        candidates.unpersist()


def upsert_days(spark: SparkSession, path: str, source: DataFrame, keys: list[str],
                update: list[str] | None = None, sort_by: str | None = None) -> None:
    """MERGE into a day-partitioned table, rewriting only the days with a match or an insert.

    Where the day is not part of the key, a key may be stored under another day: the index names it.
    """
    indexed = tables.DAY not in keys
    table = DayTable(spark, path, source.schema, keys if indexed else None, sort_by=sort_by)
    rows = source.persist()

    def attempt() -> int:
        base = table.state()
        days, fresh = set(tables.days_of(rows)), rows
        if indexed and base.pieces:
            entries = table.entries(rows.select(table.key_of()), base)
            wanted = rows.select(table.key_of("_key"), F.col(table.day).alias("_day"))
            days |= {r[0] for r in entries.join(wanted, F.col(KEY).eqNullSafe(F.col("_key")), "left_semi").select(HELD).distinct().collect()}
            same = table.key_of().eqNullSafe(F.col("_key")) & F.col(table.day).eqNullSafe(F.col("_day"))
            fresh = rows.join(entries.select(F.col(KEY).alias("_key"), F.col(HELD).alias("_day")), same, "left_anti")
        named = [table.sections[ROWS].folder_of(d) for d in days]
        merged = upsert_rows(table.rows(days, base), rows, keys, update) if base.pieces else rows
        added = table.stage(ROWS, merged)
        if indexed:
            added += table.stage_keys(fresh, rows.count())
        table.commit(base, added, base.of(ROWS, named))
        return len(days)

    try:
        _again(attempt)
        table.upkeep()
    finally:
        rows.unpersist()
