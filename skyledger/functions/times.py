"""Date and time expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def as_timestamp(moment: datetime | Column) -> Column:
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")


def ago(moment: datetime | Column, **amount: int) -> Column:
    """``moment`` minus e.g. ``minutes=30`` or ``days=7``."""
    (unit, n), = amount.items()
    return as_timestamp(moment) - F.expr(f"INTERVAL '{n}' {unit.rstrip('s').upper()}")


def day_of(moment: datetime | Column) -> Column:
    return F.to_date(as_timestamp(moment))


def days_before(moment: datetime | Column, days: int) -> Column:
    return F.date_sub(day_of(moment), days)


def minutes_between(earlier: Column, later: Column) -> Column:
    """Minute boundaries crossed, so 00:59:59 to 01:00:00 counts as one."""
    start = F.unix_seconds(F.date_trunc("minute", earlier))
    end = F.unix_seconds(F.date_trunc("minute", later))
    return ((end - start) / 60).cast("bigint")


def sunday_zero(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1).cast("int")


def monday_zero(ts: Column) -> Column:
    return F.weekday(ts).cast("int")
