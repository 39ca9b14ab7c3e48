"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(col: Column, low=None, high=None) -> Column:
    """Clamp to the bounds. NULL stays NULL (bare ``greatest``/``least`` skip it)."""
    bounded = col
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    return F.when(col.isNotNull(), bounded)


def outside(col: Column, bounds: tuple) -> Column:
    """True only for a present value beyond the bounds."""
    return F.coalesce(~col.between(*bounds), F.lit(False))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole``; NULL when the whole is zero."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def fraction(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)), digits)


def count_where(condition: Column) -> Column:
    """Rows meeting the condition, as bigint (0 for none)."""
    return F.count_if(condition)
