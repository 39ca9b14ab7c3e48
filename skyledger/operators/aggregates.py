"""Group statistics that need a distribution (median, percentile, deviation).

Ordinary sums, means and maxima combine before the shuffle by themselves. Exact
percentiles would not combine well on raw rows: Spark falls back to sorting them
once a task sees more than a few groups. Delay minutes are whole numbers with few
distinct values, so ``partials`` counts rows per (group, minute) with plain hash
aggregation, and reduces distinct values the same way beside it, in one scan. Every
statistic comes from these, by one last aggregation at group grain; partials of days
can be kept and merged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from skyledger.functions.numbers import percent

VALUE = "delay_minutes"
_FREQ = "_freq"


class Measure(NamedTuple):
    partials: list[tuple[str, Column]]
    final: Column


def rows(name: str) -> Measure:
    return Measure([("_rows", F.count("*"))], F.sum("_rows").alias(name))


def total(name: str, col: Column) -> Measure:
    return Measure([(f"_sum_{name}", F.sum(col))], F.sum(f"_sum_{name}").alias(name))


def occurrences(name: str, condition: Column) -> Measure:
    return Measure([(f"_if_{name}", F.count_if(condition))], F.sum(f"_if_{name}").alias(name))


def share(name: str, condition: Column, digits: int) -> Measure:
    """Percentage of rows that meet the condition."""
    return Measure([(f"_if_{name}", F.count_if(condition)), ("_rows", F.count("*"))],
                   percent(F.sum(f"_if_{name}"), F.sum("_rows"), digits).alias(name))


def mean(name: str, col: Column, digits: int) -> Measure:
    parts = [(f"_sum_{name}", F.sum(col.cast("double"))), (f"_n_{name}", F.count(col))]
    value = F.sum(f"_sum_{name}") / F.nullif(F.sum(f"_n_{name}"), F.lit(0))
    return Measure(parts, F.round(value, digits).alias(name))


def largest(name: str, col: Column) -> Measure:
    return Measure([(f"_max_{name}", F.max(col))], F.max(f"_max_{name}").alias(name))


def quantile(name: str, p: float, digits: int) -> Measure:
    return Measure([(_FREQ, F.count(VALUE))], F.round(F.percentile(VALUE, p, F.col(_FREQ)), digits).alias(name))


def deviation(name: str, digits: int | None = None) -> Measure:
    """Sample standard deviation from whole-number counts; NULL for one row."""
    value, n = F.col(VALUE).cast("double"), F.sum(_FREQ)
    centre = F.sum(value * F.col(_FREQ)) / n
    spread = (F.sum(value * value * F.col(_FREQ)) - F.sum(value * F.col(_FREQ)) * centre) / (n - 1)
    result = F.sqrt(F.greatest(spread, F.lit(0.0)))
    rounded = result if digits is None else F.round(result, digits)
    return Measure([(_FREQ, F.count(VALUE))], F.when(n > 1, rounded).alias(name))


def partials(df: DataFrame, keys: list[str], measures: list[Measure], distinct: dict[str, str]) -> DataFrame:
    """What ``merged`` needs of ``df``: counts per (group, minute), and the distinct values per group.

    Both come from one scan and one exchange: a row counts once for its minute, and once for each
    counted column, and both combine before the exchange. Partials of parts of ``df`` may be stacked.
    """
    columns = {name: col for m in measures for name, col in m.partials}
    text = T.StringType()
    slots = [F.struct(F.lit(None).cast(text).alias("_count"), F.lit(None).cast(text).alias("_value"), F.col(VALUE).alias("_minute"))]
    slots += [F.struct(F.lit(name).alias("_count"), F.col(col).cast(text).alias("_value"), F.lit(None).cast(df.schema[VALUE].dataType).alias("_minute"))
              for name, col in distinct.items()]
    spread = df.withColumn("_slot", F.explode(F.array(*slots))).filter("_slot._count IS NULL OR _slot._value IS NOT NULL")
    counted = spread.groupBy(*keys, F.col("_slot._count").alias("_count"), F.col("_slot._value").alias("_value"), F.col("_slot._minute").alias(VALUE)).agg(
        *[col.alias(name) for name, col in columns.items()])
    plain = F.col("_count").isNull()
    return counted.select(*keys, "_count", "_value", VALUE, *[F.when(plain, F.col(name)).alias(name) for name in columns])


def finished(parts: DataFrame, keys: list[str], measures: list[Measure], distinct: dict[str, str]) -> DataFrame:
    """One row per group of ``partials``: the measures, and ``{name: column}`` distinct counts."""
    uniques = [F.count_if(F.col("_count") == name).alias(name) for name in distinct]
    return parts.groupBy(*keys).agg(*[m.final for m in measures], *uniques)


def merged(parts: DataFrame, keys: list[str], measures: list[Measure], distinct: dict[str, str]) -> DataFrame:
    """As ``finished``, of the stacked partials of several parts (days), where a group and its values may occur in each."""
    columns = [name for name in dict.fromkeys(name for m in measures for name, _ in m.partials)]
    pick = {name: F.max(name) if name.startswith("_max_") else F.sum(name) for name in columns}
    return finished(parts.groupBy(*keys, "_count", "_value", VALUE).agg(*[col.alias(name) for name, col in pick.items()]), keys, measures, distinct)


def summarise(df: DataFrame, keys: list[str], measures: list[Measure], distinct: dict[str, str]) -> DataFrame:
    """One row per group: the measures, and ``{name: column}`` distinct counts, from one scan of ``df``.

    Grouping treats NULL keys alike, so no join is needed.
    """
    return finished(partials(df, keys, measures, distinct), keys, measures, distinct)
