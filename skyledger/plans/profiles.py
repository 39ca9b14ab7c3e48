"""Day partials: what a report needs of FACT, kept for each day and merged when it is asked for.

A profile says what a report counts and by what. Its table holds, by day, row counts per
(group, delay minute) and the distinct values per group, which are small beside FACT and
add up over days. When rows of some days change, those days are counted again and replaced; a
report reads partials only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.functions import times
from skyledger.operators import aggregates as A
from skyledger.sources.snapshots import DayTable
from skyledger.sources.tables import DAY


def verified(fact: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Unflagged rows of the last ``days`` days and today."""
    return fact.filter((F.col(DAY) >= times.days_before(as_of, days)) & ~F.col("data_quality_flag"))


@dataclass(frozen=True)
class Profile:
    name: str
    keys: tuple[str, ...]
    distinct: dict[str, str]  # name -> column whose distinct values are counted
    measures: Callable[[], list[A.Measure]]
    rows: Callable[[DataFrame], DataFrame] = lambda rows: rows  # which unflagged rows of FACT count

    def by_day(self, fact: DataFrame) -> DataFrame:
        """The partials of every day in ``fact``; one scan."""
        keys = [DAY, *(k for k in self.keys if k != DAY)]
        return A.partials(self.rows(fact.filter(~F.col("data_quality_flag"))), keys, self.measures(), self.distinct)

    def table(self, spark: SparkSession, path: str, fact: DataFrame) -> DayTable:
        """The table of the partials; ``fact`` gives the columns' types and is not read."""
        return DayTable(spark, path, self.by_day(fact).schema)

    def refresh(self, table: DayTable, fact: DataFrame, days: Iterable) -> None:
        """Count these days again, from ``fact``'s rows of them; a day that has none any more is empty."""
        table.replace(self.by_day(fact), days)

    def summary(self, source: DataFrame | DayTable, as_of: datetime, days: int) -> DataFrame:
        """One row per group over the look-back, from FACT itself or from the table of its partials."""
        if isinstance(source, DayTable):
            parts = source.rows().filter(F.col(DAY) >= times.days_before(as_of, days))
            merge = A.finished if DAY in self.keys else A.merged  # groups of one day are whole as they are
            return merge(parts, list(self.keys), self.measures(), self.distinct)
        return A.summarise(self.rows(verified(source, as_of, days)), list(self.keys), self.measures(), self.distinct)
