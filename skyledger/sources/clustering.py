"""Tables laid out by several columns at once, so that a filter on any of them opens few files.

Each column's values are cut into ranges of about equal numbers of rows, by a sample; the
bits of a row's range numbers are interleaved into one number, and the files of a day are
ranges of that number. Rows that agree in some of the columns so lie in few files, whichever
columns these are. A row per file with the extremes of the columns tells which files a
filter needs; the others are not opened.

The cuts decide only where a row lies: any sample gives the same results. A value that fills
a third of the table is spread over several files by a hash of the row's id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.sources import tables

BITS = 5  # a column has at most 2 ** BITS ranges
SAMPLE_ROWS = 20_000  # rows that decide the cuts: those with the least hashes of their ids
FILE, ROWS = "file", "file_rows"
Z, SPREAD = "_z", "_spread"


def cut_points(values: list, bits: int = BITS) -> list:
    """At most 2 ** bits - 1 distinct values that cut sorted ``values`` into ranges of about equal size."""
    values = sorted(v for v in values if v is not None)
    ranges = 1 << bits
    found = sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []
    return [v for v in found if v > values[0]]  # a cut begins a range; the least value needs none


def range_number(column: Column, cuts: list, bits: int = BITS) -> Column:
    """The range of a value, by a search tree of comparisons; 0 for null.

    Few ranges are numbered in wide steps, so that the highest bits of every column tell its ranges apart.
    """
    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit((low << bits) // (len(cuts) + 1))
        middle = (low + high) // 2
        return F.when(column < F.lit(cuts[middle]), below(low, middle)).otherwise(below(middle + 1, high))

    return F.when(column.isNull(), F.lit(0)).otherwise(below(0, len(cuts)))


def interleaved(numbers: list[Column], bits: int = BITS) -> Column:
    """One number of the bits of all ``numbers``, the highest bits first."""
    parts = [F.shiftleft(F.shiftright(n, b).bitwiseAND(F.lit(1)).cast("long"), b * len(numbers) + len(numbers) - 1 - i)
             for b in range(bits) for i, n in enumerate(numbers)]
    total = parts[0]
    for part in parts[1:]:
        total = total.bitwiseOR(part)
    return total


def sampled_cuts(rows: DataFrame, columns: list[str], key: str, sample_rows: int = SAMPLE_ROWS) -> dict[str, list]:
    """The cuts of every column, from a sample of bounded size that is the same whenever it is taken."""
    sample = rows.select(*columns, F.xxhash64(key).alias("_h")).orderBy("_h").limit(sample_rows).collect()
    return {c: cut_points([r[c] for r in sample]) for c in columns}


class ClusteredTable:
    """A table by day that is built once, with a row of figures for every file."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, columns: list[str], key: str = "event_id"):
        self.spark, self.path, self.schema, self.columns, self.key = spark, path, schema, columns, key

    @property
    def _index_path(self) -> str:
        return f"{self.path}-files"

    def write(self, rows: DataFrame, files: int | None = None) -> None:
        """Ranges of (day, interleaved number) become files: ``files`` of them, or as many as the sizes ask for.

        Without a number AQE joins neighbouring ranges that are small, so the order of the ranges stays.
        """
        cuts = sampled_cuts(rows, self.columns, self.key)
        z = interleaved([range_number(F.col(c), cuts[c]) for c in self.columns])
        placed = rows.withColumns({Z: z, SPREAD: F.xxhash64(self.key)})
        order = [tables.DAY, Z, SPREAD]
        ranged = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
        ranged.sortWithinPartitions(tables.DAY, Z).drop(Z, SPREAD).write.partitionBy(tables.DAY).parquet(self.path)
        self._index().write.parquet(self._index_path)

    def _index(self) -> DataFrame:
        """A row per file: its day, its rows, and for each column the extremes and the nulls. Reads these columns only."""
        figures = [f(c).alias(f"{name}_{c}") for c in self.columns for name, f in (("least", F.min), ("greatest", F.max))]
        nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in self.columns]
        named = self.rows().withColumn(FILE, F.col("_metadata.file_path"))
        return named.groupBy(FILE, tables.DAY).agg(F.count("*").alias(ROWS), *figures, *nulls)

    @cached_property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(self._index_path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _may_hold(self, column: str, value) -> Column:
        """Files that may hold rows with ``column`` equal to ``value``, to one of its values (a list), or within it (a pair)."""
        if column == tables.DAY:
            return self._wanted(column, value)
        least, greatest = F.col(f"least_{column}"), F.col(f"greatest_{column}")
        if value is None:
            return F.col(f"nulls_{column}") > 0
        if isinstance(value, tuple):
            return (greatest >= F.lit(value[0])) & (least <= F.lit(value[1]))
        if isinstance(value, list):
            held = F.lit(False)
            for one in value:
                held = held | self._may_hold(column, one)
            return held
        return F.lit(value).between(least, greatest)

    def _wanted(self, column: str, value) -> Column:
        c = F.col(column)
        if value is None:
            return c.isNull()
        if isinstance(value, tuple):
            return c.between(*map(F.lit, value))
        if isinstance(value, list):
            given = [v for v in value if v is not None]
            return c.isin(given) | c.isNull() if None in value else c.isin(given)
        return c == F.lit(value)

    def files_for(self, **filters) -> list[str]:
        """The files that a filter needs: names only, at most as many as Spark would list."""
        held = self.index
        for column, value in filters.items():
            held = held.filter(self._may_hold(column, value))
        return [r[0] for r in held.select(FILE).orderBy(FILE).collect()]

    def where(self, **filters) -> DataFrame:
        """The rows that pass every filter: a value, None for null, a list of values, or a pair (from, to)."""
        found = self.files_for(**filters)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*found)
        for column, value in filters.items():
            rows = rows.filter(self._wanted(column, value))
        return rows
