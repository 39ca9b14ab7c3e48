"""Tables as Parquet folders in the shared file system.

Large tables are partitioned by day. Those that are built once are plain folders; those
that change are lists of folders (``snapshots``). Small tables without a day are rewritten
as a new version beside the old one; readers take the newest version that finished.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.sources.snapshots import DayTable

DAY = "event_date"
LOAD_DAY, MADE_DAY = "load_date", "transform_date"  # days of arrival in RAW and of the run that made a CLEAN row


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def dealt(df: DataFrame, *days: str) -> DataFrame:
    """Rows by day, for even files: AQE merges small days and splits a day that is too large."""
    return df.hint("rebalance", *days)


def _by_day(df: DataFrame, sort_by: str | None, days: tuple[str, ...] = (DAY,), lie_so: bool = False) -> DataFrame:
    even = df if lie_so else dealt(df, *days)
    return even.sortWithinPartitions(*days, sort_by) if sort_by else even


def write_days(df: DataFrame, path: str, sort_by: str | None = None, days: tuple[str, ...] = (DAY,), anew: bool = False, lie_so: bool = False) -> None:
    """A table that is built once; ``anew`` replaces it whole. ``lie_so``: the rows are ``dealt`` by their days already, and only derived from since."""
    _by_day(df, sort_by, days, lie_so).write.mode("overwrite" if anew else "error").partitionBy(*days).parquet(path)


def newest_days(spark: SparkSession, path: str, day: str, n: int) -> list[date]:
    """The ``n`` newest days of a table, newest first, from the names of its folders; no file is opened."""
    fs, root = _file_system(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(root)] if fs.exists(root) else []
    found = [name.partition("=")[2] for name in names if name.startswith(f"{day}=")]
    return sorted((date.fromisoformat(name) for name in found if name[:1].isdigit()), reverse=True)[:n]


def newest_day(spark: SparkSession, path: str, day: str) -> date | None:
    return next(iter(newest_days(spark, path, day, 1)), None)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table, with a known schema: no footer is opened to infer one."""
    changing = DayTable(spark, path, schema)
    return changing.rows() if changing.exists() else spark.read.schema(schema).parquet(path)


def days_of(rows: DataFrame) -> list:
    """The distinct days of a batch, None for rows without one; the calendar bounds their number."""
    return [r[0] for r in rows.select(DAY).distinct().collect()]


KEPT_VERSIONS = 2  # the newest, and the one a running reader may still hold


class VersionedTable:
    """A small table that is rewritten whole, one folder per version; old ones are removed."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _finished_versions(self) -> list[int]:
        fs, root = _file_system(self.spark, self.path)
        if not fs.exists(root):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(root)]
        numbers = [int(n.removeprefix("v")) for n in names if n.startswith("v") and n[1:].isdigit()]
        return sorted(n for n in numbers if exists(self.spark, f"{self.path}/v{n:06d}/_SUCCESS"))

    def read(self) -> DataFrame:
        versions = self._finished_versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return read(self.spark, f"{self.path}/v{versions[-1]:06d}", self.schema)

    def write(self, df: DataFrame) -> None:
        """Write the next version; ``df`` may read the current one."""
        versions = self._finished_versions()
        following = (versions[-1] if versions else 0) + 1
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v{following:06d}")
        for number in versions[:-(KEPT_VERSIONS - 1)]:
            fs, folder = _file_system(self.spark, f"{self.path}/v{number:06d}")
            fs.delete(folder, True)
