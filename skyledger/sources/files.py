"""Bulk load of JSON files and output of results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from skyledger.sources import json_arrays, payload

CORRUPT = "_corrupt"


def _schema() -> T.StructType:
    """Fields as texts: one unusable value costs that value, not its row."""
    return T.StructType(payload.TEXT_EVENT.fields + [T.StructField(CORRUPT, T.StringType())])


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(*payload.typed_event(F.col), CORRUPT).withColumnRenamed("event_timestamp", payload.EVENT_TIME_KEY)


def read_json_files(spark: SparkSession, path: str, pattern: str = "*.json", outer_array: bool = False) -> DataFrame:
    """Events from JSON files; text that is not JSON is kept in ``_corrupt``.

    ``outer_array``: each file is one JSON array, whose elements become rows; a large file is read by several tasks.
    """
    if outer_array:
        return _typed(_parsed(json_arrays.elements(json_arrays.fragments(spark, path, pattern))))
    return _typed(spark.read.schema(_schema()).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", pattern).json(path))


def _parsed(texts: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return texts.select(F.from_json("value", _schema(), options).alias("_e")).select("_e.*")


def load_new_files(spark: SparkSession, path: str, target: str, checkpoint: str, pattern: str = "*.json",
                   outer_array: bool = False) -> None:
    """Append every file not loaded before; the checkpoint remembers the loaded ones.

    Readable and unreadable rows land together, told apart by ``_corrupt``, so the
    load never fails on a bad row. Each batch is committed once (by the Parquet file sink, for arrays
    as the folder of the batch), so a restart neither loses nor repeats a file.
    """
    if outer_array:
        def write(batch: DataFrame, batch_id: int) -> None:
            _parsed(json_arrays.elements(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        writer = json_arrays.fragments(spark, path, pattern, stream=True).writeStream.foreachBatch(write)
    else:
        stream = (spark.readStream.schema(_schema()).option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", pattern).json(path))
        writer = stream.writeStream.format("parquet").option("path", target)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def loaded_rows(spark: SparkSession, target: str) -> DataFrame:
    """Every row that was JSON, typed; unusable values are NULL and left to cleaning."""
    return _typed(spark.read.schema(_schema()).parquet(target).filter(F.col(CORRUPT).isNull())).drop(CORRUPT)


def load_counts(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.schema(_schema()).parquet(target)
    return rows.agg(F.count_if(F.col(CORRUPT).isNull()).alias("rows_loaded"),
                    F.count_if(F.col(CORRUPT).isNotNull()).alias("errors_seen"))


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A result as JSON lines or CSV with a header."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown format {fmt!r}; use json or csv")
    writer = df.write.mode("errorifexists")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def write_messages(messages: DataFrame, path: str, number: int) -> None:
    """(key, value) messages as JSON lines in the folder of this number, which they replace."""
    messages.write.mode("overwrite").json(f"{path}/attempt={number:09d}")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string, attempt int").json(path).drop("attempt")


def empty_file(spark: SparkSession, path: str) -> str:
    """An empty file at ``path``."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, False).close()
    return path


def arrange(spark: SparkSession, paths: list[str], first: datetime) -> None:
    """Give files modification times a second apart, the order in which a file stream takes them."""
    for second, path in enumerate(paths):
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(file, int(first.timestamp() * 1000) + 1000 * second, -1)
