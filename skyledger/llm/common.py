"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger import session

ROWS_AT_ONCE = 512  # rows that a task turns into Python objects at a time
ARROW_ROWS = 2048
PIECE_BYTES = 1 << 20  # very long texts are split into words in pieces of about this size


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: tasks exchange rows with Python in batches that stay small with long texts."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors, is evaluated once."""
    path = session.new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, rid: str, label: str, compression: str | None = None) -> DataFrame:
    """``df`` as a written table with a number for every row.

    Numbers that are made while reading depend on how files are split, which changes with
    the executors that are there; so rows that are read more than once get theirs once.
    """
    return written(df.withColumn(rid, F.monotonically_increasing_id()), label, compression)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for helper columns that do not clash with columns the caller already has."""
    low = {name.lower() for name in taken}
    found = []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        found.append(name)
    return found


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time.

    Python workers live on for later tasks, so Arrow's free memory is given back at the end.
    """
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    pa.default_memory_pool().release_unused()


def word_lists(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``data``, a list for each piece of about ``size`` bytes."""
    if len(data) <= size:
        yield data.split()
        return
    rest = b""
    for begin in range(0, len(data), size):
        words = (rest + data[begin:begin + size]).split()
        whole = data[min(begin + size, len(data)) - 1:begin + size].isspace()
        rest = b"" if whole or not words else words.pop()
        yield words
    if rest:
        yield [rest]


class BoundedCache(dict):
    """A dict that computes what it lacks and starts anew when it is full; results never depend on that."""

    def __init__(self, compute, entries: int = 150_000, longest: int = 64):
        super().__init__()
        self.compute, self.entries, self.longest = compute, entries, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


def word_hashes(data: bytes, cache: BoundedCache) -> np.ndarray:
    """A 64-bit hash for every word of ``data``, in order."""
    parts = [np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)) for words in word_lists(data) if words]
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


@lru_cache(maxsize=1)
def hash_cache() -> BoundedCache:
    """One for all tasks of a worker."""
    return BoundedCache(xxhash.xxh64_intdigest, entries=250_000)


_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _ODD[0]
    h = (h ^ (h >> np.uint64(27))) * _ODD[1]
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    run = min(n, width)
    h = np.full(n - run + 1, run, np.uint64)
    for i in range(run):
        h = mixed(h ^ words[i:n - run + 1 + i]) + _ODD[2]
    return np.unique(h)


def as_long(values: Sequence) -> pa.Array:
    return pa.array(values, pa.int64())


def long_of(h: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark longs of the same bits."""
    return pa.array(h.view(np.int64), pa.int64())


def tasks_for(df: DataFrame, rows_each: int, rows: int | None = None) -> int:
    """Groups of about ``rows_each`` rows."""
    return max(1, -(-(df.count() if rows is None else rows) // rows_each))


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
