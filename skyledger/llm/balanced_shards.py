"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one global order (by key) with a range partitioning, each partition adds
up its own sizes, and the totals of the partitions, one row each, give every partition
its global offset. A row belongs to the shard in which its middle byte falls, so a shard
is off its equal share by less than one document at either end.

Defined cases: a null text has no bytes and the checksum of no bytes (0); a null key
sorts first; rows of one key, repeated rows included, are spread by a row number so that
no partition has to take them all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skyledger.llm.common import as_long, fresh, text_of, written

ROW_BYTES = 16  # counted for every row besides its text
SPREAD = 4096


def _running(size: str, names: list[str]):
    part, before, row = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, total, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            extra = [as_long(np.full(len(sizes), here)), as_long(ends - sizes), as_long(np.arange(rows, rows + len(sizes)))]
            total, rows = int(ends[-1]) if len(ends) else total, rows + len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, part, before, row])

    return run


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size and checksum of every row; the texts stay where they are."""
    return docs.select(key, (F.octet_length(text_of(text)).cast("long") + ROW_BYTES).alias("size"),
                       F.crc32(text_of(text).cast("binary")).alias("text_crc32"))


def assign(rows: DataFrame, shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), in place of columns of these names."""
    spark, rows = rows.sparkSession, rows.drop("shard", "slot")
    spread, part, before, row, base, base_row = fresh([*rows.columns, "shard", "slot"], "x_spread", "x_part", "x_before", "x_row", "x_base", "x_base_row")
    order = [F.col(key).asc_nulls_first(), F.col(spread)]
    ranged = rows.withColumn(spread, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(name, T.LongType()) for name in (part, before, row))])
    placed = written(ranged.mapInArrow(_running(size, [part, before, row]), schema), "shard-order")

    totals = sorted(placed.groupBy(part).agg(F.sum(size), F.count(F.lit(1))).collect())  # a row per partition
    offsets, total, count = [], 0, 0
    for here, of_bytes, of_rows in totals:
        offsets.append((here, total, count))
        total, count = total + of_bytes, count + of_rows
    bases = spark.createDataFrame(offsets, f"`{part}` long, `{base}` long, `{base_row}` long")
    middle = 2 * (F.col(base) + F.col(before)) + F.col(size)
    shard = F.least(F.lit(shards - 1), F.floor((middle.cast("decimal(38,0)") * shards) / F.lit(max(1, 2 * total)).cast("decimal(20,0)"))).cast("int")
    found = placed.join(F.broadcast(bases), part).withColumn("shard", shard).withColumn("slot", F.col(base_row) + F.col(row))
    firsts = {r[0]: r[1] for r in found.groupBy("shard").agg(F.min("slot")).collect()}  # a row per shard
    if not firsts:
        return found.select(*rows.columns, "shard", "slot")
    first = F.create_map(*(F.lit(x) for pair in sorted(firsts.items()) for x in pair))
    return found.withColumn("slot", F.col("slot") - first[F.col("shard")]).select(*rows.columns, "shard", "slot")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in the order of their slots within each file."""
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
