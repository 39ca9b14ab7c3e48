"""Progress of the streams: offsets and durations of every batch, and what is left to read.

``ProgressLog`` is a listener: Spark tells it of each batch, and it adds a line to a folder of
JSON lines. Behind a topic source the newest line of a query says up to where it has read and
where each partition ends, which is the lag.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = ("query string, batch_id long, at timestamp, duration_ms long, input_rows long, source string, "
            "start_offset string, end_offset string, latest_offset string")
_OFFSETS = "map<string, map<string, bigint>>"  # topic -> partition -> offset


def lines(progress) -> list[str]:
    """A JSON line for each source of a batch's progress (as Spark reports it)."""
    told = json.loads(progress if isinstance(progress, str) else progress.json)
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    return [json.dumps({
        "query": told["id"], "batch_id": told["batchId"], "at": told["timestamp"], "duration_ms": told.get("batchDuration"), "input_rows": source.get("numInputRows"),
        "source": source.get("description"), "start_offset": text(source.get("startOffset")), "end_offset": text(source.get("endOffset")), "latest_offset": text(source.get("latestOffset")),
    }) for source in told["sources"]]


class ProgressLog(StreamingQueryListener):
    """Add every batch of every stream of the session to the log; ``spark.streams.addListener(ProgressLog(spark, path))``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        append(self.spark, self.path, lines(event.progress))

    def onQueryTerminated(self, event) -> None:
        pass


def append(spark: SparkSession, path: str, found: list[str]) -> None:
    if found:
        spark.createDataFrame([(x,) for x in found], "value string").coalesce(1).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)


def topic_offsets(progress: DataFrame) -> DataFrame:
    """(topic, partition, end_offset, committed) from the newest batch of each query over a topic."""
    newest = W.partitionBy("query", "source").orderBy(F.desc("batch_id"))
    last = progress.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    offsets = last.select(F.from_json("latest_offset", _OFFSETS).alias("latest"), F.from_json("end_offset", _OFFSETS).alias("done")).filter("latest IS NOT NULL")
    topics = offsets.select(F.explode("latest").alias("topic", "ends"), "done")
    ends = topics.select("topic", F.explode("ends").alias("partition", "end_offset"), F.try_element_at("done", F.col("topic")).alias("done"))
    return ends.select("topic", F.col("partition").cast("bigint").alias("partition"), "end_offset",
                       F.try_element_at("done", F.col("partition")).alias("committed"))


def folder_offsets(messages: DataFrame, runs: DataFrame, topic: str, dag_id: str = "ingestion") -> DataFrame:
    """The same for a folder of messages: how many there are, and how many the runs of the job have read."""
    read_so_far = runs.filter(F.col("dag_id") == dag_id).agg(F.coalesce(F.sum("records_read"), F.lit(0)).alias("n")).scalar()
    return messages.agg(F.count("*").alias("end_offset")).select(
        F.lit(topic).alias("topic"), F.lit(0).cast("bigint").alias("partition"), "end_offset", read_so_far.alias("committed"))
