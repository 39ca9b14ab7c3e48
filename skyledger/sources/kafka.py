"""Topic source and sink. The connector jar comes from the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOPIC = "flights_raw"


def read_topic(spark: SparkSession, servers: str, topic: str = TOPIC, max_offsets: int | None = None) -> DataFrame:
    """(key, value) strings from the start of the topic; offsets live in the checkpoint."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")


def publish(messages: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Write (key, value) rows to the topic from every executor."""
    (messages.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())
