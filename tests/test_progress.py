import json
import time

from pyspark.sql import functions as F

from skyledger.plans import health
from skyledger.streaming import progress


def told(batch, done, latest, query="q1"):
    return json.dumps({"id": query, "batchId": batch, "timestamp": f"2024-01-01T00:00:0{batch}.000Z", "batchDuration": 1200, "sources": [{
        "description": "KafkaV2[Subscribe[flights_raw]]", "startOffset": None, "endOffset": {"flights_raw": done}, "latestOffset": {"flights_raw": latest}, "numInputRows": 5}]})


def test_lag_of_a_topic_from_the_newest_batch(spark, scratch):
    path = scratch("progress")
    for line in (told(1, {"0": 5, "1": 7}, {"0": 9, "1": 7}), told(2, {"0": 9, "1": 7}, {"0": 109, "1": 57, "2": 30}), told(0, {"0": 1}, {"0": 2})):
        progress.append(spark, path, progress.lines(line))
    offsets = progress.topic_offsets(progress.read(spark, path))
    assert sorted(tuple(r) for r in offsets.collect()) == [("flights_raw", 0, 109, 9), ("flights_raw", 1, 57, 7), ("flights_raw", 2, 30, None)]
    row = health.consumer_lag(offsets).first()
    assert (row.value, row.status) == (100 + 50 + 30, "degraded")


def test_no_progress_is_no_lag(spark, scratch):
    path = scratch("progress")
    progress.append(spark, path, [])
    spark.createDataFrame([], "value string").write.text(path)
    assert health.consumer_lag(progress.topic_offsets(progress.read(spark, path))).first().value == 0


def test_the_listener_logs_every_batch(spark, scratch):
    source, path = scratch("in"), scratch("progress")
    for n in range(3):
        spark.range(n + 1).coalesce(1).write.mode("append").parquet(source)
    log = progress.ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.format("noop").option("checkpointLocation", scratch("cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(60):  # listeners are told a little later
            rows = progress.read(spark, path).filter(F.col("query") == query.id).collect() if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
                spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)) else []
            if len(rows) >= 3:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    assert sorted(r.batch_id for r in rows) == [0, 1, 2] and sum(r.input_rows for r in rows) == 6
    assert all("FileStreamSource" in r.source and r.duration_ms is not None for r in rows)
