from datetime import datetime, timedelta

from pyspark.sql import functions as F, types as T

from skyledger import queries
from skyledger.operators import dedup
from skyledger.sources import payload, snapshots, tables
from skyledger.streaming import dedup as stream_dedup, ingest, live

NOW = datetime(2024, 1, 30)


def messages(layered, path, rows=None):
    payload.to_payload(layered.raw if rows is None else rows).select("value").repartition(3).write.mode("append").text(path)
    return path


def sink(spark, scratch, **options):
    return ingest.IngestSink(spark, scratch("raw"), scratch("letters"), scratch("verdicts"), NOW, **options)


def raw_rows(target):
    return tables.read(target.spark, target.raw_path, T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_date", T.DateType())]))


def run(spark, path, target, checkpoint, max_files=None):
    stream = ingest.read_message_files(spark, path, max_files)
    ingest.start_ingest(stream, target, checkpoint, available_now=True).awaitTermination()


def test_every_message_ends_in_raw_or_dead_letters(spark, layered, scratch):
    path, target, checkpoint = messages(layered, scratch("messages")), sink(spark, scratch, max_fail_rate=1.0), scratch("cp")
    run(spark, path, target, checkpoint, max_files=2)
    raw, letters = raw_rows(target), target.letters.current()
    valid_ids = {r.event_id for r in raw.collect()}
    assert len(valid_ids) == raw.count()
    verdicts = spark.read.parquet(target.verdicts_path)
    assert verdicts.count() >= 2 and verdicts.agg(F.sum("total_records")).first()[0] == layered.raw.count()
    assert letters.select("id").distinct().count() == letters.count()
    # delivering everything again adds nothing
    run(spark, messages(layered, path), target, checkpoint)
    assert raw_rows(target).count() == len(valid_ids)
    assert target.letters.current().count() == letters.count()


def test_repeated_batch_changes_nothing(spark, layered, scratch):
    target = sink(spark, scratch, max_fail_rate=1.0)
    batch = payload.to_payload(layered.raw).select("value")
    for _ in range(2):
        target(batch, 0)
    first = raw_rows(target).count()
    assert first == raw_rows(target).select("event_id").distinct().count()
    assert spark.read.parquet(target.verdicts_path).count() == 1


def test_closed_gate_sends_the_whole_batch_to_dead_letters(spark, layered, scratch):
    path, target = messages(layered, scratch("messages")), sink(spark, scratch)
    run(spark, path, target, scratch("cp"))
    assert not tables.exists(spark, target.raw_path)
    reasons = {r.error_message for r in target.letters.current().select("error_message").distinct().collect()}
    assert "batch_rejected" in reasons and "invalid_status" in reasons


def test_unreadable_message_becomes_a_dead_letter(spark, scratch):
    path, target = scratch("messages"), sink(spark, scratch, max_fail_rate=1.0)
    spark.createDataFrame([("{oops",)], "value string").write.text(path)
    run(spark, path, target, scratch("cp"))
    assert [r.raw_payload for r in target.letters.current().collect()] == ["{oops"]


EVENT = "event_id string, flight_id string, event_timestamp timestamp, altitude int"


def arrive(spark, path, rows):
    """One more file of events; shorter than a whole day's worth, in no order."""
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def consume(spark, path, sink, checkpoint):
    stream = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream_dedup.start(stream, sink, checkpoint, available_now=True).awaitTermination()
    return sink.read(stream.schema)


def test_redelivered_ids_are_dropped_across_batches(spark, scratch):
    path, checkpoint, sink = scratch("in"), scratch("cp"), stream_dedup.FirstArrivals(spark, scratch("ids"), buckets=4)
    for part in range(4):
        arrive(spark, path, [(f"E{i % 7}" if i % 9 else None, "A", NOW - timedelta(days=40 * part, minutes=i), i) for i in range(part, 40, 4)])
    out = consume(spark, path, sink, checkpoint)
    assert sorted((r.event_id for r in out.collect()), key=str) == sorted([*(f"E{i}" for i in range(7)), None], key=str)
    batch = spark.createDataFrame([("E1", "A", NOW, 1), ("NEW", "A", NOW, 1)], EVENT)
    for _ in range(2):  # a batch that runs twice
        sink(batch, 99)
    assert out.count() + 1 == sink.read(batch.schema).count()


def test_only_touched_buckets_are_read(spark, scratch, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN_IN", 2)
    sink = stream_dedup.FirstArrivals(spark, scratch("ids"))
    first = spark.createDataFrame([(f"E{i}", "A", NOW, 1) for i in range(50)], EVENT)
    for number in range(2):  # two batches are dealt to buckets
        sink(first.filter(F.col("event_id").endswith("7") == bool(number)), number)
    table = sink.table(first.schema)
    one = table.changes(first.filter("event_id = 'E3'")).inputFiles()
    assert len(one) == 1 and len(table.changes().inputFiles()) > 20


def test_stream_and_batch_drop_the_same_near_duplicates(spark, scratch):
    midnight = NOW.replace(hour=0)
    rows = [(f"E{i:03d}", "HOT" if i % 3 else f"F{i % 5}", midnight - timedelta(seconds=200) + timedelta(milliseconds=1700 * i), i) for i in range(300)]
    rows += [("N1", None, NOW, 1), ("N2", None, NOW, 2), ("N3", "A", None, 3), ("OLD", "HOT", NOW - timedelta(days=90), 4)]
    path, checkpoint, sink = scratch("in"), scratch("cp"), stream_dedup.NearDuplicates(spark, scratch("arrivals"), scratch("kept"))
    for part in (4, 1, 3, 0, 2):
        arrive(spark, path, rows[part::5])
    got = consume(spark, path, sink, checkpoint)
    expected = sorted(tuple(r) for r in dedup.fuzzy_dedup(spark.createDataFrame(rows, EVENT)).select("event_id", "altitude").collect())
    assert sorted(tuple(r) for r in got.select("event_id", "altitude").collect()) == expected and 0 < len(expected) < len(rows)
    again = stream_dedup.NearDuplicates(spark, scratch("arrivals"), scratch("kept"))
    for number, part in ((0, 4), (1, 2), (1, 2), (2, 1), (3, 3), (4, 0), (4, 0)):  # batches that run twice
        again(spark.createDataFrame(rows[part::5], EVENT), number)
    assert sorted(tuple(r) for r in again.read(got.schema).select("event_id", "altitude").collect()) == expected


def test_a_day_that_loses_its_only_row_is_empty(spark, scratch):
    """The later row of a pair around midnight arrives first; with the earlier one it has to go."""
    midnight = NOW.replace(hour=0)
    rows = [("late", "F1", midnight + timedelta(seconds=2), 1), ("early", "F1", midnight - timedelta(seconds=1), 2)]
    sink = stream_dedup.NearDuplicates(spark, scratch("arrivals"), scratch("kept"))
    for number, row in enumerate(rows):
        sink(spark.createDataFrame([row], EVENT), number)
    schema = spark.createDataFrame([], EVENT).schema
    assert [r.event_id for r in sink.read(schema).collect()] == ["early"]
    assert [r.event_id for r in dedup.fuzzy_dedup(spark.createDataFrame(rows, EVENT)).collect()] == ["early"]


def test_the_first_valid_delivery_stays(spark, layered, scratch):
    target = sink(spark, scratch, max_fail_rate=1.0)
    events = layered.raw.filter(F.col("status") == "active").dropDuplicates(["event_id"]).limit(40)
    for number, (altitude, status) in enumerate(((100, "ghost"), (200, "active"), (300, "active"))):
        changed = events.withColumns({"altitude": F.lit(altitude).cast("bigint"), "status": F.lit(status)})
        target(payload.to_payload(changed).select("value"), number)
    schema = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("altitude", T.LongType()), T.StructField("event_date", T.DateType())])
    assert {r.altitude for r in tables.read(spark, target.raw_path, schema).collect()} == {200}
    assert target.letters.current().filter("error_message LIKE '%invalid_status%'").count() == 40


POSITION = ("flight_id string, airline_iata string, latitude double, longitude double, altitude int, speed double, "
            "status string, event_timestamp timestamp, event_id string")


def test_latest_positions_survive_late_and_repeated_batches(spark, scratch):
    schema = spark.createDataFrame([], POSITION).schema
    path, checkpoint = scratch("in"), scratch("cp")
    row = lambda flight, minute, n: (flight, "AI", 1.0, 2.0, n, 3.0, "active", NOW + timedelta(minutes=minute), f"E{n}")
    spark.createDataFrame([row("A", 1, 1), row("A", 5, 2), row("B", 1, 3)], schema).write.parquet(path)
    events = spark.readStream.schema(schema).parquet(path)
    table = live.positions_table(spark, scratch("latest"), live.newest_positions(events).schema)
    live.keep_latest(events, table, checkpoint, available_now=True).awaitTermination()
    spark.createDataFrame([row("A", 3, 4), row("C", 2, 5)], schema).write.mode("append").parquet(path)
    live.keep_latest(events, table, checkpoint, available_now=True).awaitTermination()
    assert {r.flight_id: r.event_id for r in table.current().collect()} == {"A": "E2", "B": "E3", "C": "E5"}
    assert table.changes().count() == 4  # the second batch added the rows of its own flights only


def test_hourly_windows(spark, scratch):
    schema = "flight_id string, airline_iata string, event_timestamp timestamp, delay_minutes long"
    rows = [("A", "AI", NOW, 0), ("A", "AI", NOW + timedelta(minutes=10), 10), ("B", "AI", NOW + timedelta(minutes=70), 4)]
    path = scratch("in")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(path)
    hours = live.hourly_windows(spark.readStream.schema(df.schema).parquet(path))
    hours.writeStream.outputMode("update").format("memory").queryName("hours").trigger(availableNow=True).option(
        "checkpointLocation", scratch("cp")).start().awaitTermination()
    found = sorted((r.hour_start, r.unique_flights, r.total_events, r.avg_delay) for r in spark.table("hours").collect())
    assert found == [(NOW, 1, 2, 5.0), (NOW + timedelta(hours=1), 1, 1, 4.0)]


def test_a_batch_of_messages_is_written_by_many_tasks(spark, layered, scratch, monkeypatch):
    """No task holds a whole batch, and the stream still takes exactly a batch at a time."""
    monkeypatch.setattr(queries, "MESSAGE_ROWS", 40, raising=False)
    rows = queries._dealt(layered)
    wanted = {r.arrival: r.n for r in rows.groupBy("arrival").agg(F.count("*").alias("n")).collect()}
    found: dict[int, int] = {}

    def take(batch, number):
        found[number] = batch.count()

    query = queries._arrivals(layered, rows).writeStream.foreachBatch(take).option("checkpointLocation", scratch("checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert found == wanted
    written = queries._message_files(layered, rows)
    path = written if isinstance(written, str) else written[0]
    most = [r.n for r in spark.read.text(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(most) == sum(wanted.values()) and max(most) < max(wanted.values()) * 0.9 and len(most) > len(wanted)
