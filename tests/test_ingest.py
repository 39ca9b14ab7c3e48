import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from skyledger import queries
from skyledger.operators import validate
from skyledger.plans import dead_letters, health, incremental, ingest
from skyledger.sources import files, payload, tables

NOW = datetime(2024, 1, 2, 12)


def api_record(**changes):
    record = {
        "flight": {"iata": "AI101", "icao": "AIC101", "number": "101"},
        "airline": {"name": "Air India", "iata": "AI"},
        "departure": {"iata": "DEL", "airport": "Delhi", "scheduled": "2024-06-15T06:30:00+00:00", "delay": 12},
        "arrival": {"iata": "BOM", "airport": "Mumbai", "scheduled": "2024-06-15T08:30:00+00:00"},
        "live": {"latitude": 22.3, "longitude": 73.1, "altitude": 35000.7, "speed_horizontal": 850.0, "direction": 213.0},
        "aircraft": {"icao": "A320"}, "flight_status": "active",
    }
    for path, value in changes.items():
        *parents, leaf = path.split("__")
        node = record
        for parent in parents:
            node = node[parent]
        if value is KeyError:
            del node[leaf]
        else:
            node[leaf] = value
    return json.dumps(record)


def flatten(spark, *texts):
    return payload.flatten_api_records(spark.createDataFrame([(t,) for t in texts], "value string"), fetched_at=NOW).collect()


def test_api_record_is_flattened(spark):
    row, = flatten(spark, api_record())
    assert (row.flight_id, row.airline, row.source_airport, row.dest_city) == ("AI101", "Air India", "DEL", "Mumbai")
    assert (row.altitude, row.speed, row.delay_minutes, row.aircraft_type) == (35000, 850.0, 12, "A320")
    assert row.departure_time == datetime(2024, 6, 15, 6, 30) and row.event_timestamp == NOW


def test_api_defaults_and_fallbacks(spark):
    row, = flatten(spark, api_record(flight__iata=None, airline__name=KeyError, departure__iata=KeyError, aircraft=None,
                                     flight_status=KeyError, departure__delay=None, flight__number=KeyError))
    assert (row.flight_id, row.airline, row.source_airport, row.aircraft_type) == ("AIC101", "Unknown Airline", "???", "UNKN")
    assert (row.status, row.delay_minutes, row.flight_number) == ("unknown", 0, "0")


@pytest.mark.parametrize("text", [
    api_record(live=None), api_record(live__latitude=None), api_record(live__longitude=0), api_record(live__altitude="high"),
    api_record(live__latitude=KeyError), "not json", "null",
])
def test_unusable_api_records_are_dropped(spark, text):
    assert flatten(spark, text) == []


def test_api_ids_are_repeatable_and_distinct(spark):
    first, second = flatten(spark, api_record(), api_record(flight__number="7"))
    again, _ = flatten(spark, api_record(), api_record(flight__number="7"))
    assert first.event_id == again.event_id != second.event_id


def test_request_filter(spark):
    flat = payload.flatten_api_records(spark.createDataFrame(
        [(api_record(),), (api_record(airline__iata="6E"),)], "value string"))
    assert payload.request_filter(flat, airline_iata="6E").count() == 1
    assert payload.request_filter(flat, status="landed").count() == 0
    assert payload.request_filter(flat, limit=1).count() == 1


def test_payload_paths_tolerate_bad_values(spark):
    texts = ['{"event_id":"E1","altitude":"high","latitude":12.5,"timestamp":"2024-01-01T00:00:00Z"}', "broken", None]
    rows = payload.extract_paths(spark.createDataFrame([(t,) for t in texts], "raw_payload string")).collect()
    assert (rows[0].event_id, rows[0].altitude, rows[0].latitude) == ("E1", None, 12.5)
    assert rows[0].event_timestamp == datetime(2024, 1, 1)
    assert rows[1].event_id is None and rows[2].event_id is None


UNTIDY = ['{"event_id":"E1","altitude":35000.5,"speed":"812.5","delay_minutes":"7"}', '{"event_id":"E2","altitude":"n/a","timestamp":"never"}',
          '{"event_id":"E3","altitude":"1200","latitude":"x","timestamp":"2024-01-01T00:00:00Z"}', '{"event_id":"E4","altitude":-0.5,"delay_minutes":1e2}', '{"event_id":"E5","altitude":1e30}']


def test_both_extractions_agree_on_untidy_values(spark):
    texts = spark.createDataFrame([(t,) for t in UNTIDY], "value string")
    parsed = payload.parse_events(texts).drop("value")
    paths = payload.extract_paths(texts.withColumnRenamed("value", "raw_payload")).drop("raw_payload")
    same = [c for c in parsed.columns]
    assert [tuple(r) for r in parsed.select(same).orderBy("event_id").collect()] == [tuple(r) for r in paths.select(same).orderBy("event_id").collect()]
    assert [r.altitude for r in parsed.orderBy("event_id").collect()] == [35000, None, 1200, 0, None]
    assert [r.delay_minutes for r in parsed.orderBy("event_id").collect()] == [7, None, None, 100, None]


def test_bulk_load_keeps_rows_with_a_bad_field(spark, scratch):
    source, target = scratch("json"), scratch("loaded")
    spark.createDataFrame([(t,) for t in [*UNTIDY, "{broken", "[1, 2"]], "value string").coalesce(1).write.text(source)
    files.load_new_files(spark, source, target, scratch("checkpoint"), "*.txt")
    assert tuple(files.load_counts(spark, target).first()) == (5, 2)
    assert sorted((r.event_id, r.altitude) for r in files.loaded_rows(spark, target).collect() if r.event_id < "E4") == [("E1", 35000), ("E2", None), ("E3", 1200)]


def test_publish_counts(spark):
    rows = [("A", '{"x":1}'), ("A", "{broken"), ("B", None), ("B", "[1]")]
    found = {r.key: (r.messages, r.succeeded, r.failed) for r in payload.publish_counts(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert found == {"A": (2, 1, 1), "B": (2, 0, 2)}


def test_bulk_load_skips_bad_rows_and_loaded_files(spark, scratch):
    source, target, checkpoint = scratch("json"), scratch("loaded"), scratch("checkpoint")
    good = '{"event_id":"E%d","altitude":%d}'
    spark.createDataFrame([(good % (1, 5),), ("{broken",), (good % (2, 6),)], "value string").coalesce(1).write.format(
        "text").save(source)
    load = lambda: files.load_new_files(spark, source, target, checkpoint, "*.txt")
    load()
    load()
    counts = files.load_counts(spark, target).first()
    assert (counts.rows_loaded, counts.errors_seen) == (2, 1)
    spark.createDataFrame([(good % (3, 7),)], "value string").coalesce(1).write.mode("append").format("text").save(source)
    load()
    assert sorted(r.event_id for r in files.loaded_rows(spark, target).collect()) == ["E1", "E2", "E3"]


def test_outer_array_is_stripped(spark, scratch):
    source = scratch("array")
    spark.createDataFrame([('[{"event_id":"E1"},{"event_id":"E2"}]',)], "value string").coalesce(1).write.format("text").save(source)
    rows = files.read_json_files(spark, source, "*.txt", outer_array=True)
    assert sorted(r.event_id for r in rows.collect()) == ["E1", "E2"]


def test_write_result(spark, scratch):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    for fmt in ("json", "csv"):
        path = scratch(fmt)
        files.write_result(df, path, fmt)
        reader = spark.read.option("header", True)
        back = reader.json(path) if fmt == "json" else reader.csv(path)
        assert back.select("k").first().k == "a"
    with pytest.raises(ValueError):
        files.write_result(df, scratch("bad"), "xml")


def test_quick_load_uses_row_id_and_defaults(spark):
    staging = spark.createDataFrame([(7, '{"flight_id":"AI1"}')], "id long, raw_payload string")
    row = ingest.quick_raw_rows(staging, NOW).first()
    assert (row.event_id, row.status, row.altitude, row.airline, row.source) == ("7", "active", 0, "", "simulator")


def test_unprocessed_and_gate(spark):
    staging = spark.createDataFrame([("a", False, NOW), ("b", True, NOW), ("c", False, NOW - timedelta(hours=1))],
                                    "flight_id string, processed boolean, ingested_at timestamp")
    recent = ingest.unprocessed_recent(staging, NOW)
    assert [r.flight_id for r in recent.collect()] == ["a"]
    assert ingest.has_rows(recent) and not ingest.has_rows(ingest.unprocessed_recent(staging, NOW + timedelta(days=1)))


def test_window_limit_never_splits_equal_load_times(spark):
    stamps = [1, 2, 2, 2, 3]
    rows = spark.createDataFrame([(i, datetime(2024, 1, 2, s)) for i, s in enumerate(stamps)], "id int, loaded_at timestamp")
    window = incremental.incremental_window(rows, datetime(2024, 1, 1), NOW, limit=2)
    assert sorted(r.id for r in window.collect()) == [0, 1, 2, 3]
    assert incremental.incremental_window(rows, datetime(2024, 1, 2, 2), datetime(2024, 1, 2, 3)).count() == 1


def test_watermark_defaults_and_empty_batch(spark):
    control = incremental.initial_watermarks(spark)
    read = lambda table, name: spark.range(1).select(incremental.get_watermark(table, name)).first()[0]
    assert read(control, "never seen") == datetime(2024, 1, 1)
    none = spark.createDataFrame([], "loaded_at timestamp")
    same = incremental.updated_watermark(control, "raw_to_clean", none, None, "r", NOW)
    assert read(same, "raw_to_clean") == datetime(2024, 1, 1) and same.count() == 4
    some = spark.createDataFrame([(NOW,)], "loaded_at timestamp")
    moved = incremental.updated_watermark(control, "raw_to_clean", some, None, "r", NOW)
    assert read(moved, "raw_to_clean") == NOW and read(moved, "route_aggregation") == datetime(2024, 1, 1)


def test_incremental_run_is_complete_and_repeatable(spark, layered, scratch):
    path = scratch("clean")
    control = tables.VersionedTable(spark, scratch("watermarks"), incremental.WATERMARKS)
    control.write(incremental.initial_watermarks(spark))
    first = incremental.run_raw_to_clean(spark, layered.raw, path, control, datetime(2024, 1, 15), "r1")
    assert first["status"] == "success" and first["records_out"] == first["records_after_dedup"] > 0
    assert first["records_in"] - first["dedup_removed"] == first["records_out"]
    again = incremental.run_raw_to_clean(spark, layered.raw, path, control, datetime(2024, 1, 15), "r2")
    assert again["records_out"] == 0
    second = incremental.run_raw_to_clean(spark, layered.raw, path, control, datetime(2024, 2, 1), "r3")
    assert second["records_out"] > 0
    assert incremental.run_raw_to_clean(spark, layered.raw, path, control, datetime(2024, 2, 1), "r4")["status"] in ("no_data", "success")
    ids = [r.event_id for r in tables.read(spark, path, T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_date", T.DateType())])).select("event_id").collect()]
    assert len(ids) == len(set(ids)) == first["records_out"] + second["records_out"]


RUNS = "run_id string, dag_id string, started_at timestamp, finished_at timestamp, records_read long, records_written long, records_failed long"


def runs(spark, written):
    data = [(f"r{i}", "d", NOW + timedelta(hours=i), NOW + timedelta(hours=i, seconds=10), 100, w, 100 - w)
            for i, w in enumerate(written)]
    return incremental.finalise_runs(spark.createDataFrame(data, RUNS))


def test_run_metrics(spark):
    row = runs(spark, [90]).first()
    assert (row.elapsed_seconds, row.throughput_rps, row.error_rate_pct) == (10.0, 9.0, 10.0)


@pytest.mark.parametrize("written, trend, n", [
    ([], "no_data", 0), ([50], "stable", 1), ([50, 50], "stable", 2), ([10, 10, 90, 90], "improving", 4),
    ([90, 90, 10], "degrading", 3), ([0, 50], "stable", 1),
])
def test_throughput_trend(spark, written, trend, n):
    row = incremental.throughput_trend(runs(spark, written), "d").first()
    assert (row.trend, row.runs) == (trend, n)


def test_the_trend_query_returns_the_figures_of_the_trend(layered):
    """What an hour loads decides its throughput; the ten last loads of even hours, newer half against older."""
    row = queries.throughput_trend(layered).first()
    found: dict[datetime, list[bool]] = {}
    for r in validate.with_row_errors(layered.raw).select("loaded_at", (F.size("errors") == 0).alias("ok")).collect():
        found.setdefault(r.loaded_at.replace(minute=0, second=0, microsecond=0), []).append(r.ok)
    rates = [sum(found[h]) / (5 + len(found[h]) % 17 + h.hour) for h in sorted(h for h in found if h.hour % 2 == 0)[-10:]]
    rates = [r for r in rates if round(r, 2) > 0]
    older, newer = rates[:len(rates) // 2], rates[len(rates) // 2:]
    assert row.loads == len(rates) and row.avg_rps == pytest.approx(sum(rates) / len(rates), abs=0.02)
    assert row.recent_avg == pytest.approx(sum(newer) / len(newer), abs=0.02) and row.older_avg == pytest.approx(sum(older) / len(older), abs=0.02)
    assert row.trend in ("improving", "degrading", "stable") and row.runs == 4


def letters(spark):
    data = [("E1", "A", '{"event_id":"E1"}', NOW), ("E2", None, "broken", NOW + timedelta(1)), (None, "B", "[1]", NOW)]
    rows = spark.createDataFrame(data, "event_id string, flight_id string, value string, at timestamp")
    return dead_letters.dead_letters(rows, F.repeat(F.lit("x"), 3000), "test", F.col("at"), payload=F.col("value"))


def test_dead_letters_keep_payload_and_the_whole_error(spark):
    rows = {r.event_id: r for r in letters(spark).collect()}
    assert len(rows["E1"].error_message) == 3000 and rows["E1"].raw_payload == '{"event_id":"E1"}'
    assert rows["E2"].flight_id == "unknown" and set(rows) == {"E1", "E2", "unknown"}


def test_replay_keeps_the_number_of_letters_with_equal_rows(spark):
    rows = spark.createDataFrame([("E1", "A", '{"event_id":"E1"}', NOW)] * 2, "event_id string, flight_id string, value string, at timestamp")
    twice = dead_letters.dead_letters(rows, F.lit("bad"), "test", F.col("at"), payload=F.col("value"))
    assert twice.count() == 1
    after = dead_letters.judged(twice, twice.select("id"))
    messages = dead_letters.messages_of(after)
    assert (messages.count(), after.count()) == (1, 1)
    assert twice.select(dead_letters.display_error(F.repeat("error_message", 2000)).alias("e")).first().e == ("bad" * 2000)[:2000]


def test_replay_marks_letters_and_returns_messages(spark):
    all_letters = letters(spark)
    after = dead_letters.judged(all_letters, all_letters.select("id"))
    messages = dead_letters.messages_of(after)
    assert [(m.key, m.value) for m in messages.collect()] == [("A", '{"event_id":"E1"}')]
    stats = {r.status: r.letters for r in dead_letters.letter_stats(after).collect()}
    assert stats == {"replayed": 1, "replay_failed": 2}
    assert dead_letters.pending_letters(after).count() == 0
    assert not dead_letters.volume_alert(after).first().alert
    assert dead_letters.volume_alert(all_letters, threshold=3).first().alert


@pytest.mark.parametrize("end, committed, status", [(100, 0, "healthy"), (500, 0, "degraded"), (5000, 100, "down"), (5, 50, "healthy")])
def test_consumer_lag(spark, end, committed, status):
    offsets = spark.createDataFrame([("t", 0, end, committed)], "topic string, partition int, end_offset long, committed long")
    assert health.consumer_lag(offsets).first().status == status


@pytest.mark.parametrize("states, overall", [
    (["healthy", "healthy"], "HEALTHY"), (["healthy", "degraded"], "DEGRADED"), (["down", "degraded"], "DOWN")])
def test_overall_health(spark, states, overall):
    parts = spark.createDataFrame([(s,) for s in states], "status string")
    assert health.overall_health(parts).first().overall_status == overall


def test_empty_layer_is_degraded(spark, layered):
    none = layered.raw.limit(0)
    rows = {r.component: r for r in health.layer_freshness(none, layered.clean, layered.fact, layered.as_of).collect()}
    assert rows["raw_freshness"].status == "degraded" and rows["raw_freshness"].value is None


def test_custom_checks(spark):
    df = spark.createDataFrame([(1,), (5,)], "n int")
    found = health.run_checks(df, [health.check("most", F.max("n"), F.max("n") < 3), health.check("few", F.count("*"), F.count("*") > 9, "warn")])
    assert [(r.check_name, r.status) for r in found.collect()] == [("most", "FAIL"), ("few", "WARN")]


def test_published_payload_reads_back(spark, layered):
    back = payload.parse_events(payload.to_payload(layered.raw).select("value")).drop("value")
    originals = layered.raw.select(back.columns)
    assert back.exceptAll(originals).count() == 0 and originals.exceptAll(back).count() == 0
    assert validate.with_row_errors(back).filter(F.size("errors") > 0).count() > 0
