"""The registered queries: name -> function of (session, folder with the tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from skyledger import session
from skyledger.functions import display, times
from skyledger.operators import clean, dedup, expectations, merge, validate
from skyledger.plans import dead_letters, health, incremental, ingest, kpis, reports, slices, star, views
from skyledger.plans.layers import Layers, layers
from skyledger.settings import QUALITY_GATE_MAX_FAIL_RATE
from skyledger.sources import files, flights_from_events, payload, tables
from skyledger.streaming import dedup as stream_dedup, ingest as stream_ingest, live, progress

Query = Callable[[SparkSession, str], DataFrame]

FACT_MINUTES = 20  # fixed value: look-back of the FACT build
SHOWN_DAYS = 14  # fixed value: days of the error-rate chart
STAGING_AS_OF = datetime(2024, 1, 30, 12)  # a time at which rows have arrived in the ten minutes before

_registry: dict[str, Callable[[Layers], DataFrame]] = {}


def query(function: Callable[[Layers], DataFrame]) -> Callable[[Layers], DataFrame]:
    _registry[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    def bind(function: Callable[[Layers], DataFrame]) -> Query:
        return lambda spark, sf_dir: function(layers(spark, sf_dir))

    return {name: bind(function) for name, function in _registry.items()}


# --- Raw rows, deduplication, cleaning ----------------------------------------------

@query
def raw_flights(t: Layers) -> DataFrame:
    return flights_from_events.raw_flights(t.spark, t.sf_dir)


@query
def exact_dedup(t: Layers) -> DataFrame:
    return dedup.exact_dedup(t.raw)


@query
def fuzzy_dedup(t: Layers) -> DataFrame:
    return dedup.deduplicate(t.raw)


@query
def clean_canonical(t: Layers) -> DataFrame:
    return clean.clean_flights(t.raw, F.col("loaded_at") + F.expr("INTERVAL 5 MINUTES"))


# --- Star schema ----------------------------------------------------------------------

@query
def fact_rows(t: Layers) -> DataFrame:
    return star.fact_rows(t.clean)


@query
def fact_recent_build(t: Layers) -> DataFrame:
    return star.fact_rows(t.clean_made(times.day_of(times.ago(t.as_of, minutes=FACT_MINUTES))), t.as_of, FACT_MINUTES)


@query
def dim_airlines(t: Layers) -> DataFrame:
    return star.dim_airlines(t.clean)


@query
def dim_airports(t: Layers) -> DataFrame:
    return star.dim_airports(t.clean)


@query
def hourly_summary(t: Layers) -> DataFrame:
    return star.hourly_summary(t.fact, t.as_of)


@query
def hourly_refresh(t: Layers) -> DataFrame:
    return star.hourly_refresh(t.fact, times.day_of(t.as_of), t.as_of)


@query
def routes_from_clean(t: Layers) -> DataFrame:
    return star.routes_from_clean(t.clean, t.as_of)


@query
def routes_from_fact(t: Layers) -> DataFrame:
    return star.routes_from_fact(t.fact, t.as_of)


# --- The ten reports ------------------------------------------------------------------

@query
def active_airlines_now(t: Layers) -> DataFrame:
    return views.active_airlines_now(t.fact, t.airlines, t.as_of)


@query
def delay_patterns(t: Layers) -> DataFrame:
    return views.delay_patterns(t.daily(views.DELAYS), t.as_of)


@query
def airline_league(t: Layers) -> DataFrame:
    return views.airline_league(t.daily(views.LEAGUE), t.airlines, t.as_of)


@query
def peak_hours(t: Layers) -> DataFrame:
    return views.peak_hours(t.fact, t.as_of)


@query
def airport_congestion(t: Layers) -> DataFrame:
    return views.airport_congestion(t.fact, t.airports, t.as_of)


@query
def route_efficiency(t: Layers) -> DataFrame:
    return views.route_efficiency(t.daily(views.ROUTES), t.as_of)


@query
def aircraft_performance(t: Layers) -> DataFrame:
    return views.aircraft_performance(t.daily(views.AIRCRAFT), t.as_of)


@query
def weekly_trends(t: Layers) -> DataFrame:
    return views.weekly_trends(t.fact, t.as_of)


@query
def intl_vs_domestic(t: Layers) -> DataFrame:
    return views.intl_vs_domestic(t.fact, t.as_of)


@query
def health_scorecard(t: Layers) -> DataFrame:
    today = times.day_of(t.as_of)
    return views.health_scorecard(t.raw_loaded(today, today), t.clean_made(today, today), t.fact, t.as_of)


# --- Cleaning profiles, reports of the cleaner and of deduplication --------------------

@query
def clean_warehouse(t: Layers) -> DataFrame:
    return clean.clean_warehouse_profile(dedup.exact_dedup(t.raw), t.as_of)


@query
def clean_scheduled(t: Layers) -> DataFrame:
    return clean.clean_scheduled_profile(dedup.exact_dedup(t.raw), t.as_of)


@query
def clean_quick_load(t: Layers) -> DataFrame:
    return clean.clean_quick_load_profile(t.raw, t.as_of)


@query
def clean_layer(t: Layers) -> DataFrame:
    """RAW to CLEAN as written: both deduplications, then the canonical cleaner."""
    return t.clean


@query
def transform_report(t: Layers) -> DataFrame:
    return clean.transform_report(t.clean)


@query
def dedup_report(t: Layers) -> DataFrame:
    return dedup.dedup_report(t.raw)


@query
def duplicate_events(t: Layers) -> DataFrame:
    return dedup.find_duplicates(t.raw)


@query
def duplicate_events_log(t: Layers) -> DataFrame:
    return dedup.duplicate_events_log(t.raw)


# --- Validation -------------------------------------------------------------------------

@query
def validation_raw(t: Layers) -> DataFrame:
    return validate.validate(t.raw, t.as_of)


@query
def validation_clean(t: Layers) -> DataFrame:
    return validate.validate(t.clean, t.as_of)


@query
def validation_summary(t: Layers) -> DataFrame:
    return validate.validation_summary(validate.validate(t.raw, t.as_of))


@query
def validation_samples(t: Layers) -> DataFrame:
    return validate.failure_samples(t.raw, t.as_of)


@query
def expectation_suite(t: Layers) -> DataFrame:
    return expectations.check_expectations(t.raw)


@query
def expectation_summary(t: Layers) -> DataFrame:
    return expectations.expectation_summary(expectations.check_expectations(t.clean))


@query
def numeric_profile(t: Layers) -> DataFrame:
    return expectations.numeric_profile(t.raw, quartiles=True)


@query
def row_errors(t: Layers) -> DataFrame:
    checked = validate.with_row_errors(t.raw)
    return checked.select("event_id", "loaded_at", F.array_join("errors", ",").alias("errors"))


@query
def error_breakdown(t: Layers) -> DataFrame:
    return validate.error_breakdown(validate.with_row_errors(t.raw))


@query
def quality_gate(t: Layers) -> DataFrame:
    return validate.quality_gate(validate.with_row_errors(t.raw))


# --- Payloads and ingestion ----------------------------------------------------------------

def _staging(t: Layers, since: datetime | None = None) -> DataFrame:
    """RAW rows as staged messages; rows older than six hours count as processed. ``since``: only of the days from there."""
    messages = payload.to_payload(t.raw if since is None else t.raw_loaded(times.day_of(since)))
    staged = payload.staging_rows(messages, F.col("loaded_at"))
    return staged.withColumn("processed", F.col("ingested_at") < times.ago(t.as_of, hours=6))


@query
def publish_messages(t: Layers) -> DataFrame:
    """Messages per key, as published."""
    messages = payload.to_payload(t.raw)
    return payload.publish_counts(messages)


@query
def payload_projection(t: Layers) -> DataFrame:
    return _staging(t).drop("raw_payload", "processed")


@query
def payload_paths(t: Layers) -> DataFrame:
    return payload.extract_paths(_staging(t).select("raw_payload")).drop("raw_payload")


@query
def unprocessed_recent(t: Layers) -> DataFrame:
    return ingest.unprocessed_recent(_staging(t, STAGING_AS_OF - timedelta(minutes=10)), STAGING_AS_OF).drop("raw_payload")


@query
def data_present_gate(t: Layers) -> DataFrame:
    recent = ingest.unprocessed_recent(_staging(t, STAGING_AS_OF - timedelta(minutes=10)), STAGING_AS_OF)
    return recent.agg(F.count("*").alias("waiting"), (F.count("*") > 0).alias("ready"))


def _api_records(t: Layers) -> DataFrame:
    """RAW rows as nested API records; absent values leave their field out."""
    parts = {
        "flight": F.struct(F.col("flight_id").alias("iata"), F.col("flight_number").alias("number")),
        "airline": F.struct(F.col("airline").alias("name"), F.col("airline_iata").alias("iata")),
        "departure": F.struct(F.col("source_airport").alias("iata"), F.col("source_city").alias("airport"),
                              F.col("departure_time").alias("scheduled"), F.col("delay_minutes").alias("delay")),
        "arrival": F.struct(F.col("dest_airport").alias("iata"), F.col("dest_city").alias("airport"),
                            F.col("arrival_time").alias("scheduled")),
        "live": F.struct("latitude", "longitude", "altitude", F.col("speed").alias("speed_horizontal"),
                         F.col("heading").alias("direction")),
        "aircraft": F.struct(F.col("aircraft_type").alias("icao")),
        "flight_status": F.col("status"),
    }
    record = F.struct(*[col.alias(name) for name, col in parts.items()])
    return t.raw.select(F.to_json(record, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


@query
def api_flatten(t: Layers) -> DataFrame:
    return payload.flatten_api_records(_api_records(t), fetched_at=t.as_of).drop("event_id")


@query
def api_request_filter(t: Layers) -> DataFrame:
    flat = payload.flatten_api_records(_api_records(t), fetched_at=t.as_of).drop("event_id")
    return payload.request_filter(flat, airline_iata="AI", status="active", departure="DEL")


@query
def bulk_load_json(t: Layers) -> DataFrame:
    """Events written as JSON lines, loaded twice: the second load finds nothing new."""
    source = session.new_path(t.spark, "json-files")
    events = t.raw.withColumnRenamed("event_timestamp", "timestamp").drop("loaded_at")
    events.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(source)
    target, checkpoint = session.new_path(t.spark, "json-loaded"), session.new_path(t.spark, "json-checkpoint")
    for _ in range(2):
        files.load_new_files(t.spark, source, target, checkpoint)
    return files.loaded_rows(t.spark, target)


@query
def bulk_load_untidy_json(t: Layers) -> DataFrame:
    """JSON arrays and lines whose numbers are fractional, quoted or no numbers, and lines that are not JSON."""
    e = F.regexp_extract("event_id", "([0-9]+)$", 1).cast("bigint")
    altitude = F.when(e % 4 == 0, F.concat(F.col("altitude").cast("string"), F.lit(".5"))).when(
        e % 4 == 1, F.concat(F.lit('"'), F.col("altitude").cast("string"), F.lit('"'))).when(e % 4 == 2, F.lit('"n/a"')).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"event_id":"'), F.col("event_id"), F.lit('","altitude":'), F.coalesce(altitude, F.lit("null")), F.lit("}"))
    rows = t.raw.select(F.when(e % 10 == 7, F.lit("{not json")).otherwise(text).alias("value"), (e % 10 == 7).alias("broken"))
    lines, arrays = session.new_path(t.spark, "untidy-lines"), session.new_path(t.spark, "untidy-arrays")
    rows.select("value").write.text(lines)
    whole = rows.filter(~F.col("broken")).groupBy(F.pmod(F.xxhash64("value"), F.lit(50)).alias("file"))
    whole.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(arrays)  # an array is a file

    def counts(kind: str, path: str, outer_array: bool) -> DataFrame:
        target = session.new_path(t.spark, "untidy-loaded")
        files.load_new_files(t.spark, path, target, session.new_path(t.spark, "checkpoint"), "*.txt", outer_array)
        loaded = files.loaded_rows(t.spark, target).agg(F.count("altitude").alias("with_altitude"), F.sum("altitude").alias("altitude_sum"))
        return files.load_counts(t.spark, target).crossJoin(loaded).select(F.lit(kind).alias("kind"), "*")  # one row each

    return counts("lines", lines, False).unionByName(counts("arrays", arrays, True))


@query
def written_results(t: Layers) -> DataFrame:
    """A report written as JSON lines and as CSV, read back."""
    def back(fmt: str) -> DataFrame:
        path = session.new_path(t.spark, f"result-{fmt}")
        files.write_result(kpis.airline_fleet_summary(t.fact), path, fmt)
        reader = t.spark.read.schema("airline_iata string, aircraft_types long, events long, types string").option("header", True)
        return reader.format(fmt).load(path).select(F.lit(fmt).alias("format"), "airline_iata", "aircraft_types", "events", "types")

    return back("json").unionByName(back("csv"))


def _day_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("event_date", F.to_date("event_timestamp"))


EARLY, LATE = datetime(2024, 1, 20), datetime(2024, 1, 15)  # first load ends, second load begins


@query
def raw_merge_batch(t: Layers) -> DataFrame:
    """Two overlapping batches merged into RAW: known events only take the new batch id."""
    path = session.new_path(t.spark, "raw-merged")
    rows = _day_rows(dedup.exact_dedup(t.raw)).withColumn("is_transformed", F.lit(False))
    first = rows.filter(F.col("event_timestamp") < F.lit(EARLY)).withColumn("ingestion_batch_id", F.lit("batch-1"))
    second = rows.filter(F.col("event_timestamp") >= F.lit(LATE)).withColumn("ingestion_batch_id", F.lit("batch-2"))
    ingest.merge_batch_into_raw(t.spark, path, first)
    ingest.merge_batch_into_raw(t.spark, path, second)
    return tables.read(t.spark, path, first.schema)


@query
def raw_insert_from_payload(t: Layers) -> DataFrame:
    """RAW filled from payloads, twice: the second run inserts nothing."""
    path = session.new_path(t.spark, "raw-from-payload")
    messages = payload.to_payload(dedup.exact_dedup(t.raw)).withColumnRenamed("value", "raw_payload")
    rows = ingest.raw_rows_from_payload(messages, t.as_of)
    for _ in range(2):
        merge.insert_only(t.spark, path, rows)
    return tables.read(t.spark, path, rows.schema).drop("raw_json")


@query
def quick_load_raw(t: Layers) -> DataFrame:
    messages = payload.to_payload(dedup.exact_dedup(t.raw)).withColumnRenamed("value", "raw_payload")
    numbered = messages.withColumn("id", F.unix_micros("loaded_at"))
    return ingest.quick_raw_rows(numbered, t.as_of)


@query
def clean_insert(t: Layers) -> DataFrame:
    """CLEAN filled in two overlapping inserts."""
    path = session.new_path(t.spark, "clean-insert")
    ingest.write_clean(t.spark, path, t.clean.filter(F.col("event_date") < F.lit(EARLY.date())))
    ingest.write_clean(t.spark, path, t.clean.filter(F.col("event_date") >= F.lit(LATE.date())))
    return tables.read(t.spark, path, t.clean.schema)


@query
def pending_raw(t: Layers) -> DataFrame:
    """RAW rows that CLEAN of the first days does not hold yet."""
    done = t.clean.filter(F.col("event_date") < F.lit(EARLY.date()))
    return ingest.pending(t.raw, done).select("event_id", "flight_id", "event_timestamp", "loaded_at")


@query
def raw_transformed_flag(t: Layers) -> DataFrame:
    return ingest.with_transformed_flag(t.raw.select("event_id", "loaded_at"), t.clean)


# --- Merges of the aggregate tables ----------------------------------------------------------

@query
def hourly_merge(t: Layers) -> DataFrame:
    """The summary as of five days earlier, then merged with today's."""
    path = session.new_path(t.spark, "hourly-merge")
    earlier = star.hourly_summary(t.fact.filter(F.col("event_timestamp") < F.lit(datetime(2024, 1, 25, 12))),
                                  datetime(2024, 1, 25, 12))
    merge.upsert_days(t.spark, path, earlier, star.HOURLY_KEYS)
    merge.upsert_days(t.spark, path, star.hourly_summary(t.fact, t.as_of), star.HOURLY_KEYS)
    return tables.read(t.spark, path, earlier.schema)


@query
def hourly_replace_day(t: Layers) -> DataFrame:
    """Every day of the rolling summary, today's replaced by the rounded refresh; the day before
    is replaced, too, by the rows of an airline that does not fly, and is empty afterwards."""
    base = star.hourly_summary(t.fact, t.as_of).withColumn("domestic_flights", F.lit(None).cast("bigint"))
    table = tables.DayTable(t.spark, session.new_path(t.spark, "hourly-replace"), base.schema)
    table.append(base)
    today = t.as_of.date()
    table.replace(star.hourly_refresh(t.fact, times.day_of(t.as_of), t.as_of).select(*base.columns), [today])
    yesterday = today - timedelta(days=1)
    none = star.hourly_refresh(t.fact.filter(F.col("airline_iata") == "--"), F.lit(yesterday), t.as_of)
    table.replace(none.select(*base.columns), [yesterday])
    return table.rows()


@query
def route_merge(t: Layers) -> DataFrame:
    """Route performance from CLEAN, then today's from FACT merged on top."""
    path = session.new_path(t.spark, "route-merge")
    first = star.routes_from_clean(t.clean, t.as_of)
    merge.upsert_days(t.spark, path, first, star.ROUTE_KEYS, star.ROUTE_UPDATES)
    second = star.routes_from_fact(t.fact, t.as_of).select(*first.columns)
    merge.upsert_days(t.spark, path, second, star.ROUTE_KEYS, star.ROUTE_UPDATES)
    return tables.read(t.spark, path, first.schema)


@query
def airline_dim_merge(t: Layers) -> DataFrame:
    """Dimension of the first days upserted with the whole table's."""
    before = star.dim_airlines(t.clean.filter(F.col("event_date") < F.lit(LATE.date())))
    table = tables.VersionedTable(t.spark, session.new_path(t.spark, "airlines"), before.schema)
    table.write(merge.upsert_rows(table.read(), before, ["airline_code"]))
    table.write(merge.upsert_rows(table.read(), star.dim_airlines(t.clean), ["airline_code"]))
    return table.read()


@query
def airport_dim_merge(t: Layers) -> DataFrame:
    """Dimension of the late days upserted with the early days': early figures win, new codes are added."""
    late = star.dim_airports(t.clean.filter(F.col("event_date") >= F.lit(LATE.date())))
    early = star.dim_airports(t.clean.filter(F.col("event_date") < F.lit(LATE.date())))
    return merge.upsert_rows(late, early, ["airport_code"])


# --- Incremental load and run metrics -----------------------------------------------------------

WINDOW_START = datetime(2024, 1, 10)


@query
def incremental_window(t: Layers) -> DataFrame:
    return incremental.incremental_window(t.raw_table, WINDOW_START, t.as_of, day=tables.LOAD_DAY)


@query
def incremental_window_batch(t: Layers) -> DataFrame:
    """The oldest 500 rows of the window, and all that share the last one's load time."""
    return incremental.incremental_window(t.raw_table, WINDOW_START, t.as_of, limit=500, day=tables.LOAD_DAY)


@query
def watermarks_after_run(t: Layers) -> DataFrame:
    control = incremental.initial_watermarks(t.spark)
    start = incremental.get_watermark(control, "raw_to_clean")
    batch = incremental.incremental_window(t.raw_table, start, t.as_of, day=tables.LOAD_DAY)
    return incremental.updated_watermark(control, "raw_to_clean", batch, None, "run-1", t.as_of).drop("comment_text")


def _two_runs(t: Layers) -> tuple[str, str]:
    """Paths of CLEAN and of the run metrics after two consecutive incremental runs."""
    path, runs = session.new_path(t.spark, "clean-incremental"), session.new_path(t.spark, "runs")
    control = tables.VersionedTable(t.spark, session.new_path(t.spark, "watermarks"), incremental.WATERMARKS)
    control.write(incremental.initial_watermarks(t.spark))
    for run_id, upper in (("run-1", EARLY), ("run-2", t.as_of)):
        incremental.run_raw_to_clean(t.spark, t.raw_table, path, control, upper, run_id, day=tables.LOAD_DAY, runs_path=runs)
    return path, runs


@query
def incremental_runs(t: Layers) -> DataFrame:
    """CLEAN after two consecutive incremental runs."""
    return tables.read(t.spark, _two_runs(t)[0], t.clean.schema)


@query
def incremental_run_rows(t: Layers) -> DataFrame:
    """What the two runs wrote of themselves; their times are those of the clock."""
    rows = t.spark.read.parquet(_two_runs(t)[1])
    return rows.select("run_id", "dag_id", "records_read", "records_written", "records_failed", "error_rate_pct", "status",
                       (F.col("finished_at") >= F.col("started_at")).alias("in_order"))


@cache
def _jobs(t: Layers) -> tuple[str, str]:
    """Folders of the run rows and of the messages, after the ingest stream has read four of six files and two
    incremental runs have followed."""
    fresh = lambda label: session.new_path(t.spark, label)
    runs, (path, files_each) = fresh("job-runs"), _message_files(t, _dealt(t).filter(F.col("arrival") < READ_FILES))
    sink = stream_ingest.IngestSink(t.spark, fresh("stream-raw"), fresh("stream-letters"), fresh("stream-verdicts"), t.as_of, 1.0, f"{runs}/ingestion")
    stream_ingest.start_ingest(_messages(t, path, files_each), sink, fresh("checkpoint"), available_now=True).awaitTermination()
    payload.to_payload(_dealt(t).filter(F.col("arrival") >= READ_FILES)).select("value", "arrival").write.mode("append").partitionBy("arrival").option("compression", "gzip").text(path)
    cleaned = t.spark.read.parquet(_two_runs(t)[1])
    incremental.append_runs(f"{runs}/raw_to_clean", cleaned)
    return runs, path


def _runs(t: Layers) -> DataFrame:
    """Run rows as the jobs wrote them; their times are those of the clock."""
    schema = incremental.finalise_runs(t.spark.createDataFrame([], incremental.RUN_COLUMNS)).schema
    return t.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(_jobs(t)[0])


_RUN = ["run_id", "dag_id", "records_read", "records_written", "records_failed", "error_rate_pct", "status"]


@query
def run_metrics(t: Layers) -> DataFrame:
    return _runs(t).select(*_RUN, (F.col("finished_at") >= F.col("started_at")).alias("in_order"), (F.col("throughput_rps") > 0).alias("wrote"))


@query
def recent_runs(t: Layers) -> DataFrame:
    """The last runs, the newest first."""
    rows = incremental.recent_runs(_runs(t), 50)
    newest = W.orderBy(F.desc("started_at"), "run_id")  # 50 rows
    return rows.select(F.row_number().over(newest).cast("bigint").alias("nth"), *_RUN)


@query
def throughput_trend(t: Layers) -> DataFrame:
    """The trend of the hourly loads of RAW, and beside it that of the ingest stream: the latter depends on the clock, so what does not is returned."""
    loads = incremental.throughput_trend(incremental.hourly_load_runs(t.raw, validate.row_errors(t.raw)), "ingestion").withColumnRenamed("runs", "loads")
    trend = incremental.throughput_trend(_runs(t), "ingestion")
    checks = trend.select("runs", F.col("trend").isin("improving", "degrading", "stable").alias("judged"), (F.col("avg_rps") > 0).alias("moving"),
                          (F.col("recent_avg") > 0).alias("recently"), (F.col("older_avg") > 0).alias("before"))
    return loads.crossJoin(checks)  # one row each


@query
def run_audit(t: Layers) -> DataFrame:
    """The audit history after the rows of both jobs were appended."""
    path, runs = session.new_path(t.spark, "run-audit"), _runs(t)
    incremental.append_runs(path, runs.filter("dag_id = 'ingestion'"))
    incremental.append_runs(path, runs.filter("dag_id <> 'ingestion'"))
    return tables.read(t.spark, path, runs.schema).groupBy("dag_id", "status").agg(
        F.count("*").alias("runs"), F.sum("records_read").alias("records_read"))


# --- Dead letters ------------------------------------------------------------------------------

@query
def dead_letter_rows(t: Layers) -> DataFrame:
    return t.letters.drop("id", "raw_payload")


@query
def dead_letters_pending(t: Layers) -> DataFrame:
    letters = t.letters.drop("raw_payload")
    by_time = letters.withColumn("id", F.concat_ws("|", "event_id", F.unix_micros("created_at").cast("string")))
    return dead_letters.pending_letters(by_time, 100).drop("id")


def _replayed(t: Layers) -> tuple[dead_letters.Letters, str]:
    """A table of the letters after replaying those of one kind of error, and where the messages went."""
    table, sent = dead_letters.Letters(t.spark, session.new_path(t.spark, "letters")), session.new_path(t.spark, "sent-again")
    table.publish(t.letters)
    chosen = table.current().filter("error_message = 'invalid_status'").select("id")
    for _ in range(2):  # an attempt that is repeated sends nothing twice
        table.replay(chosen, lambda messages, attempt: files.write_messages(messages, sent, attempt), 1)
    return table, sent


@query
def dead_letter_stats(t: Layers) -> DataFrame:
    """Statistics after replaying every letter of one kind of error."""
    return dead_letters.letter_stats(_replayed(t)[0].current())


@query
def dead_letter_replay(t: Layers) -> DataFrame:
    """Messages sent again, per key."""
    return files.read_messages(t.spark, _replayed(t)[1]).groupBy("key").agg(F.count("*").alias("messages"))


@query
def dead_letter_alert(t: Layers) -> DataFrame:
    return dead_letters.volume_alert(t.letters)


# --- Health --------------------------------------------------------------------------------------

def _layer_checks(t: Layers) -> DataFrame:
    since = times.day_of(times.ago(t.as_of, hours=2))
    return health.layer_checks(t.newest_raw(since), t.newest_clean(since), t.fact, t.as_of)


def _layer_freshness(t: Layers) -> DataFrame:
    return health.freshness_of(t.statistics.volumes(), t.as_of)


def _quality_rate(t: Layers) -> DataFrame:
    today = times.day_of(t.as_of)
    return health.quality_rate(t.clean_made(today, today), t.as_of)


@query
def layer_checks(t: Layers) -> DataFrame:
    return _layer_checks(t)


@query
def quality_log(t: Layers) -> DataFrame:
    """The log after the entry of one check was appended."""
    path = session.new_path(t.spark, "quality-log")
    entry = health.quality_log_entry(_layer_checks(t), t.as_of)
    entry.write.mode("append").parquet(path)
    return tables.read(t.spark, path, entry.schema)


def _offsets(t: Layers) -> DataFrame:
    """What there is to read, and what the ingest stream has read."""
    return progress.folder_offsets(t.spark.read.text(_jobs(t)[1]), _runs(t), "flights_raw")


def _components(t: Layers) -> DataFrame:
    return (_layer_freshness(t).unionByName(_quality_rate(t))
            .unionByName(health.consumer_lag(_offsets(t))).unionByName(health.dead_letter_health(t.letters)))


@query
def layer_freshness(t: Layers) -> DataFrame:
    return _layer_freshness(t)


@query
def quality_rate(t: Layers) -> DataFrame:
    return _quality_rate(t)


@query
def consumer_lag(t: Layers) -> DataFrame:
    return health.consumer_lag(_offsets(t))


@query
def dead_letter_health(t: Layers) -> DataFrame:
    return health.dead_letter_health(t.letters)


@query
def overall_health(t: Layers) -> DataFrame:
    return health.overall_health(_components(t))


@query
def health_alerts(t: Layers) -> DataFrame:
    return health.alerts(_components(t))


# --- Headline figures and verification -----------------------------------------------------------

@query
def kpi_summary(t: Layers) -> DataFrame:
    return kpis.kpi_summary(active_airlines_now(t), airline_league(t), airport_congestion(t), health_scorecard(t), t.as_of)


@query
def layer_volume(t: Layers) -> DataFrame:
    return kpis.layer_volume(t.statistics.volumes(), t.as_of)


@query
def layer_funnel(t: Layers) -> DataFrame:
    return kpis.layer_funnel(t.statistics.volumes())


@query
def airline_summary(t: Layers) -> DataFrame:
    return kpis.airline_summary(t.airlines)


@query
def delay_distribution(t: Layers) -> DataFrame:
    return kpis.delay_distribution(t.clean)


@query
def busiest_routes(t: Layers) -> DataFrame:
    return kpis.busiest_routes(t.routes, t.as_of)


@query
def hourly_traffic(t: Layers) -> DataFrame:
    return kpis.hourly_traffic(t.hourly, t.as_of)


@query
def daily_error_rate(t: Layers) -> DataFrame:
    return kpis.daily_error_rate(t.clean_of_newest_days(SHOWN_DAYS), SHOWN_DAYS)


@query
def raw_load_stats(t: Layers) -> DataFrame:
    """CLEAN of the first days counts as done."""
    return kpis.raw_load_stats(t.statistics.volumes(), t.statistics.done_before(F.lit(EARLY.date())), t.as_of)


@query
def speed_and_delay_all(t: Layers) -> DataFrame:
    return kpis.speed_and_delay(t.fact)


@query
def speed_and_delay_pruned(t: Layers) -> DataFrame:
    return kpis.speed_and_delay(t.fact_where(event_date=t.as_of.date(), airline_iata="AI"))


@query
def speed_and_delay_of_airline(t: Layers) -> DataFrame:
    """All days of one airline: the files of a day that do not hold it stay closed."""
    return kpis.speed_and_delay(t.fact_where(airline_iata="AI"))


@query
def speed_and_delay_of_route(t: Layers) -> DataFrame:
    return kpis.speed_and_delay(t.fact_where(route_key="DXB→BLR"))


@query
def speed_and_delay_of_hours(t: Layers) -> DataFrame:
    """The morning hours of all days."""
    return kpis.speed_and_delay(t.fact_where(event_hour=(6, 9)))


@query
def daily_summary(t: Layers) -> DataFrame:
    return kpis.daily_summary(t.fact, t.as_of)


@query
def airline_fleet_summary(t: Layers) -> DataFrame:
    return kpis.airline_fleet_summary(t.fact)


@query
def arrival_performance(t: Layers) -> DataFrame:
    return kpis.arrival_performance(t.fact)


@query
def weekly_patterns(t: Layers) -> DataFrame:
    return kpis.weekly_patterns(t.fact)


@query
def real_time_status(t: Layers) -> DataFrame:
    return kpis.real_time_status(t.fact)


@query
def report_run_summary(t: Layers) -> DataFrame:
    return reports.run_summary(t)


@query
def fact_rolling_views(t: Layers) -> DataFrame:
    reports.register_views(t)
    return t.spark.sql("""
        SELECT 'all' AS view_name, count(*) AS row_count FROM fact_flights
        UNION ALL SELECT 'recent', count(*) FROM fact_flights_recent
        UNION ALL SELECT 'today', count(*) FROM fact_flights_today
        UNION ALL SELECT 'clean', count(*) FROM fact_flights_clean""")


# --- Dashboard slices ---------------------------------------------------------------------------

def _once(t: Layers, rows: DataFrame, label: str) -> DataFrame:
    """A report that is used more than once, evaluated and written once."""
    path = session.new_path(t.spark, label)
    rows.write.parquet(path)
    return tables.read(t.spark, path, rows.schema)


@query
def worst_delay_hours(t: Layers) -> DataFrame:
    return slices.worst_hours(delay_patterns(t), t.as_of)


@query
def league_extremes(t: Layers) -> DataFrame:
    return slices.league_extremes(_once(t, airline_league(t), "league"))


@query
def peak_hours_ranked(t: Layers) -> DataFrame:
    return slices.peak_hours_ranked(peak_hours(t))


@query
def route_extremes(t: Layers) -> DataFrame:
    return slices.route_extremes(_once(t, route_efficiency(t), "routes"))


@query
def recent_trend(t: Layers) -> DataFrame:
    return slices.recent_trend(weekly_trends(t), t.as_of)


@query
def league_slice(t: Layers) -> DataFrame:
    return slices.league_slice(airline_league(t))


@query
def delay_slice(t: Layers) -> DataFrame:
    return slices.delay_slice(delay_patterns(t), t.as_of)


@query
def peak_slice(t: Layers) -> DataFrame:
    return slices.peak_slice(peak_hours(t))


@query
def route_slice(t: Layers) -> DataFrame:
    return slices.route_slice(route_efficiency(t))


@query
def trend_slice(t: Layers) -> DataFrame:
    return slices.trend_slice(weekly_trends(t), t.as_of)


@query
def airport_slice(t: Layers) -> DataFrame:
    return slices.airport_slice(airport_congestion(t))


@query
def segment_slice(t: Layers) -> DataFrame:
    return slices.segment_slice(intl_vs_domestic(t))


@query
def active_today(t: Layers) -> DataFrame:
    return slices.active_today(t.fact, t.airlines, t.as_of)


@query
def live_positions(t: Layers) -> DataFrame:
    return slices.live_positions(t.fact, t.as_of)


@query
def flights_today(t: Layers) -> DataFrame:
    return slices.flights_today(t.fact, t.as_of)


@query
def map_kpis(t: Layers) -> DataFrame:
    return slices.map_kpis(slices.live_positions(t.fact, t.as_of, None))


@query
def map_filtered(t: Layers) -> DataFrame:
    positions = slices.live_positions(t.fact, t.as_of, None)
    return slices.map_filter(positions, ["active", "landed"], ["cruise", "mid_altitude"], True)


@query
def map_marks(t: Layers) -> DataFrame:
    return slices.map_marks(slices.live_positions(t.fact, t.as_of, None))


@query
def delay_heatmap(t: Layers) -> DataFrame:
    return slices.delay_heatmap(slices.delay_slice(delay_patterns(t), t.as_of))


@query
def top_by_otp(t: Layers) -> DataFrame:
    return slices.top_by_otp(airline_league(t))


@query
def fleet_means(t: Layers) -> DataFrame:
    return slices.fleet_means(airline_league(t))


@query
def route_bubbles(t: Layers) -> DataFrame:
    return slices.route_bubbles(_once(t, route_efficiency(t), "routes"))


@query
def run_bubbles(t: Layers) -> DataFrame:
    bubbles = slices.run_bubbles(_once(t, incremental.recent_runs(_runs(t), 50), "runs"))
    return bubbles.select("run_id", "status", "size", (F.col("elapsed_seconds") >= 0).alias("timed"))


@query
def home_kpis(t: Layers) -> DataFrame:
    return slices.home_kpis(slices.active_today(t.fact, t.airlines, t.as_of, None), health_scorecard(t))


@query
def health_page(t: Layers) -> DataFrame:
    return slices.health_page(health_scorecard(t))


@query
def display_text(t: Layers) -> DataFrame:
    """Every CLEAN row as display text."""
    return t.clean.select(
        "event_id", display.number_text(F.col("altitude")).alias("altitude_number"),
        display.altitude_text(F.col("altitude")).alias("altitude"), display.speed_text(F.col("speed")).alias("speed"),
        display.minutes_text(F.col("delay_minutes")).alias("delay"),
        display.percent_text(F.col("heading")).alias("heading_pct"),
        display.age_text(F.col("event_timestamp"), t.as_of).alias("age"),
        display.delay_colour(F.col("delay_bucket")).alias("delay_colour"))


@query
def report_colours(t: Layers) -> DataFrame:
    routes = route_efficiency(t)
    return routes.select("route_key", display.route_mark(F.col("route_health")).alias("mark"),
                         display.health_colour(F.col("route_health")).alias("colour"))


# --- Streams ---------------------------------------------------------------------------------------

MESSAGE_FILES = 6  # batches of a stream
MESSAGE_ROWS = 100_000  # about so many messages are a file; a batch has as many files as its messages ask for
READ_FILES = 4  # batches that the ingest stream behind the run metrics has read


def _message_files(t: Layers, rows: DataFrame) -> tuple[str, int]:
    """Messages of ``rows`` in files, and how many files a batch has: as many for each, in the order of the column ``arrival``.

    A task writes a share of a batch; where shares have met in one task, empty files make up the number.
    """
    path = session.new_path(t.spark, "messages")
    counts = rows.groupBy("arrival").agg(F.count("*").alias("n")).collect()  # a row per batch
    each = max([-(-r.n // MESSAGE_ROWS) for r in counts], default=1)
    messages = payload.to_payload(rows).select("value", "arrival")
    share = F.pmod(F.xxhash64("value"), F.lit(each))
    messages.repartition(MESSAGE_FILES * each, "arrival", share).write.partitionBy("arrival").option("compression", "gzip").text(path)
    batches: dict[int, list[str]] = {int(r.arrival): [] for r in counts}
    for name in t.spark.read.text(path).inputFiles():
        batches[int(name.rpartition("arrival=")[2].partition("/")[0])].append(name)
    for arrival, names in batches.items():
        names += [files.empty_file(t.spark, f"{path}/arrival={arrival}/empty-{i:05d}.txt") for i in range(len(names), each)]
    files.arrange(t.spark, [name for arrival in sorted(batches) for name in sorted(batches[arrival])], datetime(2024, 2, 1))
    return path, each


def _messages(t: Layers, path: str, files_each: int) -> DataFrame:
    return stream_ingest.read_message_files(t.spark, path, max_files=files_each).select("value")


def _arrivals(t: Layers, rows: DataFrame) -> DataFrame:
    return _messages(t, *_message_files(t, rows))


def _dealt(t: Layers) -> DataFrame:
    """RAW with the batch a row arrives in: by the second of its event, so that deliveries of one id and
    neighbours in time fall into different batches, in no order of time."""
    return t.raw.withColumn("arrival", F.unix_seconds("event_timestamp") % MESSAGE_FILES)


def _ingested(t: Layers, max_fail_rate: float = 1.0) -> stream_ingest.IngestSink:
    """Every message run through the ingest stream."""
    fresh = lambda label: session.new_path(t.spark, label)
    sink = stream_ingest.IngestSink(t.spark, fresh("stream-raw"), fresh("stream-letters"), fresh("stream-verdicts"),
                                    t.as_of, max_fail_rate=max_fail_rate)
    stream_ingest.start_ingest(_arrivals(t, _dealt(t)), sink, fresh("checkpoint"), available_now=True).awaitTermination()
    return sink


@query
def stream_ingest_raw(t: Layers) -> DataFrame:
    """RAW after the stream: the first valid delivery of every event, many of which come in two batches."""
    events = payload.parse_events(t.spark.createDataFrame([], "value string")).drop("value")
    schema = events.withColumns({"loaded_at": times.as_timestamp(t.as_of), "event_date": F.to_date("event_timestamp")}).schema
    return tables.read(t.spark, _ingested(t).raw_path, schema)


def _letters_per_error(sink: stream_ingest.IngestSink) -> DataFrame:
    return sink.letters.current().groupBy("error_message").agg(F.count("*").alias("letters"))


@query
def stream_dead_letters(t: Layers) -> DataFrame:
    """Dead letters of the stream per error."""
    return _letters_per_error(_ingested(t))


@query
def stream_gate_closed(t: Layers) -> DataFrame:
    """Dead letters per error with the usual gate: a batch with too many invalid rows is rejected whole."""
    return _letters_per_error(_ingested(t, QUALITY_GATE_MAX_FAIL_RATE))


@query
def stream_quality_gate(t: Layers) -> DataFrame:
    """Rows judged over all batches of the stream."""
    verdicts = t.spark.read.parquet(_ingested(t).verdicts_path)
    return verdicts.agg(F.sum("total_records").alias("total_records"), F.sum("invalid_count").alias("invalid_count"))


def _event_stream(t: Layers, rows: DataFrame | None = None) -> DataFrame:
    return payload.parse_events(_arrivals(t, _dealt(t) if rows is None else rows)).drop("value")


@query
def stream_dedup_ids(t: Layers) -> DataFrame:
    """The first delivery of every event id."""
    events = _event_stream(t)
    sink = stream_dedup.FirstArrivals(t.spark, session.new_path(t.spark, "stream-ids"), buckets=16)
    stream_dedup.start(events, sink, session.new_path(t.spark, "checkpoint"), available_now=True).awaitTermination()
    return sink.read(events.schema)


def _around_midnight(t: Layers) -> DataFrame:
    """Pairs of positions three seconds apart, on both sides of a midnight long ago; the later one arrives first.

    When the earlier one comes, the day after it loses its only rows.
    """
    number = F.substring("event_id", 2, 9).cast("int")
    chosen = t.raw.filter(F.col("event_id").startswith("E") & (number % 500 == 0) & F.col("flight_id").isNotNull())
    midnight = F.timestamp_seconds(F.lit(1577836800) + 3 * 86400 * ((number / 500).cast("int") % 100 + 1))
    sides = F.explode(F.array(F.struct(F.lit("V").alias("side"), F.lit(2).alias("second"), F.lit(0).alias("arrival")),
                              F.struct(F.lit("U").alias("side"), F.lit(-1).alias("second"), F.lit(MESSAGE_FILES - 1).alias("arrival"))))
    pairs = chosen.withColumn("s", sides).withColumns({
        "event_timestamp": midnight + F.make_dt_interval(secs=F.col("s.second")), "arrival": F.col("s.arrival").cast("long")})
    return pairs.withColumn("event_id", F.concat("s.side", "event_id")).drop("s")


@query
def stream_fuzzy_dedup(t: Layers) -> DataFrame:
    """The batch operator's rows, from a stream in several unordered batches."""
    events = _event_stream(t, _dealt(t).unionByName(_around_midnight(t)))
    sink = stream_dedup.NearDuplicates(t.spark, session.new_path(t.spark, "stream-arrivals"), session.new_path(t.spark, "stream-fuzzy"))
    stream_dedup.start(events, sink, session.new_path(t.spark, "checkpoint"), available_now=True).awaitTermination()
    return sink.read(events.schema).select("event_id", "flight_id", "event_timestamp")


@query
def stream_latest_positions(t: Layers) -> DataFrame:
    events = _event_stream(t)
    schema = live.newest_positions(events).schema
    table = live.positions_table(t.spark, session.new_path(t.spark, "stream-latest"), schema)
    live.keep_latest(events, table, session.new_path(t.spark, "checkpoint"), available_now=True).awaitTermination()
    return table.current()


@query
def stream_hourly_summary(t: Layers) -> DataFrame:
    """FACT arriving in several batches; days may be split between them."""
    source = session.new_path(t.spark, "fact-arrivals")
    t.fact.repartition(6, "event_id").write.parquet(source)
    rows = t.spark.readStream.schema(t.fact.schema).option("maxFilesPerTrigger", 3).parquet(source)
    fact, summary = session.new_path(t.spark, "stream-fact"), session.new_path(t.spark, "stream-hourly")
    live.keep_hourly(t.spark, rows, fact, summary, session.new_path(t.spark, "checkpoint"), t.as_of,
                     available_now=True).awaitTermination()
    return tables.read(t.spark, summary, star.hourly_of_days(t.fact, t.as_of).schema)
