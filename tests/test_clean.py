from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skyledger.functions import text
from skyledger.operators import clean

AS_OF = datetime(2024, 6, 15, 12)


def rows(df):
    return {(r.event_id, r.flight_number): r for r in df.collect()}


@pytest.fixture(scope="module")
def tidy(tidy_flights):
    return rows(clean.clean_flights(tidy_flights, AS_OF))


@pytest.fixture(scope="module")
def messy(messy_flights):
    return rows(clean.clean_flights(messy_flights, AS_OF))


def test_valid_rows_keep_count_and_values(tidy):
    assert len(tidy) == 3
    assert all(r.transformation_log == "" and not r.data_quality_flag for r in tidy.values())


def test_airline_is_named_by_code(messy):
    assert messy["E001", "101"].airline == "Air India"
    assert messy["E005", "606"].airline == "Qatar Airways"


def test_airport_codes_are_upper_case(messy):
    assert messy["E005", "606"].source_airport == "DEL"


def test_placeholder_airport_becomes_null(messy):
    row = messy["E002", "303"]
    assert row.source_airport is None and row.route_key == "???→HYD" and row.is_international


def test_numbers_stay_in_range(messy):
    assert all(r.altitude >= 0 and r.speed >= 0 and r.delay_minutes >= 0 for r in messy.values())
    assert max(r.latitude for r in messy.values() if r.latitude is not None) == 90.0


def test_missing_delay_is_zero_and_missing_position_stays_missing(messy):
    row = messy["E002", "303"]
    assert row.delay_minutes == 0 and row.latitude is None and row.heading is None


def test_statuses_are_mapped(messy):
    assert messy["E002", "202"].status == "active"
    assert messy["E002", "303"].status == "unknown"


def test_log_lists_rules_in_order(messy):
    assert messy["E002", "303"].transformation_log == (
        "imputed_delay_minutes,capped_altitude,normalised_status,flag:missing_coordinates")
    assert messy["E003", "404"].transformation_log == (
        "capped_speed,capped_latitude,capped_delay_minutes,flag:active_with_zero_speed")
    assert messy["E002", "202"].transformation_log == "normalised_status,flag:missing_flight_id"


def test_derived_columns(tidy):
    row = tidy["E001", "101"]
    assert (row.delay_bucket, row.flight_phase, row.region) == ("on_time", "cruise", "India")
    assert (str(row.event_date), row.event_hour, row.day_of_week) == ("2024-06-15", 10, 5)
    assert row.route_key == "DEL→BOM" and not row.is_international


def test_delay_buckets(tidy):
    found = {r.delay_minutes: r.delay_bucket for r in tidy.values()}
    assert found == {0: "on_time", 15: "minor_delay", 45: "moderate_delay"}


@pytest.mark.parametrize("minutes, bucket", [
    (0, "on_time"), (1, "minor_delay"), (15, "minor_delay"), (16, "moderate_delay"), (60, "moderate_delay"),
    (61, "major_delay"), (180, "major_delay"), (181, "severe_delay"), (None, "on_time"),
])
def test_delay_bucket_edges(spark, minutes, bucket):
    from skyledger.functions.flight import delay_bucket

    assert spark.range(1).select(delay_bucket(F.lit(minutes).cast("int"))).first()[0] == bucket


@pytest.mark.parametrize("feet, phase", [
    (0, "ground"), (999, "ground"), (1000, "climbing"), (14999, "climbing"), (15000, "mid_altitude"),
    (31999, "mid_altitude"), (32000, "cruise"),
])
def test_phase_edges(spark, feet, phase):
    from skyledger.functions.flight import flight_phase

    assert spark.range(1).select(flight_phase(F.lit(feet))).first()[0] == phase


@pytest.mark.parametrize("lat, lon, region", [
    (20.0, 80.0, "India"), (36.0, 80.0, "India"), (36.0, 10.0, "Europe_Asia"), (-1.0, 80.0, "Southern"),
    (0.0, 80.0, "Southern"), (25.0, 55.0, "Middle_East_SE_Asia"), (None, 80.0, "Middle_East_SE_Asia"),
])
def test_regions(spark, lat, lon, region):
    from skyledger.functions.flight import region as region_of

    value = region_of(F.lit(lat).cast("double"), F.lit(lon))
    assert spark.range(1).select(value).first()[0] == region


def test_report(tidy_flights):
    report = clean.transform_report(clean.clean_flights(tidy_flights, AS_OF)).first()
    assert (report.records_in, report.records_out, report.records_flagged, report.flag_rate_pct) == (3, 3, 0, 0.0)


def test_empty_input(tidy_flights):
    cleaned = clean.clean_flights(tidy_flights.limit(0), AS_OF)
    assert cleaned.count() == 0
    assert clean.transform_report(cleaned).first().records_in == 0


def test_cleaning_twice_changes_nothing_but_the_log(messy_flights):
    once = clean.clean_flights(messy_flights, AS_OF)
    twice = clean.clean_flights(once, AS_OF)
    same = [c for c in once.columns if c not in ("transformation_log", "data_quality_flag")]
    assert sorted(map(str, once.select(*same).collect())) == sorted(map(str, twice.select(*same).collect()))


def test_missing_columns_are_tolerated(spark):
    few = spark.createDataFrame([("E1", "AI1", "DEL")], "event_id string, flight_id string, source_airport string")
    row = clean.clean_flights(few, AS_OF).first()
    assert row.source_airport == "DEL" and not row.data_quality_flag and "delay_bucket" not in row.asDict()


def test_text_numbers_and_bad_text(spark):
    data = [("E1", "35000", "abc", "2024-06-15T10:00:00Z"), ("E2", "12.9", "7.5", "not a time")]
    df = spark.createDataFrame(data, "event_id string, altitude string, speed string, event_timestamp string")
    first, second = clean.cast_types(df).orderBy("event_id").collect()
    assert (first.altitude, first.speed, first.event_timestamp) == (35000, None, datetime(2024, 6, 15, 10))
    assert (second.altitude, second.speed, second.event_timestamp) == (12, 7.5, None)


@pytest.mark.parametrize("raw", ["air-india", "AIR INDIA", "o'hare air", "a1b2 c", "  x", "élan vital", "", "3m co."])
def test_title_case_equals_python(spark, raw):
    assert spark.createDataFrame([(raw,)], "s string").select(text.title_case(F.col("s"))).first()[0] == raw.title()


def test_warehouse_initcap(spark):
    df = spark.createDataFrame([("zed air-line o'neil [x]",)], "s string")
    assert df.select(text.warehouse_initcap(F.col("s"))).first()[0] == "Zed Air-Line O'neil [X]"


def test_profiles_disagree_where_expected(spark, messy_flights):
    typed = clean.cast_types(messy_flights).withColumns({
        "source_city": F.lit("x"), "dest_city": F.lit("y"), "aircraft_type": F.lit("A320")})
    warehouse = rows(clean.clean_warehouse_profile(typed, AS_OF))
    assert ("E002", "202") not in warehouse  # no flight id
    assert warehouse["E002", "303"].latitude == 0.0 and warehouse["E002", "303"].data_quality_flag
    assert warehouse["E003", "404"].status == "active" and warehouse["E003", "404"].delay_bucket == "minor_delay"
    scheduled = rows(clean.clean_scheduled_profile(typed, AS_OF))
    assert scheduled["E002", "202"].status == "in_air" and scheduled["E002", "303"].source_airport == "???"
    quick = rows(clean.clean_quick_load_profile(typed, AS_OF))
    assert not any(r.data_quality_flag for r in quick.values())
    assert {r.event_timestamp for r in quick.values()} == {AS_OF}
