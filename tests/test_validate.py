from datetime import datetime, timedelta

import pytest

from skyledger.operators import clean, expectations, validate

NOW = datetime(2024, 6, 15, 12)
EIGHT = ("event_id string, flight_id string, source_airport string, dest_airport string, latitude double, "
         "longitude double, event_timestamp timestamp, status string")


def flights(spark, n=20, **changes):
    base = {"event_id": None, "flight_id": "AI101", "source_airport": "DEL", "dest_airport": "BOM", "latitude": 22.0,
            "longitude": 77.0, "event_timestamp": NOW - timedelta(hours=1), "status": "active"}
    data = [tuple({**base, "event_id": f"E{i}", **changes}[k] for k in base) for i in range(n)]
    return spark.createDataFrame(data, EIGHT)


def results(df):
    return {r.rule_name: r for r in validate.validate(df, NOW).collect()}


def test_valid_rows_pass_everything(spark, tidy_flights):
    found = results(clean.cast_types(tidy_flights))
    assert len(found) == 10 and all(r.passed for r in found.values())
    summary = validate.validation_summary(validate.validate(clean.cast_types(tidy_flights), NOW)).first()
    assert summary.is_healthy and summary.pass_rate_pct == 100.0 and summary.total_records == 3


@pytest.mark.parametrize("rule, changes, affected", [
    ("required_fields_present", {"flight_id": None}, 20),
    ("coordinate_bounds_valid", {"latitude": 999.0}, 20),
    ("no_duplicate_event_ids", {"event_id": "SAME"}, 20),
    ("status_is_valid_enum", {"status": "ghost_flight"}, 20),
    ("no_route_self_loop", {"dest_airport": "DEL"}, 20),
    ("timestamp_is_fresh", {"event_timestamp": NOW - timedelta(hours=25)}, 20),
    ("airport_code_format_valid", {"source_airport": "del"}, 20),
])
def test_defect_is_caught(spark, rule, changes, affected):
    found = results(flights(spark, **changes))
    assert not found[rule].passed and found[rule].affected_count == affected
    assert [name for name, r in found.items() if not r.passed] == [rule]


def test_few_failures_stay_below_the_threshold(spark):
    mixed = flights(spark, 95).unionByName(flights(spark, 5, flight_id=None, event_id="X").dropDuplicates())
    assert results(mixed)["required_fields_present"].passed


def test_absent_columns_pass(spark):
    found = results(flights(spark).drop("latitude", "status"))
    assert found["coordinate_bounds_valid"].passed and found["status_is_valid_enum"].passed
    assert found["altitude_in_valid_range"].affected_count == 0


def test_empty_input_has_no_results(spark):
    assert validate.validate(flights(spark, 0), NOW).count() == 0


def test_warnings_do_not_make_unhealthy(spark):
    summary = validate.validation_summary(validate.validate(flights(spark, dest_airport="DEL"), NOW)).first()
    assert summary.is_healthy and summary.checks_warned == 1 and summary.checks_failed == 0


def test_samples_are_few_and_ordered(spark):
    found = validate.failure_samples(flights(spark, dest_airport="DEL", status="ghost"), NOW).collect()
    loops = [r for r in found if r.rule_name == "no_route_self_loop"]
    assert [r.sample_rank for r in loops] == [1, 2, 3, 4, 5]
    assert [r.value for r in found if r.rule_name == "status_is_valid_enum"] == ["ghost"]


ROW = ("flight_id string, source_airport string, dest_airport string, latitude double, longitude double, "
       "altitude int, speed double, status string")


def test_row_errors(spark):
    data = [("A", "DEL", "BOM", 1.0, 2.0, 100, 100.0, "active"), (None, "", "BOM", None, 200.0, -1, 1300.0, None)]
    good, bad = validate.with_row_errors(spark.createDataFrame(data, ROW)).collect()
    assert good.errors == []
    assert bad.errors == ["missing_flight_id", "missing_source_airport", "missing_latitude", "missing_status",
                          "altitude_out_of_range", "speed_out_of_range", "longitude_out_of_range", "invalid_status"]


@pytest.mark.parametrize("bad_rows, allowed", [(0, True), (1, True), (2, False)])
def test_quality_gate(spark, bad_rows, allowed):
    good, bad = ("A", "DEL", "BOM", 1.0, 2.0, 100, 100.0, "active"), ("A", "DEL", "BOM", 1.0, 2.0, 100, 100.0, "ghost")
    rows = [good] * (20 - bad_rows) + [bad] * bad_rows
    verdict = validate.quality_gate(validate.with_row_errors(spark.createDataFrame(rows, ROW))).first()
    assert verdict.load_allowed is allowed and verdict.invalid_count == bad_rows


def test_quality_gate_needs_rows(spark):
    nothing = validate.with_row_errors(spark.createDataFrame([], ROW))
    assert validate.quality_gate(nothing).first().load_allowed is False


def test_expectations(spark, tidy_flights):
    small = expectations.check_expectations(clean.cast_types(tidy_flights)).collect()
    assert len(small) == 31 and [r.category for r in small if r.success is None] == ["statistical"] * 2  # too few rows for these
    assert all(r.success for r in small if r.category != "statistical")
    assert all(r.success is not None for r in expectations.check_expectations(clean.cast_types(tidy_flights), 2).collect())
    large = expectations.check_expectations(flights(spark, 20, status="ghost")).collect()
    failed = {(r.category, r.column_name) for r in large if r.success is False}
    assert ("enum", "status") in failed and ("schema", "altitude") in failed and ("schema", "status") not in failed
    summary = expectations.expectation_summary(expectations.check_expectations(flights(spark, 20, status="ghost"))).first()
    assert not summary.success and summary.checks_failed == len(failed) and "enum:status" in summary.failed_checks


def test_numeric_profile_quartiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "speed double")
    row = expectations.numeric_profile(df, quartiles=True).first()
    assert (row.n, row.mean, row.minimum, row.maximum) == (100, 50.5, 1.0, 100.0)
    assert (row.q1, row.median, row.q3) == (25.0, 50.0, 75.0)
    few = spark.createDataFrame([(7.0, None), (None, None)], "speed double, heading double")
    assert {r.column_name: (r.q1, r.median, r.q3) for r in expectations.numeric_profile(few, quartiles=True).collect()} == {"speed": (7.0,) * 3, "heading": (None,) * 3}
