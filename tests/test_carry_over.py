from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import dedup, merge
from skyledger.plans import carry_over, incremental
from skyledger.sources import tables

NOW = datetime(2024, 1, 20)


def raw(layered, times):
    """Rows of RAW with these (event id, flight, seconds after midnight, load hour)."""
    one = layered.raw.limit(1).drop("event_id", "flight_id", "event_timestamp", "loaded_at")
    rows = layered.spark.createDataFrame([(e, f, NOW + timedelta(seconds=s), NOW + timedelta(hours=h)) for e, f, s, h in times],
                                         "event_id string, flight_id string, event_timestamp timestamp, loaded_at timestamp")
    return rows.join(one).select(*layered.raw.columns)


def run(spark, rows, path, control, hour, seen, number):
    return incremental.run_raw_to_clean(spark, rows, path, control, NOW + timedelta(hours=hour), f"run-{number}", seen=seen)


@pytest.fixture()
def job(spark, scratch):
    control = tables.VersionedTable(spark, scratch("control"), incremental.WATERMARKS)
    control.write(incremental.initial_watermarks(spark))
    return scratch("clean"), control, carry_over.SeenPositions(spark, scratch("seen"))


TIMES = [("A1", "F1", -1, 1), ("A2", "F1", 3, 2), ("A3", "F1", 9, 3), ("A4", "F1", 13, 3),  # three seconds after, across a midnight and two windows
         ("B1", "F2", 4.9, 1), ("B2", "F2", 5.1, 2), ("B3", "F2", 10.1, 2), ("B4", "F2", 15.1, 3), ("C1", "F3", 0, 2), ("D1", None, 0, 1), ("D2", None, 1, 2),
         ("E1", "F4", 100, 1), ("E1", "F4", 500, 2), ("E2", "F4", 502, 3)]  # E1 is delivered again, with another time


def test_windows_equal_one_run_over_all(spark, layered, job):
    path, control, seen = job
    rows = raw(layered, TIMES)
    for number, hour in enumerate((1, 2, 3)):
        run(spark, rows, path, control, hour, seen, number)
    found = sorted(r.event_id for r in tables.read(spark, path, layered.clean.schema).collect())
    assert found == sorted(r.event_id for r in dedup.deduplicate(rows).collect())
    assert "A2" not in found and "B2" not in found and {"A3", "B3", "B4", "E1", "E2"} <= set(found)


def test_a_run_moves_whole_rows_by_id_once(spark, layered, job, monkeypatch):
    path, control, _ = job
    again, usual = [], merge.one_row_per_key
    monkeypatch.setattr(merge, "one_row_per_key", lambda rows, keys: again.append(keys) or usual(rows, keys))
    rows = raw(layered, [*TIMES, (None, "F5", 700, 1), (None, "F5", 800, 1)])  # rows without an id count as one
    written = run(spark, rows, path, control, 3, None, 1)["records_out"]
    found = sorted(str(r.event_id) for r in tables.read(spark, path, layered.clean.schema).collect())
    assert found == sorted(str(r.event_id) for r in dedup.fuzzy_dedup(dedup.exact_dedup(rows)).collect()) and len(found) == written
    assert found.count("None") == 1 and ["event_id"] not in again


def test_a_run_that_is_repeated_does_not_meet_its_own_rows(spark, layered, job, monkeypatch):
    path, control, seen = job
    rows = raw(layered, TIMES)
    run(spark, rows, path, control, 1, seen, 1)
    usual = incremental.ingest.write_clean
    monkeypatch.setattr(incremental.ingest, "write_clean", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, rows, path, control, 3, seen, 2)
    monkeypatch.setattr(incremental.ingest, "write_clean", usual)
    run(spark, rows, path, control, 3, seen, 3)
    found = sorted(r.event_id for r in tables.read(spark, path, layered.clean.schema).collect())
    assert found == sorted(r.event_id for r in dedup.deduplicate(rows).collect())


def test_only_the_days_of_a_run_are_read(spark, layered, job):
    seen = job[2]
    for day in range(5):
        seen.add(raw(layered, [(f"X{day}", "F1", day * 86400, 1)]), F.lit(NOW))
    read = seen.table.rows([(NOW + timedelta(days=3)).date()]).inputFiles()
    assert len(read) == 1 and len(seen.table.rows().inputFiles()) == 5
