from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.plans import incremental, kpis
from skyledger.plans.layer_stats import LayerStatistics
from skyledger.sources import snapshots, tables

NOW = datetime(2024, 1, 30)
ROW = "event_id string, flight_id string, event_timestamp timestamp, transformed_at timestamp, loaded_at timestamp, event_date date"
IDS = ["AI101", "AI7", "AI007", "7", "07", "0", "00", "AI", "", None, "X9999999999", "AI40000", "AI32768", "AI32769", "6E2\n", "6E2", "ai101"]


def figures(df):
    return sorted(tuple(r) for r in df.collect())


def rows(spark, ids, shift=0):
    return spark.createDataFrame([(f"E{i}", f, NOW - timedelta(hours=7 * i + shift), NOW, NOW - timedelta(days=i % 3), (NOW - timedelta(days=i % 4)).date()) for i, f in enumerate(ids)], ROW)


def test_merged_figures_equal_a_scan(spark, scratch, monkeypatch):
    monkeypatch.setattr(snapshots, "FAN_IN", 2)
    table, whole = LayerStatistics(spark, scratch("stats")), None
    for part in range(5):
        batch = rows(spark, IDS[part::2] + IDS[:part], part)
        whole = batch if whole is None else whole.unionByName(batch)
        table.add("FACT", batch)
        table.add("RAW", batch.limit(3), F.to_date("loaded_at"), ("loads", part))
        table.add("RAW", batch.limit(3), F.to_date("loaded_at"), ("loads", part))  # the batch again
    expected = {r.layer: tuple(r) for r in kpis.volumes_of(whole, whole, whole).collect()}
    found = {r.layer: tuple(r) for r in table.volumes().collect()}
    assert found["FACT"] == expected["FACT"] and found["FACT"][2] == len(set(IDS) - {None})
    assert found["CLEAN"] == ("CLEAN", 0, 0, None, None, None) and found["RAW"][1] == 15
    assert max(len(table.state().of("figures", [f"layer={x}"])) for x in ("RAW", "FACT")) <= 3
    table.recount("FACT", rows(spark, IDS))
    assert {r.layer: r.total_rows for r in table.volumes().collect()}["FACT"] == len(IDS)


def test_no_layer_is_read(layered):
    volumes = layered.statistics.volumes()
    assert figures(volumes) == figures(kpis.volumes_of(layered.raw, layered.clean, layered.fact))
    for report in (kpis.layer_volume(volumes), kpis.layer_funnel(volumes), kpis.raw_load_stats(volumes, F.lit(0))):
        assert report.inputFiles() and all("layer-statistics" in f for f in report.inputFiles())


@pytest.mark.parametrize("uppers", [(datetime(2024, 1, 12), datetime(2024, 2, 1))])
def test_runs_keep_the_figures(spark, layered, scratch, uppers):
    table, path = LayerStatistics(spark, scratch("stats")), scratch("clean")
    control = tables.VersionedTable(spark, scratch("control"), incremental.WATERMARKS)
    control.write(incremental.initial_watermarks(spark))
    for n, upper in enumerate(uppers):
        incremental.run_raw_to_clean(spark, layered.raw_table, path, control, upper, f"run-{n}", day=tables.LOAD_DAY, statistics=table)
    clean = tables.read(spark, path, layered.clean.schema)
    expected = {r.layer: tuple(r) for r in kpis.volumes_of(layered.raw, clean, clean).collect()}
    found = {r.layer: tuple(r) for r in table.volumes().collect()}
    assert found["RAW"] == expected["RAW"] and found["CLEAN"] == expected["CLEAN"]
    done = spark.range(1).select(table.done_before(F.lit(datetime(2024, 1, 20).date())).alias("n")).first().n
    early = clean.filter(F.col("event_date") < F.lit(datetime(2024, 1, 20).date())).select("event_id")
    assert done == layered.raw.join(early.distinct(), "event_id").count()
