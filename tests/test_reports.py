import pytest

import __spark_entry__ as entry
from checks import oracle
from checks.compare import compare, duck
from skyledger import queries
from skyledger.plans import reports, views
from tests.conftest import SF_DIR

QUERIES, ORACLE = queries.registered(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    yield (connection := duck(SF_DIR))
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_unknown_report(layered):
    with pytest.raises(ValueError):
        reports.run_report(layered, "nothing")


def test_report_limit(layered):
    assert reports.run_report(layered, "delay_patterns", 3).count() == 3
    assert set(reports.REPORTS) == set(reports.run_all(layered))


def test_reports_read_only_needed_days_and_columns(layered, capsys):
    views.active_airlines_now(layered.fact, layered.airlines, layered.as_of).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "PushedFilters: [IsNotNull(status)" in plan or "EqualTo(status,active)" in plan
    assert "source_airport" not in plan.split("ReadSchema")[1].split("\n")[0]




@pytest.mark.parametrize("name", ["incremental_window", "incremental_window_batch", "fact_recent_build", "unprocessed_recent", "health_scorecard", "layer_checks",
                                  "quality_rate", "watermarks_after_run"])
def test_look_backs_open_only_their_days(layered, capsys, name):
    """RAW and CLEAN are read with a filter on the day they are partitioned by."""
    queries._registry[name](layered).explain("formatted")
    plan = capsys.readouterr().out
    layers = [part for part in plan.split("Scan parquet")[1:] if "/0" in part and ("-raw]" in part or "-clean]" in part)]
    filters = [line for part in layers for line in part.splitlines() if "PartitionFilters" in line]
    assert filters and all("load_date" in line or "transform_date" in line for line in filters)


@pytest.mark.parametrize("name", ["layer_freshness", "layer_volume", "layer_funnel", "raw_load_stats"])
def test_figures_of_the_layers_open_no_layer(layered, name):
    opened = queries._registry[name](layered).inputFiles()
    assert opened and not any(f"-{layer}/" in f for f in opened for layer in ("raw", "clean", "fact"))
