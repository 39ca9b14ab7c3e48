from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skyledger.plans import kpis
from skyledger.sources import clustering, tables
from skyledger.sources.clustering import ClusteredTable, cut_points, interleaved, range_number

COLUMNS = ["airline_iata", "route_key", "event_hour"]
SCHEMA = "event_id string, airline_iata string, route_key string, event_hour int, event_date date"


@given(st.lists(st.one_of(st.none(), st.integers(0, 40)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_cuts_begin_ranges(values):
    cuts, given = cut_points(values, 3), [v for v in values if v is not None]
    assert cuts == sorted(set(cuts)) and len(cuts) < 8 and set(cuts) <= set(given)
    assert not given or all(c > min(given) for c in cuts)


def test_range_numbers_and_bits(spark):
    cuts = ["B", "D", "F"]
    values = [None, "", "A", "B", "C", "D", "E", "F", "Z"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", range_number(F.col("v"), cuts, 3).alias("n"))
    assert {r.v: r.n for r in df.collect()} == {v: 0 if v is None else 2 * sum(c <= v for c in cuts) for v in values}
    assert spark.range(1).select(range_number(F.col("id"), []).alias("n")).first().n == 0
    pairs = spark.range(64).select((F.col("id") % 8).cast("int").alias("a"), (F.col("id") / 8).cast("int").alias("b"))
    for r in pairs.select("a", "b", interleaved([F.col("a"), F.col("b")], 3).alias("z")).collect():
        assert r.z == int("".join(x + y for x, y in zip(f"{r.a:03b}", f"{r.b:03b}")), 2)


@pytest.fixture(scope="module")
def grid(spark):
    """One day and a second one; a third of all rows is one cell."""
    id_ = F.col("id")
    hot = id_ % 3 == 0
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    return spark.range(24_000).select(
        id_.cast("string").alias("event_id"),
        F.when(hot, "H0").when(id_ % 1000 != 1, F.format_string("A%02d", pick(40, 1))).alias("airline_iata"),
        F.when(hot, "R000").otherwise(F.format_string("R%03d", pick(300, 2))).alias("route_key"),
        F.when(hot, 0).otherwise(pick(24, 3)).cast("int").alias("event_hour"),
        F.when(id_ < 20_000, F.lit(date(2024, 1, 1))).otherwise(F.lit(date(2024, 1, 2))).alias("event_date"))


@pytest.fixture(scope="module")
def clustered(spark, grid):
    from skyledger import session

    table = ClusteredTable(spark, session.new_path(spark, "clustered"), grid.schema, COLUMNS)
    table.write(grid, files=64)
    return table


def test_filters_equal_a_scan(grid, clustered):
    cases = [
        {}, {"airline_iata": "A07"}, {"route_key": "R123"}, {"event_hour": 5}, {"event_hour": (3, 6)}, {"airline_iata": None},
        {"airline_iata": ["A01", None, "H0"]}, {"airline_iata": "H0", "event_hour": 0}, {"event_date": date(2024, 1, 2), "airline_iata": "A07"},
        {"route_key": "nowhere"}, {"event_date": date(2030, 1, 1)}, {"airline_iata": []},
    ]
    order = ["event_id", *COLUMNS, "event_date"]
    for filters in cases:
        wanted = grid
        for column, value in filters.items():
            wanted = wanted.filter(clustered._wanted(column, value))
        assert sorted(clustered.where(**filters).select(order).collect(), key=lambda r: r.event_id) == \
            sorted(wanted.select(order).collect(), key=lambda r: r.event_id), filters


def test_each_single_filter_opens_few_files(grid, clustered):
    every = clustered.files_for()
    opened = {"airline_iata": "A07", "route_key": "R123", "event_hour": 5}
    counts = {c: len(clustered.files_for(**{c: v})) for c, v in opened.items()}
    assert len(every) >= 60 and all(n <= 0.45 * len(every) for n in counts.values()), (counts, len(every))
    assert len(clustered.files_for(**opened)) <= len(every) / 8  # files that begin in one cell and end in the next count too
    assert len(clustered.where(route_key="R123").inputFiles()) == counts["route_key"]


def test_sorted_by_one_column_opens_more(spark, scratch, grid, clustered):
    """The layout by airline alone: its own filter opens fewer files, the two others nearly all."""
    table = ClusteredTable(spark, scratch("one"), grid.schema, COLUMNS)
    path = table.path
    grid.repartitionByRange(64, "event_date", "airline_iata", F.xxhash64("event_id")).write.partitionBy("event_date").parquet(path)
    table._index().write.parquet(table._index_path)
    for column, value in {"route_key": "R123", "event_hour": 5}.items():
        assert len(clustered.files_for(**{column: value})) < 0.7 * len(table.files_for(**{column: value}))


def test_a_hot_cell_is_spread(clustered):
    sizes = [r[0] for r in clustered.index.select(clustering.ROWS).collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)


def test_empty_table(spark, scratch):
    table = ClusteredTable(spark, scratch("none"), spark.createDataFrame([], SCHEMA).schema, COLUMNS)
    table.write(spark.createDataFrame([], SCHEMA))
    assert table.rows().count() == 0 and table.where(airline_iata="A").count() == 0


def test_fact_by_layers(layered):
    fact = layered.fact
    day = fact.agg(F.max(tables.DAY)).first()[0]
    found = kpis.speed_and_delay(layered.fact_where(event_date=day, airline_iata="AI"))
    assert found.collect() == kpis.speed_and_delay(fact, F.lit(day), "AI").collect()
    route = fact.filter("route_key IS NOT NULL").agg(F.min("route_key")).first()[0]
    assert kpis.speed_and_delay(layered.fact_where(route_key=route)).collect() == kpis.speed_and_delay(fact.filter(F.col("route_key") == route)).collect()


def test_error_rate_opens_the_shown_days(layered):
    rows = layered.clean_of_newest_days(3)
    assert kpis.daily_error_rate(rows, 3).collect() == kpis.daily_error_rate(layered.clean, 3).collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "transform_date" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert kpis.daily_error_rate(layered.clean_of_newest_days(10_000), 10_000).collect() == kpis.daily_error_rate(layered.clean, 10_000).collect()
