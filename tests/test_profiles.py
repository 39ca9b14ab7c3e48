from datetime import timedelta

from pyspark.sql import functions as F

from skyledger.plans import views
from skyledger.settings import AS_OF
from skyledger.streaming import live


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def report_of(profile, layered, source):
    if profile.name == "league":
        return views.airline_league(source, layered.airlines, min_flights=1)
    return {"delays": views.delay_patterns, "routes": lambda s: views.route_efficiency(s, min_flights=1),
            "aircraft": lambda s: views.aircraft_performance(s, min_flights=1)}[profile.name](source)


def test_reports_from_partials_equal_those_from_fact_and_do_not_read_it(layered):
    for profile in views.PROFILES:
        found = report_of(profile, layered, layered.daily(profile))
        assert rows(found) == rows(report_of(profile, layered, layered.fact)) != []
        assert found.inputFiles() and not any("-fact/" in f for f in found.inputFiles())
        assert sum("-fact/" in f for f in report_of(profile, layered, layered.fact).inputFiles()) == len(layered.fact.filter(
            F.col("event_date") >= (AS_OF - timedelta(days=30)).date()).inputFiles())


def test_only_changed_days_are_counted_again(spark, layered, scratch):
    fact, profile = layered.fact, views.LEAGUE
    table = profile.table(spark, scratch("league"), fact)
    day, gone = AS_OF.date() - timedelta(days=3), AS_OF.date() - timedelta(days=5)
    table.append(profile.by_day(fact.filter(F.col("event_date") != F.lit(day))))
    before = {p.part: p for p in table.state().pieces}
    profile.refresh(table, fact.filter(F.col("event_date") == F.lit(day)), [day, gone])
    after = {p.part: p for p in table.state().pieces}
    assert set(after) ^ set(before) == {f"event_date={day}", f"event_date={gone}"}
    assert all(after[part] == before[part] for part in set(after) & set(before))
    left = fact.filter(F.col("event_date") != F.lit(gone))
    assert rows(report_of(profile, layered, table)) == rows(report_of(profile, layered, left)) != []


def test_a_stream_keeps_the_partials(spark, layered, scratch):
    source, partials = scratch("in"), scratch("partials")
    layered.fact.repartition(2, "event_id").write.parquet(source)
    arriving = spark.readStream.schema(layered.fact.schema).option("maxFilesPerTrigger", 1).parquet(source)
    live.keep_hourly(spark, arriving, scratch("fact"), scratch("hourly"), scratch("cp"), available_now=True,
                     profiles={partials: views.AIRCRAFT}).awaitTermination()
    table = views.AIRCRAFT.table(spark, partials, layered.fact)
    assert rows(views.aircraft_performance(table, min_flights=1)) == rows(views.aircraft_performance(layered.fact, min_flights=1)) != []
