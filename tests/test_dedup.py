import random
from datetime import datetime, timedelta

import pytest

from skyledger.operators import clean, dedup

T0 = datetime(2024, 6, 15, 10)
SCHEMA = "event_id string, flight_id string, event_timestamp timestamp, loaded_at timestamp, altitude int"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_repeated_id_is_removed(spark):
    df = frame(spark, [("E001", "AI1", T0, T0, 1), ("E001", "AI1", T0, T0, 1), ("E002", "AI2", T0, T0, 1)])
    assert sorted(r.event_id for r in dedup.exact_dedup(df).collect()) == ["E001", "E002"]
    assert dedup.dedup_report(df).first().exact_duplicates_removed == 1


def test_unique_rows_stay(tidy_flights):
    df = clean.cast_types(tidy_flights)
    assert dedup.deduplicate(df).count() == 3
    report = dedup.dedup_report(df).first()
    assert (report.original, report.total_removed, report.dedup_rate_pct) == (3, 0, 0.0)


def test_earliest_load_wins(spark):
    df = frame(spark, [("E1", "A", T0, T0 + timedelta(seconds=5), 36000), ("E1", "A", T0, T0, 35000),
                       ("E1", "A", T0, None, 1)])
    assert [r.altitude for r in dedup.exact_dedup(df).collect()] == [35000]


def test_rows_without_id_count_as_one(spark):
    df = frame(spark, [(None, "A", T0, T0, 1), (None, "B", T0, T0 + timedelta(1), 2), ("E1", "A", T0, T0, 3)])
    assert sorted(r.altitude for r in dedup.exact_dedup(df).collect()) == [1, 3]


def test_near_duplicate_is_removed(spark):
    times = [T0, T0 + timedelta(seconds=2), T0 + timedelta(seconds=35)]
    df = frame(spark, [(f"E{i}", "AI101", ts, T0, i) for i, ts in enumerate(times)])
    assert sorted(r.altitude for r in dedup.fuzzy_dedup(df).collect()) == [0, 2]


def test_other_flights_are_untouched(spark):
    df = frame(spark, [("E1", "AI101", T0, T0, 1), ("E2", "6E202", T0 + timedelta(seconds=1), T0, 2)])
    assert dedup.fuzzy_dedup(df).count() == 2


def test_exactly_the_window_apart_is_kept(spark):
    df = frame(spark, [("E1", "A", T0 + timedelta(seconds=3), T0, 1), ("E2", "A", T0 + timedelta(seconds=8), T0, 2)])
    assert dedup.fuzzy_dedup(df).count() == 2


def test_rows_without_flight_or_time_are_kept(spark):
    df = frame(spark, [("E1", None, T0, T0, 1), ("E2", None, T0, T0, 2), ("E3", "A", None, T0, 3), ("E4", "A", None, T0, 4)])
    assert dedup.fuzzy_dedup(df).count() == 4


def previous_row_rule(data, seconds):
    """The definition: sort by flight and time, drop what follows the row before it too closely."""
    kept, last = [], {}
    for row in sorted((r for r in data if r[1] and r[2]), key=lambda r: (r[1], r[2], r[3], r[0])):
        before = last.get(row[1])
        if before is None or (row[2] - before).total_seconds() >= seconds:
            kept.append(row[0])
        last[row[1]] = row[2]
    return sorted(kept + [r[0] for r in data if not (r[1] and r[2])])


@pytest.mark.parametrize("seconds", [1, 5, 7])
def test_matches_the_definition_with_a_hot_flight(spark, seconds):
    """One flight holds most rows, with bursts, equal times and chains across cell borders."""
    rng = random.Random(seconds)
    data = []
    for i in range(1500):
        flight = "HOT" if rng.random() < 0.6 else rng.choice(["A", "B", "C", None])
        moment = T0 + timedelta(milliseconds=rng.randrange(0, 900_000, 250)) if rng.random() > 0.02 else None
        data.append((f"E{i:05d}", flight, moment, T0 + timedelta(seconds=rng.randrange(50)), i))
    kept = sorted(r.event_id for r in dedup.fuzzy_dedup(frame(spark, data).repartition(4), seconds).collect())
    assert kept == previous_row_rule(data, seconds)


@pytest.mark.parametrize("seconds", [1, 5])
def test_both_removals_equal_one_after_the_other(spark, seconds):
    """Repeated ids, rows without id, flight, time or load time, equal times and ids like the marks of the join."""
    rng = random.Random(seconds)
    data = []
    for i in range(1200):
        number = rng.choice([f"E{i // 2:05d}", f"E{i:05d}", "", "=", None])
        flight = rng.choice(["HOT", "HOT", "A", "B", None])
        moment = T0 + timedelta(milliseconds=rng.randrange(0, 900_000, 500)) if rng.random() > 0.05 else None
        data.append((number, flight, moment, T0 + timedelta(seconds=rng.randrange(3)) if rng.random() > 0.1 else None, i))
    df = frame(spark, data).repartition(4)
    apart = dedup.fuzzy_dedup(dedup.exact_dedup(df), seconds)
    key = lambda r: tuple((x is not None, x) for x in r)
    found = dedup.deduplicate(df, seconds)
    assert found.schema == apart.schema and sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, apart.collect()), key=key)


def shuffled_bytes(df):
    """What the exchanges of a query that has run have written; reused ones count once."""
    def of(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().apply("shuffleBytesWritten").value() if name == "ShuffleExchangeExec" else 0
        children = node.children()
        return own + sum(of(children.apply(i)) for i in range(children.size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_whole_rows_are_shuffled_once(spark):
    """A second exchange used to carry every column of the candidates; here one column is nearly all there is to carry."""
    rng = random.Random(1)
    data = [(f"E{i:05d}", f"F{i % 3}", T0 + timedelta(minutes=i), T0, "".join(chr(rng.randrange(33, 127)) for _ in range(2000))) for i in range(1000)]
    df = spark.createDataFrame(data, SCHEMA.replace("altitude int", "note string")).repartition(4)
    unique, both = dedup.exact_dedup(df), dedup.deduplicate(df)
    assert len(unique.collect()) == len(both.collect()) == 1000
    assert shuffled_bytes(both) < 1.3 * shuffled_bytes(unique)


def test_hot_id_is_reduced_before_the_shuffle(spark, capsys):
    df = frame(spark, [("DUP", "A", T0 + timedelta(minutes=i), T0, i) for i in range(50)])
    dedup.exact_dedup(df).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert dedup.exact_dedup(df).count() == 1


def test_report_adds_up(spark, layered):
    report = dedup.dedup_report(layered.raw).first()
    assert report.original == layered.raw.count()
    assert report.final_count == dedup.deduplicate(layered.raw).count()
    assert report.exact_duplicates_removed + report.fuzzy_duplicates_removed == report.total_removed > 0


def test_find_duplicates_lists_all_members(spark):
    df = frame(spark, [("E1", "A", T0, T0, 1), ("E1", "A", T0, T0 + timedelta(1), 2), ("E2", "A", T0, T0, 3),
                       (None, "A", T0, T0, 4), (None, "A", T0, T0, 5)])
    found = dedup.find_duplicates(df).collect()
    assert sorted(r.altitude for r in found) == [1, 2, 4, 5]
    assert {r.first_seen_at for r in found} == {T0}
