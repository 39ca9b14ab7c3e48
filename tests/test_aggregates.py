from datetime import date

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from skyledger.operators import aggregates as A
from skyledger.operators.ranking import latest_per, rank_desc_then_asc


def test_summary_matches_brute_force_with_missing_keys_and_values(spark):
    rng = random.Random(1)
    data = [(rng.choice(["x", "x", "x", "y", None]), rng.choice(["F1", "F2", "F3", None]),
             rng.choice([None, 0, 0, 5, 30, 200]), rng.random() < 0.4, rng.randrange(100) / 8) for _ in range(600)]
    df = spark.createDataFrame(data, "k string, flight string, delay_minutes long, late boolean, speed double").repartition(5)
    got = A.summarise(df, ["k"], [
        A.rows("n"), A.mean("avg_delay", F.col("delay_minutes"), 4), A.quantile("median", 0.5, 4), A.quantile("p90", 0.9, 4),
        A.largest("worst", F.col("delay_minutes")), A.deviation("sd", 4), A.share("pct_late", F.col("late"), 4),
        A.occurrences("n_late", F.col("late")), A.total("sum_speed", F.col("speed")), A.mean("avg_speed", F.col("speed"), 4),
    ], {"flights": "flight"})
    found = {r.k: r for r in got.collect()}
    assert set(found) == {"x", "y", None}
    for key, row in found.items():
        group = [d for d in data if d[0] == key]
        delays = [d[2] for d in group if d[2] is not None]
        assert row.n == len(group) and row.flights == len({d[1] for d in group if d[1]})
        assert row.avg_delay == round(statistics.mean(delays), 4)
        assert row.median == round(statistics.median(delays), 4)
        assert abs(row.p90 - np.percentile(delays, 90)) < 1e-3
        assert abs(row.sd - statistics.stdev(delays)) < 1e-3
        assert row.worst == max(delays) and row.n_late == sum(d[3] for d in group)
        assert abs(row.pct_late - 100 * sum(d[3] for d in group) / len(group)) < 1e-3
        assert abs(row.sum_speed - sum(d[4] for d in group)) < 1e-9


def test_deviation_of_one_row_is_null(spark):
    df = spark.createDataFrame([("x", "F", 5)], "k string, flight string, delay_minutes long")
    assert A.summarise(df, ["k"], [A.deviation("sd", 2)], {"flights": "flight"}).first().sd is None


def test_distributed_rank_equals_global_rank(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([100.0, 100.0, 90.5, 80.0, None]), rng.choice([1.0, 2.0, 3.0])) for i in range(200)]
    df = spark.createDataFrame(data, "id int, otp double, delay double")
    got = {r.id: r["rank"] for r in rank_desc_then_asc(df, "rank", "otp", "delay").collect()}
    df.createOrReplaceTempView("ranked_input")
    expected = spark.sql("SELECT id, rank() OVER (ORDER BY otp DESC NULLS LAST, delay ASC) AS r FROM ranked_input")
    assert got == {r.id: r.r for r in expected.collect()}


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 3, "y"), ("b", 2, "w")], "k string, ts int, id string")
    got = latest_per(df, "k", [F.desc("ts"), F.asc("id")])
    assert sorted((r.k, r.id) for r in got.collect()) == [("a", "y"), ("b", "w")]


def test_stacked_partials_are_those_of_the_whole(spark):
    rows = [("a" if i % 3 else None, f"f{i % 7}", date(2024, 1, 1 + i % 4), (i * 13) % 50 if i % 5 else None, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, flight string, day date, delay_minutes long, speed double")
    measures = [A.rows("n"), A.quantile("median", 0.5, 2), A.deviation("sd", 4), A.mean("speed", F.col("speed"), 3), A.largest("most", F.col("delay_minutes")), A.share("late", F.col("delay_minutes") > 9, 2)]
    distinct = {"flights": "flight", "days": "day"}
    whole = A.summarise(df, ["k"], measures, distinct)
    daily = A.partials(df, ["day", "k"], measures, distinct)
    again = A.merged(daily.filter("day <> DATE '2024-01-02'").unionByName(daily.filter("day = DATE '2024-01-02'")), ["k"], measures, distinct)
    key = lambda r: str(r.k)
    assert [tuple(r) for r in sorted(whole.collect(), key=key)] == [tuple(r) for r in sorted(again.collect(), key=key)]
    assert whole.count() == 2
