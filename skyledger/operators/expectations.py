"""A declarative expectation suite and a numeric profile of a flight table."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger import settings as S
from skyledger.operators.validate import AIRPORT_CODE

# Fixed values of the suite.
EXPECTED_COLUMNS = [
    "event_id", "flight_id", "airline", "airline_iata", "source_airport", "dest_airport",
    "latitude", "longitude", "altitude", "speed", "status", "event_timestamp",
]
NEVER_NULL = ["event_id", "flight_id", "event_timestamp"]
RARELY_NULL = ["source_airport", "dest_airport", "latitude", "longitude"]
RANGES = [
    ("altitude", 0, 60000, 0.95), ("speed", 0, 1200, 0.95), ("latitude", -90, 90, 0.99),
    ("longitude", -180, 180, 0.99), ("delay_minutes", 0, None, 0.99),
]
FORMATS = [("source_airport", AIRPORT_CODE), ("dest_airport", AIRPORT_CODE), ("airline_iata", "^[A-Z0-9]{2}$")]
MEAN_SPEED = (50, 950)
MIN_TOP_ALTITUDE = 10000
STATISTICS_NEED_MORE_THAN = 10  # rows; with fewer, statistical expectations do not apply


class Expectation(NamedTuple):
    category: str
    column: str
    success: Column  # an aggregate


def _mostly(good: Column, relevant: Column, at_least: float) -> Column:
    """Share of relevant rows that are good; holds when nothing is relevant."""
    n = F.count_if(relevant)
    return (n == 0) | (F.count_if(relevant & good) / F.nullif(n, F.lit(0)) >= at_least)


def flight_expectations(columns: list[str]) -> list[Expectation]:
    have = set(columns)
    suite = [Expectation("schema", c, F.lit(c in have)) for c in EXPECTED_COLUMNS]
    always = F.lit(True)
    for names, category, share in ((NEVER_NULL, "not_null_critical", 1.0), (RARELY_NULL, "not_null_95pct", 0.95)):
        suite += [Expectation(category, c, _mostly(F.col(c).isNotNull(), always, share)) for c in names if c in have]
    for name, low, high, share in RANGES:
        if name in have:
            good = F.col(name) >= low if high is None else F.col(name).between(low, high)
            suite.append(Expectation("range", name, _mostly(good, F.col(name).isNotNull(), share)))
    if "status" in have:
        status = F.col("status")
        suite.append(Expectation("enum", "status", _mostly(status.isin(S.VALID_STATUSES), status.isNotNull(), 0.95)))
    if "event_id" in have:
        suite.append(Expectation("unique", "event_id", F.lit(None).cast("boolean")))  # filled from its own scan
    for name, pattern in FORMATS:
        if name in have:
            suite.append(Expectation("format", name, _mostly(F.col(name).rlike(pattern), F.col(name).isNotNull(), 0.95)))
    if "speed" in have:
        suite.append(Expectation("statistical", "speed_mean", F.avg("speed").between(*MEAN_SPEED)))
    if "altitude" in have:
        suite.append(Expectation("statistical", "altitude_max", F.max("altitude") >= MIN_TOP_ALTITUDE))
    return suite


def check_expectations(df: DataFrame, statistics_need_more_than: int = STATISTICS_NEED_MORE_THAN) -> DataFrame:
    """One row per expectation; ``success`` is NULL where one does not apply: a statistical one on too few rows."""
    suite = flight_expectations(df.columns)
    outcome = df.agg(F.count("*").alias("records"),
                     *[F.coalesce(x.success, F.lit(False)).alias(f"x{i}") for i, x in enumerate(suite)])
    if "event_id" in df.columns:
        repeated = df.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("n"))
        unique = repeated.agg((F.count_if(F.col("n") > 1) == 0).alias("ok")).scalar()
        place = next(i for i, x in enumerate(suite) if x.category == "unique")
        outcome = outcome.withColumn(f"x{place}", unique)
    each = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(x.category).alias("category"),
                 F.lit(x.column).alias("column_name"), F.col(f"x{i}").alias("success"))
        for i, x in enumerate(suite)
    ])).alias("x")
    listed = outcome.select("records", each).select("records", "x.*")
    applies = (F.col("category") != "statistical") | (F.col("records") > statistics_need_more_than)
    return listed.select("position", "category", "column_name", F.when(applies, F.col("success")).alias("success"))


def expectation_summary(checked: DataFrame) -> DataFrame:
    name = F.concat_ws(":", "category", "column_name")
    failed = F.sort_array(F.collect_list(F.when(~F.col("success"), name)))  # at most 31 names
    return checked.agg(
        (F.count_if(~F.col("success")) == 0).alias("success"),
        F.count("success").alias("total_checks"),
        F.count_if("success").alias("checks_passed"),
        F.count_if(~F.col("success")).alias("checks_failed"),
        F.round(100.0 * F.count_if("success") / F.greatest(F.count("success"), F.lit(1)), 2).alias("pass_rate_pct"),
        F.array_join(failed, ",").alias("failed_checks"),
    )


PROFILED = ["latitude", "longitude", "altitude", "speed", "heading", "delay_minutes"]


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
RANGES_OF_VALUES = 4096


def _quartiles(df: DataFrame, names: list[str]) -> DataFrame:
    """Exact quartiles per column: the smallest value that at least that share of the values does not exceed.

    Values are counted, the counts of equal ranges of values are added up (a few thousand
    rows per column), and only the ranges that hold a quartile are looked at value by value.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in names])).alias("p")
    counted = df.select(pairs).select("p.*").filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    bounds = counted.groupBy("column_name").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    place = F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * (RANGES_OF_VALUES - 1))
    placed = counted.join(bounds, "column_name").withColumn("place", F.coalesce(place, F.lit(0)))
    up_to = W.partitionBy("column_name").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("column_name", "place").agg(F.sum("n").alias("inside"), F.max("total").alias("total"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("inside").over(up_to), F.lit(0)))
    ranks = {q: F.ceil(F.col("total") * share) for q, share in QUARTILES.items()}
    holds = reduce(Column.__or__, [(r > F.col("before")) & (r <= F.col("before") + F.col("inside")) for r in ranks.values()])
    within = W.partitionBy("column_name", "place").orderBy("value")
    near = placed.join(ranges.filter(holds).select("column_name", "place", "before"), ["column_name", "place"])
    near = near.withColumn("through", F.col("before") + F.sum("n").over(within))
    hit = {q: F.when((r <= F.col("through")) & (r > F.col("through") - F.col("n")), F.col("value")) for q, r in ranks.items()}
    return near.groupBy("column_name").agg(*[F.max(value).alias(q) for q, value in hit.items()])


def numeric_profile(df: DataFrame, quartiles: bool = False) -> DataFrame:
    """Count, mean, deviation, minimum and maximum per numeric column, in one aggregation; exact quartiles if asked for."""
    names = [c for c in PROFILED if c in df.columns]

    def stats(name: str) -> Column:
        value = F.col(name).cast("double")
        parts = [F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"),
                 F.round(F.stddev_samp(value), 6).alias("stddev"), F.min(value).alias("minimum"),
                 F.max(value).alias("maximum")]
        return F.struct(F.lit(name).alias("column_name"), *parts).alias(name)

    profile = df.agg(*[stats(c) for c in names]).select(F.explode(F.array(*names)).alias("s")).select("s.*")
    return profile.join(_quartiles(df, names), "column_name", "left") if quartiles else profile
