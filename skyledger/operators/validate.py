"""Data-quality checks.

All column checks of a table share one aggregation without a shuffle; only the
uniqueness check needs its own, over the id column alone. Samples of failing rows
come from a per-rule ranking that each map task limits to a handful of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger import settings as S
from skyledger.functions import numbers, times

REQUIRED_COLUMNS = ["flight_id", "source_airport", "dest_airport", "latitude", "longitude", "event_timestamp"]
AIRPORT_CODE = "^[A-Z]{2,4}$"  # fixed value
SAMPLE_SIZE = 5


@dataclass(frozen=True)
class Rule:
    name: str
    threshold: float
    severity: str
    bad: Column | None  # None: a needed column is absent, the check passes
    problem: str
    sample: Column | None = None


def _any(conditions: list[Column]) -> Column:
    total = F.lit(False)
    for condition in conditions:
        total = total | F.coalesce(condition, F.lit(False))
    return total


def _number(name: str) -> Column:
    return numbers.nan_to_null(F.col(name).try_cast("double"))


def _bad_airport(name: str) -> Column:
    return F.coalesce(~F.col(name).rlike(AIRPORT_CODE), F.lit(True))


def flight_rules(columns: list[str], as_of: datetime) -> list[Rule]:
    have = set(columns)

    def when_present(needed: list[str], condition) -> Column | None:
        return F.coalesce(condition(), F.lit(False)) if set(needed) <= have else None

    error, warning = S.ERROR_THRESHOLD, S.WARNING_THRESHOLD
    flight = F.col("flight_id") if "flight_id" in have else None
    now = times.as_timestamp(as_of)
    ts = lambda: F.col("event_timestamp").try_cast("timestamp")

    def off_map() -> Column:
        lat, lon = _number("latitude"), _number("longitude")
        return lat.isNull() | lon.isNull() | ~lat.between(*S.LATITUDE_RANGE) | ~lon.between(*S.LONGITUDE_RANGE)

    def stale() -> Column:
        return ts().isNull() | (ts() > now) | (ts() < times.ago(as_of, hours=24))

    def fast_on_ground() -> Column:
        zero = F.lit(0.0)
        return (F.coalesce(_number("altitude"), zero) < 500) & (F.coalesce(_number("speed"), zero) > 400)

    position = None
    if {"flight_id", "latitude", "longitude"} <= have:
        position = F.to_json(F.struct("flight_id", "latitude", "longitude"))
    return [
        Rule("required_fields_present", error, "error",
             _any([F.col(c).isNull() for c in REQUIRED_COLUMNS if c in have]), "miss a required field", flight),
        Rule("coordinate_bounds_valid", error, "error", when_present(["latitude", "longitude"], off_map),
             "have no valid coordinates", position),
        Rule("altitude_in_valid_range", warning, "warning",
             when_present(["altitude"], lambda: numbers.outside(_number("altitude"), S.ALTITUDE_RANGE)),
             "have an altitude out of range"),
        Rule("speed_in_valid_range", warning, "warning",
             when_present(["speed"], lambda: numbers.outside(_number("speed"), S.SPEED_RANGE)),
             "have a speed out of range"),
        Rule("status_is_valid_enum", error, "error",
             when_present(["status"], lambda: ~F.coalesce(F.col("status").isin(S.VALID_STATUSES), F.lit(False))),
             "have an unknown status", F.col("status") if "status" in have else None),
        Rule("timestamp_is_fresh", warning, "warning", when_present(["event_timestamp"], stale),
             "are stale or in the future"),
        Rule("airport_code_format_valid", error, "error", None, "have a malformed airport code"),
        Rule("no_duplicate_event_ids", 0.0, "error", None, "share an event id"),
        Rule("no_route_self_loop", warning, "warning",
             when_present(["source_airport", "dest_airport"], lambda: F.col("source_airport") == F.col("dest_airport")),
             "have equal source and destination", F.col("source_airport") if "source_airport" in have else None),
        Rule("speed_altitude_consistent", warning, "warning", when_present(["speed", "altitude"], fast_on_ground),
             "are fast at ground level"),
    ]


def _duplicated_rows(df: DataFrame, key: str = "event_id") -> DataFrame:
    copies = df.groupBy(key).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))


def validate(df: DataFrame, as_of: datetime = S.AS_OF) -> DataFrame:
    """One row per check; no rows for empty input."""
    rules = flight_rules(df.columns, as_of)
    airports = [c for c in ("source_airport", "dest_airport") if c in df.columns]
    aggregates = [F.count("*").alias("total")]
    aggregates += [F.count_if(r.bad).alias(r.name) for r in rules if r.bad is not None]
    aggregates += [F.count_if(_bad_airport(c)).alias(f"_{c}") for c in airports]
    counts = df.agg(*aggregates)
    if "event_id" in df.columns:
        counts = counts.withColumn("no_duplicate_event_ids", _duplicated_rows(df).scalar())

    total = F.col("total")
    over = lambda count, limit: count / F.greatest(total, F.lit(1)) > limit
    first_bad_airport = F.coalesce(
        *[F.when(over(F.col(f"_{c}"), S.ERROR_THRESHOLD), F.col(f"_{c}")) for c in airports], F.lit(0))

    def affected(rule: Rule) -> Column:
        if rule.name == "airport_code_format_valid":
            return first_bad_airport
        return F.col(rule.name) if rule.name in counts.columns else F.lit(0)

    outcome = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"),
            F.lit(r.threshold).cast("double").alias("threshold"), affected(r).cast("bigint").alias("affected_count"),
            F.lit(r.problem).alias("problem"),
        ) for i, r in enumerate(rules, start=1)
    ])).alias("r")
    share = F.col("affected_count") / F.greatest(total, F.lit(1))
    return counts.filter("total > 0").select("total", outcome).select("total", "r.*").select(
        "position", "rule_name", (share <= F.col("threshold")).alias("passed"), "severity", "affected_count",
        share.alias("affected_pct"),
        F.concat(F.col("affected_count").cast("string"), F.lit(" records "), F.col("problem")).alias("message"),
        F.col("total").alias("total_records"),
    )


def validation_summary(results: DataFrame) -> DataFrame:
    """Healthy when no error-level check failed."""
    failed = ~F.col("passed") & (F.col("severity") == "error")
    warned = ~F.col("passed") & (F.col("severity") == "warning")
    return results.agg(
        F.coalesce(F.max("total_records"), F.lit(0)).alias("total_records"),
        F.count("*").alias("checks_run"),
        F.count_if("passed").alias("checks_passed"),
        F.count_if(failed).alias("checks_failed"),
        F.count_if(warned).alias("checks_warned"),
        (F.count_if(failed) == 0).alias("is_healthy"),
        F.coalesce(numbers.percent(F.count_if("passed"), F.count("*"), 2), F.lit(0.0)).alias("pass_rate_pct"),
    )


def failure_samples(df: DataFrame, as_of: datetime = S.AS_OF) -> DataFrame:
    """The first few failing values per rule, in value order; of repeated ids each once."""
    sampled = [r for r in flight_rules(df.columns, as_of) if r.bad is not None and r.sample is not None]
    hits = F.explode(F.array_compact(F.array(*[
        F.when(r.bad, F.struct(F.lit(r.name).alias("rule_name"), r.sample.cast("string").alias("value")))
        for r in sampled
    ])))
    failing = df.select(hits.alias("h")).select("h.*")
    # a status is sampled once; other rules list rows, so equal values may repeat
    statuses = failing.filter("rule_name = 'status_is_valid_enum'").distinct()
    others = failing.filter("rule_name <> 'status_is_valid_enum'")
    per_rule = W.partitionBy("rule_name").orderBy(F.col("value").asc_nulls_last())
    listed = others.unionByName(statuses)
    if "event_id" in df.columns:
        repeated = df.filter(F.col("event_id").isNotNull()).groupBy(F.col("event_id").alias("value")).agg(F.count("*").alias("n")).filter("n > 1")
        listed = listed.unionByName(repeated.select(F.lit("no_duplicate_event_ids").alias("rule_name"), "value"))
    ranked = listed.withColumn("sample_rank", F.row_number().over(per_rule))
    return ranked.filter(F.col("sample_rank") <= SAMPLE_SIZE)


# --- Row-level checks ----------------------------------------------------------------

ROW_REQUIRED = ["flight_id", "source_airport", "dest_airport", "latitude", "longitude", "status"]
ROW_RANGES = {
    "altitude": S.ALTITUDE_RANGE, "speed": S.SPEED_RANGE,
    "latitude": S.LATITUDE_RANGE, "longitude": S.LONGITUDE_RANGE,
}


def row_errors(df: DataFrame) -> Column:
    """Error codes of a row as an array, empty for a valid row. A missing status gives two."""
    kinds = dict(df.dtypes)

    def missing(name: str) -> Column:
        absent = F.col(name).isNull()
        return absent | (F.col(name) == "") if kinds[name] == "string" else absent

    codes = [F.when(missing(c), f"missing_{c}") for c in ROW_REQUIRED]
    codes += [F.when(numbers.outside(F.col(c), bounds), f"{c}_out_of_range") for c, bounds in ROW_RANGES.items()]
    codes.append(F.when(~F.coalesce(F.col("status").isin(S.VALID_STATUSES), F.lit(False)), "invalid_status"))
    return F.array_compact(F.array(*codes))


def with_row_errors(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", row_errors(df))


def error_breakdown(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("occurrences"))


def quality_gate(checked: DataFrame, max_fail_rate: float = S.QUALITY_GATE_MAX_FAIL_RATE,
                 min_records: int = S.QUALITY_GATE_MIN_RECORDS) -> DataFrame:
    """One row: counts, failure rate and whether the batch may be loaded."""
    counts = checked.agg(F.count("*").alias("total_records"), F.count_if(F.size("errors") == 0).alias("valid_count"),
                         F.count_if(F.size("errors") > 0).alias("invalid_count"))
    rate = F.coalesce(F.col("invalid_count") / F.nullif(F.col("total_records"), F.lit(0)), F.lit(0.0))
    return counts.withColumns({
        "fail_rate": F.round(rate, 4),
        "load_allowed": (F.col("total_records") >= min_records) & (F.round(rate, 4) <= max_fail_rate),
    })
