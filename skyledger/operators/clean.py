"""Cleaning and enrichment of raw flight rows.

The canonical cleaner is a chain of projections; Catalyst collapses them, no row
moves between tasks and no Python runs per row. Steps skip columns that the input
lacks. Three further profiles reproduce older cleaners whose rules differ.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from skyledger import settings as S
from skyledger.functions import flight, numbers, text, times

_INTEGERS = ["altitude", "delay_minutes"]
_DOUBLES = ["speed", "latitude", "longitude", "heading"]
_TIMESTAMPS = ["event_timestamp", "departure_time", "arrival_time", "loaded_at", "ingested_at"]
_DEFAULTS = {"altitude": 0, "speed": 0.0, "delay_minutes": 0}
_RANGES = {
    "altitude": S.ALTITUDE_RANGE,
    "speed": S.SPEED_RANGE,
    "latitude": S.LATITUDE_RANGE,
    "longitude": S.LONGITUDE_RANGE,
    "delay_minutes": (S.MIN_DELAY, None),
}
_LOG = "_log"


def _update(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Replace those columns that the input has."""
    return df.withColumns({name: col for name, col in changes.items() if name in df.columns})


def cast_types(df: DataFrame) -> DataFrame:
    """Unparseable values become NULL; fractional feet or minutes are rounded down."""
    kinds = dict(df.dtypes)

    def whole(name: str) -> Column:
        if kinds[name] in ("bigint", "int", "smallint", "tinyint"):
            return F.col(name).cast("bigint")
        return F.floor(numbers.nan_to_null(F.col(name).try_cast("double"))).cast("bigint")

    changes = {c: whole(c) for c in _INTEGERS if c in kinds}
    changes |= {c: numbers.nan_to_null(F.col(c).try_cast("double")) for c in _DOUBLES if c in kinds}
    changes |= {c: F.col(c).try_cast("timestamp") for c in _TIMESTAMPS if c in kinds}
    return df.withColumns(changes)


def clean_strings(df: DataFrame) -> DataFrame:
    changes: dict[str, Column] = {}
    for name in ("source_airport", "dest_airport"):
        changes[name] = text.blank_to_null(F.upper(text.strip(F.col(name))), S.AIRPORT_BLANKS)
    spelled = text.title_case(text.strip(F.col("airline")))
    if "airline_iata" in df.columns:  # looked up before the code itself is trimmed
        spelled = F.coalesce(text.lookup(S.AIRLINE_NAMES, F.col("airline_iata")), spelled)
    changes["airline"] = spelled
    changes["airline_iata"] = text.blank_to_null(F.upper(text.strip(F.col("airline_iata"))), S.AIRLINE_CODE_BLANKS)
    changes["status"] = F.lower(text.strip(F.col("status")))
    for name in ("source_city", "dest_city"):
        city = text.strip(F.col(name))
        changes[name] = F.when(~F.lower(city).isin(S.CITY_BLANKS), text.title_case(city))
    return _update(df, changes)


def _log_columns(present: list[str]) -> list[Column]:
    """One optional entry per rule, in the order the rules run; reads values before repair."""
    entries = [F.when(F.col(c).isNull(), f"imputed_{c}") for c in _DEFAULTS if c in present]
    for name, (low, high) in _RANGES.items():
        if name in present:
            beyond = F.col(name) < low
            if high is not None:
                beyond = beyond | (F.col(name) > high)
            entries.append(F.when(beyond, f"capped_{name}"))
    if "status" in present:
        odd = ~F.coalesce(F.col("status").isin(S.VALID_STATUSES), F.lit(False))
        entries.append(F.when(odd, "normalised_status"))
    return entries


def repair_values(df: DataFrame) -> DataFrame:
    """Fill missing numbers, clamp ranges, map status synonyms, and note each change."""
    status = F.when(F.col("status").isin(S.VALID_STATUSES), F.col("status")).otherwise(
        F.coalesce(text.lookup(S.STATUS_SYNONYMS, F.col("status")), F.lit("unknown"))
    )
    changes = {}
    for name, (low, high) in _RANGES.items():
        if name in _DEFAULTS:
            changes[name] = numbers.clip(F.coalesce(F.col(name), F.lit(_DEFAULTS[name])), low, high)
        else:
            changes[name] = numbers.clip(F.col(name), low, high)
        kind = "bigint" if name in _INTEGERS else "double"
        changes[name] = changes[name].cast(kind)
    changes["status"] = status
    logged = df.withColumn(_LOG, F.concat_ws(",", *_log_columns(df.columns)))  # skips NULL entries
    return _update(logged, changes)


def derive_columns(df: DataFrame, domestic: list[str] = S.DOMESTIC_AIRPORTS_18) -> DataFrame:
    have = set(df.columns)
    new: dict[str, Column] = {}
    if {"source_airport", "dest_airport"} <= have:
        source, dest = F.col("source_airport"), F.col("dest_airport")
        new["is_international"] = flight.is_international(source, dest, domestic)
        new["route_key"] = flight.route_key(source, dest, missing="???")
    if "delay_minutes" in have:
        new["delay_bucket"] = flight.delay_bucket(F.col("delay_minutes"))
    if "altitude" in have:
        new["flight_phase"] = flight.flight_phase(F.col("altitude"))
    if {"latitude", "longitude"} <= have:
        new["region"] = flight.region(F.col("latitude"), F.col("longitude"))
    if "event_timestamp" in have:
        ts = F.col("event_timestamp")
        new["event_date"] = F.to_date(ts)
        new["event_hour"] = F.hour(ts)
        new["day_of_week"] = times.monday_zero(ts)
    return df.withColumns(new)


def quality_rules(columns: list[str]) -> list[tuple[str, Column]]:
    """(rule, condition) in order of precedence, over the columns that exist."""
    have = set(columns)

    def any_of(conditions: list[Column]) -> Column:
        total = F.lit(False)
        for condition in conditions:
            total = total | F.coalesce(condition, F.lit(False))
        return total

    coordinates = [F.col(c).isNull() for c in ("latitude", "longitude") if c in have]
    airports = [F.col(c).isin(S.UNKNOWN_AIRPORTS) for c in ("source_airport", "dest_airport") if c in have]
    rules = [("missing_coordinates", any_of(coordinates))]
    if "flight_id" in have:
        rules.append(("missing_flight_id", F.col("flight_id").isNull()))
    if {"status", "speed"} <= have:
        idle = (F.col("status") == "active") & (F.coalesce(F.col("speed"), F.lit(0.0)) == 0)
        rules.append(("active_with_zero_speed", any_of([idle])))
    rules.append(("unknown_airport", any_of(airports)))
    if {"altitude", "speed"} <= have:
        fast_on_ground = (F.coalesce(F.col("altitude"), F.lit(0)) < 1000) & (F.col("speed") > 500)
        rules.append(("speed_altitude_mismatch", any_of([fast_on_ground])))
    return rules


def flag_quality(df: DataFrame) -> DataFrame:
    """Flag rows with any problem; the log names only the first rule that fired."""
    rules = quality_rules(df.columns)
    first = F.coalesce(*[F.when(condition, f"flag:{name}") for name, condition in rules])
    flagged = df.withColumn("_first_rule", first)
    return flagged.withColumns({
        "data_quality_flag": F.col("_first_rule").isNotNull(),
        "transformation_log": F.concat_ws(",", F.nullif(F.col(_LOG), F.lit("")), F.col("_first_rule")),
    }).drop(_LOG, "_first_rule")


def clean_flights(df: DataFrame, transformed_at: datetime | Column = S.AS_OF) -> DataFrame:
    """The canonical cleaner. Applying it to its own output changes no value."""
    steps = flag_quality(derive_columns(repair_values(clean_strings(cast_types(df)))))
    return steps.withColumns({
        "transformed_at": times.as_timestamp(transformed_at),
        "transformer_version": F.lit(S.TRANSFORMER_VERSION),
    })


def transform_report(cleaned: DataFrame) -> DataFrame:
    """Row counts in, out and flagged. The cleaner keeps every row, so one scan suffices."""
    flagged = numbers.count_where(F.col("data_quality_flag"))
    return cleaned.agg(F.count("*").alias("records_in"), F.count("*").alias("records_out"),
                     flagged.alias("records_flagged"),
                     F.coalesce(numbers.percent(flagged, F.count("*"), 2), F.lit(0.0)).alias("flag_rate_pct"))


# --- Other profiles -----------------------------------------------------------------

def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def clean_warehouse_profile(df: DataFrame, transformed_at: datetime | Column = S.AS_OF) -> DataFrame:
    """Warehouse rules: expects rows already unique by event_id.

    Derived columns and the flag read the values before repair; missing coordinates
    become 0.0; altitude has no ceiling; statuses are only lower-cased.
    """
    zero_if_null = lambda name: F.coalesce(F.col(name), F.lit(0))
    source, dest = F.upper(F.col("source_airport")), F.upper(F.col("dest_airport"))
    flagged = (F.col("latitude").isNull() | F.col("longitude").isNull()
               | _known(F.col("source_airport").isin("???", ""))
               | _known(F.col("altitude") < 0) | _known(F.col("speed") < 0))
    kept = df.filter(F.col("flight_id").isNotNull() & F.col("event_timestamp").isNotNull())
    derived = kept.withColumns({
        "is_international": flight.is_international(source, dest, S.DOMESTIC_AIRPORTS_10),
        "delay_bucket": flight.delay_bucket_zero_exact(F.col("delay_minutes")),
        "flight_phase": flight.flight_phase(F.col("altitude")),
        "region": flight.region(F.col("latitude"), F.col("longitude")),
        "data_quality_flag": flagged,
    })
    return derived.withColumns({
        "airline": F.trim(text.warehouse_initcap(F.col("airline"))),
        "airline_iata": F.upper(F.trim("airline_iata")),
        "source_airport": F.upper(F.trim("source_airport")),
        "dest_airport": F.upper(F.trim("dest_airport")),
        "latitude": F.coalesce("latitude", F.lit(0.0)),
        "longitude": F.coalesce("longitude", F.lit(0.0)),
        "altitude": F.greatest(zero_if_null("altitude"), F.lit(0)).cast("bigint"),
        "speed": F.greatest(F.least(zero_if_null("speed"), F.lit(1200)), F.lit(0)).cast("double"),
        "status": F.lower(F.coalesce("status", F.lit("unknown"))),
        "delay_minutes": F.greatest(zero_if_null("delay_minutes"), F.lit(0)).cast("bigint"),
        "transformed_at": times.as_timestamp(transformed_at),
    })


def clean_scheduled_profile(df: DataFrame, transformed_at: datetime | Column = S.AS_OF) -> DataFrame:
    """Rules of the scheduled job: expects rows already unique by event_id.

    Ten domestic airports, no status mapping, no placeholder removal. A missing
    speed-and-status pair only flags together; a missing coordinate flags alone.
    """
    code = lambda name: F.upper(text.strip(F.col(name)))
    tidy = df.withColumns({
        "airline": text.title_case(text.strip(F.col("airline"))),
        "airline_iata": code("airline_iata"),
        "source_airport": code("source_airport"),
        "dest_airport": code("dest_airport"),
        "status": F.lower(text.strip(F.col("status"))),
        "altitude": numbers.clip(F.coalesce("altitude", F.lit(0)), *S.ALTITUDE_RANGE).cast("bigint"),
        "speed": numbers.clip(F.coalesce("speed", F.lit(0.0)), *S.SPEED_RANGE).cast("double"),
        "delay_minutes": numbers.clip(F.coalesce("delay_minutes", F.lit(0)), 0).cast("bigint"),
    })
    idle = (F.col("speed") == 0) & _known(F.col("status") == "active")
    return tidy.withColumns({
        "is_international": flight.is_international(
            F.col("source_airport"), F.col("dest_airport"), S.DOMESTIC_AIRPORTS_10),
        "delay_bucket": flight.delay_bucket(F.col("delay_minutes")),
        "flight_phase": flight.flight_phase(F.col("altitude")),
        "region": flight.region(F.col("latitude"), F.col("longitude")),
        "data_quality_flag": (F.col("latitude").isNull() | F.col("longitude").isNull()
                              | idle | _known(F.col("source_airport") == "???")),
        "transformed_at": times.as_timestamp(transformed_at),
    })


def clean_quick_load_profile(df: DataFrame, loaded_now: datetime | Column = S.AS_OF) -> DataFrame:
    """Quick-load rules: defaults for gaps, nothing flagged, event time = load time."""
    source, dest = F.upper(F.col("source_airport")), F.upper(F.col("dest_airport"))
    trimmed = lambda name: F.upper(F.trim(name))
    derived = df.withColumns({
        "is_international": flight.is_international(source, dest, S.DOMESTIC_AIRPORTS_10),
        "delay_bucket": flight.delay_bucket_zero_exact(F.col("delay_minutes")),
        "flight_phase": flight.flight_phase(F.col("altitude")),
        "region": flight.region(F.col("latitude"), F.col("longitude")),
        "route_key": flight.route_key(trimmed("source_airport"), trimmed("dest_airport")),
        "data_quality_flag": F.lit(False),
    })
    return derived.withColumns({
        "airline": text.warehouse_initcap(F.trim("airline")),
        "airline_iata": F.upper(F.trim(F.coalesce("airline_iata", F.lit("")))),
        "source_airport": trimmed("source_airport"),
        "dest_airport": trimmed("dest_airport"),
        "latitude": F.coalesce("latitude", F.lit(0.0)),
        "longitude": F.coalesce("longitude", F.lit(0.0)),
        "altitude": F.greatest(F.coalesce("altitude", F.lit(0)), F.lit(0)).cast("bigint"),
        "speed": F.greatest(F.least(F.coalesce("speed", F.lit(0.0)), F.lit(1200.0)), F.lit(0.0)),
        "status": F.lower(F.coalesce("status", F.lit("active"))),
        "delay_minutes": F.greatest(F.coalesce("delay_minutes", F.lit(0)), F.lit(0)).cast("bigint"),
        "source": F.coalesce("source", F.lit("simulator")),
        "event_timestamp": times.as_timestamp(loaded_now),
        "transformed_at": times.as_timestamp(loaded_now),
    })
