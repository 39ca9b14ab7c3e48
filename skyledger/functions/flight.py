"""Derived flight attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from skyledger.settings import ROUTE_ARROW

# Upper edges of the delay buckets in minutes, and their order.
DELAY_BUCKET_EDGES = [("on_time", 0), ("minor_delay", 15), ("moderate_delay", 60), ("major_delay", 180)]
DELAY_BUCKETS = [name for name, _ in DELAY_BUCKET_EDGES] + ["severe_delay"]

# Altitude (feet) below which a phase applies.
PHASE_CEILINGS = [("ground", 1000), ("climbing", 15000), ("mid_altitude", 32000)]
FLIGHT_PHASES = [name for name, _ in PHASE_CEILINGS] + ["cruise"]

# Bounding box of the home region (latitude, longitude).
HOME_REGION_BOX = ((8, 37), (68, 97))


def _first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    (condition, label), *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], rule[1]), rest, F.when(condition, label))
    return chain.otherwise(otherwise)


def delay_bucket(minutes: Column) -> Column:
    known = F.coalesce(minutes, F.lit(0))
    return _first_match([(known <= edge, name) for name, edge in DELAY_BUCKET_EDGES], "severe_delay")


def delay_bucket_zero_exact(minutes: Column) -> Column:
    """Warehouse variant: only an exact 0 is on time, so -3 is a minor delay."""
    known = F.coalesce(minutes, F.lit(0))
    rules = [(known == 0, "on_time")]
    rules += [(minutes <= edge, name) for name, edge in DELAY_BUCKET_EDGES[1:]]
    return _first_match(rules, "severe_delay")


def flight_phase(altitude: Column) -> Column:
    known = F.coalesce(altitude, F.lit(0))
    return _first_match([(known < ceiling, name) for name, ceiling in PHASE_CEILINGS], "cruise")


def region(latitude: Column, longitude: Column) -> Column:
    lat_box, lon_box = HOME_REGION_BOX
    return _first_match(
        [
            (latitude.between(*lat_box) & longitude.between(*lon_box), "India"),
            (latitude >= 35, "Europe_Asia"),
            (latitude <= 0, "Southern"),
        ],
        "Middle_East_SE_Asia",
    )


def is_international(source: Column, dest: Column, domestic: list[str]) -> Column:
    """An unknown airport counts as abroad."""
    both_home = F.coalesce(source.isin(domestic), F.lit(False)) & F.coalesce(dest.isin(domestic), F.lit(False))
    return ~both_home


def route_key(source: Column, dest: Column, missing: str | None = None) -> Column:
    if missing is not None:
        source, dest = F.coalesce(source, F.lit(missing)), F.coalesce(dest, F.lit(missing))
    return F.concat(source, F.lit(ROUTE_ARROW), dest)
