"""All oracle SQL by query name."""

from __future__ import annotations

from checks import oracle_more, oracle_views
from checks.oracle_base import clean_ctes, sql

CLEANING = {
    "raw_flights": "SELECT * FROM raw",
    "exact_dedup": "SELECT * FROM d1",
    "fuzzy_dedup": "SELECT * FROM d2",
    "clean_canonical": "SELECT * FROM rc",
}


def oracle_sql() -> dict[str, str]:
    extra = clean_ctes("raw", "rc")
    bodies = {**CLEANING, **oracle_views.STAR, **oracle_views.REPORTS, **oracle_more.MORE}
    return {name: sql(body, extra) for name, body in bodies.items()}
