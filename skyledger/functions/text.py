"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that end a word for the warehouse's INITCAP.
WAREHOUSE_WORD_BREAKS = r"""\s!?@"^#$&~_,.:;+\-*%/|\\\[\](){}<>"""

_WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only spaces."""
    return F.btrim(col, F.lit(_WHITESPACE))


def _capitalise_runs(col: Column, pattern: str) -> Column:
    runs = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    capitalised = F.transform(
        runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2))))
    )
    return F.array_join(capitalised, "")


def title_case(col: Column) -> Column:
    """Capital after every non-letter: ``air-india`` becomes ``Air-India``.

    Text of letters and spaces takes the compiled ``initcap``, which agrees there.
    """
    return F.when(col.rlike(r"[^\p{L} ]"), _capitalise_runs(col, r"\p{L}+|\P{L}+")).otherwise(F.initcap(col))


def warehouse_initcap(col: Column) -> Column:
    """Capital after whitespace or punctuation, but not after an apostrophe."""
    breaks = WAREHOUSE_WORD_BREAKS
    return _capitalise_runs(col, f"[^{breaks}]+|[{breaks}]+")


def blank_to_null(col: Column, blanks: list[str]) -> Column:
    return F.when(~col.isin(blanks), col)


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value for ``key`` or NULL, as a constant map that Catalyst folds."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)
