"""Typing and text-cleaning column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def clean_pid(c: Column) -> Column:
    """Digits only, zero-filled to nine; a longer value is kept whole."""
    d = digits(c)
    return F.when(F.length(d) >= 9, d).otherwise(F.lpad(d, 9, "0"))


def number_or_null(c: Column) -> Column:
    """Numeric coercion: junk and NaN become null."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number_or_null(c), F.lit(0.0))


def upper_key(c: Column) -> Column:
    """Trimmed, upper-cased key; the text 'NAN' counts as missing."""
    return F.nullif(F.upper(F.trim(c)), F.lit("NAN"))


def amount(c: Column) -> Column:
    """A number out of text such as '$1,350,000' or '1,204 sqft'."""
    return F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit("")).try_cast("double")


def whole_amount(c: Column) -> Column:
    return F.floor(amount(c)).cast("bigint")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def yes_flag(c: Column) -> Column:
    return F.upper(F.trim(c)).isin("Y", "YES", "TRUE", "1")


def true_false(c: Column) -> Column:
    """'t' / 'f' text to boolean, anything else null."""
    v = F.lower(F.trim(c))
    return F.when(v == "t", True).when(v == "f", False)


def first_present(columns: list[str], names: list[str]) -> str | None:
    """The first candidate column name that the source really has."""
    by_lower = {c.lower(): c for c in columns}
    for name in names:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    return None
