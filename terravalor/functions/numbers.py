"""Guarded arithmetic; a missing or zero base gives null, never an error or NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def change(new: Column, old: Column) -> Column:
    return F.when(old > 0, (new - old) / old)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Bounds that keep null as null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def share(condition: Column) -> Column:
    """Share of rows, in percent, for which the condition holds."""
    return F.avg(condition.cast("int")) * 100


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def starts_with_any(c: Column, prefixes: tuple[str, ...]) -> Column:
    return any_of([c.startswith(p) for p in prefixes])


def row_mean(columns: list[Column]) -> Column:
    """Mean over the columns of one row, skipping nulls."""
    present = F.array_compact(F.array(*columns))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(present) > 0, total / F.size(present))
