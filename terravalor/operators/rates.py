"""Interest-rate series: wide table, as-of values, stress rate, mortgage capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = ("policy_rate", "mortgage_5yr", "mortgage_3yr")
STRESS_BUFFER, STRESS_FLOOR = 2.0, 5.25


def wide_rates(series: DataFrame, names: tuple[str, ...] = SERIES) -> DataFrame:
    """One row per date, one column per series; the values are known, so no scan finds them."""
    return series.groupBy("date").pivot("series", list(names)).agg(F.max("value"))


def rates_at_assessment(series: DataFrame, names: tuple[str, ...] = SERIES, before: int = 30, after: int = 7) -> DataFrame:
    """Last value per series in the window around July 1 of the year before each assessment year.

    The window lies inside one calendar year, so the year is an equality key and
    no range join is needed.
    """
    year = F.year("date") + 1
    july = F.make_date(F.year("date"), F.lit(7), F.lit(1))
    inside = F.col("date").between(F.date_sub(july, before), F.date_add(july, after))
    return (
        series.where(inside & F.col("value").isNotNull())
        .groupBy(year.alias("tax_assessment_year"))
        .agg(*[F.max_by(F.when(F.col("series") == n, F.col("value")), F.when(F.col("series") == n, F.col("date"))).alias(f"{n}_at_assessment") for n in names])
    )


def current_rates(series: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Last value per series in the days before ``as_of``."""
    day = F.to_date(F.lit(as_of))
    return (
        series.where(F.col("date").between(F.date_sub(day, days), day) & F.col("value").isNotNull())
        .groupBy("series")
        .agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"))
    )


def stress_rate(rate: Column) -> Column:
    return F.greatest(rate + STRESS_BUFFER, F.lit(STRESS_FLOOR))


def max_mortgage(
    income: Column, rate: Column, years: int = 25, gds: float = 0.39, tax: float = 5_000.0, heating: float = 100.0
) -> Column:
    """Largest principal whose payment fits the housing-cost limit."""
    available = income / 12 * gds - tax / 12 - heating
    monthly = rate / 100 / 12
    n = years * 12
    factor = (1 - F.pow(1 + monthly, F.lit(-n))) / F.when(monthly != 0, monthly)
    principal = F.when(monthly == 0, available * n).otherwise(available * factor)
    return F.when(available <= 0, 0.0).otherwise(principal)


def mortgage_capacity(wide: DataFrame, incomes: DataFrame) -> DataFrame:
    """Capacity per (date, area): the incomes, a bounded reference list, ride along as an array."""
    packed = incomes.agg(F.array_agg(F.struct("area_id", "median_income")).alias("areas"))
    rows = wide.where(F.col("mortgage_5yr").isNotNull()).select(
        "date", "mortgage_5yr", F.explode(packed.scalar()).alias("a")
    )
    stress = stress_rate(F.col("mortgage_5yr"))
    return rows.select(
        "date", F.col("a.area_id").alias("area_id"), stress.alias("stress_rate"),
        max_mortgage(F.col("a.median_income"), stress).alias("max_mortgage"),
    )
