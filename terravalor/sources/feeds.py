"""Permit and listing feeds brought to one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravalor.functions.text import first_present

# Names under which the feeds carry each permit field.
PERMIT_FIELDS = {
    "permit_number": ("permitnumber", "permit_no", "permit_number", "permit_id"),
    "issue_date": ("issuedate", "issued", "issue_date"),
    "type_of_work": ("typeofwork", "work", "type_of_work"),
    "address": ("address", "site_address"),
    "project_value": ("projectvalue", "value", "project_value"),
}


def resolve_columns(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Project each wanted field from the first candidate name the source has, else null."""
    columns = []
    for target, names in wanted.items():
        found = first_present(df.columns, list(names))
        columns.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(target))
    return df.select(*columns)


def unify_permits(vancouver: DataFrame, surrey: DataFrame) -> DataFrame:
    first = resolve_columns(vancouver, PERMIT_FIELDS).withColumn("source", F.lit("vancouver"))
    second = resolve_columns(surrey, PERMIT_FIELDS).withColumn("source", F.lit("surrey"))
    return first.unionByName(second)


def filter_permits(
    permits: DataFrame, start: str, end: str, kinds: list[str] | None = None, minimum: float | None = None
) -> DataFrame:
    out = permits.where(F.col("issue_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if kinds:
        out = out.where(F.col("type_of_work").isin(*kinds))
    if minimum is not None:
        out = out.where(F.col("project_value") >= minimum)
    return out


# Names under which sources carry coordinates.
LATITUDES = ("latitude", "lat", "y", "stop_lat")
LONGITUDES = ("longitude", "lon", "lng", "long", "x", "stop_lon")


def with_point(df: DataFrame) -> DataFrame:
    """``point`` struct from whichever coordinate pair exists; null unless both are there."""
    lat, lon = first_present(df.columns, list(LATITUDES)), first_present(df.columns, list(LONGITUDES))
    if not lat or not lon:
        return df.withColumn("point", F.lit(None).cast("struct<lat: double, lon: double>"))
    both = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return df.withColumn(
        "point", F.when(both, F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")))
    )
