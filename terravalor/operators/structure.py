"""Stories and living area from footprint, value, zoning and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions.numbers import clamp, positive, ratio

MIN_AREA, MAX_AREA = 200.0, 15_000.0
SINGLE_GARAGE, DOUBLE_GARAGE, LARGE_LOT = 400.0, 600.0, 4_000.0
BASEMENT_OLD, BASEMENT_NEW, BASEMENT_YEAR = 0.60, 0.80, 1990
TOWNHOME_UNIT_SQM, CONDO_UNIT_VALUE, CONDO_UNIT_SQFT = 175.0, 600_000.0, 800.0


def stories_from_intensity(x: Column) -> Column:
    """Building value per footprint square metre to stories, linear between breakpoints."""
    points = K.STORY_BREAKPOINTS
    out = F.when(x < points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x < x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.when(x.isNotNull(), K.STORIES_ABOVE_LAST)


def stories_from_zone(zoning: Column) -> Column:
    """The longest known zone prefix decides; an unknown zone gets the default."""
    code = F.upper(F.trim(zoning))
    out = None
    for prefix in sorted(K.STORIES_BY_ZONE, key=len, reverse=True):
        test, value = code.startswith(prefix), K.STORIES_BY_ZONE[prefix]
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.when(code.isNotNull(), K.STORIES_DEFAULT)


def stories_from_year(year: Column) -> Column:
    return F.when(year < 1940, 1.5).when(year < 1980, 2.0).when(year.isNotNull(), 2.5)


def add_stories(df: DataFrame) -> DataFrame:
    """Stories by value intensity, else zoning, else year, else default; then limits by type."""
    intensity = ratio(positive(F.col("current_improvement_value")), F.col("building_footprint_sqm"))
    by_value, by_zone, by_year = (
        stories_from_intensity(intensity), stories_from_zone(F.col("zoning_district")), stories_from_year(F.col("year_built")),
    )
    raw = F.coalesce(by_value, by_zone, by_year, F.lit(K.STORIES_DEFAULT))
    source = (
        F.when(by_value.isNotNull(), "improvement_ratio").when(by_zone.isNotNull(), "zoning")
        .when(by_year.isNotNull(), "year_built").otherwise("default")
    )
    kind = F.col("property_type")
    limited = F.when((kind == K.DETACHED) & (raw > 3.5), 3.0).when((kind == K.TOWNHOME) & (raw > 4.5), 4.0).otherwise(raw)
    return df.withColumns({"estimated_stories": clamp(limited, 1.0, 60.0), "stories_source": source})


def add_living_area(df: DataFrame, units: str | None = None) -> DataFrame:
    """Living area by type with a confidence; needs footprint and stories."""
    sqft = positive(F.col("building_footprint_sqm")) * K.SQM_TO_SQFT
    stories = F.col("estimated_stories")
    known = positive(F.col(units)) if units else F.lit(None).cast("double")
    kind = F.col("property_type")

    garage = F.when(F.coalesce(F.col("lot_size_sqft"), F.lit(0.0)) > LARGE_LOT, DOUBLE_GARAGE).otherwise(SINGLE_GARAGE)
    basement = sqft * F.when(F.coalesce(F.col("year_built"), F.lit(0)) >= BASEMENT_YEAR, BASEMENT_NEW).otherwise(BASEMENT_OLD)
    detached = sqft * stories * K.EFFICIENCY[K.DETACHED] - garage + basement

    row_units = F.coalesce(known, F.greatest(F.bround(F.greatest(F.col("building_footprint_sqm") / TOWNHOME_UNIT_SQM, F.lit(1.0))), F.lit(1.0)))
    townhome = sqft * stories * K.EFFICIENCY[K.TOWNHOME] / row_units

    building = sqft * stories * K.EFFICIENCY[K.CONDO]
    by_value = F.bround(F.greatest(positive(F.col("current_improvement_value")) / CONDO_UNIT_VALUE, F.lit(1.0)))
    by_value = F.when(F.col("current_improvement_value") > 0, by_value)
    by_size = F.bround(F.greatest(building / CONDO_UNIT_SQFT, F.lit(1.0)))
    condo_units = F.greatest(F.coalesce(known, by_value, by_size), F.lit(1.0))
    condo = building / condo_units

    area = F.when(kind == K.TOWNHOME, townhome).when(kind == K.CONDO, condo).otherwise(detached)
    boost = F.when(F.col("stories_source") == "improvement_ratio", 0.10).otherwise(0.0)
    confidence = (
        F.when(kind == K.DETACHED, 0.55 + boost)
        .when(kind == K.TOWNHOME, F.when(known.isNotNull(), 0.55).otherwise(0.45))
        .when(kind == K.CONDO, F.when(known.isNotNull(), 0.50).when(F.col("current_improvement_value") > 0, 0.38).otherwise(0.30))
        .otherwise(0.40 + boost)
    )
    usable = sqft.isNotNull() & (stories > 0)
    return df.withColumns(
        {
            "estimated_living_area_sqft": F.when(usable, clamp(area, MIN_AREA, MAX_AREA)),
            "living_area_confidence": F.when(usable, confidence).otherwise(0.0),
        }
    )


def add_lot_ratio(df: DataFrame) -> DataFrame:
    sqft = positive(F.col("building_footprint_sqm")) * K.SQM_TO_SQFT
    return df.withColumn("footprint_to_lot_ratio", ratio(sqft, F.col("lot_size_sqft")))
