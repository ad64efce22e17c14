"""Model features: derived columns, proxies, selection, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions.numbers import ratio, starts_with_any
from terravalor.functions.quantiles import medians
from terravalor.operators.universe import effective_age


def add_derived_features(df: DataFrame, rail: str = "dist_nearest_rail_m", income: str = "census_median_income") -> DataFrame:
    """Twelve derived features for whichever inputs are present."""
    have = set(df.columns)
    land, building, total = (F.col(c) for c in ("current_land_value", "current_improvement_value", "total_assessed_value"))
    out: dict[str, Column] = {
        "effective_age": effective_age(F.col("tax_assessment_year"), F.col("year_built")),
        "land_to_total_ratio": ratio(land, total),
        "improvement_to_land_ratio": ratio(building, land),
        "log_total_value": F.when(total > 0, F.log(total)),
        "log_land_value": F.when(land > 0, F.log(land)),
        "log_improvement_value": F.log(F.greatest(building, F.lit(0.0)) + 1),
    }
    if rail in have:
        d = F.col(rail)
        out["is_tod_area"] = F.coalesce(d <= 800, F.lit(False))
        out["tod_tier"] = F.when(d <= 200, "tier1").when(d <= 400, "tier2").when(d <= 800, "tier3").otherwise("none")
        if income in have:
            out["transit_wealth_interaction"] = d * F.col(income)
    if "lot_size_sqft" in have:
        out["value_per_lot_sqft"] = ratio(total, F.col("lot_size_sqft"))
    if "building_footprint_sqm" in have:
        out["improvement_intensity"] = ratio(building, F.col("building_footprint_sqm"))
    age = F.col("effective_age")
    bucket = (
        F.when(age <= 5, "New").when(age <= 15, "Recent").when(age <= 30, "Mature").when(age <= 60, "Older").when(age > 60, "Heritage")
    )
    return df.withColumns(out).withColumn("building_age_bucket", bucket)


def construction_type(year_built: Column, zoning: Column) -> Column:
    zone = F.upper(F.coalesce(zoning, F.lit("")))
    tall = starts_with_any(zone, K.HIGH_RISE_ZONES) & (F.coalesce(year_built, F.lit(0)) >= 2000)
    return F.when(tall, "concrete").otherwise("wood_frame")


def bedrooms_from_area(area: Column) -> Column:
    return (
        F.when(area < 600, 0).when(area < 900, 1).when(area < 1300, 2).when(area < 1800, 3).when(area < 2500, 4).when(area >= 2500, 5)
    )


def add_proxies(df: DataFrame) -> DataFrame:
    """Stand-ins for listing columns that are absent or wholly null, each with an ``_imputed`` flag."""
    wanted = [c for c in ("living_area_sqft", "construction_type", "bedrooms") if c in df.columns]
    filled = set()
    if wanted:
        counts = df.agg(*[F.count(c).alias(c) for c in wanted]).first()
        filled = {c for c in wanted if counts[c] > 0}
    out = df
    if "living_area_sqft" not in filled:
        source = F.col("estimated_living_area_sqft") if "estimated_living_area_sqft" in df.columns else F.lit(None).cast("double")
        out = out.withColumns({"living_area_sqft": source, "living_area_imputed": F.lit(True)})
    if "construction_type" not in filled:
        out = out.withColumns(
            {"construction_type": construction_type(F.col("year_built"), F.col("zoning_district")), "construction_type_imputed": F.lit(True)}
        )
    if "bedrooms" not in filled:
        out = out.withColumns({"bedrooms": bedrooms_from_area(F.col("living_area_sqft")), "bedrooms_imputed": F.lit(True)})
    return out


def training_rows(matched: DataFrame, props: DataFrame) -> DataFrame:
    """Matched sales on their property; listing values override the property's where present."""
    listing = matched.where(F.col("matched_pid").isNotNull()).select(
        F.col("matched_pid").alias("pid"), "mls_number", "sold_price", "list_price", "sold_date", "sale_to_assessment_ratio",
        F.col("dom").alias("days_on_market"), "maint_fee",
        *[F.col(c).alias(f"_{c}") for c in ("bedrooms", "bathrooms", "floor_area", "year_built")],
    )

    def own(c: str, kind: str) -> Column:
        return F.col(c) if c in props.columns else F.lit(None).cast(kind)

    living = F.coalesce(F.when(F.col("_floor_area") > 0, F.col("_floor_area").cast("double")), own("living_area_sqft", "double"))
    joined = props.join(listing, "pid")
    return joined.withColumns(
        {
            "bedrooms": F.coalesce(F.col("_bedrooms"), own("bedrooms", "int")),
            "bathrooms": F.coalesce(F.col("_bathrooms").cast("double"), own("bathrooms", "double")),
            "year_built": F.coalesce(F.col("_year_built"), F.col("year_built")),
            "living_area_sqft": living,
            "strata_fee_per_sqft": ratio(F.col("maint_fee"), living),
            "list_to_sold_ratio": ratio(F.col("sold_price"), F.col("list_price")),
        }
    ).drop("_bedrooms", "_bathrooms", "_floor_area", "_year_built")


# ---- shape of the feature matrix ------------------------------------------------------


def null_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column from one aggregate row."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def drop_sparse(df: DataFrame, limit: float = 0.80, inclusive: bool = False) -> DataFrame:
    shares = null_shares(df)
    bad = [c for c, s in shares.items() if s > limit or (inclusive and s >= limit)]
    return df.drop(*bad)


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mixed or boolean columns to numbers; a missing boolean counts as 0."""
    kinds = dict(df.dtypes)
    changed = {}
    for c in columns:
        if kinds[c] == "boolean":
            changed[c] = F.coalesce(F.col(c).cast("int"), F.lit(0))
        elif kinds[c] == "string":
            changed[c] = F.col(c).try_cast("double")
    return df.withColumns(changed)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Populated count, percent and names of missing features per row."""
    flags = [F.col(c).isNotNull().cast("int") for c in columns]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    populated = reduce(lambda a, b: a + b, flags)
    return df.withColumns(
        {
            "populated_features": populated,
            "completeness_pct": populated / F.lit(float(len(columns))) * 100,
            "missing_features": missing,
        }
    )


def completeness_summary(rows: DataFrame) -> DataFrame:
    """Over all rows: mean, median, extremes, complete rows."""
    tagged = rows.withColumn("all_rows", F.lit("all"))
    stats = tagged.groupBy("all_rows").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("completeness_pct").alias("mean_pct"), F.min("completeness_pct").alias("min_pct"),
        F.max("completeness_pct").alias("max_pct"), F.count_if(F.col("completeness_pct") >= 100).alias("complete_rows"),
    )
    mids = medians(tagged, ["all_rows"], {"median_pct": "completeness_pct"})
    return stats.join(mids, "all_rows").drop("all_rows")


def column_completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many of the columns are full, and how many are null in over half of the rows; one scan."""
    filled = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns])
    number = lambda test: reduce(lambda a, b: a + b, [F.when(test(F.col(c)), 1).otherwise(0) for c in columns])
    return filled.select(
        F.lit(len(columns)).alias("total_features"), number(lambda n: n == F.col("_rows")).alias("fully_populated_features"),
        number(lambda n: 2 * n < F.col("_rows")).alias("features_over_50pct_null"),
    )


def fill_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled and total rows per column, from one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns])
    return counts.unpivot(["total"], columns, "column_name", "filled").select("column_name", "filled", "total")
