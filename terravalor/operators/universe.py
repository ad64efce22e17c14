"""Assessment roll to property universe: typing, classification, derived fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions.numbers import change, ratio, starts_with_any
from terravalor.functions.text import clean_pid, number_or_null, number_or_zero, upper_key
from terravalor.operators.match import let

VALUE_COLUMNS = (
    "current_land_value", "current_improvement_value", "previous_land_value",
    "previous_improvement_value", "tax_levy",
)
YEAR_COLUMNS = ("tax_assessment_year", "year_built")
CIVIC_COLUMNS = ("from_civic_number", "to_civic_number")
KEY_COLUMNS = (
    "neighbourhood_code", "zoning_district", "zoning_classification", "legal_type",
    "street_name", "property_postal_code",
)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().upper().replace(" ", "_") for c in df.columns])


def clean_types(df: DataFrame) -> DataFrame:
    """Typed columns for whichever of the known names are present."""
    typed = {}
    for c in df.columns:
        if c == "pid":
            typed[c] = clean_pid(F.col(c))
        elif c in VALUE_COLUMNS:
            typed[c] = number_or_zero(F.col(c))
        elif c in YEAR_COLUMNS:
            typed[c] = number_or_null(F.col(c)).cast("int")
        elif c in CIVIC_COLUMNS:
            typed[c] = number_or_null(F.col(c))
        elif c in KEY_COLUMNS:
            typed[c] = upper_key(F.col(c))
    return df.withColumns(typed)


def latest_per_pid(df: DataFrame) -> DataFrame:
    """One row per property, the latest assessment year.

    ``row_number() = 1`` lets Spark keep one row per key in every map task
    before the shuffle, so a key with very many rows does not pile up.
    """
    ties = [F.col(c).desc_nulls_last() for c in sorted(df.columns) if c not in ("pid", "tax_assessment_year")]
    order = Window.partitionBy("pid").orderBy(F.col("tax_assessment_year").desc_nulls_last(), *ties)
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def classify(zoning: Column, legal: Column) -> Column:
    """Property type from zoning prefix and legal type; the first rule that fits wins.

    Both are worked out once: the rules name them some forty times, and a filter on the type repeats whatever they are made of.
    """
    zone = F.coalesce(F.upper(F.trim(zoning)), F.lit(""))
    strata = F.coalesce(F.upper(F.trim(legal)), F.lit("")) == "STRATA"
    return let(F.struct(zone.alias("zone"), strata.alias("strata")), lambda known: _type_of(known["zone"], known["strata"]))


def _type_of(zone: Column, strata: Column) -> Column:
    condo_or_land = F.when(strata, K.CONDO).otherwise(K.DEVELOPMENT_LAND)
    industrial = zone.isin(*K.INDUSTRIAL_ZONES) | starts_with_any(
        zone, tuple(z + " " for z in K.INDUSTRIAL_ZONES)
    )
    return (
        F.when(industrial, K.DEVELOPMENT_LAND)
        .when(zone.startswith("CD-1"), condo_or_land)
        .when(starts_with_any(zone, K.DETACHED_ZONES), K.DETACHED)
        .when(starts_with_any(zone, K.TOWNHOME_ZONES), K.TOWNHOME)
        .when(starts_with_any(zone, K.CONDO_ZONES), K.CONDO)
        .when(starts_with_any(zone, K.COMMERCIAL_ZONES), condo_or_land)
        .when(strata, K.CONDO)
        .otherwise(K.DETACHED)
    )


def add_type(df: DataFrame) -> DataFrame:
    return df.withColumn("property_type", classify(F.col("zoning_district"), F.col("legal_type")))


def effective_age(assessment_year: Column, year_built: Column) -> Column:
    return F.when(year_built > 1800, F.greatest(assessment_year - year_built, F.lit(0)))


def best_civic(from_civic: Column, to_civic: Column) -> Column:
    return (
        F.when(F.coalesce(from_civic, F.lit(0.0)) > 0, from_civic)
        .otherwise(F.coalesce(to_civic, F.lit(0.0)))
        .cast("bigint")
    )


def full_address(civic: Column, street: Column) -> Column:
    number = F.when(civic > 0, civic.cast("string")).otherwise("")
    return F.trim(F.concat_ws(" ", number, F.coalesce(street, F.lit(""))))


def add_derived(df: DataFrame) -> DataFrame:
    total = F.col("current_land_value") + F.col("current_improvement_value")
    previous = F.col("previous_land_value") + F.col("previous_improvement_value")
    return (
        df.withColumns(
            {
                "total_assessed_value": total,
                "civic_number": best_civic(F.col("from_civic_number"), F.col("to_civic_number")),
            }
        )
        .withColumns(
            {
                "land_ratio": ratio(F.col("current_land_value"), F.col("total_assessed_value")),
                "yoy_change_pct": change(F.col("total_assessed_value"), previous),
                "full_address": full_address(F.col("civic_number"), F.col("street_name")),
                "effective_age": effective_age(F.col("tax_assessment_year"), F.col("year_built")),
            }
        )
    )


def geocode(df: DataFrame, parcels: DataFrame) -> DataFrame:
    """Parcel centroid by land coordinate; parcels are reduced to one row per key first."""
    centroids = parcels.groupBy("land_coordinate").agg(
        F.min(F.struct("latitude", "longitude")).alias("_c")
    )
    keep = [c for c in df.columns if c not in ("latitude", "longitude")]
    return (
        df.select(*keep)
        .join(centroids, "land_coordinate", "left")
        .withColumns({"latitude": F.col("_c.latitude"), "longitude": F.col("_c.longitude")})
        .drop("_c")
    )


def residential_only(df: DataFrame) -> DataFrame:
    zone = F.coalesce(F.col("zoning_district"), F.lit(""))
    return df.where(
        (F.col("total_assessed_value") > 0)
        & ~starts_with_any(zone, K.EXCLUDED_ZONES)
        & F.col("property_type").isin(*K.RESIDENTIAL_TYPES)
    )


def build_universe(roll: DataFrame, parcels: DataFrame) -> DataFrame:
    """Roll rows to the residential property table, one row per property."""
    typed = latest_per_pid(clean_types(lower_names(roll)))
    return geocode(residential_only(add_derived(add_type(typed))), parcels)


# ---- serving fixes -------------------------------------------------------------


def fix_inclusive_zone(df: DataFrame) -> DataFrame:
    """Strata lots in the inclusive residential zone are detached homes, not condos."""
    wrong = (F.col("zoning_district") == "R1-1") & (F.col("property_type") == K.CONDO)
    return df.withColumn(
        "property_type", F.when(wrong, K.DETACHED).otherwise(F.col("property_type"))
    )


def lot_key() -> list[Column]:
    return [
        F.coalesce(F.col("to_civic_number"), F.lit(0)).cast("bigint").alias("_lot_civic"),
        F.upper(F.trim(F.coalesce(F.col("street_name"), F.lit("")))).alias("_lot_street"),
    ]


def mark_duplex(df: DataFrame) -> DataFrame:
    """Two or more detached properties on one lot address are duplex halves.

    Counted with a partial aggregate and joined back, not with a window over the
    lot: a crowded lot address then costs no more than any other.
    """
    keyed = df.select("*", *lot_key())
    crowded = (
        keyed.where((F.col("_lot_civic") > 0) & (F.col("property_type") == K.DETACHED))
        .groupBy("_lot_civic", "_lot_street")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n >= 2")
    )
    joined = keyed.join(crowded, ["_lot_civic", "_lot_street"], "left")
    return joined.withColumn(
        "property_type",
        F.when(F.col("_n").isNotNull() & (F.col("property_type") == K.DETACHED), K.DUPLEX).otherwise(
            F.col("property_type")
        ),
    ).drop("_n", "_lot_civic", "_lot_street")


def building_pattern(df: DataFrame) -> DataFrame:
    """Duplex or strata pattern per building (to-civic, street), from its units."""
    unit = F.when(
        (F.col("civic_number") > 0) & (F.col("civic_number") != F.col("_lot_civic")), F.col("civic_number")
    )
    stats = (
        df.select("*", *lot_key())
        .where("_lot_civic > 0")
        .groupBy("_lot_civic", "_lot_street")
        .agg(
            F.count(F.lit(1)).alias("units"),
            F.count(unit).alias("numbered_units"),
            F.max((unit == 1).cast("int")).alias("_has1"),
            F.max((unit == 2).cast("int")).alias("_has2"),
            F.max(F.col("property_type").isin(K.CONDO, K.TOWNHOME).cast("int")).alias("_condo"),
        )
    )
    duplex = (
        (F.col("_condo") == 0)
        & (F.col("numbered_units") == 2)
        & (F.coalesce(F.col("_has1"), F.lit(0)) == 1)
        & (F.coalesce(F.col("_has2"), F.lit(0)) == 1)
    )
    strata = (F.col("units") > 2) | ((F.col("units") > 1) & (F.col("_condo") == 1))
    return stats.select(
        F.col("_lot_civic").alias("building_number"),
        F.col("_lot_street").alias("street_name"),
        "units",
        "numbered_units",
        F.when(duplex, "duplex").when(strata, "strata").otherwise("single").alias("pattern"),
    )


def fill_year_from_neighbours(df: DataFrame, reach: int = 4) -> DataFrame:
    """Missing year built from the same address, else the nearest civic number, lower first."""
    civic = F.coalesce(F.col("civic_number"), F.lit(0)).cast("bigint")
    known = (
        df.where(F.col("year_built").isNotNull() & (civic > 0) & F.col("street_name").isNotNull())
        .groupBy(civic.alias("_c"), F.col("street_name").alias("_s"))
        .agg(F.max("year_built").alias("_y"))
    )
    offsets = [0] + [o for d in range(1, reach + 1) for o in (-d, d)]
    tries = F.explode(
        F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).cast("bigint").alias("off")) for i, o in enumerate(offsets)])
    )
    # Look-ups are made per distinct address, so copies of one address cost one search.
    wanted = (
        df.where(
            F.col("year_built").isNull() & (F.col("property_type") != K.DUPLEX) & (civic > 0)
            & F.col("street_name").isNotNull()
        )
        .select(civic.alias("_civic"), "street_name")
        .distinct()
    )
    found = (
        wanted.select("*", tries.alias("_t"))
        .select("*", (F.col("_civic") + F.col("_t.off")).alias("_c"), F.col("street_name").alias("_s"))
        .join(known, ["_c", "_s"])
        .groupBy("_civic", "street_name")
        .agg(F.min_by("_y", F.col("_t.rank")).alias("_filled"))
    )
    joined = df.withColumn("_civic", civic).join(found, ["_civic", "street_name"], "left")
    usable = F.col("year_built").isNull() & (F.col("property_type") != K.DUPLEX)
    return joined.withColumns(
        {
            "year_built_source": F.when(F.col("year_built").isNotNull(), "roll").when(
                usable & F.col("_filled").isNotNull(), "neighbour"
            ),
            "year_built": F.coalesce(F.col("year_built"), F.when(usable, F.col("_filled"))),
        }
    ).select(*df.columns, "year_built_source")


def fill_year_from_permits(df: DataFrame, permits: DataFrame) -> DataFrame:
    """Missing year built from the latest permit at the same civic number and short street."""
    from terravalor.operators.match import permit_key

    key = permit_key(F.col("address"))
    latest = (
        permits.select(key.alias("_k"), F.year("issue_date").alias("_y"))
        .where(F.col("_k.civic") > 0)
        .groupBy(F.col("_k.civic").alias("_civic"), F.col("_k.street").alias("_street"))
        .agg(F.max("_y").alias("permit_year"))
    )
    keyed = df.withColumns(
        {
            "_civic": F.coalesce(F.col("to_civic_number"), F.lit(0)).cast("bigint"),
            "_street": F.col("street_name"),
        }
    )
    joined = keyed.join(latest, ["_civic", "_street"], "left")
    return joined.withColumn("year_built", F.coalesce("year_built", "permit_year")).select(
        *df.columns, "permit_year"
    )


# ---- panel ---------------------------------------------------------------------


def add_panel_change(panel: DataFrame) -> DataFrame:
    """Change against the previous year of the same property.

    Rows are one per (property, year), so a window partition holds only years.
    """
    yearly = panel.withColumn(
        "total_assessed_value", F.col("current_land_value") + F.col("current_improvement_value")
    )
    w = Window.partitionBy("pid").orderBy("tax_assessment_year")
    previous = F.lag("total_assessed_value").over(w)
    return yearly.withColumn("yoy_change_pct", change(F.col("total_assessed_value"), previous))
