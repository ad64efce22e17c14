"""Keyed merges: listing upserts, article dedup, report log, ledger of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions.numbers import change
from terravalor.functions.text import amount, whole_amount

# Later arrival wins; the listed columns give a total order.
ARRIVAL = (
    "sold_date", "sold_price", "list_price", "address", "listed_pid", "sub_area",
    "property_type", "dom", "maint_fee",
)


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order, pruned map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def arrival_order(df: DataFrame) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in ARRIVAL if c in df.columns]


def latest_listings(rows: DataFrame) -> DataFrame:
    return latest_by_key(rows, ["mls_number"], arrival_order(rows))


def upsert_listings(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """Insert-or-replace by listing number; the first-seen date never moves forward."""
    both = current.withColumn("_batch", F.lit(0)).unionByName(
        arrived.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    seen = both.groupBy("mls_number").agg(F.min("first_seen_date").alias("_seen"))
    newest = latest_by_key(both, ["mls_number"], [F.col("_batch").desc(), *arrival_order(both)])
    return (
        newest.join(seen, "mls_number")
        .withColumn("first_seen_date", F.col("_seen"))
        .drop("_seen", "_batch")
    )


def insert_new(current: DataFrame, arrived: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of ``arrived`` whose key is not stored yet, one per key."""
    fresh = arrived.join(current.select(key).distinct(), key, "left_anti")
    return latest_by_key(fresh, [key], order)


def update_by_key(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite the named columns where a change row exists."""
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = current.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(
        *current.columns
    )


# ---- listing exports -------------------------------------------------------------


def detect_format(headers: list[str]) -> str:
    """Attached exports carry strata columns, detached ones carry lot columns."""
    names = {h.strip().lower() for h in headers}
    if {"locker", "maintfee", "bylaw restrictions"} & names:
        return "attached"
    if {"frontage - feet", "depth", "#kitchens"} & names:
        return "detached"
    return "unknown"


def side_of_city(code: Column) -> Column:
    return (
        F.when(code.startswith("VVW"), "Vancouver West")
        .when(code.startswith("VVE"), "Vancouver East")
        .otherwise("Vancouver")
    )


def price_difference(df: DataFrame) -> DataFrame:
    sold, asked = F.col("sold_price"), F.col("list_price")
    return df.withColumns(
        {
            "price_diff": F.when(sold.isNotNull() & (asked > 0), sold - asked),
            "price_diff_pct": change(sold, asked) * 100,
        }
    )


# Headers of the export files and what their columns become.
EXPORT_NUMBERS = {
    "days_on_mls": "Days On MLS", "bathrooms": "Tot Baths", "age": "Age", "parking": "TotalPrkng", "kitchens": "#Kitchens", "photos": "PicCount",
}
EXPORT_AMOUNTS = {"frontage_ft": "Frontage - Feet", "depth_ft": "Depth"}
EXPORT_TEXTS = {
    "list_date": "List Date", "postal_code": "Postal Code", "zoning": "Zoning", "view": "View - Specify", "locker": "Locker", "bylaw_restrictions": "Bylaw Restrictions",
    "style": "Style of Home", "photo_url": "Pics",
}


def clean_listing_export(raw: DataFrame) -> DataFrame:
    """Text columns of one export file to typed listing rows; rows without number drop out.

    A column that the file lacks is null, as is an empty text; strata and lot columns come from
    whichever format has them.
    """
    fmt = detect_format(raw.columns)

    def text(name: str) -> Column:
        return F.trim(F.col(f"`{name}`")) if name in raw.columns else F.lit(None).cast("string")

    def whole(name: str) -> Column:
        return whole_amount(F.col(f"`{name}`")) if name in raw.columns else F.lit(None).cast("bigint")

    def money(name: str) -> Column:
        return amount(F.col(f"`{name}`")) if name in raw.columns else F.lit(None).cast("double")

    area_name = F.lit(None).cast("string")
    lookup = F.create_map(*[F.lit(x) for kv in K.SUB_AREAS.items() for x in kv])
    if "S/A" in raw.columns:
        area_name = F.coalesce(lookup[text("S/A")], text("S/A"))
    listing = raw.select(
        text("ML #").alias("mls_number"),
        text("Status").alias("status"),
        text("Address").alias("address"),
        text("S/A").alias("sub_area"),
        area_name.alias("sub_area_name"),
        side_of_city(text("S/A")).alias("side"),
        F.coalesce(whole("Sold Price"), whole("Price")).alias("sold_price"),
        whole("List Price").alias("list_price"),
        text("Sold Date").alias("sold_date"),
        whole("DOM").cast("int").alias("dom"),
        whole("Tot BR").cast("int").alias("bedrooms"),
        whole("TotFlArea").cast("int").alias("floor_area"),
        whole("Yr Blt").cast("int").alias("year_built"),
        text("TypeDwel").alias("property_type"),
        money("MaintFee").alias("maint_fee"),
        *[whole(h).cast("int").alias(c) for c, h in EXPORT_NUMBERS.items()],
        *[money(h).alias(c) for c, h in EXPORT_AMOUNTS.items()],
        *[F.nullif(text(h), F.lit("")).alias(c) for c, h in EXPORT_TEXTS.items()],
        F.lit(fmt).alias("source_format"),
    ).where(F.col("mls_number") != "")
    return price_difference(listing)


def clean_listing_exports(frames: list[DataFrame]) -> DataFrame:
    """Exports of several formats as one listing table; each frame is read by its own header."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [clean_listing_export(f) for f in frames])
