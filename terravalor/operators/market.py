"""Market aggregates: trends, segment statistics, summaries, histograms, report numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions.numbers import change, share
from terravalor.functions.quantiles import UPPER_MEDIAN, exact_percentiles, medians


def with_sets(df: DataFrame, sets: list[tuple[str, Column]]) -> DataFrame:
    """One copy of each row per grouping set: columns ``set_name`` and ``set_key``.

    The same as GROUPING SETS, but with labels, so that exact percentiles can
    follow. Rows with a null key leave that set only.
    """
    options = F.array(*[F.struct(F.lit(n).alias("set_name"), c.cast("string").alias("set_key")) for n, c in sets])
    return (
        df.withColumn("_set", F.explode(options))
        .select("*", "_set.set_name", "_set.set_key")
        .drop("_set")
        .where(F.col("set_key").isNotNull())
    )


def modal_value(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value; the smallest of ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column).asc()).limit(1)


def top_counts(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(column).asc())
        .limit(n)
    )


def universe_stats(props: DataFrame) -> DataFrame:
    keys = ["set_name", "set_key"]
    stacked = with_sets(
        props,
        [("all", F.lit("all")), ("type", F.col("property_type")), ("area", F.col("neighbourhood_code"))],
    )
    means = stacked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg("total_assessed_value").alias("mean_total")
    )
    mids = medians(
        stacked, keys, {"median_total": "total_assessed_value", "median_land_ratio": "land_ratio"}
    )
    zones = top_counts(props, "zoning_district").select(
        F.lit("zone").alias("set_name"),
        F.col("zoning_district").alias("set_key"),
        F.col("count"),
    )
    return means.join(mids, keys, "left").unionByName(zones, allowMissingColumns=True)


def segment_stats(props: DataFrame, value: str = "total_assessed_value", minimum: int = 200) -> DataFrame:
    """Per (area, type), plus citywide by type and citywide over all."""
    base = props.where(
        F.col("neighbourhood_code").isNotNull() & F.col("property_type").isNotNull() & (F.col(value) > 0)
    )
    stacked = base.select(
        value,
        "year_built",
        F.explode(
            F.array(
                F.concat_ws("__", "neighbourhood_code", "property_type"),
                F.concat_ws("__", F.lit("citywide"), "property_type"),
                F.lit("citywide__all"),
            )
        ).alias("segment"),
    )
    stats = stacked.groupBy("segment").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(value).alias("mean_value"),
        F.stddev_samp(value).alias("std_value"),
        F.min("year_built").alias("min_year"),
        F.max("year_built").alias("max_year"),
    )
    mids = medians(stacked, ["segment"], {"median_value": value})
    return stats.join(mids, "segment").withColumn("qualifies", F.col("count") >= minimum)


def market_summary(props: DataFrame, minimum: int = 10) -> DataFrame:
    """Per area and type with enough rows: count, median value, change of medians."""
    keys = ["neighbourhood_code", "property_type"]
    base = props.select(
        *keys,
        "total_assessed_value",
        (F.coalesce("previous_land_value", F.lit(0.0)) + F.coalesce("previous_improvement_value", F.lit(0.0))).alias(
            "previous_total"
        ),
    ).where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    mids = medians(base, keys, {"median_value": "total_assessed_value", "_previous": "previous_total"})
    return (
        counts.where(F.col("count") >= minimum)
        .join(mids, keys)
        .withColumn("yoy_pct", change(F.col("median_value"), F.col("_previous")) * 100)
        .drop("_previous")
    )


def area_names(df: DataFrame, code: str = "neighbourhood_code") -> DataFrame:
    lookup = F.create_map(*[F.lit(x) for kv in K.AREA_NAMES.items() for x in kv])
    return df.withColumn("neighbourhood_name", F.coalesce(lookup[F.col(code)], F.col(code)))


def summary_maps(summary: DataFrame) -> DataFrame:
    """One row per area with maps type → count, median and change."""

    def as_map(column: str) -> Column:
        pairs = F.sort_array(F.collect_list(F.struct("property_type", F.col(column).alias("v"))))
        return F.map_from_entries(pairs)

    return summary.groupBy("neighbourhood_code").agg(
        as_map("count").alias("property_counts"),
        as_map("median_value").alias("median_values"),
        as_map("yoy_pct").alias("yoy_changes"),
    )


def assessment_class(legal: Column) -> Column:
    return F.when(legal == "STRATA", K.CONDO).when(legal == "LAND", K.DETACHED).otherwise("other")


def market_trends(panel: DataFrame, minimum: int = 20, min_years: int = 2) -> DataFrame:
    """Median and count per (area, year), for each type and over all types."""
    total = F.coalesce("current_land_value", F.lit(0.0)) + F.coalesce("current_improvement_value", F.lit(0.0))
    keys = ["neighbourhood_code", "tax_assessment_year", "property_type"]
    stacked = (
        panel.withColumn("_total", total)
        .where((F.col("_total") > 0) & F.col("neighbourhood_code").isNotNull())
        .select(
            "neighbourhood_code",
            "tax_assessment_year",
            F.explode(F.array(assessment_class(F.col("legal_type")), F.lit("all"))).alias("property_type"),
            "_total",
        )
    )
    points = exact_percentiles(stacked, keys, "_total", {"median_value": 0.5}).where(F.col("n") >= minimum)
    # A window partition holds the years of one area and type only.
    years = F.count(F.lit(1)).over(Window.partitionBy("neighbourhood_code", "property_type"))
    return (
        points.withColumn("_years", years).where(F.col("_years") >= min_years).drop("_years")
        .withColumnRenamed("n", "count")
    )


def dominant_year_trends(props: DataFrame, minimum: int = 20) -> DataFrame:
    """The fallback: medians of the assessment year that most rows have."""
    year = modal_value(props, "tax_assessment_year").select("tax_assessment_year")
    rows = props.join(F.broadcast(year), "tax_assessment_year", "left_semi")
    keys = ["neighbourhood_code", "tax_assessment_year"]
    return (
        exact_percentiles(rows, keys, "total_assessed_value", {"median_value": 0.5})
        .where(F.col("n") >= minimum)
        .withColumnRenamed("n", "count")
    )


def year_pair_change(trends: DataFrame) -> DataFrame:
    w = Window.partitionBy("neighbourhood_code", "property_type").orderBy("tax_assessment_year")
    return trends.withColumn(
        "change_pct", change(F.col("median_value"), F.lag("median_value").over(w)) * 100
    ).where(F.col("change_pct").isNotNull())


def movers(changes: DataFrame, year: int, k: int = 8) -> DataFrame:
    """Top gainers and decliners of one year over all types."""
    rows = changes.where((F.col("tax_assessment_year") == year) & (F.col("property_type") == "all"))
    up = rows.where("change_pct > 0").orderBy(F.col("change_pct").desc(), "neighbourhood_code").limit(k)
    down = rows.where("change_pct < 0").orderBy(F.col("change_pct").asc(), "neighbourhood_code").limit(k)
    return up.withColumn("direction", F.lit("gainer")).unionByName(
        down.withColumn("direction", F.lit("decliner"))
    )


def dashboard_rollup(summary: DataFrame) -> DataFrame:
    """Total count, mean over areas of the area's mean of medians, mean change."""
    per_area = summary.groupBy("neighbourhood_code").agg(
        F.sum("count").alias("c"), F.avg("median_value").alias("m"), F.avg("yoy_pct").alias("y")
    )
    return per_area.agg(
        F.sum("c").alias("total_properties"),
        F.avg("m").alias("avg_median_value"),
        F.avg("y").alias("avg_yoy_pct"),
        F.count(F.lit(1)).alias("areas"),
    )


def sorted_market(summary: DataFrame, by: str) -> DataFrame:
    """Market table in one of the offered orders."""
    per_area = area_names(
        summary.groupBy("neighbourhood_code").agg(
            F.sum("count").alias("count"),
            F.avg("median_value").alias("median_value"),
            F.avg("yoy_pct").alias("yoy_pct"),
        )
    )
    orders = {
        "name": F.col("neighbourhood_name").asc(),
        "median_desc": F.col("median_value").desc_nulls_last(),
        "median_asc": F.col("median_value").asc_nulls_last(),
        "yoy": F.col("yoy_pct").desc_nulls_last(),
        "count": F.col("count").desc(),
    }
    return per_area.orderBy(orders[by], "neighbourhood_code")


# ---- transfer tax ------------------------------------------------------------------


def date_parts(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    d = F.col(column)
    return df.withColumns(
        {
            "transaction_year": F.year(d),
            "transaction_month": F.month(d),
            "transaction_quarter": F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
        }
    )


def transaction_summary(df: DataFrame, by: str = "municipality", period: str = "transaction_quarter") -> DataFrame:
    keys = [by, period]
    base = date_parts(df)
    sums = base.groupBy(*keys).agg(
        F.count("fair_market_value").alias("count"),
        F.avg("fair_market_value").alias("mean_value"),
        F.sum("fair_market_value").alias("total_value"),
    )
    return sums.join(medians(base, keys, {"median_value": "fair_market_value"}), keys)


def foreign_share(df: DataFrame) -> DataFrame:
    from terravalor.functions.text import yes_flag

    foreign = yes_flag(F.col("foreign_involvement"))
    return date_parts(df).groupBy("municipality", "transaction_year").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(foreign).alias("foreign_transactions"),
        share(foreign).alias("foreign_pct"),
    )


def price_histogram(df: DataFrame, column: str = "fair_market_value") -> DataFrame:
    """Counts per [low, high) bracket and their share; the share window sees brackets only."""
    edges = K.PRICE_BRACKETS
    bracket = F.lit(None).cast("int")
    for i in range(len(edges) - 1, -1, -1):
        top = edges[i + 1] if i + 1 < len(edges) else None
        inside = F.col(column) >= edges[i]
        if top is not None:
            inside = inside & (F.col(column) < top)
        bracket = F.when(inside, i).otherwise(bracket)
    counts = (
        df.select(bracket.alias("bracket")).where("bracket IS NOT NULL")
        .groupBy("bracket").agg(F.count(F.lit(1)).alias("count"))
    )
    lows = F.array(*[F.lit(float(e)) for e in edges])
    return counts.select(
        F.element_at(lows, F.col("bracket") + 1).alias("price_from"),
        "count",
        (F.col("count") / F.sum("count").over(Window.partitionBy()) * 100).alias("pct"),
    )


# ---- schools, admissions, short-term rentals, permits ------------------------------------


def school_scores(results: DataFrame, score_columns: list[str]) -> DataFrame:
    """Row mean of scores, mean per school, then 0–100 over all schools; 50 if flat."""
    from terravalor.functions.numbers import row_mean

    raw = (
        results.withColumn("_m", row_mean([F.col(c).cast("double") for c in score_columns]))
        .where(F.col("_m").isNotNull())
        .groupBy("school_id")
        .agg(F.avg("_m").alias("raw_score"))
    )
    bounds = raw.agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    return raw.withColumn(
        "quality_score",
        F.when(hi > lo, (F.col("raw_score") - lo) / (hi - lo) * 100).otherwise(50.0),
    )


def monthly_admissions(df: DataFrame) -> DataFrame:
    return df.groupBy(F.make_date("year", "month", F.lit(1)).alias("date")).agg(
        F.sum("admitted").alias("admitted")
    )


def admission_trends(monthly: DataFrame) -> DataFrame:
    """Trailing figures at the latest month. The window orders months, a bounded series."""
    w = Window.orderBy("date")
    last12 = F.sum("admitted").over(w.rowsBetween(-11, 0))
    series = monthly.withColumns(
        {
            "trailing_12": last12,
            "prior_12": F.sum("admitted").over(w.rowsBetween(-23, -12)),
            "mean_3": F.avg("admitted").over(w.rowsBetween(-2, 0)),
        }
    )
    latest = series.agg(
        F.sum("admitted").alias("total"),
        F.avg("admitted").alias("monthly_mean"),
        F.max("date").alias("latest_month"),
        F.max_by("admitted", "date").alias("latest"),
        F.max("admitted").alias("highest"),
        F.max_by("trailing_12", "date").alias("trailing_12"),
        F.max_by("prior_12", "date").alias("prior_12"),
        F.max_by("mean_3", "date").alias("mean_3"),
    )
    return latest.withColumn("growth_pct", change(F.col("trailing_12"), F.col("prior_12")) * 100)


def demand_indicators(monthly: DataFrame, household_size: float = 2.5) -> DataFrame:
    return monthly.agg(
        (F.avg("admitted") * 12 / household_size).alias("housing_units_per_year"),
        F.avg("admitted").alias("avg_monthly"),
    )


def projection_growth(wide: DataFrame, region: str, years: list[str]) -> DataFrame:
    """Growth and compound yearly rate over year columns, per region."""
    long = wide.unpivot([region], years, "year", "population").where("population IS NOT NULL")
    ends = long.groupBy(region).agg(
        F.min("year").cast("int").alias("first_year"),
        F.max("year").cast("int").alias("last_year"),
        F.min_by("population", "year").alias("first_value"),
        F.max_by("population", "year").alias("last_value"),
    )
    span = F.col("last_year") - F.col("first_year")
    return ends.withColumns(
        {
            "growth_pct": change(F.col("last_value"), F.col("first_value")) * 100,
            "cagr_pct": F.when(
                (span > 0) & (F.col("first_value") > 0),
                (F.pow(F.col("last_value") / F.col("first_value"), F.lit(1.0) / span) - 1) * 100,
            ),
        }
    )


def str_area_stats(listings: DataFrame) -> DataFrame:
    entire = F.col("room_type") == "Entire home/apt"
    stats = listings.groupBy("area_name").agg(
        F.count(F.lit(1)).alias("listing_count"),
        F.avg("price").alias("avg_price"),
        share(entire).alias("entire_home_pct"),
        F.avg("availability_365").alias("avg_availability"),
        F.sum("number_of_reviews").alias("total_reviews"),
    )
    return stats.join(medians(listings, ["area_name"], {"median_price": "price"}), "area_name", "left")


def permit_summary(permits: DataFrame) -> DataFrame:
    kind = F.lower(F.col("type_of_work"))
    return permits.agg(
        F.count(F.lit(1)).alias("total_permits"),
        F.count_if(kind.contains("new")).alias("new_buildings"),
        F.count_if(kind.contains("demol")).alias("demolitions"),
        F.sum("project_value").alias("total_value"),
    )


# ---- daily and regional figures ------------------------------------------------------------


def canonical_type(c: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in K.LISTING_TYPES.items() for x in kv])
    return F.coalesce(lookup[c], F.lit("other"))


def listing_class(c: Column) -> Column:
    """Detached or attached, for the report split."""
    return F.when(canonical_type(c) == K.DETACHED, "detached").otherwise("attached")


def daily_kpis(listings: DataFrame, day: str = "sold_date") -> DataFrame:
    diff = F.col("sold_price") - F.col("list_price")
    stats = listings.groupBy(day).agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.count_if(listing_class(F.col("property_type")) == "detached").alias("detached_sales"),
        F.avg("sold_price").alias("avg_price"),
        F.avg("dom").alias("avg_dom"),
        F.avg(diff).alias("avg_diff"),
        F.count_if(diff > 0).alias("over_ask"),
        F.count_if(diff < 0).alias("under_ask"),
        F.count_if(diff == 0).alias("at_ask"),
    )
    mids = exact_percentiles(listings, [day], "sold_price", {"median_price": UPPER_MEDIAN}).drop("n")
    return stats.join(mids, day)


def region_stats(listings: DataFrame, active: DataFrame, region: str = "sub_area", original: str = "original_price") -> DataFrame:
    """Sold figures per region, change against the original list price, mean list price of active listings and the sales-to-active ratio."""
    asked = F.when(F.col(original) > 0, F.col(original))
    sold = listings.groupBy(region).agg(
        F.count(F.lit(1)).alias("sold_count"),
        F.avg("sold_price").alias("avg_sold"),
        F.avg(change(F.col("sold_price"), asked) * 100).alias("avg_change_pct"),
    )
    mids = exact_percentiles(listings, [region], "sold_price", {"median_sold": UPPER_MEDIAN}).drop("n")
    live = active.groupBy(region).agg(F.count(F.lit(1)).alias("active_count"), F.avg(F.when(F.col("list_price") > 0, F.col("list_price"))).alias("avg_list"))
    return (
        sold.join(mids, region).join(live, region, "left")
        .withColumn("active_count", F.coalesce("active_count", F.lit(0)))
        .withColumn(
            "sales_to_active_pct",
            F.when(F.col("active_count") > 0, F.col("sold_count") / F.col("active_count") * 100),
        )
    )


def newly_seen_sales(listings: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Listings first seen on a day that were sold no more than some days before it, dearest first."""
    on = F.to_date(F.lit(day))
    fresh = listings.where((F.col("first_seen_date") == on) & (F.col("sold_date") >= F.date_sub(on, days)))
    return fresh.orderBy(F.col("sold_price").desc(), "mls_number")


def store_stats(listings: DataFrame) -> DataFrame:
    """Listing store figures in total, by type and by sub-area."""
    stacked = with_sets(
        listings, [("all", F.lit("all")), ("type", F.col("property_type")), ("city", F.col("sub_area"))]
    )
    return stacked.groupBy("set_name", "set_key").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("sold_price").alias("avg_price"),
        F.min("sold_price").alias("min_price"),
        F.max("sold_price").alias("max_price"),
    )


# ---- market against assessment ----------------------------------------------------------------


def market_vs_assessed(matched: DataFrame) -> DataFrame:
    """Match rate, ratios and shares over all sales in one row."""
    ratio = F.col("sale_to_assessment_ratio")
    stats = matched.agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.count(ratio).alias("matched"),
        share(ratio.isNotNull()).alias("match_rate"),
        F.avg(ratio).alias("mean_ratio"),
        F.avg(F.when(ratio.isNotNull(), F.col("sold_price"))).alias("avg_sold"),
        F.avg(F.when(ratio.isNotNull(), F.col("assessed_value"))).alias("avg_assessed"),
        share(ratio > 1).alias("pct_above"),
        share(ratio < 1).alias("pct_below"),
    )
    mid = exact_percentiles(matched, [], "sale_to_assessment_ratio", {"median_ratio": 0.5})
    return stats.withColumn("median_ratio", mid.select("median_ratio").scalar())


def ratio_by(matched: DataFrame, key: Column, name: str) -> DataFrame:
    rows = matched.where(F.col("sale_to_assessment_ratio").isNotNull()).withColumn(name, key)
    stats = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("sold_price").alias("avg_sold"),
        F.avg("assessed_value").alias("avg_assessed"),
    )
    return stats.join(medians(rows, [name], {"median_ratio": "sale_to_assessment_ratio"}), name)


def trim_outliers(df: DataFrame, keys: list[str], value: str, minimum: int = 5) -> DataFrame:
    """Drop values outside 1.5 IQR of their group; groups below ``minimum`` stay whole."""
    from terravalor.session import small_side

    q = exact_percentiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75})
    spread = F.col("_q3") - F.col("_q1")
    bounds = small_side(
        q.where(F.col("n") >= minimum).select(
            *keys, (F.col("_q1") - 1.5 * spread).alias("_low"), (F.col("_q3") + 1.5 * spread).alias("_high")
        )
    )
    joined = df.join(bounds, keys, "left")
    outside = F.coalesce((F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high")), F.lit(False))
    return joined.where(~outside).select(*df.columns)


def ratio_table(sales: DataFrame) -> DataFrame:
    """Median sale-to-assessment ratio and count per (area, type) and citywide per type."""
    valid = sales.where(
        F.col("ratio").between(0.5, 2.0)
        & F.col("neighbourhood_code").isNotNull()
        & F.col("property_type").isNotNull()
    )
    from terravalor.session import materialize

    # Read several times below: the trim's join runs once.
    kept = materialize(trim_outliers(valid.select("neighbourhood_code", "property_type", "ratio"), ["neighbourhood_code", "property_type"], "ratio"))
    stacked = kept.select(
        F.explode(F.array(F.col("neighbourhood_code"), F.lit("_all"))).alias("area"), "property_type", "ratio"
    )
    return exact_percentiles(stacked, ["area", "property_type"], "ratio", {"median_ratio": 0.5})
