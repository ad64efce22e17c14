"""Ratio and rate queries, built on the matched sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.functions.dates import month_label
from terravalor.operators import comps, market, rates
from terravalor.plans.proxies import ORACLE_ONLY
from terravalor.plans.registry import query, rounded


@query(
    "a06_market_vs_assessed",
    """SELECT count(*) AS total_sales, count(ratio) AS matched, round(count(ratio) / count(*) * 100, 6) AS match_rate,
         round(avg(ratio), 6) AS mean_ratio, round(avg(sold_price) FILTER (ratio IS NOT NULL), 3) AS avg_sold,
         round(avg(assessed_value) FILTER (ratio IS NOT NULL), 3) AS avg_assessed,
         round(avg(CASE WHEN ratio > 1 THEN 1.0 WHEN ratio IS NOT NULL THEN 0 END) * 100, 6) AS pct_above,
         round(avg(CASE WHEN ratio < 1 THEN 1.0 WHEN ratio IS NOT NULL THEN 0 END) * 100, 6) AS pct_below,
         round(median(ratio), 6) AS median_ratio FROM o_matched""",
)
def a06(t):
    out = market.market_vs_assessed(t.matched)
    return out.select(
        "total_sales", "matched", *[F.round(c, 6).alias(c) for c in ("match_rate", "mean_ratio", "pct_above", "pct_below", "median_ratio")],
        F.round("avg_sold", 3).alias("avg_sold"), F.round("avg_assessed", 3).alias("avg_assessed"),
    )


def _ratio_out(df, key):
    return df.select(
        key, "count", F.round("avg_sold", 3).alias("avg_sold"), F.round("avg_assessed", 3).alias("avg_assessed"),
        F.round("median_ratio", 6).alias("median_ratio"),
    )


@query(
    "a07_ratio_by_sub_area",
    """SELECT sub_area, count(*) AS count, round(avg(sold_price), 3) AS avg_sold, round(avg(assessed_value), 3) AS avg_assessed,
         round(median(ratio), 6) AS median_ratio FROM o_matched WHERE ratio IS NOT NULL GROUP BY 1""",
)
def a07(t):
    return _ratio_out(market.ratio_by(t.matched, F.col("sub_area"), "sub_area"), "sub_area")


@query(
    "a07_ratio_by_month",
    """SELECT strftime(sold_date, '%Y-%m') AS sold_month, count(*) AS count, round(avg(sold_price), 3) AS avg_sold,
         round(avg(assessed_value), 3) AS avg_assessed, round(median(ratio), 6) AS median_ratio
       FROM o_matched WHERE ratio IS NOT NULL GROUP BY 1""",
)
def a07b(t):
    return _ratio_out(market.ratio_by(t.matched, month_label(F.col("sold_date")), "sold_month"), "sold_month")


ORACLE_ONLY["o_valid_ratio"] = """
SELECT mls_number, neighbourhood_code, assessed_type AS property_type, ratio FROM o_matched WHERE ratio BETWEEN 0.5 AND 2.0
"""
ORACLE_ONLY["o_trimmed"] = """
SELECT v.* FROM o_valid_ratio v JOIN (
  SELECT neighbourhood_code, property_type, count(*) AS n, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3
  FROM o_valid_ratio GROUP BY 1, 2) q USING (neighbourhood_code, property_type)
WHERE q.n < 5 OR ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
"""
ORACLE_ONLY["o_ratio_table"] = """
SELECT area, property_type, median(ratio) AS median_ratio, count(*) AS n FROM (
  SELECT unnest([neighbourhood_code, '_all']) AS area, property_type, ratio FROM o_trimmed) s GROUP BY 1, 2
"""


def ratio_rows(t, *own: str):
    """Area, type and ratio of the matched sales, behind columns of their own."""
    rows = t.matched_with(*own, "neighbourhood_code", "assessed_type", "sale_to_assessment_ratio")
    return rows.withColumnsRenamed({"assessed_type": "property_type", "sale_to_assessment_ratio": "ratio"})


@query("p29_valid_ratios", "SELECT mls_number, property_type, round(ratio, 6) AS ratio FROM o_valid_ratio")
def p29(t):
    return rounded(ratio_rows(t, "mls_number").where(F.col("ratio").between(0.5, 2.0)).select("mls_number", "property_type", "ratio"), 6)


@query("w07_trimmed_ratios", "SELECT mls_number, neighbourhood_code, property_type, round(ratio, 6) AS ratio FROM o_trimmed")
def w07(t):
    valid = ratio_rows(t, "mls_number").where(F.col("ratio").between(0.5, 2.0) & F.col("neighbourhood_code").isNotNull())
    return rounded(market.trim_outliers(valid, ["neighbourhood_code", "property_type"], "ratio"), 6)


@query("a05_ratio_table", "SELECT area, property_type, round(median_ratio, 6) AS median_ratio, n FROM o_ratio_table")
def a05(t):
    return rounded(market.ratio_table(ratio_rows(t)), 6)


@query(
    "x16_ratio_with_model",
    """SELECT p.pid, round(p.total_assessed_value * (0.70 * (CASE WHEN l.n >= 5 THEN l.median_ratio
           WHEN l.n >= 2 THEN 0.5 * l.median_ratio + 0.5 * coalesce(c.median_ratio, 1) ELSE coalesce(c.median_ratio, 1) END)
         + 0.30 * least(greatest(0.4 + (CAST(pid AS BIGINT) % 17) * 0.1, 0.6), 1.8)), 1) AS market_estimate
       FROM (SELECT *, CASE WHEN property_type = 'duplex' THEN 'detached' ELSE property_type END AS rt FROM o_properties) p
       LEFT JOIN o_ratio_table l ON l.area = p.neighbourhood_code AND l.property_type = p.rt
       LEFT JOIN o_ratio_table c ON c.area = '_all' AND c.property_type = p.rt
       WHERE l.n IS NOT NULL OR c.n IS NOT NULL""",
)
def x16m(t):
    """The same with a model's ratio taking thirty percent, after its limits."""
    model = F.lit(0.4) + (F.col("pid").cast("long") % 17) * F.lit(0.1)
    out = comps.ratio_estimate(t.properties, market.ratio_table(ratio_rows(t)), model)
    return rounded(out.select("pid", "market_estimate"), 1)


@query(
    "x16_ratio_estimate",
    """SELECT p.pid, round(p.total_assessed_value * CASE WHEN l.n >= 5 THEN l.median_ratio
           WHEN l.n >= 2 THEN 0.5 * l.median_ratio + 0.5 * coalesce(c.median_ratio, 1) ELSE coalesce(c.median_ratio, 1) END, 2) AS market_estimate,
         CASE WHEN l.n >= 5 THEN 'area' WHEN l.n >= 2 THEN 'area_blended' ELSE 'citywide' END AS ratio_source
       FROM (SELECT *, CASE WHEN property_type = 'duplex' THEN 'detached' ELSE property_type END AS rt FROM o_properties) p
       LEFT JOIN o_ratio_table l ON l.area = p.neighbourhood_code AND l.property_type = p.rt
       LEFT JOIN o_ratio_table c ON c.area = '_all' AND c.property_type = p.rt
       WHERE l.n IS NOT NULL OR c.n IS NOT NULL""",
)
def x16(t):
    out = comps.ratio_estimate(t.properties, market.ratio_table(ratio_rows(t)))
    return out.select("pid", F.round("market_estimate", 2).alias("market_estimate"), "ratio_source")


@query(
    "p24_training_overrides",
    """SELECT m.mls_number, m.matched_pid AS pid, m.bedrooms, CAST(m.floor_area AS DOUBLE) AS living_area_sqft,
         coalesce(m.year_built, p.year_built) AS year_built, round(m.maint_fee / m.floor_area, 6) AS strata_fee_per_sqft,
         round(m.sold_price / m.list_price, 6) AS list_to_sold_ratio, round(m.ratio, 6) AS ratio
       FROM o_matched m JOIN o_properties p ON p.pid = m.matched_pid""",
)
def p24(t):
    from terravalor.operators.features import training_rows

    out = training_rows(t.matched, t.properties)
    return out.select(
        "mls_number", "pid", "bedrooms", "living_area_sqft", "year_built",
        *[F.round(c, 6).alias(c) for c in ("strata_fee_per_sqft", "list_to_sold_ratio")],
        F.round("sale_to_assessment_ratio", 6).alias("ratio"),
    )


@query(
    "a27_match_audit",
    """SELECT property_type, count(*) AS total, count(ratio) AS matched, round(count(ratio) / count(*) * 100, 6) AS matched_pct
       FROM o_matched GROUP BY 1""",
)
def a27(t):
    from terravalor.functions.numbers import share

    r = F.col("sale_to_assessment_ratio")
    return rounded(
        t.matched_with("property_type", "sale_to_assessment_ratio").groupBy("property_type").agg(
            F.count(F.lit(1)).alias("total"), F.count(r).alias("matched"), share(r.isNotNull()).alias("matched_pct")
        ), 6,
    )


@query(
    "a27_fill_audit",
    """SELECT 'matched_pid' AS column_name, count(*) FILTER (matched_pid IS NOT NULL) AS filled, count(*) AS total FROM o_matched
       UNION ALL SELECT 'maint_fee', count(maint_fee), count(*) FROM o_matched UNION ALL SELECT 'bathrooms', count(bathrooms), count(*) FROM o_matched""",
)
def a27b(t):
    from terravalor.operators.features import fill_audit

    audited = ["matched_pid", "maint_fee", "bathrooms"]
    return fill_audit(t.matched_with(*audited), audited)


@query("j09_wide_rates", "SELECT date, policy_rate, mortgage_5yr, mortgage_3yr FROM px_rates")
def j09(t):
    return rates.wide_rates(t("px_rate_series"))


@query(
    "j10_rates_at_assessment",
    """SELECT CAST(year(date) + 1 AS INT) AS tax_assessment_year, arg_max(value, date) FILTER (series = 'policy_rate') AS policy_rate_at_assessment,
         arg_max(value, date) FILTER (series = 'mortgage_5yr') AS mortgage_5yr_at_assessment,
         arg_max(value, date) FILTER (series = 'mortgage_3yr') AS mortgage_3yr_at_assessment
       FROM px_rate_series WHERE date BETWEEN make_date(year(date), 7, 1) - 30 AND make_date(year(date), 7, 1) + 7 GROUP BY 1""",
)
def j10(t):
    return rates.rates_at_assessment(t("px_rate_series"))


@query(
    "j11_current_rates",
    """SELECT series, arg_max(value, date) AS value, max(date) AS date FROM px_rate_series
       WHERE date BETWEEN DATE '2001-06-30' - 30 AND DATE '2001-06-30' GROUP BY 1""",
)
def j11(t):
    return rates.current_rates(t("px_rate_series"), "2001-06-30")


@query(
    "x17_mortgage_capacity",
    """WITH x AS (SELECT r.date, a.area_id, greatest(r.mortgage_5yr + 2, 5.25) AS s, a.median_income / 12 * 0.39 - 5000.0 / 12 - 100 AS av
         FROM px_rates r, px_area a WHERE r.mortgage_5yr IS NOT NULL)
       SELECT date, area_id, s AS stress_rate, round(CASE WHEN av <= 0 THEN 0 ELSE av * (1 - pow(1 + s / 1200, -300)) / (s / 1200) END, 2) AS max_mortgage FROM x""",
)
def x17(t):
    out = rates.mortgage_capacity(t("px_rates"), t("px_area"))
    return out.withColumn("max_mortgage", F.round("max_mortgage", 2))
