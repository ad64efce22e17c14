"""Queries of the property universe: typing, classification, serving fixes, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.operators import market, universe
from terravalor.plans.registry import query, rounded
from terravalor.session import by_keys, landing_path


@query(
    "p02_clean_pid",
    "SELECT PID AS raw_pid, lpad(regexp_replace(PID, '[^0-9]', '', 'g'), 9, '0') AS pid FROM px_tax_roll",
)
def p02(t):
    from terravalor.functions.text import clean_pid

    return t("px_tax_roll").select(F.col("PID").alias("raw_pid"), clean_pid(F.col("PID")).alias("pid"))


@query(
    "p01_p03_p04_typed_roll",
    """SELECT pid, land_coordinate AS land_coordinate, from_civic_number, to_civic_number, street_name, property_postal_code,
       neighbourhood_code, zoning_district, legal_type, current_land_value, current_improvement_value,
       previous_land_value, previous_improvement_value, tax_assessment_year, year_built FROM o_typed""",
)
def p01(t):
    return universe.clean_types(universe.lower_names(t("px_tax_roll")))


@query("w01_latest_per_pid", "SELECT pid, tax_assessment_year, current_land_value FROM o_latest")
def w01(t):
    typed = universe.clean_types(universe.lower_names(t("px_tax_roll")))
    return universe.latest_per_pid(typed).select("pid", "tax_assessment_year", "current_land_value")


@query("p05_property_type", "SELECT pid, zoning_district, legal_type, property_type FROM o_classified")
def p05(t):
    typed = universe.latest_per_pid(universe.clean_types(universe.lower_names(t("px_tax_roll"))))
    return universe.add_type(typed).select("pid", "zoning_district", "legal_type", "property_type")


@query(
    "p06_p07_p08_derived_fields",
    """SELECT pid, total_assessed_value, round(land_ratio, 6) AS land_ratio,
       round(yoy_change_pct, 6) AS yoy_change_pct, civic_number, full_address, effective_age FROM o_derived""",
)
def p06(t):
    typed = universe.latest_per_pid(universe.clean_types(universe.lower_names(t("px_tax_roll"))))
    out = universe.add_derived(universe.add_type(typed)).select(
        "pid", "total_assessed_value", "land_ratio", "yoy_change_pct", "civic_number", "full_address", "effective_age"
    )
    return rounded(out, 6)


@query(
    "p09_j03_universe",
    """SELECT pid, property_type, neighbourhood_code, total_assessed_value, latitude, longitude FROM o_universe""",
)
def p09(t):
    return t.universe.select(
        "pid", "property_type", "neighbourhood_code", "total_assessed_value", "latitude", "longitude"
    )


@query("p25_w05_served_types", "SELECT pid, property_type FROM o_properties")
def p25(t):
    return t.properties.select("pid", "property_type")


@query(
    "w06_building_pattern",
    """WITH u AS (
         SELECT CAST(coalesce(to_civic_number, 0) AS BIGINT) AS b, upper(trim(coalesce(street_name, ''))) AS s,
           CASE WHEN civic_number > 0 AND civic_number <> CAST(coalesce(to_civic_number, 0) AS BIGINT)
                THEN civic_number END AS unit, property_type FROM o_universe),
       g AS (SELECT b, s, count(*) AS units, count(unit) AS numbered_units, bool_or(unit = 1) AS h1,
               bool_or(unit = 2) AS h2, bool_or(property_type IN ('condo', 'townhome')) AS c
             FROM u WHERE b > 0 GROUP BY b, s)
       SELECT b AS building_number, s AS street_name, units, numbered_units,
         CASE WHEN NOT c AND numbered_units = 2 AND coalesce(h1, false) AND coalesce(h2, false) THEN 'duplex'
              WHEN units > 2 OR (units > 1 AND c) THEN 'strata' ELSE 'single' END AS pattern FROM g""",
)
def w06(t):
    return universe.building_pattern(t.universe)


@query(
    "j15_year_from_neighbours",
    """WITH known AS (SELECT civic_number c, street_name s, max(year_built) y FROM o_properties
         WHERE year_built IS NOT NULL AND civic_number > 0 AND street_name IS NOT NULL GROUP BY 1, 2),
       offs AS (SELECT * FROM (VALUES (0,0),(1,-1),(2,1),(3,-2),(4,2),(5,-3),(6,3),(7,-4),(8,4)) v(rank, off)),
       tries AS (SELECT p.pid, k.y, o.rank FROM o_properties p, offs o JOIN known k
         ON k.c = p.civic_number + o.off AND k.s = p.street_name
         WHERE p.year_built IS NULL AND p.property_type <> 'duplex' AND p.civic_number > 0),
       best AS (SELECT pid, arg_min(y, rank) AS y FROM tries GROUP BY pid)
       SELECT p.pid, coalesce(p.year_built, b.y) AS year_built,
         CASE WHEN p.year_built IS NOT NULL THEN 'roll' WHEN b.y IS NOT NULL THEN 'neighbour' END AS year_built_source
       FROM o_properties p LEFT JOIN best b USING (pid)""",
)
def j15(t):
    return universe.fill_year_from_neighbours(t.properties).select("pid", "year_built", "year_built_source")


@query(
    "w09_panel_change",
    """SELECT pid, tax_assessment_year, round(total_assessed_value, 2) AS total_assessed_value,
         round(CASE WHEN prev > 0 THEN (total_assessed_value - prev) / prev END, 6) AS yoy_change_pct
       FROM (SELECT *, lag(total_assessed_value) OVER (PARTITION BY pid ORDER BY tax_assessment_year) AS prev
             FROM (SELECT *, current_land_value + current_improvement_value AS total_assessed_value FROM px_panel) a) b""",
)
def w09(t):
    out = universe.add_panel_change(t("px_panel")).select(
        "pid", "tax_assessment_year", F.round("total_assessed_value", 2).alias("total_assessed_value"),
        F.round("yoy_change_pct", 6).alias("yoy_change_pct"),
    )
    return out


@query(
    "u01_t01_panel_sorted",
    "SELECT pid, tax_assessment_year, current_land_value FROM px_panel",
)
def u01(t):
    """Each year of the data written as a file of its own, then stacked by one scan."""
    folder = landing_path(t.spark, "years")
    rows = t("px_panel").select("pid", "tax_assessment_year", "current_land_value")
    rows.withColumn("year", F.col("tax_assessment_year")).write.partitionBy("year").parquet(folder)
    return t.spark.read.parquet(folder).drop("year").orderBy("pid", "tax_assessment_year")


@query(
    "u05_train_holdout",
    """SELECT CASE WHEN tax_assessment_year < 2026 THEN 'train' ELSE 'test' END AS part, count(*) AS n
       FROM px_panel GROUP BY 1""",
)
def u05(t):
    panel = t("px_panel")
    train = panel.where("tax_assessment_year < 2026").withColumn("part", F.lit("train"))
    test = panel.where("tax_assessment_year = 2026").withColumn("part", F.lit("test"))
    return train.unionByName(test).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a01_t03_universe_stats",
    """WITH s AS (
        SELECT 'all' AS set_name, 'all' AS set_key, total_assessed_value v, land_ratio r FROM o_universe
        UNION ALL SELECT 'type', property_type, total_assessed_value, land_ratio FROM o_universe
        UNION ALL SELECT 'area', neighbourhood_code, total_assessed_value, land_ratio FROM o_universe)
       SELECT set_name, set_key, count(*) AS count, round(avg(v), 2) AS mean_total, round(median(v), 2) AS median_total,
         round(median(r), 6) AS median_land_ratio FROM s GROUP BY 1, 2
       UNION ALL SELECT * FROM (SELECT 'zone', zoning_district, count(*) AS c, NULL, NULL, NULL FROM o_universe
         WHERE zoning_district IS NOT NULL GROUP BY 2 ORDER BY c DESC, zoning_district LIMIT 30)""",
)
def a01(t):
    return market.universe_stats(t.universe).select(
        "set_name", "set_key", "count", F.round("mean_total", 2).alias("mean_total"),
        F.round("median_total", 2).alias("median_total"), F.round("median_land_ratio", 6).alias("median_land_ratio"),
    )


@query(
    "a02_segment_stats",
    """WITH s AS (SELECT unnest([neighbourhood_code || '__' || property_type, 'citywide__' || property_type,
           'citywide__all']) AS segment, total_assessed_value v, year_built FROM o_properties WHERE total_assessed_value > 0)
       SELECT segment, count(*) AS count, round(avg(v), 2) AS mean_value, round(stddev_samp(v), 2) AS std_value,
         min(year_built) AS min_year, max(year_built) AS max_year, round(median(v), 2) AS median_value,
         count(*) >= 200 AS qualifies FROM s GROUP BY 1""",
)
def a02(t):
    return rounded(market.segment_stats(t.properties), 2)


@query(
    "a03_market_summary",
    """SELECT neighbourhood_code, property_type, count(*) AS count, median(total_assessed_value) AS median_value,
         round(CASE WHEN median(prev_total) > 0 THEN (median(total_assessed_value) - median(prev_total))
           / median(prev_total) * 100 END, 4) AS yoy_pct
       FROM o_properties GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def a03(t):
    return rounded(market.market_summary(t.properties))


@query(
    "q08_area_market",
    """WITH m AS (SELECT neighbourhood_code, property_type, count(*) AS c, median(total_assessed_value) AS v
         FROM o_properties GROUP BY 1, 2 HAVING count(*) >= 10)
       SELECT neighbourhood_code, string_agg(property_type || ':' || c, ',' ORDER BY property_type) AS counts,
         count(*) AS types, sum(c) AS properties, max(v) AS top_median FROM m GROUP BY 1""",
)
def q08(t):
    maps = market.summary_maps(market.market_summary(t.properties))
    counts = F.map_entries("property_counts")
    return maps.select(
        "neighbourhood_code",
        F.array_join(
            F.transform(counts, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","
        ).alias("counts"),
        F.size(counts).cast("long").alias("types"),
        F.aggregate(F.map_values("property_counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("properties"),
        F.array_max(F.map_values("median_values")).alias("top_median"),
    )


@query(
    "a04_market_trends",
    """WITH s AS (SELECT neighbourhood_code, tax_assessment_year,
           unnest([CASE legal_type WHEN 'STRATA' THEN 'condo' WHEN 'LAND' THEN 'detached' ELSE 'other' END, 'all']) AS property_type,
           current_land_value + current_improvement_value AS v FROM px_panel),
       g AS (SELECT neighbourhood_code, tax_assessment_year, property_type, median(v) AS median_value, count(*) AS count
             FROM s WHERE v > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 20)
       SELECT neighbourhood_code, tax_assessment_year, property_type, round(median_value, 2) AS median_value, count FROM g
       QUALIFY count(*) OVER (PARTITION BY neighbourhood_code, property_type) >= 2""",
)
def a04(t):
    return rounded(market.market_trends(t("px_panel")), 2)


@query(
    "a04_dominant_year_trends",
    """SELECT neighbourhood_code, tax_assessment_year, median(total_assessed_value) AS median_value, count(*) AS count
       FROM o_universe WHERE tax_assessment_year = (SELECT tax_assessment_year FROM o_universe GROUP BY 1
         ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1, 2 HAVING count(*) >= 20""",
)
def a04b(t):
    return market.dominant_year_trends(t.universe)


@query(
    "a22_modal_year",
    """SELECT tax_assessment_year, count(*) AS n FROM o_universe GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""",
)
def a22(t):
    return market.modal_value(t.universe, "tax_assessment_year")


_TRENDS = """WITH s AS (SELECT neighbourhood_code, tax_assessment_year,
           unnest([CASE legal_type WHEN 'STRATA' THEN 'condo' WHEN 'LAND' THEN 'detached' ELSE 'other' END, 'all']) AS property_type,
           current_land_value + current_improvement_value AS v FROM px_panel),
       g AS (SELECT neighbourhood_code, tax_assessment_year, property_type, median(v) AS median_value, count(*) AS count
             FROM s WHERE v > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 20),
       c AS (SELECT *, (median_value - lag(median_value) OVER w) / lag(median_value) OVER w * 100 AS change_pct FROM g
             WINDOW w AS (PARTITION BY neighbourhood_code, property_type ORDER BY tax_assessment_year))
"""


@query(
    "w10_year_pair_change",
    _TRENDS + """SELECT neighbourhood_code, property_type, tax_assessment_year, round(change_pct, 4) AS change_pct
       FROM c WHERE change_pct IS NOT NULL""",
)
def w10(t):
    out = market.year_pair_change(market.market_trends(t("px_panel")))
    return rounded(out.select("neighbourhood_code", "property_type", "tax_assessment_year", "change_pct"))


@query(
    "w10_t02_movers",
    _TRENDS + """SELECT * FROM (SELECT neighbourhood_code, round(change_pct, 4) AS change_pct, 'gainer' AS direction FROM c
         WHERE property_type = 'all' AND tax_assessment_year = 2026 AND change_pct > 0
         ORDER BY c.change_pct DESC, neighbourhood_code LIMIT 8)
       UNION ALL SELECT * FROM (SELECT neighbourhood_code, round(change_pct, 4) AS change_pct, 'decliner' AS direction FROM c
         WHERE property_type = 'all' AND tax_assessment_year = 2026 AND change_pct < 0
         ORDER BY c.change_pct, neighbourhood_code LIMIT 8)""",
)
def movers(t):
    changes = market.year_pair_change(market.market_trends(t("px_panel")))
    return rounded(market.movers(changes, 2026).select("neighbourhood_code", "change_pct", "direction"))


_SUMMARY = """WITH m AS (SELECT neighbourhood_code, property_type, count(*) AS c, median(total_assessed_value) AS v,
           (median(total_assessed_value) - median(prev_total)) / median(prev_total) * 100 AS y
         FROM o_properties GROUP BY 1, 2 HAVING count(*) >= 10),
       a AS (SELECT neighbourhood_code, sum(c) AS c, avg(v) AS m, avg(y) AS y FROM m GROUP BY 1)
"""


@query(
    "a26_dashboard_rollup",
    _SUMMARY + """SELECT sum(c) AS total_properties, round(avg(m), 2) AS avg_median_value,
       round(avg(y), 4) AS avg_yoy_pct, count(*) AS areas FROM a""",
)
def a26(t):
    out = market.dashboard_rollup(market.market_summary(t.properties))
    return out.select(
        "total_properties", F.round("avg_median_value", 2).alias("avg_median_value"),
        F.round("avg_yoy_pct", 4).alias("avg_yoy_pct"), "areas",
    )


@query(
    "t09_sorted_market",
    _SUMMARY + """SELECT neighbourhood_code, c AS count, round(m, 2) AS median_value, round(y, 4) AS yoy_pct FROM a""",
)
def t09(t):
    out = market.sorted_market(market.market_summary(t.properties), "yoy")
    return out.select(
        "neighbourhood_code", "count", F.round("median_value", 2).alias("median_value"),
        F.round("yoy_pct", 4).alias("yoy_pct"),
    )


@query(
    "j12_p37_trend_source",
    """SELECT r.pid, r.tax_assessment_year, u.neighbourhood_code,
         CASE r.legal_type WHEN 'STRATA' THEN 'condo' WHEN 'LAND' THEN 'detached' ELSE 'other' END AS property_type
       FROM px_panel r JOIN o_universe u USING (pid)""",
)
def j12(t):
    codes = by_keys(t.universe.select("pid", "neighbourhood_code"))  # a panel has a row for every year of a property
    return t("px_panel").select("pid", "tax_assessment_year", "legal_type").join(codes, "pid").select(
        "pid", "tax_assessment_year", "neighbourhood_code", market.assessment_class(F.col("legal_type")).alias("property_type")
    )
