"""Structure and feature queries over the enriched property table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.operators import features, registry_table, spatial, structure
from terravalor.plans.proxies import ORACLE_ONLY
from terravalor.plans.q_spatial import _AREA, box_dist, hav
from terravalor.plans.registry import query, rounded

ORACLE_ONLY["o_pt_foot"] = f"""
SELECT lat, lon, footprint_id, area FROM (
  SELECT p.lat, p.lon, b.footprint_id, {_AREA} AS area,
    {hav('p.lat', 'p.lon', '(b.lat_min + b.lat_max) / 2', '(b.lon_min + b.lon_max) / 2')} AS d
  FROM (SELECT DISTINCT latitude AS lat, longitude AS lon FROM o_universe WHERE latitude IS NOT NULL) p
  JOIN px_footprint b ON {box_dist('p.lat', 'p.lon')} <= 50) c
QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY round(area, 3) DESC, round(d, 3), footprint_id) = 1
"""
ORACLE_ONLY["o_struct"] = """
SELECT p.*, f.area AS fp, x.lot_size_sqft, CASE WHEN f.area > 0 AND p.current_improvement_value > 0 THEN p.current_improvement_value / f.area END AS xi
FROM o_properties p LEFT JOIN o_pt_foot f ON f.lat = p.latitude AND f.lon = p.longitude LEFT JOIN px_property x USING (pid)
"""
ORACLE_ONLY["o_stories"] = """
SELECT *, least(60, greatest(1, CASE WHEN property_type = 'detached' AND raw > 3.5 THEN 3.0 WHEN property_type = 'townhome' AND raw > 4.5 THEN 4.0 ELSE raw END)) AS stories
FROM (SELECT *, CASE WHEN xi < 2000 THEN 1.5 WHEN xi < 5000 THEN 1.5 + (xi - 2000) / 3000 * 1.5 WHEN xi < 10000 THEN 3 + (xi - 5000) / 5000 * 3
    WHEN xi < 20000 THEN 6 + (xi - 10000) / 10000 * 6 WHEN xi < 50000 THEN 12 + (xi - 20000) / 30000 * 8 WHEN xi IS NOT NULL THEN 35
    ELSE CASE zoning_district WHEN 'RS-1' THEN 2 WHEN 'RT-5' THEN 2.5 WHEN 'RM-3A' THEN 4 WHEN 'RM-5B' THEN 6 WHEN 'C-2' THEN 6 WHEN 'CD-1 (12)' THEN 6 ELSE 2 END END AS raw,
  CASE WHEN xi IS NOT NULL THEN 'improvement_ratio' ELSE 'zoning' END AS source FROM o_struct) r
"""


def footprint_rows(t):
    layer = spatial.as_layer(spatial.with_ring(t("px_footprint")))
    feet = spatial.match_footprints(t.locations, layer).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    lots = t("px_property").select("pid", "lot_size_sqft")
    return t.properties.join(feet, ["latitude", "longitude"], "left").join(lots, "pid", "left")


@query("p21_stories", "SELECT pid, round(stories, 6) AS estimated_stories, source AS stories_source FROM o_stories")
def p21(t):
    return rounded(structure.add_stories(footprint_rows(t)).select("pid", "estimated_stories", "stories_source"), 6)


@query(
    "p22_living_area",
    """WITH a AS (SELECT *, fp * 10.7639 AS sq FROM o_stories)
       SELECT pid, round(CASE WHEN fp > 0 THEN least(15000, greatest(200, CASE property_type
          WHEN 'townhome' THEN sq * stories * 0.85 / greatest(1, round_even(greatest(fp / 175, 1), 0))
          WHEN 'condo' THEN sq * stories * 0.85 / greatest(1, CASE WHEN current_improvement_value > 0 THEN round_even(greatest(current_improvement_value / 600000, 1), 0)
             ELSE round_even(greatest(sq * stories * 0.85 / 800, 1), 0) END)
          ELSE sq * stories * 0.9 - CASE WHEN coalesce(lot_size_sqft, 0) > 4000 THEN 600 ELSE 400 END + sq * CASE WHEN coalesce(year_built, 0) >= 1990 THEN 0.8 ELSE 0.6 END END)) END, 3)
          AS estimated_living_area_sqft,
        round(CASE WHEN fp > 0 THEN CASE property_type WHEN 'townhome' THEN 0.45 WHEN 'condo' THEN CASE WHEN current_improvement_value > 0 THEN 0.38 ELSE 0.30 END
          WHEN 'detached' THEN 0.55 + CASE WHEN source = 'improvement_ratio' THEN 0.10 ELSE 0 END ELSE 0.40 + CASE WHEN source = 'improvement_ratio' THEN 0.10 ELSE 0 END END ELSE 0 END, 4)
          AS living_area_confidence FROM a""",
)
def p22(t):
    out = structure.add_living_area(structure.add_stories(footprint_rows(t)))
    return out.select(
        "pid", F.round("estimated_living_area_sqft", 3).alias("estimated_living_area_sqft"),
        F.round("living_area_confidence", 4).alias("living_area_confidence"),
    )


@query(
    "p23_lot_ratio",
    "SELECT pid, round(fp * 10.7639 / lot_size_sqft, 7) AS footprint_to_lot_ratio FROM o_struct",
)
def p23(t):
    return rounded(structure.add_lot_ratio(footprint_rows(t)).select("pid", "footprint_to_lot_ratio"), 7)


@query(
    "p14_derived_features",
    """SELECT pid, effective_age, round(current_land_value / total_assessed_value, 7) AS land_to_total_ratio,
         round(CASE WHEN current_land_value > 0 THEN current_improvement_value / current_land_value END, 7) AS improvement_to_land_ratio,
         round(ln(total_assessed_value), 7) AS log_total_value, round(CASE WHEN current_land_value > 0 THEN ln(current_land_value) END, 7) AS log_land_value,
         round(ln(current_improvement_value + 1), 7) AS log_improvement_value,
         CASE WHEN effective_age <= 5 THEN 'New' WHEN effective_age <= 15 THEN 'Recent' WHEN effective_age <= 30 THEN 'Mature' WHEN effective_age <= 60 THEN 'Older'
              WHEN effective_age > 60 THEN 'Heritage' END AS building_age_bucket,
         round(total_assessed_value / lot_size_sqft, 7) AS value_per_lot_sqft, round(CASE WHEN fp > 0 THEN current_improvement_value / fp END, 5) AS improvement_intensity
       FROM o_struct""",
)
def p14(t):
    out = features.add_derived_features(footprint_rows(t))
    return out.select(
        "pid", "effective_age",
        *[F.round(c, 7).alias(c) for c in ("land_to_total_ratio", "improvement_to_land_ratio", "log_total_value", "log_land_value", "log_improvement_value", "value_per_lot_sqft")],
        "building_age_bucket", F.round("improvement_intensity", 5).alias("improvement_intensity"),
    )


@query(
    "p14_transit_tiers",
    f"""WITH d AS (SELECT p.lat, p.lon, min({hav('p.lat', 'p.lon', 's.lat', 's.lon')}) AS d FROM
          (SELECT DISTINCT latitude AS lat, longitude AS lon FROM o_universe WHERE latitude IS NOT NULL) p, px_stops s WHERE s.stop_name LIKE 'Station%' GROUP BY 1, 2)
        SELECT u.pid, coalesce(d <= 800 AND d <= 10000, false) AS is_tod_area, CASE WHEN d <= 200 THEN 'tier1' WHEN d <= 400 THEN 'tier2' WHEN d <= 800 THEN 'tier3' ELSE 'none' END AS tod_tier
        FROM o_universe u LEFT JOIN d ON d.lat = u.latitude AND d.lon = u.longitude""",
)
def p14b(t):
    rail = spatial.point_layer(spatial.rail_stops(t("px_stops")), "lat", "lon")
    near = spatial.nearest_distance(t.locations, rail, "dist_nearest_rail_m")
    return features.add_derived_features(spatial.attach(t.universe, near)).select("pid", "is_tod_area", "tod_tier")


@query(
    "p15_p16_p17_proxies",
    """SELECT pid, CASE WHEN regexp_matches(zoning_district, '^(RM-[456]|FM-1|DD|C-3)') AND year_built >= 2000 THEN 'concrete' ELSE 'wood_frame' END AS construction_type,
         CASE WHEN area < 600 THEN 0 WHEN area < 900 THEN 1 WHEN area < 1300 THEN 2 WHEN area < 1800 THEN 3 WHEN area < 2500 THEN 4 WHEN area IS NOT NULL THEN 5 END AS bedrooms,
         true AS bedrooms_imputed FROM (SELECT p.*, x.lot_size_sqft / 3 AS area FROM o_properties p JOIN px_property x USING (pid)) a""",
)
def p15(t):
    lots = t("px_property").select("pid", (F.col("lot_size_sqft") / 3).alias("estimated_living_area_sqft"))
    return features.add_proxies(t.properties.join(lots, "pid")).select("pid", "construction_type", "bedrooms", "bedrooms_imputed")


def _filled(feature: str, filled: str, *kinds: str) -> str:
    return f"SELECT property_type, count(*) AS rows, '{feature}' AS feature, count({filled}) AS filled FROM p WHERE property_type IN ({', '.join(repr(k) for k in kinds)}) GROUP BY 1"


_THREE = ("condo", "townhome", "detached")


@query(
    "p18_registry_counts",
    "WITH p AS (SELECT p.*, x.lot_size_sqft FROM o_properties p LEFT JOIN px_property x USING (pid)) "
    + " UNION ALL ".join([
        *[_filled(c, c, *_THREE) for c in ("effective_age", "latitude", "longitude", "year_built")], _filled("building_age_bucket", "effective_age", "condo", "townhome"),
        _filled("land_to_total_ratio", "CASE WHEN total_assessed_value > 0 THEN current_land_value END", "detached"), _filled("lot_size_sqft", "lot_size_sqft", "detached", "townhome"),
    ]),
)
def p18(t):
    """Registry features that the enriched table holds, with their filled rows per property type."""
    props = features.add_derived_features(footprint_rows(t))
    return registry_table.fill_by_type(props)


@query("p18_registry_summary", None)
def p18b(t):
    """Eligible features per phase and type of the properties at hand."""
    counts = t.properties.groupBy("property_type").agg(F.count(F.lit(1)).alias("properties"))
    return counts.join(registry_table.summary(t.spark), "property_type", "left")


@query(
    "p19_sparse_columns",
    """SELECT 'maint_fee' AS column_name, round(avg(CASE WHEN maint_fee IS NULL THEN 1.0 ELSE 0 END), 6) AS null_share FROM o_sold
       UNION ALL SELECT 'bathrooms', round(avg(CASE WHEN bathrooms IS NULL THEN 1.0 ELSE 0 END), 6) FROM o_sold
       UNION ALL SELECT 'sold_price', round(avg(CASE WHEN sold_price IS NULL THEN 1.0 ELSE 0 END), 6) FROM o_sold""",
)
def p19(t):
    rows = t.sold.select("maint_fee", "bathrooms", "sold_price")
    kept = features.drop_sparse(rows, 0.80)
    shares = kept.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in kept.columns])
    return shares.unpivot([], kept.columns, "column_name", "null_share")


@query(
    "p20_numeric_repair",
    "SELECT pid, CASE WHEN is_corner_lot THEN 1 ELSE 0 END AS is_corner_lot, TRY_CAST(rainscreen_status AS DOUBLE) AS rainscreen_status FROM px_rule_inputs",
)
def p20(t):
    return features.to_numeric(t("px_rule_inputs"), ["is_corner_lot", "rainscreen_status"]).select("pid", "is_corner_lot", "rainscreen_status")


_COMPLETE = ("year_built", "neighbourhood_code", "property_postal_code", "effective_age", "yoy_change_pct")


@query(
    "a20_completeness",
    "SELECT pid, n AS populated_features, round(n / 5.0 * 100, 4) AS completeness_pct, missing FROM (SELECT pid, "
    + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _COMPLETE) + " AS n, concat_ws(',', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _COMPLETE) + ") AS missing FROM o_universe) x",
)
def a20(t):
    rows = features.completeness(t.universe, list(_COMPLETE))
    return rows.select("pid", "populated_features", F.round("completeness_pct", 4).alias("completeness_pct"), F.array_join("missing_features", ",").alias("missing"))


@query(
    "a20_completeness_summary",
    "WITH x AS (SELECT (" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _COMPLETE) + """) / 5.0 * 100 AS p FROM o_universe)
       SELECT count(*) AS rows, round(avg(p), 4) AS mean_pct, min(p) AS min_pct, max(p) AS max_pct, count(*) FILTER (p >= 100) AS complete_rows,
       round(median(p), 4) AS median_pct FROM x""",
)
def a20b(t):
    return rounded(features.completeness_summary(features.completeness(t.universe, list(_COMPLETE))))


@query(
    "a20_column_completeness",
    """WITH c AS (SELECT count(*) AS n, count(maint_fee) AS a, count(bathrooms) AS b, count(year_built) AS c, count(sold_price) AS d, count(CASE WHEN bedrooms > 3 THEN 1 END) AS e FROM o_sold)
       SELECT 5 AS total_features, (a = n)::INT + (b = n)::INT + (c = n)::INT + (d = n)::INT + (e = n)::INT AS fully_populated_features,
         (2 * a < n)::INT + (2 * b < n)::INT + (2 * c < n)::INT + (2 * d < n)::INT + (2 * e < n)::INT AS features_over_50pct_null FROM c""",
)
def a20c(t):
    rows = t.sold.withColumn("many_bedrooms", F.when(F.col("bedrooms") > 3, 1))
    return features.column_completeness(rows, ["maint_fee", "bathrooms", "year_built", "sold_price", "many_bedrooms"])


@query(
    "s18_first_present_columns",
    "SELECT poi_id, price AS str_price, lat AS latitude FROM px_poi",
)
def s18(t):
    from terravalor.sources.feeds import resolve_columns

    return resolve_columns(t("px_poi"), {"poi_id": ("listing_id", "poi_id"), "str_price": ("nightly_price", "price"), "latitude": ("latitude", "lat")})


@query(
    "p39_points_from_columns",
    "SELECT poi_id, CASE WHEN poi_id % 11 <> 0 THEN lat END AS point_lat, CASE WHEN poi_id % 11 <> 0 THEN lon END AS point_lon FROM px_poi",
)
def p39(t):
    from terravalor.sources.feeds import with_point

    raw = t("px_poi").select("poi_id", F.when(F.col("poi_id") % 11 != 0, F.col("lat")).alias("LAT"), F.col("lon").alias("LON"))
    return with_point(raw).select("poi_id", "point.lat", "point.lon").toDF("poi_id", "point_lat", "point_lon")
