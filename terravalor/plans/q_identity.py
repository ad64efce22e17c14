"""Queries that establish identity: addresses, matches, assessment view, transit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.operators import match, universe
from terravalor.plans.proxies import ORACLE_ONLY, PROXIES
from terravalor.plans.registry import query

PROXIES["px_request_address"] = """
SELECT pid, CAST(to_civic_number AS STRING) || ' ' ||
         CASE WHEN pkey % 2 = 0 THEN initcap_word || ' Street' ELSE initcap_word || ' Avenue West' END ||
         CASE pkey % 3 WHEN 0 THEN ' Unit 7' WHEN 1 THEN ' #12' ELSE '' END || ', Vancouver, BC, Canada' AS request_text,
       to_civic_number AS civic, street_name AS street,
       CASE pkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 12 END AS unit
FROM (SELECT *, upper(substr(street_name, 1, 1)) || lower(substr(split_part(street_name, ' ', 1), 2)) AS initcap_word
      FROM px_property) p
"""

ORACLE_ONLY["o_addr"] = """
SELECT DISTINCT address,
  regexp_matches(address, '^\\d+ \\d+ .+$') AS is_strata,
  CASE WHEN regexp_matches(address, '^\\d+ \\d+ .+$') THEN CAST(regexp_extract(address, '^(\\d+) ', 1) AS BIGINT) END AS unit,
  CASE WHEN regexp_matches(address, '^\\d+ \\d+ .+$') THEN CAST(regexp_extract(address, '^\\d+ (\\d+) ', 1) AS BIGINT)
       ELSE CAST(regexp_extract(address, '^(\\d+) ', 1) AS BIGINT) END AS building,
  regexp_replace(regexp_replace(regexp_extract(address, '^(?:\\d+ )+(.+)$', 1), ' STREET$', ' ST'), ' AVENUE W$', ' AVE W') AS street
FROM o_sold
"""
ORACLE_ONLY["o_props_ranked"] = """
SELECT *, CASE legal_type WHEN 'STRATA' THEN 0 WHEN 'LAND' THEN 2 ELSE 1 END AS lrank FROM o_properties
"""
ORACLE_ONLY["o_hit"] = """
SELECT address, level, pid FROM (
  SELECT a.address, 1 AS level, p.pid, p.lrank FROM o_addr a JOIN o_props_ranked p
    ON a.is_strata AND p.legal_type = 'STRATA' AND p.civic_number = a.unit AND p.to_civic_number = a.building AND p.street_name = a.street
  UNION ALL
  SELECT a.address, 2, p.pid, p.lrank FROM o_addr a JOIN o_props_ranked p
    ON a.is_strata AND p.legal_type = 'STRATA' AND p.civic_number = a.unit AND p.street_name = a.street
  UNION ALL
  SELECT a.address, 3, p.pid, p.lrank FROM o_addr a JOIN o_props_ranked p
    ON p.full_address = CAST(a.building AS STRING) || ' ' || a.street AND NOT (a.is_strata AND p.legal_type = 'LAND')
) h QUALIFY row_number() OVER (PARTITION BY address ORDER BY level, lrank, pid) = 1
"""
ORACLE_ONLY["o_matched"] = """
SELECT s.*, h.level AS match_level, p.pid AS matched_pid, p.property_type AS assessed_type, p.neighbourhood_code,
  p.total_assessed_value AS assessed_value, p.current_land_value AS land_value, p.latitude, p.longitude, p.zoning_district,
  CASE WHEN p.total_assessed_value > 0 THEN s.sold_price / p.total_assessed_value END AS ratio
FROM o_sold s LEFT JOIN o_hit h ON s.address = h.address LEFT JOIN o_properties p ON p.pid = h.pid
"""


@query(
    "x01_listing_address",
    "SELECT address, is_strata, unit, building FROM o_addr",
)
def x01(t):
    parsed = t.sold.select("address").distinct().withColumn("p", match.parse_listing_address(F.col("address")))
    return parsed.select("address", "p.is_strata", "p.unit", "p.building")


@query(
    "x01_street_resolution",
    """SELECT DISTINCT raw_street, CASE WHEN raw_street LIKE 'X%' THEN raw_street ELSE street END AS street FROM (
         SELECT regexp_extract(address, '^(?:\\d+ )+(.+)$', 1) AS raw_street, street FROM o_addr) a""",
)
def x01b(t):
    raw = t.sold.select("address").distinct().select(
        match.parse_listing_address(F.col("address"))["street"].alias("raw_street")
    )
    return match.resolve_streets(raw, t.properties.select(F.col("street_name").alias("street")))


@query(
    "x02_street_aliases",
    """WITH s AS (SELECT DISTINCT street_name AS street FROM o_properties WHERE street_name IS NOT NULL),
       w AS (SELECT street, split_part(street, ' ', 1) AS b, street LIKE '% ST' AS st FROM s)
       SELECT street AS alias, street FROM w
       UNION SELECT b || CASE WHEN st THEN ' STREET' ELSE ' AVENUE W' END, street FROM w
       UNION SELECT 'W ' || b || ' AVE', street FROM w WHERE NOT st
       UNION SELECT 'W ' || b || ' AVENUE', street FROM w WHERE NOT st""",
)
def x02(t):
    return match.street_aliases(t.properties.select(F.col("street_name").alias("street")))


@query(
    "x03_sale_address_key",
    "SELECT address, building AS civic, street FROM o_addr",
)
def x03(t):
    keyed = t.sold.select("address").distinct().withColumn("k", match.sale_address_key(F.col("address")))
    return keyed.select("address", "k.civic", "k.street")


@query("x04_request_address", "SELECT pid, civic, street, unit FROM px_request_address")
def x04(t):
    return t("px_request_address").select("pid", match.parse_request_address(F.col("request_text")).alias("p")).select(
        "pid", "p.civic", "p.street", "p.unit"
    )


@query(
    "x05_permit_address",
    """SELECT permit_id, CAST(regexp_extract(address, '^(\\d+) ', 1) AS BIGINT) AS civic,
       replace(replace(upper(regexp_extract(address, '^\\d+ ([^,]+),', 1)), ' STREET', ' ST'), ' AVENUE', ' AVE') AS street FROM px_permits""",
)
def x05(t):
    return t("px_permits").select("permit_id", match.permit_key(F.col("address")).alias("k")).select(
        "permit_id", "k.civic", "k.street"
    )


@query(
    "x06_date_layouts",
    "SELECT mls_number, sold_date FROM o_sold",
)
def x06(t):
    from terravalor.functions.dates import parse_date

    layouts = F.array(
        F.date_format("sold_date", "MM/dd/yyyy"), F.date_format("sold_date", "yyyy-MM-dd"),
        F.date_format("sold_date", "MM/dd/yy"), F.date_format("sold_date", "MMMM d, yyyy"),
    )
    # Two-digit years read as 2000–2099, so that layout is used on those dates only.
    pick = F.when((F.col("dom") % 4 == 2) & (F.year("sold_date") < 2000), 1).otherwise(F.col("dom") % 4 + 1)
    return t.sold.select("mls_number", parse_date(F.element_at(layouts, pick)).alias("sold_date"))


@query(
    "j04_w03_match_sales",
    "SELECT mls_number, match_level, matched_pid, assessed_value, round(ratio, 6) AS ratio FROM o_matched",
)
def j04(t):
    return t.matched.select(
        "mls_number", "match_level", "matched_pid", "assessed_value",
        F.round("sale_to_assessment_ratio", 6).alias("ratio"),
    )


@query(
    "k07_matched_export",
    """SELECT mls_number, sold_price, assessed_value, sold_date FROM o_matched WHERE ratio IS NOT NULL""",
)
def k07(t):
    shown = ["mls_number", "sold_price", "assessed_value", "sold_date"]
    rows = t.matched_with(*shown, "sale_to_assessment_ratio").where(F.col("sale_to_assessment_ratio").isNotNull())
    return rows.select(*shown).orderBy(F.col("sold_date").desc_nulls_last())


ORACLE_ONLY["o_geo"] = """
SELECT address, arg_min(pid, CAST(level AS BIGINT) * 10000000000 + CAST(pid AS BIGINT)) AS pid FROM (
  SELECT a.address, 1 AS level, p.pid FROM o_addr a JOIN o_properties p
    ON p.street_name = a.street AND p.civic_number = a.building AND p.civic_number > 0 AND p.latitude IS NOT NULL
  UNION ALL SELECT a.address, 1, p.pid FROM o_addr a JOIN o_properties p
    ON p.street_name = a.street AND p.to_civic_number = a.building AND p.to_civic_number > 0 AND p.latitude IS NOT NULL) g
GROUP BY address
"""


@query(
    "j05_geocode_sales",
    """SELECT s.mls_number, p.latitude, p.longitude, p.total_assessed_value AS assessed_value, p.neighbourhood_code
       FROM o_sold s LEFT JOIN o_geo g USING (address) LEFT JOIN o_properties p ON p.pid = g.pid""",
)
def j05(t):
    return match.geocode_sales(t.sold, t.properties).select(
        "mls_number", "latitude", "longitude", "assessed_value", "neighbourhood_code"
    )


@query(
    "j01_j02_assessment_view",
    """SELECT d.folio_id, d.jurisdiction, d.actual_use_code, a.street_number, a.street_name, a.postal_code, l.pid, l.lot,
         v.land_value, v.improvement_value, round(v.land_value + v.improvement_value, 2) AS total_value,
         s.sale_price AS last_sale_price, s.sale_date AS last_sale_date
       FROM px_folio_descriptions d
       LEFT JOIN px_folio_addresses a ON a.folio_id = d.folio_id AND a.primary_flag = 'Y'
       LEFT JOIN px_folio_legal l ON l.folio_id = d.folio_id LEFT JOIN px_folio_values v ON v.folio_id = d.folio_id
       LEFT JOIN (SELECT * FROM px_folio_sales QUALIFY row_number() OVER (PARTITION BY folio_id ORDER BY sale_date DESC, sale_id DESC) = 1) s
         ON s.folio_id = d.folio_id""",
)
def j01(t):
    out = match.assessment_view(
        t("px_folio_descriptions"), t("px_folio_addresses"), t("px_folio_legal"), t("px_folio_values"), t("px_folio_sales")
    )
    return out.withColumn("total_value", F.round("total_value", 2))


@query(
    "j02_latest_sale",
    """SELECT folio_id, sale_price, sale_date FROM px_folio_sales
       QUALIFY row_number() OVER (PARTITION BY folio_id ORDER BY sale_date DESC, sale_id DESC) = 1""",
)
def j02(t):
    from terravalor.operators.ingest import latest_by_key

    return latest_by_key(t("px_folio_sales"), ["folio_id"], [F.col("sale_date").desc(), F.col("sale_id").desc()]).select(
        "folio_id", "sale_price", "sale_date"
    )


_SR = """SELECT DISTINCT st.stop_id, r.route_id, r.route_short_name, r.route_type FROM px_stop_times st
  JOIN px_trips tr ON st.trip_id = tr.trip_id JOIN px_routes r ON tr.route_id = r.route_id"""


def _stop_routes(t):
    return match.stop_routes(t("px_stop_times"), t("px_trips"), t("px_routes"))


@query("j06_u07_stop_routes", _SR)
def j06(t):
    return _stop_routes(t)


@query(
    "j07_stops_with_routes",
    f"""WITH sr AS ({_SR}), g AS (SELECT stop_id, min(route_type) AS route_type, min(route_id) AS route_id FROM sr GROUP BY 1)
       SELECT s.stop_id, s.stop_name, g.route_type, g.route_id, 'R' || g.route_id AS route_short_name FROM px_stops s LEFT JOIN g USING (stop_id)""",
)
def j07(t):
    return match.stops_with_routes(t("px_stops"), _stop_routes(t)).select(
        "stop_id", "stop_name", "route_type", "route_id", "route_short_name"
    )


@query(
    "j08_rail_stations",
    f"""WITH sr AS ({_SR}) SELECT stop_id, stop_name FROM px_stops WHERE stop_id IN (SELECT stop_id FROM sr WHERE route_type = 1)""",
)
def j08(t):
    return match.rail_stations(t("px_stops"), _stop_routes(t)).select("stop_id", "stop_name")


@query(
    "j14_year_from_permits",
    """WITH k AS (SELECT CAST(regexp_extract(address, '^(\\d+) ', 1) AS BIGINT) AS civic,
         replace(replace(upper(regexp_extract(address, '^\\d+ ([^,]+),', 1)), ' STREET', ' ST'), ' AVENUE', ' AVE') AS street,
         CAST(year(issue_date) AS INT) AS y FROM px_permits),
       g AS (SELECT civic, street, max(y) AS permit_year FROM k GROUP BY 1, 2)
       SELECT pid, coalesce(year_built, permit_year) AS year_built, permit_year FROM o_properties p
       LEFT JOIN g ON g.civic = CAST(p.to_civic_number AS BIGINT) AND g.street = p.street_name""",
)
def j14(t):
    return universe.fill_year_from_permits(t.properties, t("px_permits")).select("pid", "year_built", "permit_year")


@query(
    "j17_u03_sub_areas_near",
    """WITH own AS (SELECT DISTINCT neighbourhood_code AS n, sub_area AS s FROM o_matched WHERE neighbourhood_code IS NOT NULL),
       near AS (SELECT DISTINCT CAST(CAST(n AS INT) + d AS STRING) AS n, s FROM own, (SELECT unnest([-2, -1, 0, 1, 2]) AS d) x WHERE CAST(n AS INT) + d >= 1)
       SELECT near.n AS neighbourhood_code, near.s AS sub_area, own.n IS NOT NULL AS own FROM near LEFT JOIN own ON own.n = near.n AND own.s = near.s""",
)
def j17(t):
    return match.area_sub_areas(t.matched)


@query(
    "x18_display_address",
    """SELECT pid, CASE WHEN to_civic_number > 0 AND civic_number > 0 AND civic_number <> to_civic_number AND civic_number < 100
         THEN CAST(CAST(to_civic_number AS BIGINT) AS STRING) || ' ' || street_name || ' (Unit ' || CAST(civic_number AS STRING) || ')'
         WHEN civic_number > 0 THEN CAST(civic_number AS STRING) || ' ' || street_name ELSE street_name END AS display_address FROM o_universe""",
)
def x18(t):
    return t.universe.select("pid", match.display_address(t.universe).alias("display_address"))
