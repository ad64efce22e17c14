"""Look-up queries over request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.operators import comps, market, match, rules, serve
from terravalor.plans.proxies import ORACLE_ONLY, PROXIES
from terravalor.plans.q_ratios import ratio_rows
from terravalor.plans.registry import query, rounded

# One request per customer; each names its subject in one of four ways.
PROXIES["px_resolve"] = """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 4 = 0 THEN lpad(CAST(c_custkey AS STRING), 9, '0') END AS pid,
       CASE WHEN c_custkey % 4 = 1 THEN CAST(100 + c_custkey % 400 AS STRING) || ' Small Street, Vancouver, BC' END AS address,
       CASE WHEN c_custkey % 4 = 2 THEN 49.20E0 + (c_custkey * 53 % 1000) * 0.0001E0 + 0.00003E0 END AS latitude,
       CASE WHEN c_custkey % 4 = 2 THEN -123.22E0 + (c_custkey * 71 % 2000) * 0.0001E0 + 0.00003E0 END AS longitude,
       CASE c_custkey % 3 WHEN 0 THEN 'condo' WHEN 1 THEN 'detached' ELSE 'townhome' END AS property_type
FROM customer
"""
PROXIES["px_search"] = """
SELECT CAST(100 + c_custkey % 450 AS STRING) || ' ' || CASE c_custkey % 8 WHEN 0 THEN 'blu' WHEN 1 THEN 'NEW' WHEN 2 THEN 'Cold st'
         WHEN 3 THEN 're ave' WHEN 4 THEN 'lar' WHEN 5 THEN 'ho' WHEN 6 THEN 'old' ELSE 'smal' END AS query,
       lpad(CAST(c_custkey % 1000 AS STRING), 4, '0') AS pid_query
FROM customer
"""


@query("q01_j25_property_detail", "SELECT r.request_id, p.pid, p.property_type, p.total_assessed_value, p.full_address FROM px_request r JOIN o_properties p USING (pid)")
def q01(t):
    out = serve.property_detail(t("px_request").select("request_id", "pid"), t.properties)
    return out.select("request_id", "pid", "property_type", "total_assessed_value", "full_address")


@query(
    "q02_search_pid",
    """WITH q AS (SELECT DISTINCT pid_query AS query FROM px_search)
       SELECT query, pid, rank FROM (SELECT query, pid, row_number() OVER (PARTITION BY query ORDER BY pid) AS rank
         FROM q JOIN o_properties p ON contains(p.pid, q.query)) r WHERE rank <= 10""",
)
def q02(t):
    return serve.search_pid(t("px_search").select(F.col("pid_query").alias("query")), t.pid_index)


@query(
    "q02_fragments_of_all_lengths",
    """WITH q AS (SELECT DISTINCT substr(pid, CAST(1 + CAST(pid AS BIGINT) % 5 AS INT), CAST(1 + CAST(pid AS BIGINT) % 8 AS INT)) AS query FROM o_properties)
       SELECT query, pid, rank FROM (SELECT query, pid, row_number() OVER (PARTITION BY query ORDER BY pid) AS rank FROM q JOIN o_properties p ON contains(p.pid, q.query)) r WHERE rank <= 10""",
)
def q02f(t):
    """Every property's number searched by a piece of it, of one to eight digits."""
    asked = t.properties.select(F.expr("substr(pid, 1 + CAST(pid AS BIGINT) % 5, 1 + CAST(pid AS BIGINT) % 8)").alias("query"))
    return serve.search_pid(asked, t.pid_index)


@query(
    "q02_search_address",
    """WITH q AS (SELECT DISTINCT query, CAST(split_part(query, ' ', 1) AS BIGINT) AS civic, upper(split_part(query, ' ', 2)) AS w1, upper(split_part(query, ' ', 3)) AS w2 FROM px_search),
       h AS (SELECT q.*, p.pid, p.street_name, p.civic_number, CAST(p.to_civic_number AS BIGINT) AS tc, p.tax_assessment_year AS y FROM q JOIN o_properties p
         ON regexp_matches(p.street_name, '(^|[ -])' || q.w1) AND (q.w2 = '' OR regexp_matches(p.street_name, '(^|[ -])' || q.w2))),
       e AS (SELECT query, pid, row_number() OVER (PARTITION BY query ORDER BY y DESC, pid) AS rank FROM h WHERE civic_number = civic OR tc = civic),
       n AS (SELECT query, pid, row_number() OVER (PARTITION BY query ORDER BY abs(civic_number - civic), pid) AS rank FROM h
         WHERE civic_number > 0 AND query NOT IN (SELECT query FROM e))
       SELECT query, pid, rank, 'exact' AS kind FROM e WHERE rank <= 10 UNION ALL SELECT query, pid, rank, 'nearest' FROM n WHERE rank <= 10""",
)
def q02b(t):
    return serve.search_address(t("px_search"), t.properties)


@query(
    "q02_search_street",
    """WITH q AS (SELECT DISTINCT substr(query, instr(query, ' ') + 1) AS query FROM px_search),
       h AS (SELECT q.query, p.pid, coalesce(p.civic_number, 0) > 0 AS numbered FROM q JOIN o_properties p
         ON regexp_matches(p.street_name, '(^|[ -])' || upper(split_part(q.query, ' ', 1)))
         AND (split_part(q.query, ' ', 2) = '' OR regexp_matches(p.street_name, '(^|[ -])' || upper(split_part(q.query, ' ', 2))))),
       g AS (SELECT *, bool_or(numbered) OVER (PARTITION BY query) AS any_numbered FROM h)
       SELECT query, pid, rank, 'street' AS kind FROM (SELECT query, pid, row_number() OVER (PARTITION BY query ORDER BY pid) AS rank
         FROM g WHERE numbered OR NOT any_numbered) r WHERE rank <= 10""",
)
def q02c(t):
    streets = t("px_search").select(F.expr("substr(query, instr(query, ' ') + 1)").alias("query"))
    return serve.search_address(streets, t.properties)


@query(
    "q03_building_units",
    """WITH b AS (SELECT DISTINCT CAST(p.to_civic_number AS BIGINT) AS building_number, p.street_name FROM px_request r JOIN o_properties p USING (pid))
       SELECT building_number, b.street_name, CASE WHEN civic_number > 0 AND civic_number <> building_number THEN civic_number END AS unit_number, p.pid, p.property_type, p.total_assessed_value
       FROM b JOIN o_properties p ON CAST(p.to_civic_number AS BIGINT) = building_number AND p.street_name = b.street_name""",
)
def q03(t):
    wanted = t.properties.join(t("px_request").select("pid"), "pid", "left_semi").select(
        F.col("to_civic_number").cast("long").alias("building_number"), "street_name"
    )
    return serve.building_units(wanted, t.properties).orderBy("building_number", "street_name", F.col("unit_number").asc_nulls_last(), "pid")


@query(
    "q04_resolve_subjects",
    """WITH a AS (SELECT request_id, 1 AS way, p.pid FROM px_resolve r JOIN o_properties p ON p.pid = r.pid
         UNION ALL SELECT request_id, 2, pid FROM (SELECT request_id, p.pid, row_number() OVER (PARTITION BY request_id ORDER BY p.tax_assessment_year DESC, p.pid) AS rn
            FROM px_resolve r JOIN o_properties p ON p.street_name = 'SMALL ST' AND CAST(split_part(r.address, ' ', 1) AS BIGINT) IN (p.civic_number, CAST(p.to_civic_number AS BIGINT))) x WHERE rn = 1
         UNION ALL SELECT request_id, 3, pid FROM (SELECT request_id, p.pid, row_number() OVER (PARTITION BY request_id ORDER BY
              CASE WHEN p.property_type = r.property_type AND sqrt(pow(r.latitude - p.latitude, 2) + pow(r.longitude - p.longitude, 2)) < 0.002 THEN 0 ELSE 1 END,
              sqrt(pow(r.latitude - p.latitude, 2) + pow(r.longitude - p.longitude, 2)), p.pid) AS rn FROM px_resolve r, o_properties p WHERE r.latitude IS NOT NULL) y WHERE rn = 1),
       m AS (SELECT property_type, median(total_assessed_value) AS peer FROM o_properties GROUP BY 1)
       SELECT r.request_id, a.pid, CASE a.way WHEN 1 THEN 'pid' WHEN 2 THEN 'address' WHEN 3 THEN 'nearest' ELSE 'synthetic' END AS resolved_by,
         round(coalesce(p.total_assessed_value, m.peer), 2) AS total_assessed_value, round(coalesce(p.current_land_value, m.peer * 0.4), 2) AS current_land_value,
         round(coalesce(p.current_improvement_value, m.peer * 0.6), 2) AS current_improvement_value
       FROM px_resolve r LEFT JOIN a USING (request_id) LEFT JOIN o_properties p ON p.pid = a.pid LEFT JOIN m ON m.property_type = r.property_type""",
)
def q04(t):
    return rounded(serve.resolve_subjects(t("px_resolve"), t.properties), 2)


@query(
    "w13_nearest_civic",
    """WITH w AS (SELECT DISTINCT to_civic_number + 3 AS civic, street_name FROM px_property)
       SELECT civic, street_name, pid, gap AS civic_gap FROM (SELECT w.civic, w.street_name, p.pid, abs(p.civic_number - w.civic) AS gap,
         row_number() OVER (PARTITION BY w.civic, w.street_name ORDER BY abs(p.civic_number - w.civic), p.civic_number_rank, p.pid) AS rn
         FROM w JOIN (SELECT *, -tax_assessment_year AS civic_number_rank FROM o_properties WHERE civic_number > 0) p ON p.street_name = w.street_name) x WHERE rn = 1""",
)
def w13(t):
    wanted = t("px_property").select((F.col("to_civic_number") + 3).alias("civic"), "street_name")
    return serve.nearest_civic(wanted, t.properties)


@query(
    "p41_validate_requests",
    """SELECT request_id, CASE WHEN pid IS NULL AND address IS NULL AND latitude IS NULL THEN 'no identifier'
       WHEN latitude IS NOT NULL AND NOT (latitude BETWEEN 48.5 AND 49.6 AND longitude BETWEEN -123.5 AND -122.5) THEN 'outside the region' END AS reject_reason
       FROM (SELECT request_id, pid, address, latitude + CASE WHEN request_id % 5 = 0 THEN 1 ELSE 0 END AS latitude, longitude FROM px_resolve) r""",
)
def p41(t):
    moved = t("px_resolve").withColumn("latitude", F.col("latitude") + F.when(F.col("request_id") % 5 == 0, 1.0).otherwise(0.0))
    return serve.validate_requests(moved).select("request_id", "reject_reason")


@query(
    "j26_request_overrides",
    """SELECT r.request_id, coalesce(r.bedrooms_override, CASE WHEN x.pid IS NOT NULL THEN 2 END) AS bedrooms, round(coalesce(r.area_override, x.lot_size_sqft / 3), 6) AS living_area_sqft
       FROM px_request r LEFT JOIN o_properties p ON p.pid = r.pid LEFT JOIN px_property x ON x.pid = p.pid""",
)
def j26(t):
    lots = t("px_property").select("pid", (F.col("lot_size_sqft") / 3).alias("living_area_sqft"), F.lit(2).alias("bedrooms"))
    # A request whose property isn't known keeps what it says itself.
    rows = t("px_request").join(lots.join(t.properties.select("pid"), "pid", "left_semi"), "pid", "left")
    out = serve.with_overrides(rows, {"bedrooms": "bedrooms_override", "living_area_sqft": "area_override"})
    return out.select("request_id", "bedrooms", F.round("living_area_sqft", 6).alias("living_area_sqft"))


@query(
    "j28_stored_or_computed",
    """SELECT r.request_id, coalesce(CASE WHEN x.pkey % 2 = 0 THEN x.lot_size_sqft END, 1500) AS lot_size_sqft FROM px_request r LEFT JOIN px_property x USING (pid)""",
)
def j28(t):
    stored = t("px_property").where("pkey % 2 = 0").select("pid", "lot_size_sqft")
    out = serve.with_lookup(t("px_request").select("request_id", "pid"), stored, "pid", {"lot_size_sqft": F.lit(1500.0)})
    return out.select("request_id", "lot_size_sqft")


@query(
    "a21_market_context",
    """WITH g AS (SELECT neighbourhood_code, count(*) AS area_count, max(tax_assessment_year) AS latest_year, median(total_assessed_value) AS m, median(prev_total) AS p FROM o_properties GROUP BY 1)
       SELECT r.request_id, neighbourhood_code, area_count, latest_year, round(m, 2) AS area_median, round((m - p) / p * 100, 5) AS area_yoy_pct
       FROM px_request r JOIN o_properties x USING (pid) JOIN g USING (neighbourhood_code)""",
)
def a21(t):
    rows = t("px_request").select("request_id", "pid").join(t.properties.select("pid", "neighbourhood_code"), "pid").drop("pid")
    out = serve.market_context(rows, t.properties)
    return out.select("request_id", "neighbourhood_code", "area_count", "latest_year", F.round("area_median", 2).alias("area_median"), F.round("area_yoy_pct", 5).alias("area_yoy_pct"))


@query(
    "q09_freshness",
    "SELECT max(sold_date) AS latest, count(*) AS rows, CAST(DATE '2001-12-31' - max(sold_date) AS INT) AS staleness_days FROM o_sold",
)
def q09(t):
    return serve.freshness(t.sold, "sold_date", "2001-12-31")


@query(
    "q09_assessment_freshness",
    "SELECT make_date(max(tax_assessment_year) - 1, 7, 1) AS latest, count(*) AS rows, CAST(DATE '2026-03-15' - make_date(max(tax_assessment_year) - 1, 7, 1) AS INT) AS staleness_days FROM o_universe",
)
def q09a(t):
    """How old the assessments are: they stand for July of the year before their roll."""
    valued = t.universe.withColumn("assessed_on", F.make_date(F.col("tax_assessment_year") - 1, F.lit(7), F.lit(1)))
    return serve.freshness(valued, "assessed_on", "2026-03-15")


@query(
    "q10_t10_report_areas",
    """SELECT sub_area, count(*) AS count, round(median(ratio), 6) AS median_ratio FROM o_matched WHERE ratio IS NOT NULL GROUP BY 1 ORDER BY count DESC, sub_area LIMIT 20""",
)
def q10(t):
    return serve.report_top_lists(t.matched).select("sub_area", "count", F.round("median_ratio", 6).alias("median_ratio"))


@query(
    "q10_daily_numbers",
    """SELECT sold_date, count(*) AS total_sales, list_sort(list(sold_price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_price,
       count(*) FILTER (sold_price > list_price) AS over_ask FROM o_sold WHERE sold_date = DATE '2000-06-15' GROUP BY 1""",
)
def q10b(t):
    return serve.daily_numbers(t.sold, "2000-06-15").select("sold_date", "total_sales", "median_price", "over_ask")


ORACLE_ONLY["o_segment"] = """
SELECT segment, avg(total_assessed_value) AS mean_value FROM (
  SELECT unnest([neighbourhood_code || '__' || property_type, 'citywide__' || property_type, 'citywide__all']) AS segment, total_assessed_value FROM o_properties) s
GROUP BY 1 HAVING count(*) >= 25
"""


@query(
    "j19_segment_fallback",
    """SELECT p.pid, coalesce(a.segment, b.segment, c.segment) AS segment_used,
         round(CASE WHEN a.segment IS NOT NULL THEN a.mean_value WHEN b.segment IS NOT NULL THEN b.mean_value ELSE c.mean_value END, 2) AS mean_value
       FROM o_properties p LEFT JOIN o_segment a ON a.segment = p.neighbourhood_code || '__' || p.property_type
       LEFT JOIN o_segment b ON b.segment = 'citywide__' || p.property_type LEFT JOIN o_segment c ON c.segment = 'citywide__all'""",
)
def j19(t):
    segments = market.segment_stats(t.properties, minimum=25).where("qualifies").select("segment", "mean_value")
    out = serve.segment_fallback(t.properties, segments, ["mean_value"])
    return out.select("pid", "segment_used", F.round("mean_value", 2).alias("mean_value"))


@query(
    "j20_nearest_segment",
    """WITH av AS (SELECT neighbourhood_code AS area, property_type AS st FROM o_properties GROUP BY 1, 2 HAVING count(*) >= 25),
       pr AS (SELECT * FROM (VALUES ('townhome','townhome',0),('townhome','condo',1),('townhome','detached',2),('condo','condo',0),('condo','townhome',1),('condo','detached',2),
          ('detached','detached',0),('detached','condo',1),('detached','townhome',2),('duplex','duplex',0),('duplex','detached',1),('duplex','townhome',2)) v(pt, st, r)),
       w AS (SELECT DISTINCT neighbourhood_code, property_type FROM o_properties)
       SELECT neighbourhood_code, property_type, area || '__' || st AS segment_used, gap AS code_gap FROM (
         SELECT w.*, av.area, av.st, abs(CAST(av.area AS INT) - CAST(w.neighbourhood_code AS INT)) AS gap,
           row_number() OVER (PARTITION BY w.neighbourhood_code, w.property_type ORDER BY pr.r, abs(CAST(av.area AS INT) - CAST(w.neighbourhood_code AS INT)), av.area, av.st) AS rn
         FROM w JOIN pr ON pr.pt = w.property_type JOIN av ON av.st = pr.st) x WHERE rn = 1""",
)
def j20(t):
    counts = t.properties.groupBy(F.col("neighbourhood_code").alias("area"), F.col("property_type").alias("seg_type")).agg(F.count(F.lit(1)).alias("n"))
    return serve.nearest_segment(t.properties, counts.where("n >= 25").select("area", "seg_type"))


@query(
    "q07_request_subjects",
    """WITH a AS (SELECT request_id, 1 AS way, p.pid FROM px_request r JOIN o_properties p ON p.pid = r.pid
         UNION ALL SELECT request_id, 2, pid FROM (SELECT request_id, p.pid, row_number() OVER (PARTITION BY request_id ORDER BY
              CASE WHEN p.property_type = r.req_type AND sqrt(pow(r.req_lat - p.latitude, 2) + pow(r.req_lon - p.longitude, 2)) < 0.002 THEN 0 ELSE 1 END,
              sqrt(pow(r.req_lat - p.latitude, 2) + pow(r.req_lon - p.longitude, 2)), p.pid) AS rn FROM px_request r, o_properties p) y WHERE rn = 1),
       b AS (SELECT request_id, min_by(pid, way) AS pid, min(way) AS way FROM a GROUP BY 1)
       SELECT r.request_id, b.pid, CASE b.way WHEN 1 THEN 'pid' ELSE 'nearest' END AS resolved_by, p.property_type, round(p.total_assessed_value, 2) AS total_assessed_value
       FROM px_request r JOIN b USING (request_id) JOIN o_properties p ON p.pid = b.pid""",
)
def q07s(t):
    """The part of the valuation that no model decides: every request and its subject."""
    from terravalor.plans.value import request_subjects

    found = request_subjects(t).join(t.properties.select("pid", "property_type"), "pid")
    return found.select("request_id", "pid", "resolved_by", "property_type", F.round("total_assessed_value", 2).alias("total_assessed_value"))


@query("q07_full_valuation")
def q07(t):
    """Request → subject → model → rules → comparables → blend → interval → grade, for every request."""
    from terravalor.plans.value import value_requests

    return rounded(value_requests(t), 2)
