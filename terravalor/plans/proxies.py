"""Input views in the library's schemas, derived from the driver tables.

The text is plain SQL that Spark and DuckDB both run, so both sides of a
comparison start from the same rows. ``@SERIES(a, b)@`` makes one row per number.
"""

from __future__ import annotations

PROXIES: dict[str, str] = {}
# Views that restate library steps for the oracle; Spark never runs them.
ORACLE_ONLY: dict[str, str] = {}

PROXIES["px_property"] = """
SELECT p_partkey AS pkey,
       lpad(CAST(p_partkey AS STRING), 9, '0') AS pid,
       lpad(CAST(p_partkey AS STRING), 8, '0') AS land_coordinate,
       CAST(p_partkey % 22 + 1 AS STRING) AS neighbourhood_code,
       49.20E0 + (p_partkey * 37 % 1000) * 0.0001E0 AS latitude,
       -123.22E0 + (p_partkey * 91 % 2000) * 0.0001E0 AS longitude,
       CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'LAND'
            WHEN p_type = 'PROMO' THEN 'OTHER' ELSE 'STRATA' END AS legal_type,
       CASE CAST(substr(p_brand, 7) AS INT) % 8
            WHEN 0 THEN 'RS-1' WHEN 1 THEN 'RT-5' WHEN 2 THEN 'RM-3A' WHEN 3 THEN 'RM-5B'
            WHEN 4 THEN 'C-2' WHEN 5 THEN 'CD-1 (12)' WHEN 6 THEN 'I-2' ELSE 'R1-1'
       END AS zoning_district,
       CASE WHEN p_partkey % 17 = 0 THEN NULL
            ELSE CAST(1930 + p_partkey * 13 % 95 AS INT) END AS year_built,
       CAST(2026 - p_partkey % 3 AS INT) AS tax_assessment_year,
       p_retailprice * 600E0 AS current_land_value,
       CASE WHEN p_partkey % 29 = 0 THEN 0E0
            ELSE p_retailprice * p_size * 20E0 END AS current_improvement_value,
       p_retailprice * 600E0 * (0.9E0 + (p_partkey % 21) * 0.01E0) AS previous_land_value,
       p_retailprice * p_size * 19E0 AS previous_improvement_value,
       CASE WHEN p_partkey % 3 = 0 THEN CAST(0 AS BIGINT)
            ELSE 1 + p_partkey % 40 END AS from_civic_number,
       100 + p_partkey % 400 AS to_civic_number,
       upper(split_part(p_name, ' ', 1)) ||
         CASE WHEN p_partkey % 2 = 0 THEN ' ST' ELSE ' AVE W' END AS street_name,
       2000E0 + p_partkey * 7 % 6000 AS lot_size_sqft
FROM part
"""

# The assessment roll as it lands: text columns, upper-case names, two years per
# property, junk in some value fields.
PROXIES["px_tax_roll"] = """
SELECT substr(pid, 1, 3) || '-' || substr(pid, 4, 3) || '-' || substr(pid, 7) AS PID,
       land_coordinate AS LAND_COORDINATE,
       CASE WHEN from_civic_number = 0 THEN '' ELSE CAST(from_civic_number AS STRING) END
         AS FROM_CIVIC_NUMBER,
       CAST(to_civic_number AS STRING) AS TO_CIVIC_NUMBER,
       CASE WHEN pkey % 23 = 0 THEN lower(street_name) ELSE street_name END AS STREET_NAME,
       CASE WHEN pkey % 19 = 0 THEN 'nan' ELSE 'V5K 1A' || CAST(pkey % 10 AS STRING) END
         AS PROPERTY_POSTAL_CODE,
       neighbourhood_code AS NEIGHBOURHOOD_CODE,
       CASE WHEN pkey % 13 = 0 THEN ' ' || lower(zoning_district) || ' '
            ELSE zoning_district END AS ZONING_DISTRICT,
       legal_type AS LEGAL_TYPE,
       CASE WHEN pkey % 31 = 0 THEN 'n/a'
            ELSE CAST(CAST(floor(current_land_value * (1E0 - 0.02E0 * k)) AS BIGINT) AS STRING) END
         AS CURRENT_LAND_VALUE,
       CAST(CAST(floor(current_improvement_value) AS BIGINT) AS STRING) AS CURRENT_IMPROVEMENT_VALUE,
       CAST(CAST(floor(previous_land_value * (1E0 - 0.02E0 * k)) AS BIGINT) AS STRING)
         AS PREVIOUS_LAND_VALUE,
       CASE WHEN pkey % 37 = 0 THEN NULL
            ELSE CAST(CAST(floor(previous_improvement_value) AS BIGINT) AS STRING) END
         AS PREVIOUS_IMPROVEMENT_VALUE,
       CAST(tax_assessment_year - k AS STRING) AS TAX_ASSESSMENT_YEAR,
       CAST(year_built AS STRING) AS YEAR_BUILT
FROM (SELECT *, @SERIES(0, 1)@ AS k FROM px_property) y
"""

PROXIES["px_parcels"] = """
SELECT land_coordinate, latitude, longitude FROM px_property
"""

PROXIES["px_panel"] = """
SELECT pid, pkey, neighbourhood_code, legal_type, zoning_district, year_built, lot_size_sqft,
       latitude, longitude, yr AS tax_assessment_year,
       current_land_value * (1E0 + 0.03E0 * (yr - 2020) - 0.01E0 * (pkey % 5)) AS current_land_value,
       current_improvement_value
FROM (SELECT *, @SERIES(2020, 2026)@ AS yr FROM px_property) y
"""

PROXIES["px_sold"] = """
SELECT 'R' || CAST(l_orderkey * 10 + l_linenumber AS STRING) AS mls_number,
       lpad(CAST(l_partkey AS STRING), 9, '0') AS listed_pid,
       CAST(floor(base * (0.80E0 + l_quantity * 0.008E0)
                  * CASE WHEN l_discount > 0.095E0 THEN 1.8E0 ELSE 1E0 END) AS BIGINT) AS sold_price,
       CAST(floor(base * (1E0 + l_tax - 0.04E0)) AS BIGINT) AS list_price,
       CAST(l_shipdate AS DATE) AS sold_date,
       CAST(l_quantity AS INT) AS dom,
       CAST(l_suppkey % 12 AS STRING) AS sub_area,
       CASE l_returnflag WHEN 'A' THEN 'Apartment/Condo' WHEN 'N' THEN 'House/Single Family'
            ELSE 'Townhouse' END AS property_type,
       CAST(400 + l_partkey * 7 % 2600 AS INT) AS floor_area,
       CAST(l_linenumber % 6 AS INT) AS bedrooms,
       CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(1 + l_suppkey % 4 AS INT) END AS bathrooms,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(1930 + l_partkey * 13 % 95 AS INT) END AS year_built,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 200E0 + l_suppkey % 300 END AS maint_fee,
       CASE WHEN l_linenumber % 2 = 1 AND from_civic_number > 0
            THEN CAST(from_civic_number AS STRING) || ' ' ELSE '' END
         || CAST(to_civic_number AS STRING) || ' '
         || CASE WHEN l_partkey % 11 = 0 THEN 'X' ELSE '' END
         || CASE WHEN l_partkey % 2 = 0 THEN word || ' STREET' ELSE word || ' AVENUE W' END AS address,
       CAST(l_shipdate AS DATE) AS first_seen_date
FROM (
  SELECT l.*, p.from_civic_number, p.to_civic_number, split_part(p.street_name, ' ', 1) AS word,
         p.current_land_value + q.p_retailprice * q.p_size * 20E0 AS base
  FROM lineitem l
  JOIN px_property p ON l.l_partkey = p.pkey
  JOIN part q ON l.l_partkey = q.p_partkey
) s
"""

PROXIES["px_poi"] = """
SELECT c_custkey AS poi_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'transit' WHEN 'BUILDING' THEN 'school'
            WHEN 'FURNITURE' THEN 'park' WHEN 'HOUSEHOLD' THEN 'contaminated' ELSE 'str' END AS kind,
       49.20E0 + (c_custkey * 53 % 1000) * 0.0001E0 + 0.00003E0 AS lat,
       -123.22E0 + (c_custkey * 71 % 2000) * 0.0001E0 + 0.00003E0 AS lon,
       abs(c_acctbal) / 20E0 AS price,
       CAST(c_nationkey AS INT) AS route_id,
       CASE c_custkey % 4 WHEN 0 THEN 'Entire home/apt' WHEN 1 THEN 'Private room'
            WHEN 2 THEN 'Shared room' ELSE 'Hotel room' END AS room_type,
       CAST(c_custkey % 365 AS INT) AS availability_365,
       CAST(c_custkey * 7 % 90 AS INT) AS number_of_reviews,
       CASE c_custkey % 3 WHEN 0 THEN 'Elementary' WHEN 1 THEN 'Secondary' ELSE 'K-12' END AS school_type,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) END AS school_score,
       'Area ' || CAST(c_nationkey AS STRING) AS area_name
FROM customer
"""

PROXIES["px_area"] = """
SELECT CAST(n_nationkey AS INT) AS area_id, n_name AS area_name,
       49.20E0 + (n_nationkey % 5) * 0.02E0 AS lat_min,
       49.20E0 + (n_nationkey % 5) * 0.02E0 + 0.02E0 AS lat_max,
       -123.22E0 + CAST(floor(n_nationkey / 5) AS INT) * 0.04E0 AS lon_min,
       -123.22E0 + CAST(floor(n_nationkey / 5) AS INT) * 0.04E0 + 0.04E0 AS lon_max,
       60000E0 + n_nationkey * 2000E0 AS median_income
FROM nation
"""

# Smaller boxes inside the areas: protected land (even keys) and flood zones (odd keys).
PROXIES["px_zone"] = """
SELECT area_id AS zone_id, CASE WHEN area_id % 2 = 0 THEN 'alr' ELSE 'floodplain' END AS kind,
       lat_min + 0.004E0 AS lat_min, lat_min + 0.012E0 AS lat_max,
       lon_min + 0.005E0 AS lon_min, lon_min + 0.025E0 AS lon_max
FROM px_area
"""

PROXIES["px_footprint"] = """
SELECT poi_id AS footprint_id, lat - half AS lat_min, lat + half AS lat_max,
       lon - half AS lon_min, lon + half AS lon_max
FROM (SELECT poi_id, lat, lon, 0.00004E0 + (poi_id % 5) * 0.00002E0 AS half FROM px_poi) f
"""

PROXIES["px_rates"] = """
SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) * 0.25E0 AS policy_rate,
       CASE WHEN extract(DAY FROM CAST(o_orderdate AS DATE)) % 7 = 3
            THEN 1E0 + COUNT(*) * 0.5E0 END AS mortgage_5yr,
       CASE WHEN extract(DAY FROM CAST(o_orderdate AS DATE)) % 5 = 1
            THEN 2E0 + COUNT(*) * 0.5E0 END AS mortgage_3yr
FROM orders GROUP BY CAST(o_orderdate AS DATE)
"""

PROXIES["px_rate_series"] = """
SELECT date, 'policy_rate' AS series, policy_rate AS value FROM px_rates
UNION ALL SELECT date, 'mortgage_5yr', mortgage_5yr FROM px_rates WHERE mortgage_5yr IS NOT NULL
UNION ALL SELECT date, 'mortgage_3yr', mortgage_3yr FROM px_rates WHERE mortgage_3yr IS NOT NULL
"""

PROXIES["px_admissions"] = """
SELECT CAST(extract(YEAR FROM o_orderdate) AS INT) AS year,
       CAST(extract(MONTH FROM o_orderdate) AS INT) AS month,
       o_orderpriority AS category, COUNT(*) AS admitted
FROM orders GROUP BY 1, 2, 3
"""

PROXIES["px_transfer_tax"] = """
SELECT CAST(o.o_orderdate AS DATE) AS transaction_date, n.n_name AS municipality,
       o.o_totalprice AS fair_market_value,
       CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'Y' ELSE 'N' END AS foreign_involvement,
       c.c_mktsegment AS property_type
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

PROXIES["px_stop_times"] = """
SELECT CAST(l_orderkey AS STRING) AS trip_id, CAST(l_suppkey AS STRING) AS stop_id,
       l_linenumber AS stop_sequence FROM lineitem
"""
PROXIES["px_trips"] = """
SELECT CAST(o_orderkey AS STRING) AS trip_id, CAST(o_custkey % 40 AS STRING) AS route_id FROM orders
"""
PROXIES["px_routes"] = """
SELECT DISTINCT CAST(o_custkey % 40 AS STRING) AS route_id,
       'R' || CAST(o_custkey % 40 AS STRING) AS route_short_name,
       CAST(o_custkey % 40 % 4 AS INT) AS route_type FROM orders
"""
PROXIES["px_stops"] = """
SELECT CAST(s_suppkey AS STRING) AS stop_id,
       CASE WHEN s_suppkey % 10 = 0 THEN 'Station ' ELSE 'Stop ' END || CAST(s_suppkey AS STRING) AS stop_name,
       49.20E0 + (s_suppkey * 53 % 1000) * 0.0001E0 + 0.00002E0 AS lat,
       -123.22E0 + (s_suppkey * 71 % 2000) * 0.0001E0 + 0.00002E0 AS lon,
       CAST(s_suppkey % 2 AS INT) AS location_type
FROM supplier
"""

PROXIES["px_folio_descriptions"] = """
SELECT CAST(c_custkey AS STRING) AS folio_id, CAST(c_nationkey AS STRING) AS jurisdiction,
       c_mktsegment AS actual_use_code FROM customer
"""
PROXIES["px_folio_addresses"] = """
SELECT CAST(c_custkey AS STRING) AS folio_id, CAST(100 + c_custkey % 900 AS STRING) AS street_number,
       'MAIN' AS street_name, 'V' || CAST(c_custkey % 100 AS STRING) AS postal_code, 'Y' AS primary_flag
FROM customer
UNION ALL
SELECT CAST(c_custkey AS STRING), CAST(1 + c_custkey % 9 AS STRING), 'LANE', 'V0', 'N'
FROM customer WHERE c_custkey % 3 = 0
"""
PROXIES["px_folio_legal"] = """
SELECT CAST(c_custkey AS STRING) AS folio_id, lpad(CAST(c_custkey AS STRING), 9, '0') AS pid,
       'LOT ' || CAST(c_custkey % 50 AS STRING) AS lot FROM customer WHERE c_custkey % 7 <> 0
"""
PROXIES["px_folio_values"] = """
SELECT CAST(c_custkey AS STRING) AS folio_id, abs(c_acctbal) * 100E0 AS land_value,
       abs(c_acctbal) * 40E0 AS improvement_value FROM customer
"""
PROXIES["px_folio_sales"] = """
SELECT CAST(o_custkey AS STRING) AS folio_id, o_totalprice AS sale_price,
       CAST(o_orderdate AS DATE) AS sale_date, o_orderkey AS sale_id FROM orders
"""

PROXIES["px_permits"] = """
SELECT o_orderkey AS permit_id, CAST(o_orderdate AS DATE) AS issue_date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'New Building' WHEN '2-HIGH' THEN 'Demolition / Deconstruction'
            WHEN '3-MEDIUM' THEN 'Addition / Alteration' WHEN '5-LOW' THEN 'Salvage and Abatement'
            ELSE 'Temporary Building' END AS type_of_work,
       o_totalprice AS project_value,
       CAST(100 + o_custkey % 400 AS STRING) || ' ' ||
         CASE o_custkey % 8 WHEN 0 THEN 'Blue' WHEN 1 THEN 'New' WHEN 2 THEN 'Cold' WHEN 3 THEN 'Red'
              WHEN 4 THEN 'Large' WHEN 5 THEN 'Hot' WHEN 6 THEN 'Old' ELSE 'Small' END ||
         CASE WHEN o_custkey % 2 = 0 THEN ' Street' ELSE ' Avenue W' END ||
         ', Vancouver, BC' AS address
FROM orders
"""

# Feed articles: a feed per document source, some copies share a url.
PROXIES["px_news"] = """
SELECT doc_id, source AS feed_name, 'http://news.example/' || CAST(doc_id % 700 AS STRING) AS url,
       text AS summary, 'Update ' || CAST(doc_id AS STRING) AS title,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 20240101 + doc_id % 28 END AS published_day
FROM documents
"""

# Valuation requests: one per customer, with overrides on some.
PROXIES["px_request"] = """
SELECT c_custkey AS request_id, lpad(CAST(c_custkey AS STRING), 9, '0') AS pid,
       49.20E0 + (c_custkey * 53 % 1000) * 0.0001E0 + 0.00003E0 AS req_lat,
       -123.22E0 + (c_custkey * 71 % 2000) * 0.0001E0 + 0.00003E0 AS req_lon,
       CASE c_custkey % 3 WHEN 0 THEN 'condo' WHEN 1 THEN 'detached' ELSE 'townhome' END AS req_type,
       CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 6 AS INT) END AS bedrooms_override,
       CASE WHEN c_custkey % 6 = 0 THEN 700E0 + c_custkey % 2000 END AS area_override
FROM customer
"""

# Attributes that rule adjustments need, per property.
PROXIES["px_rule_inputs"] = """
SELECT pid,
       CASE pkey % 5 WHEN 0 THEN 'prepaid' WHEN 1 THEN 'non_prepaid' WHEN 2 THEN 'first_nations'
            ELSE 'freehold' END AS lease_type,
       CASE WHEN pkey % 10 = 7 THEN NULL ELSE CAST(pkey * 7 % 99 AS DOUBLE) END AS lease_remaining_years,
       CASE WHEN pkey % 6 = 0 THEN NULL ELSE CAST(pkey * 11 % 90 AS INT) END AS depreciation_report_age_months,
       CASE WHEN pkey % 7 = 0 THEN NULL ELSE CAST(pkey * 13 % 80 AS DOUBLE) END AS contingency_reserve_pct,
       CASE WHEN pkey % 4 = 0 THEN CAST(pkey * 17 % 60000 AS DOUBLE) END AS special_assessment_total_5yr,
       CASE WHEN pkey % 3 = 0 THEN CAST(pkey * 101 % 700000 AS DOUBLE) END AS insurance_deductible,
       CASE pkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Partial' WHEN 2 THEN 'No' END AS rainscreen_status,
       CASE WHEN pkey % 2 = 0 THEN CAST(pkey % 8 AS INT) END AS crt_dispute_count_3yr,
       CASE WHEN pkey % 5 = 1 THEN NULL ELSE 25E0 + pkey % 30 END AS lot_frontage_ft,
       pkey % 8 = 0 AS is_corner_lot,
       1E0 + (pkey % 9) * 0.5E0 AS assessment_rate, 2E0 + (pkey % 7) * 0.5E0 AS current_rate
FROM px_property
"""

# ---- library steps restated for the oracle -------------------------------------

ORACLE_ONLY["o_typed"] = """
SELECT CASE WHEN length(d) >= 9 THEN d ELSE lpad(d, 9, '0') END AS pid,
       land_coordinate,
       TRY_CAST(from_civic_number AS DOUBLE) AS from_civic_number,
       TRY_CAST(to_civic_number AS DOUBLE) AS to_civic_number,
       nullif(upper(trim(street_name)), 'NAN') AS street_name,
       nullif(upper(trim(property_postal_code)), 'NAN') AS property_postal_code,
       nullif(upper(trim(neighbourhood_code)), 'NAN') AS neighbourhood_code,
       nullif(upper(trim(zoning_district)), 'NAN') AS zoning_district,
       nullif(upper(trim(legal_type)), 'NAN') AS legal_type,
       coalesce(TRY_CAST(current_land_value AS DOUBLE), 0) AS current_land_value,
       coalesce(TRY_CAST(current_improvement_value AS DOUBLE), 0) AS current_improvement_value,
       coalesce(TRY_CAST(previous_land_value AS DOUBLE), 0) AS previous_land_value,
       coalesce(TRY_CAST(previous_improvement_value AS DOUBLE), 0) AS previous_improvement_value,
       TRY_CAST(tax_assessment_year AS INTEGER) AS tax_assessment_year,
       TRY_CAST(year_built AS INTEGER) AS year_built
FROM (SELECT *, regexp_replace(PID, '[^0-9]', '', 'g') AS d FROM px_tax_roll) t
"""
ORACLE_ONLY["o_latest"] = """
SELECT * FROM o_typed
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY tax_assessment_year DESC) = 1
"""
ORACLE_ONLY["o_classified"] = """
SELECT *, CASE
  WHEN regexp_matches(coalesce(zoning_district, ''), '^(I-[1-4]|M-1|M-1A|M-1B|M-2|IC-[1-3])( |$)') THEN 'development_land'
  WHEN zoning_district LIKE 'CD-1%' THEN CASE WHEN legal_type = 'STRATA' THEN 'condo' ELSE 'development_land' END
  WHEN regexp_matches(coalesce(zoning_district, ''), '^(RS-[123567]|RT-|RA-1|FSHCA|R1-1)') THEN 'detached'
  WHEN regexp_matches(coalesce(zoning_district, ''), '^RM-[123]') THEN 'townhome'
  WHEN regexp_matches(coalesce(zoning_district, ''), '^(RM-[456]|FM-1|DD|HA-|FC-|CWD)') THEN 'condo'
  WHEN regexp_matches(coalesce(zoning_district, ''), '^(C-[12356]|MC-[12])')
    THEN CASE WHEN legal_type = 'STRATA' THEN 'condo' ELSE 'development_land' END
  WHEN legal_type = 'STRATA' THEN 'condo' ELSE 'detached' END AS property_type
FROM o_latest
"""
ORACLE_ONLY["o_derived"] = """
SELECT *,
  CASE WHEN total_assessed_value > 0 THEN current_land_value / total_assessed_value END AS land_ratio,
  CASE WHEN prev_total > 0 THEN (total_assessed_value - prev_total) / prev_total END AS yoy_change_pct,
  trim(CASE WHEN civic_number > 0 THEN CAST(civic_number AS STRING) ELSE '' END || ' ' || coalesce(street_name, '')) AS full_address,
  CASE WHEN year_built > 1800 THEN greatest(tax_assessment_year - year_built, 0) END AS effective_age
FROM (SELECT *, current_land_value + current_improvement_value AS total_assessed_value,
        previous_land_value + previous_improvement_value AS prev_total,
        CAST(CASE WHEN coalesce(from_civic_number, 0) > 0 THEN from_civic_number
             ELSE coalesce(to_civic_number, 0) END AS BIGINT) AS civic_number
      FROM o_classified) c
"""
ORACLE_ONLY["o_universe"] = """
SELECT d.*, p.latitude, p.longitude FROM o_derived d LEFT JOIN px_parcels p USING (land_coordinate)
WHERE total_assessed_value > 0 AND property_type IN ('detached', 'townhome', 'condo')
  AND NOT regexp_matches(coalesce(zoning_district, ''), '^(I-[1-4]|M-1|M-2)')
"""
ORACLE_ONLY["o_properties"] = """
SELECT * EXCLUDE (property_type, n_lot),
  CASE WHEN property_type = 'detached' AND n_lot >= 2 THEN 'duplex' ELSE property_type END AS property_type
FROM (
  SELECT *, CASE WHEN coalesce(to_civic_number, 0) > 0 THEN
       sum(CASE WHEN property_type = 'detached' THEN 1 ELSE 0 END)
         OVER (PARTITION BY CAST(coalesce(to_civic_number, 0) AS BIGINT), upper(trim(coalesce(street_name, '')))) END AS n_lot
  FROM (SELECT * EXCLUDE (property_type),
          CASE WHEN zoning_district = 'R1-1' AND property_type = 'condo' THEN 'detached'
               ELSE property_type END AS property_type FROM o_universe) z
) w
"""
ORACLE_ONLY["o_sold"] = """
SELECT * FROM px_sold WHERE sold_price > 0
QUALIFY row_number() OVER (PARTITION BY mls_number ORDER BY sold_date DESC, sold_price DESC,
  list_price DESC, address DESC, listed_pid DESC, sub_area DESC, property_type DESC, dom DESC, maint_fee DESC) = 1
"""
