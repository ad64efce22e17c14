"""Spatial queries; oracles compare against all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions import geo
from terravalor.operators import layers, match, spatial
from terravalor.plans.proxies import ORACLE_ONLY
from terravalor.plans.registry import query, rounded


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * "
        f"cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))))))"
    )


def box_dist(lat: str, lon: str, b: str = "b") -> str:
    """Distance to a box on the plane tangent at the point, as the operator defines it."""
    m = "(6371000.0 * pi() / 180.0)"
    dy = f"greatest({b}.lat_min - {lat}, 0, {lat} - {b}.lat_max)"
    dx = f"(greatest({b}.lon_min - {lon}, 0, {lon} - {b}.lon_max) * cos(radians({lat})))"
    return f"(sqrt({dx} * {dx} + {dy} * {dy}) * {m})"


ORACLE_ONLY["o_pts"] = "SELECT DISTINCT latitude AS lat, longitude AS lon FROM o_universe WHERE latitude IS NOT NULL"
ORACLE_ONLY["o_rpts"] = "SELECT DISTINCT req_lat AS lat, req_lon AS lon FROM px_request"
H = hav("p.lat", "p.lon", "l.lat", "l.lon")


def kind(t, name):
    return t("px_poi").where(F.col("kind") == name)


def zones(t, name):
    return spatial.with_ring(t("px_zone").where(F.col("kind") == name))


def request_points(t):
    from terravalor.session import materialize, spread

    return materialize(spread(t("px_request").select(F.col("req_lat").alias("lat"), F.col("req_lon").alias("lon")).distinct(), "lat", "lon"))


@query(
    "g00_cell_join",
    f"SELECT p.lat, p.lon, l.poi_id, round({H}, 3) AS dist_m FROM o_pts p JOIN px_poi l ON l.kind = 'transit' AND {H} <= 700",
)
def g00(t):
    layer = spatial.point_layer(kind(t, "transit"), "lat", "lon", by=["poi_id"])
    return spatial.pairs_within(t.locations, layer, 700.0).select("lat", "lon", "poi_id", F.round("dist_m", 3).alias("dist_m"))


@query(
    "g01_nearest_distance",
    f"SELECT p.lat, p.lon, round(min(CASE WHEN {H} <= 10000 THEN {H} END), 3) AS dist_m FROM o_pts p, px_poi l WHERE l.kind = 'transit' GROUP BY 1, 2",
)
def g01(t):
    layer = spatial.point_layer(kind(t, "transit"), "lat", "lon")
    out = spatial.nearest_distance(t.locations, layer, "dist_m")
    return out.withColumn("dist_m", F.round("dist_m", 3))


@query(
    "g02_count_within",
    f"""SELECT p.lat, p.lon, count(*) FILTER ({H} <= 400) AS stops_400m, count(*) FILTER ({H} <= 800) AS stops_800m
        FROM o_pts p, px_poi l WHERE l.kind = 'transit' GROUP BY 1, 2""",
)
def g02(t):
    layer = spatial.point_layer(kind(t, "transit"), "lat", "lon")
    return spatial.counts_within(t.locations, layer, {"stops_400m": 400.0, "stops_800m": 800.0})


@query(
    "g03_inside_any",
    """SELECT p.lat, p.lon, coalesce(bool_or(p.lat >= b.lat_min AND p.lat < b.lat_max AND p.lon >= b.lon_min AND p.lon < b.lon_max), false) AS in_zone
       FROM o_pts p, px_zone b WHERE b.kind = 'floodplain' GROUP BY 1, 2""",
)
def g03(t):
    return spatial.inside_any(t.locations, spatial.as_layer(zones(t, "floodplain")), "in_zone")


@query(
    "g04_polygon_distance",
    f"""SELECT p.lat, p.lon, round(min(CASE WHEN {box_dist('p.lat', 'p.lon')} <= 10000 THEN {box_dist('p.lat', 'p.lon')} END), 3) AS dist_m
        FROM o_pts p, px_zone b WHERE b.kind = 'alr' GROUP BY 1, 2""",
)
def g04(t):
    out = spatial.polygon_distance(t.locations, spatial.as_layer(zones(t, "alr")), "dist_m")
    return out.withColumn("dist_m", F.round("dist_m", 3))


@query(
    "g05_aggregate_within",
    f"""SELECT p.lat, p.lon, round(avg(l.price), 7) AS mean_price, round(sum(l.price), 6) AS total_price, round(median(l.price), 7) AS median_price
        FROM o_pts p LEFT JOIN px_poi l ON l.kind = 'str' AND {H} <= 500 GROUP BY 1, 2""",
)
def g05(t):
    rows = kind(t, "str")
    layer = spatial.point_layer(rows, "lat", "lon", {"s": F.sum("price"), "c": F.count("price")})
    sums = spatial.aggregate_within(
        t.locations, layer, 500.0, {"mean_price": F.sum("s") / F.sum("c"), "total_price": F.sum("s")}
    )
    mids = spatial.median_within(t.locations, rows, "price", "lat", "lon", 500.0, "median_price")
    return sums.join(mids, ["lat", "lon"]).select(
        "lat", "lon", F.round("mean_price", 7).alias("mean_price"), F.round("total_price", 6).alias("total_price"),
        F.round("median_price", 7).alias("median_price"),
    )


@query(
    "g06_routes_within",
    f"SELECT p.lat, p.lon, count(DISTINCT l.route_id) AS routes FROM o_pts p LEFT JOIN px_poi l ON l.kind = 'transit' AND {H} <= 400 GROUP BY 1, 2",
)
def g06(t):
    return spatial.distinct_within(t.locations, kind(t, "transit"), "route_id", 400.0, "routes")


@query(
    "g07_nearest_attribute",
    f"""SELECT lat, lon, poi_id, school_score FROM (SELECT p.lat, p.lon, l.poi_id, l.school_score,
          row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY {H}, l.poi_id) AS rn FROM o_pts p, px_poi l
          WHERE l.kind = 'school' AND {H} <= 10000) x WHERE rn = 1""",
)
def g07(t):
    layer = spatial.point_layer(kind(t, "school"), "lat", "lon", {"pick": F.min(F.struct("poi_id", "school_score"))})
    return spatial.nearest(t.locations, layer, payload=["pick"]).select("lat", "lon", "pick.poi_id", "pick.school_score")


_AREA = "(b.lat_max - b.lat_min) * (b.lon_max - b.lon_min) * cos(radians((b.lat_min + b.lat_max) / 2)) * pow(6371000.0 * pi() / 180.0, 2)"


@query(
    "g08_polygon_area_within",
    f"""SELECT p.lat, p.lon, round(coalesce(sum(CASE WHEN {box_dist('p.lat', 'p.lon')} <= 1000 THEN {_AREA} END), 0), 2) AS area_sqm
        FROM o_pts p, px_zone b GROUP BY 1, 2""",
)
def g08(t):
    polygons = spatial.as_layer(spatial.with_ring(t("px_zone")))
    out = spatial.polygon_area_within(t.locations, polygons, 1_000.0, "area_sqm")
    return out.withColumn("area_sqm", F.round("area_sqm", 2))


@query(
    "g09_area_of_point",
    """SELECT p.lat, p.lon, b.area_id, b.area_name, b.median_income FROM o_pts p
       LEFT JOIN px_area b ON p.lat >= b.lat_min AND p.lat < b.lat_max AND p.lon >= b.lon_min AND p.lon < b.lon_max
       QUALIFY row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY b.area_id) = 1""",
)
def g09(t):
    polygons = spatial.as_layer(spatial.with_ring(t("px_area")))
    return spatial.area_attributes(t.locations, polygons, "area_id", ["area_name", "median_income"])


_KNOWN = "(VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in K.AREA_NAMES.items()) + ") k(code, name)"
#: The names of areas as people write them: in other case, with more around, cut short, and of no known area.
_WRITTEN = """CASE pkey % 6 WHEN 0 THEN name WHEN 1 THEN '  ' || lower(name) || ' ' WHEN 2 THEN 'Upper ' || name || ' Village' WHEN 3 THEN substr(name, 1, 6)
  WHEN 4 THEN 'Nowhere ' || CAST(pkey % 9 AS STRING) ELSE upper(name) END"""


@query(
    "g09_area_code_of_name",
    f"""WITH w AS (SELECT DISTINCT {_WRITTEN} AS said FROM px_property JOIN {_KNOWN} ON code = neighbourhood_code),
       m AS (SELECT said, code, name, upper(name) = upper(trim(said)) AS same FROM w, {_KNOWN}
             WHERE contains(upper(name), upper(trim(said))) OR contains(upper(trim(said)), upper(name))),
       r AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY same DESC, length(name) DESC, code) AS rn FROM m)
       SELECT w.said AS written, r.code, r.name FROM w LEFT JOIN r ON r.said = w.said AND rn = 1""",
)
def g09n(t):
    """Area codes of written names: equal, else one within the other."""
    known = t.spark.createDataFrame(list(K.AREA_NAMES.items()), "neighbourhood_code string, name string")
    written = t("px_property").join(F.broadcast(known), "neighbourhood_code").selectExpr(f"{_WRITTEN} AS written").distinct()
    found = layers.area_code_of(F.col("written"))
    return written.select("written", found["code"].alias("code"), found["name"].alias("name"))


@query(
    "s17_j16_census_by_area",
    "SELECT pid, k.name AS area_name, " + ", ".join(f"v{i} AS {c}" for i, c in enumerate(layers.CENSUS_COLUMNS)) + " FROM o_universe u LEFT JOIN (VALUES "
    + ", ".join(f"('{c}', '{n}', " + ", ".join(f"{float(x)!r}::DOUBLE" for x in K.CENSUS_BY_AREA[n]) + ")" for c, n in K.AREA_NAMES.items())
    + ") k(code, name, " + ", ".join(f"v{i}" for i in range(len(layers.CENSUS_COLUMNS))) + ") ON k.code = u.neighbourhood_code",
)
def s17(t):
    """Census figures of every property's area."""
    return layers.join_census(t.universe).select("pid", "area_name", *layers.CENSUS_COLUMNS)


@query(
    "g10_g12_fixed_point_distance",
    f"""SELECT lat, lon, round({hav('lat', 'lon', '49.2827', '-123.1207')}, 3) AS dist_downtown_m,
        round({hav('lat', 'lon', '49.2856', '-123.1115')}, 3) AS dist_cbd_m FROM o_pts""",
)
def g10(t):
    out = spatial.location_features(t.locations)
    return out.withColumns({c: F.round(c, 3) for c in ("dist_downtown_m", "dist_cbd_m")})


_FAREA = _AREA


@query(
    "g11_match_footprints",
    f"""WITH c AS (SELECT p.lat, p.lon, b.footprint_id, {_FAREA} AS area,
          {hav('p.lat', 'p.lon', '(b.lat_min + b.lat_max) / 2', '(b.lon_min + b.lon_max) / 2')} AS d
          FROM o_pts p JOIN px_footprint b ON {box_dist('p.lat', 'p.lon')} <= 50),
        r AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY round(area, 3) DESC, round(d, 3), footprint_id) AS rn FROM c)
        SELECT p.lat, p.lon, r.footprint_id, round(r.area, 2) AS building_footprint_sqm FROM o_pts p LEFT JOIN r ON r.lat = p.lat AND r.lon = p.lon AND rn = 1""",
)
def g11(t):
    layer = spatial.as_layer(spatial.with_ring(t("px_footprint")))
    out = spatial.match_footprints(t.locations, layer)
    return out.withColumn("building_footprint_sqm", F.round("building_footprint_sqm", 2))


@query(
    "g13_p27_polygon_area",
    f"""SELECT b.zone_id, round({_AREA}, 2) AS area_sqm, round((lat_min + lat_max) / 2, 6) AS c_lat, round((lon_min + lon_max) / 2, 6) AS c_lon FROM px_zone b""",
)
def g13(t):
    rings = spatial.drop_degenerate(spatial.with_ring(t("px_zone")))
    c = geo.ring_centroid(F.col("ring"))
    return rings.select(
        "zone_id", F.round("area_sqm", 2).alias("area_sqm"), F.round(c["lat"], 6).alias("c_lat"), F.round(c["lon"], 6).alias("c_lon")
    )


@query(
    "p26_bounding_box",
    "SELECT poi_id FROM px_poi WHERE lat BETWEEN 49.22 AND 49.26 AND lon BETWEEN -123.15 AND -123.08",
)
def p26(t):
    return spatial.in_bounding_box(t("px_poi"), "lat", "lon", 49.22, -123.15, 49.26, -123.08).select("poi_id")


HS = hav("p.lat", "p.lon", "s.lat", "s.lon")


@query(
    "g14_transit_features",
    f"""SELECT p.lat, p.lon, round(min(CASE WHEN {HS} <= 10000 THEN {HS} END), 3) AS dist_nearest_transit_m,
          round(min(CASE WHEN s.stop_name LIKE 'Station%' AND {HS} <= 10000 THEN {HS} END), 3) AS dist_nearest_rail_m,
          count(*) FILTER ({HS} <= 400) AS transit_stops_400m, count(*) FILTER ({HS} <= 800) AS transit_stops_800m,
          coalesce(bool_or(s.stop_name LIKE 'Station%' AND {HS} <= 800), false) AS has_rail_800m
        FROM o_pts p, px_stops s GROUP BY 1, 2""",
)
def g14(t):
    out = spatial.transit_features(t.locations, t("px_stops"))
    return out.withColumns({c: F.round(c, 3) for c in ("dist_nearest_transit_m", "dist_nearest_rail_m")})


@query(
    "g15_school_features",
    f"""WITH x AS (SELECT p.lat, p.lon, l.poi_id, l.school_type, l.school_score, {H} AS d FROM o_pts p LEFT JOIN px_poi l ON l.kind = 'school' AND {H} <= 10000)
        SELECT lat, lon, round(min(d), 3) AS dist_nearest_school_m, (arg_min({{'s': school_score}}, d)).s AS nearest_school_score,
          round(min(d) FILTER (school_type IN ('Elementary', 'K-12')), 3) AS dist_nearest_elementary_m,
          round(min(d) FILTER (school_type IN ('Secondary', 'K-12')), 3) AS dist_nearest_secondary_m,
          arg_min(school_score, d) FILTER (school_type IN ('Secondary', 'K-12') AND school_score IS NOT NULL) AS nearest_secondary_score,
          count(*) FILTER (d <= 1000) AS schools_within_1km FROM x GROUP BY 1, 2""",
)
def g15(t):
    schools = kind(t, "school").withColumnRenamed("poi_id", "school_id")
    out = spatial.school_features(t.locations, schools)
    return out.withColumns({c: F.round(c, 3) for c in out.columns if c.startswith("dist_")})


@query(
    "g16_park_features",
    f"""SELECT p.lat, p.lon, round(min({H}), 3) AS dist_nearest_park_m, count(*) FILTER ({H} <= 500) AS parks_within_500m,
          any_value(a.park_area_within_1km_sqm) AS park_area_within_1km_sqm
        FROM o_pts p JOIN px_poi l ON l.kind = 'park' AND {H} <= 10000
        JOIN (SELECT p.lat, p.lon, round(coalesce(sum(CASE WHEN {box_dist('p.lat', 'p.lon')} <= 1000 THEN {_AREA} END), 0), 2) AS park_area_within_1km_sqm
              FROM o_pts p, px_zone b GROUP BY 1, 2) a ON a.lat = p.lat AND a.lon = p.lon GROUP BY 1, 2""",
)
def g16(t):
    out = spatial.park_features(t.locations, kind(t, "park"), spatial.with_ring(t("px_zone")))
    return out.withColumns(
        {"dist_nearest_park_m": F.round("dist_nearest_park_m", 3), "park_area_within_1km_sqm": F.round("park_area_within_1km_sqm", 2)}
    )


def _env(points: str) -> str:
    d = box_dist("p.lat", "p.lon")
    inside = "p.lat >= b.lat_min AND p.lat < b.lat_max AND p.lon >= b.lon_min AND p.lon < b.lon_max"
    return f"""z AS (SELECT p.lat, p.lon, bool_or(b.kind = 'alr' AND {inside}) AS in_alr,
          round(min(CASE WHEN b.kind = 'alr' AND {d} <= 10000 THEN {d} END), 3) AS dist_alr_m,
          bool_or(b.kind = 'floodplain' AND {inside}) AS in_floodplain,
          round(min(CASE WHEN b.kind = 'floodplain' AND {d} <= 10000 THEN {d} END), 3) AS dist_floodplain_m
        FROM {points} p, px_zone b GROUP BY 1, 2),
        c AS (SELECT p.lat, p.lon, count(*) FILTER ({H} <= 500) AS contaminated_sites_500m,
          round(min(CASE WHEN {H} <= 10000 THEN {H} END), 3) AS dist_nearest_contaminated_m
        FROM {points} p, px_poi l WHERE l.kind = 'contaminated' GROUP BY 1, 2)"""


@query(
    "g16_environmental_features",
    f"WITH {_env('o_pts')} SELECT z.*, c.contaminated_sites_500m, c.dist_nearest_contaminated_m FROM z JOIN c ON z.lat = c.lat AND z.lon = c.lon",
)
def g16b(t):
    out = spatial.environmental_features(t.locations, zones(t, "alr"), zones(t, "floodplain"), kind(t, "contaminated"))
    return out.withColumns({c: F.round(c, 3) for c in out.columns if c.startswith("dist_")})


@query(
    "g17_rental_features",
    f"""SELECT p.lat, p.lon, count(l.poi_id) AS str_count_500m, round(avg(l.price), 7) AS str_avg_price_500m,
          round(count(l.poi_id) / (pi() * 0.25), 7) AS str_density_per_km2
        FROM o_pts p LEFT JOIN px_poi l ON l.kind = 'str' AND {H} <= 500 GROUP BY 1, 2""",
)
def g17(t):
    out = spatial.rental_features(t.locations, kind(t, "str"))
    return out.withColumns({c: F.round(c, 7) for c in ("str_avg_price_500m", "str_density_per_km2")})


@query(
    "g18_rental_profile",
    f"""SELECT p.lat, p.lon, count(l.poi_id) AS str_count, round(avg(l.price), 7) AS avg_price, round(median(l.price), 7) AS median_price,
          count(*) FILTER (l.room_type = 'Entire home/apt') AS entire_homes, count(*) FILTER (l.room_type = 'Private room') AS private_rooms,
          round(avg(l.number_of_reviews), 7) AS avg_reviews, round(avg(l.availability_365), 7) AS avg_availability
        FROM o_rpts p LEFT JOIN px_poi l ON l.kind = 'str' AND {H} <= 500 GROUP BY 1, 2""",
)
def g18(t):
    out = spatial.rental_profile(request_points(t), kind(t, "str"))
    return out.withColumns({c: F.round(c, 7) for c in ("avg_price", "median_price", "avg_reviews", "avg_availability")})


@query(
    "g19_risk_profile",
    f"""WITH {_env('o_rpts')} SELECT z.lat, z.lon, in_alr, in_floodplain, contaminated_sites_500m,
          concat_ws(',', CASE WHEN in_alr THEN 'alr' END, CASE WHEN in_floodplain THEN 'floodplain' END,
            CASE WHEN contaminated_sites_500m > 0 THEN 'contamination' END) AS risks,
          CAST(in_alr AS INT) + CAST(in_floodplain AS INT) + CASE WHEN contaminated_sites_500m > 0 THEN 1 ELSE 0 END AS risk_count
        FROM z JOIN c ON z.lat = c.lat AND z.lon = c.lon""",
)
def g19(t):
    out = spatial.risk_profile(request_points(t), zones(t, "alr"), zones(t, "floodplain"), kind(t, "contaminated"))
    return out.select(
        "lat", "lon", "in_alr", "in_floodplain", "contaminated_sites_500m",
        F.array_join("environmental_risks", ",").alias("risks"), "risk_count",
    )


@query(
    "g20_j13_school_proximity",
    f"""WITH x AS (SELECT p.lat, p.lon, l.school_score AS q, {H} AS d, row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY round({H}, 6), l.poi_id) AS rn
          FROM o_rpts p JOIN px_poi l ON l.kind = 'school' AND {H} <= 3000),
        s AS (SELECT lat, lon, min(d) AS m, count(*) FILTER (d <= 1000) AS c1, count(*) FILTER (d <= 2000) AS c2, avg(q) AS q FROM x WHERE rn <= 10 GROUP BY 1, 2)
        SELECT p.lat, p.lon, round(m, 3) AS nearest_school_m, coalesce(c1, 0) AS schools_within_1km, coalesce(c2, 0) AS schools_within_2km,
          round(q, 4) AS avg_quality,
          round(coalesce(least(CASE WHEN q IS NOT NULL THEN 0.6 * exp(-m / 1000) * 100 + 0.4 * q ELSE exp(-m / 1000) * 100 END, 100), 0), 4) AS proximity_score
        FROM o_rpts p LEFT JOIN s ON s.lat = p.lat AND s.lon = p.lon""",
)
def g20(t):
    schools = kind(t, "school").withColumnRenamed("poi_id", "school_id")
    out = spatial.school_proximity(request_points(t), schools)
    return out.withColumns(
        {"nearest_school_m": F.round("nearest_school_m", 3), "avg_quality": F.round("avg_quality", 4), "proximity_score": F.round("proximity_score", 4)}
    )


@query(
    "g21_transit_score",
    f"""WITH dep AS (SELECT stop_id, count(*) AS c FROM px_stop_times GROUP BY 1),
        sr AS (SELECT DISTINCT st.stop_id, r.route_id, r.route_type FROM px_stop_times st JOIN px_trips tr ON st.trip_id = tr.trip_id JOIN px_routes r ON tr.route_id = r.route_id),
        a AS (SELECT p.lat, p.lon, count(*) FILTER ({HS} <= 400) AS stops_400m, count(*) FILTER ({HS} <= 800) AS stops_800m,
           CAST(coalesce(sum(dep.c) FILTER ({HS} <= 400), 0) AS BIGINT) AS frequency_score,
           round(min({HS}) FILTER ({HS} <= 10000 AND s.stop_id IN (SELECT stop_id FROM sr WHERE route_type = 1)), 3) AS nearest_rail_m
          FROM o_rpts p, px_stops s LEFT JOIN dep USING (stop_id) GROUP BY 1, 2),
        b AS (SELECT p.lat, p.lon, count(DISTINCT sr.route_id) AS unique_routes_400m, count(DISTINCT sr.route_type) AS route_types_400m
          FROM o_rpts p JOIN px_stops s ON {HS} <= 400 JOIN sr USING (stop_id) GROUP BY 1, 2)
        SELECT a.*, coalesce(unique_routes_400m, 0) AS unique_routes_400m, coalesce(route_types_400m, 0) AS route_types_400m,
          coalesce(nearest_rail_m <= 800, false) AS has_rail_800m FROM a LEFT JOIN b ON a.lat = b.lat AND a.lon = b.lon""",
)
def g21(t):
    routes = match.stop_routes(t("px_stop_times"), t("px_trips"), t("px_routes"))
    out = spatial.transit_score(request_points(t), t("px_stops"), routes, t("px_stop_times"))
    return out.withColumn("nearest_rail_m", F.round("nearest_rail_m", 3))


@query(
    "g22_nearest_property",
    """WITH r AS (SELECT DISTINCT req_lat AS lat, req_lon AS lon, req_type AS property_type FROM px_request),
       x AS (SELECT r.*, u.pid, u.property_type = r.property_type AS same, sqrt(pow(r.lat - u.latitude, 2) + pow(r.lon - u.longitude, 2)) AS d
             FROM r, o_universe u),
       k AS (SELECT *, row_number() OVER (PARTITION BY lat, lon, property_type
               ORDER BY CASE WHEN same AND d < 0.002 THEN 0 ELSE 1 END, d, pid) AS rn FROM x)
       SELECT lat, lon, property_type, pid, same AND d < 0.002 AS same_type FROM k WHERE rn = 1""",
)
def g22(t):
    requests = t("px_request").select(F.col("req_lat").alias("lat"), F.col("req_lon").alias("lon"), F.col("req_type").alias("property_type"))
    return spatial.nearest_property(requests, t.universe)


@query("g23_feature_table")
def g23(t):
    from terravalor.plans.features import spatial_table

    return rounded(spatial.attach(t.universe, spatial_table(t)), 3)
