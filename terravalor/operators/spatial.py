"""Spatial operators over plain latitude and longitude columns.

Two rules keep them scalable. Points and layers are reduced to distinct
locations before they meet, so copies of a point never multiply pairs. And every
distance condition becomes an equi-join on cells, so no plan holds a nested-loop
join. Layers are written, so Spark knows their size and broadcasts only small ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions import geo
from terravalor.functions.quantiles import exact_percentiles
from terravalor.operators import polygons
from terravalor.operators.polygons import PolygonLayer
from terravalor.session import materialize, small_side, spread

WHOLE_EARTH_DEG = 402.5  # the longest way between two points in degrees
NEAREST_LIMIT_M = 10_000.0


def distinct_points(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return (
        df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .select(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
        .distinct()
    )


# ---- grids: metres on the sphere, or plain degrees ---------------------------------


class MetreGrid:
    unit = 100.0

    cell_sql = staticmethod(geo.cell_sql)

    @staticmethod
    def around_sql(lat: str, lon: str, r: float) -> str:
        return geo.cells_around_sql(lat, lat, lon, lon, r)

    beside_sql = staticmethod(geo.cells_beside_sql)
    distance = staticmethod(geo.haversine_m)


class DegreeGrid:
    unit = 0.001

    @staticmethod
    def cell_sql(lat: str, lon: str, r: float) -> str:
        return (
            f"named_struct('band', CAST(floor({lat} / {r!r}D) AS BIGINT), 'col', CAST(floor({lon} / {r!r}D) AS BIGINT))"
        )

    @staticmethod
    def around_sql(lat: str, lon: str, r: float) -> str:
        def near(x: str) -> str:
            return f"sequence(CAST(floor({x} / {r!r}D) AS BIGINT) - 1, CAST(floor({x} / {r!r}D) AS BIGINT) + 1)"

        return (
            f"flatten(transform({near(lat)}, b -> transform({near(lon)}, x -> named_struct('band', b, 'col', x))))"
        )

    @staticmethod
    def beside_sql(band: str, col: str, r: float) -> str:
        return f"flatten(transform(sequence({band} - 1, {band} + 1), b -> transform(sequence({col} - 1, {col} + 1), x -> named_struct('band', b, 'col', x))))"

    @staticmethod
    def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
        return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def _in_cell(df: DataFrame, cell_sql: str) -> DataFrame:
    """One row per cell of the given expression (an array is exploded): ``_band``, ``_col``."""
    return df.selectExpr("*", f"{cell_sql} AS _c").selectExpr("*", "_c.band AS _band", "_c.col AS _col").drop("_c")


# ---- layers --------------------------------------------------------------------------


@dataclass
class Layer:
    """A materialized layer."""

    df: DataFrame


def as_layer(df: DataFrame) -> Layer | PolygonLayer:
    """A written layer; one with rings is tessellated."""
    if "ring" in df.columns:
        return polygons.polygon_layer(df)
    return Layer(materialize(df))


def point_layer(df: DataFrame, lat: str, lon: str, aggs: dict[str, Column] | None = None, by: list[str] | None = None) -> Layer:
    """One row per distinct location (and ``by`` value): point count ``n`` plus the given aggregates."""
    keys = [F.col(lat).alias("l_lat"), F.col(lon).alias("l_lon"), *[F.col(b) for b in by or []]]
    columns = [F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in (aggs or {}).items()]]
    present = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    made = present.groupBy(*keys).agg(*columns)
    return as_layer(spread(made, "l_lat", "l_lon", *(by or [])))


# ---- cell join --------------------------------------------------------------------------


def pairs_within(points: DataFrame, layer: Layer, radius_m: float, by: list[str] | None = None) -> DataFrame:
    """Points (lat, lon) × layer locations no farther than the radius, with ``dist_m``.

    The point side keeps one cell; the layer side is repeated over the cells
    around it, so every pair meets exactly once.
    """
    left = _in_cell(points, geo.cell_sql("lat", "lon", radius_m))
    right = _in_cell(layer.df, f"explode({geo.cells_around_sql('l_lat', 'l_lat', 'l_lon', 'l_lon', radius_m)})")
    joined = left.join(right, ["_band", "_col", *(by or [])])
    dist = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("l_lat"), F.col("l_lon"))
    return joined.withColumn("dist_m", dist).where(F.col("dist_m") <= radius_m).drop("_band", "_col")


def nearest_within(points: DataFrame, layer: Layer, k: int, reach_m: float, tie: str) -> DataFrame:
    """The pairs of ``pairs_within`` of each point's k nearest layer rows, ties to the lower ``tie``.

    Circles grow fourfold; a point that has k rows in one goes no further, so a crowded place isn't
    met with all that lies within the reach.
    """
    w = Window.partitionBy("lat", "lon").orderBy(F.round("dist_m", 6), tie)
    left, out = points.select("lat", "lon"), []
    for radius in (reach_m / 16, reach_m / 4, reach_m):
        best = materialize(pairs_within(left, layer, radius).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn"))
        if radius == reach_m:
            return reduce(DataFrame.unionByName, [*out, best])
        # A row beyond the circle may tie with one on its edge, by rounding: the k lie clearly within it.
        full = best.where(F.col("dist_m") < radius - 0.001).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
        full = small_side(full.select("lat", "lon"))
        out.append(best.join(full, ["lat", "lon"], "left_semi"))
        left = materialize(spread(left.join(full, ["lat", "lon"], "left_anti"), "lat", "lon"))


def aggregate_within(points: DataFrame, layer: Layer, radius_m: float, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over layer locations within the radius; points without any keep nulls."""
    found = pairs_within(points, layer, radius_m).groupBy("lat", "lon").agg(*[c.alias(n) for n, c in aggs.items()])
    return points.select("lat", "lon").join(found, ["lat", "lon"], "left")


def count_within(points: DataFrame, layer: Layer, radius_m: float, name: str) -> DataFrame:
    out = aggregate_within(points, layer, radius_m, {name: F.sum("n")})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def counts_within(points: DataFrame, layer: Layer, radii: dict[str, float]) -> DataFrame:
    """Several radii from one join at the largest."""
    aggs = {name: F.sum(F.when(F.col("dist_m") <= r, F.col("n"))) for name, r in radii.items()}
    out = aggregate_within(points, layer, max(radii.values()), aggs)
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in radii})


def median_within(points: DataFrame, rows: DataFrame, value: str, lat: str, lon: str, radius_m: float, name: str) -> DataFrame:
    layer = point_layer(rows, lat, lon, by=[value])
    pairs = pairs_within(points, layer, radius_m).withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    mid = exact_percentiles(pairs, ["lat", "lon"], value, {name: 0.5}).drop("n")
    return points.select("lat", "lon").join(mid, ["lat", "lon"], "left")


# ---- nearest --------------------------------------------------------------------------------


def nearest(
    points: DataFrame,
    layer: Layer,
    limit: float = NEAREST_LIMIT_M,
    grid=MetreGrid,
    by: list[str] | None = None,
    payload: list[str] | None = None,
) -> DataFrame:
    """The nearest layer location per point: ``dist`` and the payload columns.

    Cell sizes grow fourfold. A point takes the finest level at which its cell or one beside it
    holds anything; whatever lies there is less than four cell sizes away, so one search a level
    up sees the true nearest. Dense places search small cells only, and one level is searched
    per point. A layer row has one cell a level; what is beside a cell is worked out from the
    occupied cells, not from rows. Ties go to the smallest payload.
    """
    by, payload = by or [], payload or []
    sizes = [grid.unit]
    while sizes[-1] < limit:
        sizes.append(sizes[-1] * 4)
    last = len(sizes) - 1

    def levels(cells) -> str:
        tagged = [
            f"transform({cells(r)}, c -> named_struct('lvl', {i}, 'band', c.band, 'col', c.col))"
            for i, r in enumerate(sizes)
        ]
        return f"explode(flatten(array({', '.join(tagged)}))) AS _c"

    def of_level(cells) -> str:
        each = " ".join(f"WHEN {i} THEN {cells(r)}" for i, r in enumerate(sizes))
        return f"explode(CASE lvl {each} END) AS _c"

    keep = [*by, *payload, "l_lat", "l_lon"]
    keys = ["lvl", "band", "col", *by]
    own = levels(lambda r: f"array({grid.cell_sql('l_lat', 'l_lon', r)})")
    placed = layer.df.selectExpr(*keep, own).selectExpr(*keep, "_c.lvl", "_c.band", "_c.col")
    beside = of_level(lambda r: grid.beside_sql("band", "col", r))
    occupied = placed.select(*keys).distinct().selectExpr("lvl", *by, beside).selectExpr("lvl", "_c.band", "_c.col", *by).distinct()

    place = ["lat", "lon", *by]
    mine = levels(lambda r: f"array({grid.cell_sql('lat', 'lon', r)})")
    level = (
        points.selectExpr(*place, mine)
        .selectExpr(*place, "_c.lvl", "_c.band", "_c.col")
        .join(occupied, keys, "left_semi")
        .groupBy(*place)
        .agg(F.min("lvl").alias("_found"))
        .withColumn("lvl", F.least(F.col("_found") + 1, F.lit(last)))
    )
    search = level.selectExpr(*place, "lvl", of_level(lambda r: grid.around_sql("lat", "lon", r))).selectExpr(*place, "lvl", "_c.band", "_c.col")
    dist = grid.distance(F.col("lat"), F.col("lon"), F.col("l_lat"), F.col("l_lon"))
    best = (
        search.join(placed, keys)
        .withColumn("dist", dist)
        .where(F.col("dist") <= limit)
        .groupBy("lat", "lon", *by)
        .agg(F.min(F.struct("dist", *payload)).alias("_b"))
    )
    return best.select("lat", "lon", *by, F.col("_b.dist").alias("dist"), *[F.col(f"_b.{p}").alias(p) for p in payload])


def nearest_distance(points: DataFrame, layer: Layer, name: str, limit: float = NEAREST_LIMIT_M) -> DataFrame:
    """Distance to the nearest layer point, null beyond the limit."""
    found = nearest(points, layer, limit).withColumnRenamed("dist", name)
    return points.select("lat", "lon").join(found, ["lat", "lon"], "left")


# ---- polygons ----------------------------------------------------------------------------------


def box_ring(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column) -> Column:
    def corner(lat: Column, lon: Column) -> Column:
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.array(
        corner(lat_min, lon_min), corner(lat_min, lon_max), corner(lat_max, lon_max), corner(lat_max, lon_min)
    )


def with_ring(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn(
        "ring", box_ring(F.col("lat_min"), F.col("lat_max"), F.col("lon_min"), F.col("lon_max"))
    )


def add_bounds(polygons: DataFrame) -> DataFrame:
    """Bounding columns of a ``ring`` column."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    return polygons.withColumns(
        {
            "lat_min": F.array_min(lats), "lat_max": F.array_max(lats),
            "lon_min": F.array_min(lons), "lon_max": F.array_max(lons),
        }
    )


def _holes(df: DataFrame) -> Column | None:
    """The holes of polygons that carry them."""
    return F.col("holes") if "holes" in df.columns else None


def drop_degenerate(polygons: DataFrame, minimum_sqm: float = 1.0) -> DataFrame:
    return polygons.withColumn("area_sqm", geo.area_sqm(F.col("ring"), _holes(polygons))).where(F.col("area_sqm") >= minimum_sqm)


def in_bounding_box(df: DataFrame, lat: str, lon: str, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def containing(points: DataFrame, layer: PolygonLayer) -> DataFrame:
    """(point, polygon's columns) for every polygon that holds the point."""
    return polygons.pairs_inside(points, layer).join(layer.attributes, "_poly").drop("_poly", "_area", "_centre")


def inside_any(points: DataFrame, layer: PolygonLayer, name: str) -> DataFrame:
    hit = polygons.pairs_inside(points, layer).select("lat", "lon").distinct().withColumn(name, F.lit(True))
    return points.select("lat", "lon").join(hit, ["lat", "lon"], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def area_attributes(points: DataFrame, layer: PolygonLayer, polygon_id: str, columns: list[str]) -> DataFrame:
    """Attributes of the containing polygon; the lowest id where polygons overlap."""
    first = containing(points, layer).groupBy("lat", "lon").agg(
        F.min(F.struct(polygon_id, *columns)).alias("_a")
    )
    return points.select("lat", "lon").join(first, ["lat", "lon"], "left").select(
        "lat", "lon", *[F.col(f"_a.{c}").alias(c) for c in [polygon_id, *columns]]
    )


def polygon_distance(points: DataFrame, layer: PolygonLayer, name: str, limit_m: float = NEAREST_LIMIT_M) -> DataFrame:
    """Distance to the nearest polygon, 0 inside, null beyond the limit.

    Searched at a tenth of the limit first; only points without a hit go on.
    """
    places = points.select("lat", "lon")
    inside = polygons.pairs_inside(places, layer).select("lat", "lon").distinct().withColumn(name, F.lit(0.0))

    def search(some: DataFrame, radius: float) -> DataFrame:
        return polygons.edge_distances(some, layer, radius).groupBy("lat", "lon").agg(F.min("_d").alias(name))

    known = materialize(inside)
    outside = materialize(places.join(known, ["lat", "lon"], "left_anti"))
    close = materialize(search(outside, limit_m / 10))
    rest = outside.join(close, ["lat", "lon"], "left_anti")
    return places.join(known.unionByName(close).unionByName(search(rest, limit_m)), ["lat", "lon"], "left")


def polygon_area_within(points: DataFrame, layer: PolygonLayer, radius_m: float, name: str) -> DataFrame:
    """Whole area of every polygon that touches the circle; 0 when none does."""
    near = polygons.pairs_touching(points, layer, radius_m).join(layer.attributes.select("_poly", "_area"), "_poly")
    total = near.groupBy("lat", "lon").agg(F.sum("_area").alias(name))
    return points.select("lat", "lon").join(total, ["lat", "lon"], "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(0.0))
    )


def match_footprints(points: DataFrame, footprints: PolygonLayer, radius_m: float = 50.0) -> DataFrame:
    """The footprint of a point: largest within reach, then nearest centroid, then lowest id."""
    known = footprints.attributes.select("_poly", "footprint_id", F.col("_area").alias("area_sqm"), F.col("_centre.lat").alias("_y"), F.col("_centre.lon").alias("_x"))
    near = polygons.pairs_touching(points, footprints, radius_m).join(known, "_poly")
    away = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_y"), F.col("_x")), 3)
    best = near.groupBy("lat", "lon").agg(
        F.min(F.struct((-F.round("area_sqm", 3)).alias("neg"), away.alias("d"), "footprint_id", "area_sqm")).alias("_b")
    )
    return points.select("lat", "lon").join(best, ["lat", "lon"], "left").select(
        "lat", "lon", F.col("_b.footprint_id").alias("footprint_id"),
        F.col("_b.area_sqm").alias("building_footprint_sqm"),
    )


# ---- feature groups --------------------------------------------------------------------------------


def rail_stops(stops: DataFrame) -> DataFrame:
    """Rail stops by route type, else by station name and parent flag, else by name."""
    if "route_type" in stops.columns:
        by_type = stops.where("route_type = 1")
        if not by_type.isEmpty():
            return by_type
    named = stops.where(F.lower("stop_name").contains("station"))
    if "location_type" in stops.columns:
        parents = named.where("location_type = 1")
        if not parents.isEmpty():
            return parents
    return named


def transit_features(points: DataFrame, stops: DataFrame, routes_at: DataFrame | None = None) -> DataFrame:
    """Nearest stop and rail station, stop counts, distinct routes, rail flag."""
    layer = point_layer(stops, "lat", "lon")
    rail = point_layer(rail_stops(stops), "lat", "lon")
    out = nearest_distance(points, layer, "dist_nearest_transit_m")
    out = out.join(nearest_distance(points, rail, "dist_nearest_rail_m"), ["lat", "lon"])
    out = out.join(counts_within(points, layer, {"transit_stops_400m": 400.0, "transit_stops_800m": 800.0}), ["lat", "lon"])
    if routes_at is not None:
        out = out.join(distinct_within(points, routes_at, "route_id", 400.0, "unique_routes_400m"), ["lat", "lon"])
    return out.withColumn("has_rail_800m", F.coalesce(F.col("dist_nearest_rail_m") <= 800, F.lit(False)))


def distinct_within(points: DataFrame, rows: DataFrame, value: str, radius_m: float, name: str) -> DataFrame:
    layer = point_layer(rows.where(F.col(value).isNotNull()), "lat", "lon", by=[value])
    out = aggregate_within(points, layer, radius_m, {name: F.count_distinct(F.col(value))})
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def school_features(points: DataFrame, schools: DataFrame) -> DataFrame:
    """Nearest of any, elementary and secondary kind, their scores, count within 1 km."""
    kind = F.lower(F.col("school_type"))
    any_layer = point_layer(schools, "lat", "lon", {"pick": F.min(F.struct("school_id", "school_score"))})
    elementary = point_layer(schools.where(kind.rlike("elementary|k-")), "lat", "lon")
    secondary = point_layer(schools.where(kind.rlike("secondary|high|k-12")), "lat", "lon")
    scored = point_layer(
        schools.where(kind.rlike("secondary|high|k-12") & F.col("school_score").isNotNull()),
        "lat", "lon", {"pick": F.min(F.struct("school_id", "school_score"))},
    )
    out = nearest(points, any_layer, payload=["pick"]).select(
        "lat", "lon", F.col("dist").alias("dist_nearest_school_m"), F.col("pick.school_score").alias("nearest_school_score")
    )
    out = points.select("lat", "lon").join(out, ["lat", "lon"], "left")
    out = out.join(nearest_distance(points, elementary, "dist_nearest_elementary_m"), ["lat", "lon"])
    out = out.join(nearest_distance(points, secondary, "dist_nearest_secondary_m"), ["lat", "lon"])
    best = nearest(points, scored, payload=["pick"]).select("lat", "lon", F.col("pick.school_score").alias("nearest_secondary_score"))
    out = out.join(best, ["lat", "lon"], "left")
    return out.join(count_within(points, any_layer, 1_000.0, "schools_within_1km"), ["lat", "lon"])


def park_features(points: DataFrame, parks: DataFrame, park_polygons: DataFrame | None = None) -> DataFrame:
    layer = point_layer(parks, "lat", "lon")
    out = nearest_distance(points, layer, "dist_nearest_park_m").join(
        count_within(points, layer, 500.0, "parks_within_500m"), ["lat", "lon"]
    )
    if park_polygons is not None:
        out = out.join(polygon_area_within(points, as_layer(park_polygons), 1_000.0, "park_area_within_1km_sqm"), ["lat", "lon"])
    return out


def environmental_features(points: DataFrame, protected: DataFrame, flood: DataFrame, contaminated: DataFrame) -> DataFrame:
    alr, fp = as_layer(protected), as_layer(flood)
    sites = point_layer(contaminated, "lat", "lon")
    out = inside_any(points, alr, "in_alr")
    out = out.join(polygon_distance(points, alr, "dist_alr_m"), ["lat", "lon"])
    out = out.join(inside_any(points, fp, "in_floodplain"), ["lat", "lon"])
    out = out.join(polygon_distance(points, fp, "dist_floodplain_m"), ["lat", "lon"])
    out = out.join(count_within(points, sites, 500.0, "contaminated_sites_500m"), ["lat", "lon"])
    return out.join(nearest_distance(points, sites, "dist_nearest_contaminated_m"), ["lat", "lon"])


def rental_features(points: DataFrame, rentals: DataFrame) -> DataFrame:
    """Short-term rentals within 500 m: count, density per km², mean price."""
    layer = point_layer(rentals, "lat", "lon", {"price_sum": F.sum("price"), "price_n": F.count("price")})
    out = aggregate_within(
        points, layer, 500.0,
        {"str_count_500m": F.sum("n"), "str_avg_price_500m": F.sum("price_sum") / F.when(F.sum("price_n") > 0, F.sum("price_n"))},
    ).withColumn("str_count_500m", F.coalesce("str_count_500m", F.lit(0)))
    return out.withColumn("str_density_per_km2", F.col("str_count_500m") / F.lit(3.141592653589793 * 0.25))


def location_features(points: DataFrame) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return points.select(
        "lat", "lon",
        geo.haversine_m(lat, lon, F.lit(K.DOWNTOWN[0]), F.lit(K.DOWNTOWN[1])).alias("dist_downtown_m"),
        geo.haversine_m(lat, lon, F.lit(K.CBD[0]), F.lit(K.CBD[1])).alias("dist_cbd_m"),
    )


def feature_table(points: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """All groups side by side, one row per distinct location."""
    out = points.select("lat", "lon")
    for group in groups:
        out = out.join(group, ["lat", "lon"], "left")
    return out


def attach(props: DataFrame, features: DataFrame) -> DataFrame:
    """Features of the location onto every property; rows without a point keep nulls."""
    renamed = features.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    return props.join(renamed, ["latitude", "longitude"], "left")


# ---- request-point profiles ----------------------------------------------------------------------------


def school_proximity(points: DataFrame, schools: DataFrame, k: int = 10, reach_m: float = 3_000.0) -> DataFrame:
    """Score from the nearest school's distance and the quality of the k nearest."""
    layer = point_layer(schools, "lat", "lon", {"q": F.avg("school_score")}, by=["school_id"])
    stats = nearest_within(points, layer, k, reach_m, "school_id").groupBy("lat", "lon").agg(
        F.min("dist_m").alias("nearest_school_m"),
        F.count_if(F.col("dist_m") <= 1_000).alias("schools_within_1km"),
        F.count_if(F.col("dist_m") <= 2_000).alias("schools_within_2km"),
        F.avg("q").alias("avg_quality"),
    )
    by_distance = F.exp(-F.col("nearest_school_m") / 1_000.0) * 100
    score = F.when(F.col("avg_quality").isNotNull(), 0.6 * by_distance + 0.4 * F.col("avg_quality")).otherwise(by_distance)
    out = points.select("lat", "lon").join(stats, ["lat", "lon"], "left")
    return out.withColumns(
        {
            "proximity_score": F.coalesce(F.least(score, F.lit(100.0)), F.lit(0.0)),
            "schools_within_1km": F.coalesce("schools_within_1km", F.lit(0)),
            "schools_within_2km": F.coalesce("schools_within_2km", F.lit(0)),
        }
    )


def rental_profile(points: DataFrame, rentals: DataFrame, radius_m: float = 500.0) -> DataFrame:
    rooms = F.col("room_type")
    layer = point_layer(
        rentals, "lat", "lon",
        {
            "price_sum": F.sum("price"), "entire": F.count_if(rooms == "Entire home/apt"),
            "private": F.count_if(rooms == "Private room"), "reviews": F.sum("number_of_reviews"),
            "available": F.sum("availability_365"),
        },
    )
    out = aggregate_within(
        points, layer, radius_m,
        {
            "str_count": F.sum("n"), "avg_price": F.sum("price_sum") / F.sum("n"), "entire_homes": F.sum("entire"),
            "private_rooms": F.sum("private"), "avg_reviews": F.sum("reviews") / F.sum("n"),
            "avg_availability": F.sum("available") / F.sum("n"),
        },
    )
    mid = median_within(points, rentals, "price", "lat", "lon", radius_m, "median_price")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("str_count", "entire_homes", "private_rooms")}
    return out.withColumns(zero).join(mid, ["lat", "lon"])


def risk_profile(points: DataFrame, protected: DataFrame, flood: DataFrame, contaminated: DataFrame) -> DataFrame:
    f = environmental_features(points, protected, flood, contaminated)
    risks = F.array_compact(
        F.array(
            F.when(F.col("in_alr"), F.lit("alr")), F.when(F.col("in_floodplain"), F.lit("floodplain")),
            F.when(F.col("contaminated_sites_500m") > 0, F.lit("contamination")),
        )
    )
    return f.withColumn("environmental_risks", risks).withColumn("risk_count", F.size("environmental_risks"))


def transit_score(points: DataFrame, stops: DataFrame, stop_routes: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stops, routes, route types and departures near request points."""
    departures = stop_times.groupBy("stop_id").agg(F.count(F.lit(1)).alias("departures"))
    here = stops.join(departures, "stop_id", "left")
    layer = point_layer(here, "lat", "lon", {"dep": F.sum(F.coalesce("departures", F.lit(0)))})
    out = aggregate_within(
        points, layer, 800.0,
        {
            "stops_400m": F.sum(F.when(F.col("dist_m") <= 400, F.col("n"))), "stops_800m": F.sum("n"),
            "frequency_score": F.sum(F.when(F.col("dist_m") <= 400, F.col("dep"))),
        },
    ).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("stops_400m", "stops_800m", "frequency_score")})
    served = stops.select("stop_id", "lat", "lon").join(stop_routes, "stop_id")
    routes = distinct_within(points, served, "route_id", 400.0, "unique_routes_400m")
    kinds = distinct_within(points, served, "route_type", 400.0, "route_types_400m")
    rail_ids = stop_routes.where("route_type = 1").select("stop_id").distinct()
    rail = point_layer(stops.join(rail_ids, "stop_id", "left_semi"), "lat", "lon")
    out = out.join(routes, ["lat", "lon"]).join(kinds, ["lat", "lon"])
    out = out.join(nearest_distance(points, rail, "nearest_rail_m"), ["lat", "lon"])
    return out.withColumn("has_rail_800m", F.coalesce(F.col("nearest_rail_m") <= 800, F.lit(False)))


def nearest_property(requests: DataFrame, props: DataFrame, same_type_deg: float = 0.002) -> DataFrame:
    """Nearest property per (lat, lon, property_type) request, however far; the same type wins if close by."""
    usable = props.where(F.col("latitude").isNotNull())
    any_layer = point_layer(usable, "latitude", "longitude", {"pid": F.min("pid")})
    typed = point_layer(usable, "latitude", "longitude", {"pid": F.min("pid")}, by=["property_type"])
    places = requests.select("lat", "lon", "property_type").distinct()
    same = nearest(places, typed, same_type_deg, DegreeGrid, by=["property_type"], payload=["pid"])
    closest = nearest(places.select("lat", "lon").distinct(), any_layer, WHOLE_EARTH_DEG, DegreeGrid, payload=["pid"])
    return (
        places.join(closest.select("lat", "lon", F.col("pid").alias("_any")), ["lat", "lon"], "left")
        .join(
            same.where(F.col("dist") < same_type_deg).select("lat", "lon", "property_type", F.col("pid").alias("_same")),
            ["lat", "lon", "property_type"], "left",
        )
        .select("lat", "lon", "property_type", F.coalesce("_same", "_any").alias("pid"), F.col("_same").isNotNull().alias("same_type"))
    )
