"""Distances, cells and polygon formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
# Metres per degree of latitude, rounded down so that a cell is never narrower
# than the radius it stands for.
CELL_METRES_PER_DEGREE = 110_000.0
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


# ---- cells -------------------------------------------------------------------
# A cell is (band of latitude, column within the band). Column width depends on
# the band only, so both sides of a join agree on it at every latitude. The
# expressions are SQL text over column names: one parse instead of many calls.


def _d(x: float) -> str:
    return f"{x!r}D"


def _degrees(radius_m: float) -> str:
    return _d(radius_m / CELL_METRES_PER_DEGREE)


def _band(lat: str, deg: str) -> str:
    return f"CAST(floor(({lat}) / {deg}) AS BIGINT)"


def _column_width(band: str, deg: str) -> str:
    return f"({deg} / cos(radians(least(greatest(abs({band}), abs({band} + 1)) * {deg}, 85D))))"


def cell_sql(lat: str, lon: str, radius_m: float) -> str:
    """The cell of a point, as struct<band, col>."""
    deg = _degrees(radius_m)
    band = _band(lat, deg)
    return f"named_struct('band', {band}, 'col', CAST(floor(({lon}) / {_column_width(band, deg)}) AS BIGINT))"


def cells_around_sql(lat_min: str, lat_max: str, lon_min: str, lon_max: str, radius_m: float) -> str:
    """All cells that can hold a point within the radius of a box (or a point)."""
    deg = _degrees(radius_m)
    reach = f"({deg} / cos(radians(least(greatest(abs({lat_min}), abs({lat_max})) + {deg}, 85D))))"
    width = _column_width("b", deg)
    bands = f"sequence({_band(f'{lat_min} - {deg}', deg)}, {_band(f'{lat_max} + {deg}', deg)})"
    columns = (
        f"sequence(CAST(floor(({lon_min} - {reach}) / {width}) AS BIGINT), "
        f"CAST(floor(({lon_max} + {reach}) / {width}) AS BIGINT))"
    )
    return f"flatten(transform({bands}, b -> transform({columns}, x -> named_struct('band', b, 'col', x))))"


def cells_beside_sql(band: str, col: str, radius_m: float) -> str:
    """The cell (band, col) and all that can hold a point within the radius of one of its points."""
    deg = _degrees(radius_m)
    width = _column_width(band, deg)
    inner = 1e-9  # a cell ends before the next one begins
    return cells_around_sql(f"({band} + {_d(inner)}) * {deg}", f"({band} + {_d(1 - inner)}) * {deg}", f"({col} + {_d(inner)}) * {width}", f"({col} + {_d(1 - inner)}) * {width}", radius_m)


def cells_of_box_sql(lat: str, lon: str, radius_m: float, cell_m: float) -> str:
    """Cells of one size that cover the circle of another size around a point."""
    deg, reach = _degrees(cell_m), _degrees(radius_m)
    wide = f"({reach} / cos(radians(least(abs({lat}) + {reach}, 85D))))"
    width = _column_width("b", deg)
    bands = f"sequence({_band(f'{lat} - {reach}', deg)}, {_band(f'{lat} + {reach}', deg)})"
    columns = (
        f"sequence(CAST(floor(({lon} - {wide}) / {width}) AS BIGINT), CAST(floor(({lon} + {wide}) / {width}) AS BIGINT))"
    )
    return f"flatten(transform({bands}, b -> transform({columns}, x -> named_struct('band', b, 'col', x))))"


# ---- polygons: ring = array<struct<lat, lon>>, last point need not repeat ------


def ring_edges(ring: Column) -> Column:
    """array<struct<a, b>> of consecutive corners, closed."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def inside_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting; lower and left edges count as inside."""

    def crosses(e: Column) -> Column:
        spans = (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
        run = e["b"]["lat"] - e["a"]["lat"]
        at = e["a"]["lon"] + (lat - e["a"]["lat"]) * (e["b"]["lon"] - e["a"]["lon"]) / F.when(
            run != 0, run
        )
        return F.when(spans & (lon < at), 1).otherwise(0)

    return (F.aggregate(ring_edges(ring), F.lit(0), lambda acc, e: acc + crosses(e)) % 2) == 1


def segment_distance_m(
    lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column
) -> Column:
    """Distance to a segment on a plane tangent at the point."""
    k = F.cos(F.radians(lat))
    ax, ay = (a_lon - lon) * k, a_lat - lat
    bx, by = (b_lon - lon) * k, b_lat - lat
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.least(F.greatest(-(ax * dx + ay * dy) / len2, F.lit(0.0)), F.lit(1.0)))
    t = F.coalesce(t, F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py) * METRES_PER_DEGREE


def ring_distance_m(lat: Column, lon: Column, ring: Column) -> Column:
    """Distance to the ring's area: 0 inside, else to the nearest edge."""
    nearest = F.array_min(
        F.transform(
            ring_edges(ring),
            lambda e: segment_distance_m(
                lat, lon, e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]
            ),
        )
    )
    return F.when(inside_ring(lat, lon, ring), 0.0).otherwise(nearest)


def inside_area(lat: Column, lon: Column, ring: Column, holes: Column | None = None) -> Column:
    """Inside the outer ring and in none of the holes (an array of rings; null for none)."""
    inside = inside_ring(lat, lon, ring)
    if holes is None:
        return inside
    return inside & ~F.coalesce(F.exists(holes, lambda h: inside_ring(lat, lon, h)), F.lit(False))


def area_distance_m(lat: Column, lon: Column, ring: Column, holes: Column | None = None) -> Column:
    """Distance to an area with holes: 0 inside, else to the nearest edge of any of its rings."""
    if holes is None:
        return ring_distance_m(lat, lon, ring)
    in_hole = F.filter(F.coalesce(holes, F.array().cast("array<array<struct<lat:double,lon:double>>>")), lambda h: inside_ring(lat, lon, h))
    edge = lambda r: F.array_min(
        F.transform(ring_edges(r), lambda e: segment_distance_m(lat, lon, e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]))
    )
    return F.when(inside_ring(lat, lon, ring) & (F.size(in_hole) > 0), F.array_min(F.transform(in_hole, edge))).otherwise(ring_distance_m(lat, lon, ring))


def area_sqm(ring: Column, holes: Column | None = None) -> Column:
    """Area of the outer ring without its holes."""
    if holes is None:
        return ring_area_sqm(ring)
    return ring_area_sqm(ring) - F.coalesce(F.aggregate(holes, F.lit(0.0), lambda s, h: s + ring_area_sqm(h)), F.lit(0.0))


def ring_mean_lat(ring: Column) -> Column:
    return F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)


def ring_area_sqm(ring: Column) -> Column:
    """Shoelace area on a plane scaled at the ring's mean latitude."""
    k = F.cos(F.radians(ring_mean_lat(ring)))
    o_lat, o_lon = ring[0]["lat"], ring[0]["lon"]  # relative to a corner: no cancellation
    cross = F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda s, e: s
        + (
            (e["a"]["lon"] - o_lon) * (e["b"]["lat"] - o_lat)
            - (e["b"]["lon"] - o_lon) * (e["a"]["lat"] - o_lat)
        ),
    )
    return F.abs(cross) / 2 * k * METRES_PER_DEGREE * METRES_PER_DEGREE


def ring_centroid(ring: Column) -> Column:
    """Area centroid as struct<lat, lon>, relative to the first corner for precision."""
    o_lat, o_lon = ring[0]["lat"], ring[0]["lon"]

    def add(s: Column, e: Column) -> Column:
        ay, ax = e["a"]["lat"] - o_lat, e["a"]["lon"] - o_lon
        by, bx = e["b"]["lat"] - o_lat, e["b"]["lon"] - o_lon
        c = ax * by - bx * ay
        return F.struct(
            (s["a"] + c).alias("a"),
            (s["y"] + (ay + by) * c).alias("y"),
            (s["x"] + (ax + bx) * c).alias("x"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"))
    s = F.aggregate(ring_edges(ring), zero, add)
    base = F.when(s["a"] != 0, 3 * s["a"])
    return F.struct((o_lat + s["y"] / base).alias("lat"), (o_lon + s["x"] / base).alias("lon"))
