"""A tessellated polygon layer: cells decide what lies inside, edges how far the rest is.

A polygon is cut into cells of a size that suits it. A cell that no edge crosses is
wholly inside or outside, so its points are decided by the cell alone. A cell on
the boundary carries the edges that cross it and whether one corner of it is
inside: a point there is joined to that corner by two straight ways within the
cell, and each crossing changes sides. No ring ever meets a point, and a long
coast is as many rows as it has edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor.functions import geo
from terravalor.session import materialize

#: Cell sizes in metres; a polygon takes the smallest that spans it in CELLS_ACROSS.
SIZES = tuple(250.0 * 4**i for i in range(7))
CELLS_ACROSS = 256
#: Edges longer than so many radii are searched in pieces.
LONG_EDGE = 8.0
#: Degrees by which an edge's columns are widened, against rounding on a cell's border.
SLACK = 1e-9


def _crossing_lon(e, lat: Column) -> Column:
    run = e("b_lat") - e("a_lat")
    return e("a_lon") + (lat - e("a_lat")) * (e("b_lon") - e("a_lon")) / F.when(run != 0, run)


def _field(c: Column):
    return lambda name: c[name]


@dataclass
class PolygonLayer:
    """Polygons as three written tables: attributes, edges and cells."""

    base: DataFrame

    @cached_property
    def attributes(self) -> DataFrame:
        """``_poly``, the polygon's own columns, its area without holes and the centroid of its outer ring."""
        return materialize(self.base.drop("ring", "holes", "_level"))

    @cached_property
    def edges(self) -> DataFrame:
        """``_poly``, ``_level`` and the ends of every edge of every ring."""
        rings = F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(self.base.schema["holes"].dataType)))
        every = self.base.select("_poly", "_level", F.explode(rings).alias("_ring"))
        cut = every.select("_poly", "_level", F.explode(geo.ring_edges(F.col("_ring"))).alias("e"))
        out = cut.select("_poly", "_level", F.col("e.a.lat").alias("a_lat"), F.col("e.a.lon").alias("a_lon"), F.col("e.b.lat").alias("b_lat"), F.col("e.b.lon").alias("b_lon"))
        return materialize(out.where("a_lat <> b_lat OR a_lon <> b_lon"))

    @cached_property
    def levels(self) -> list[int]:
        """The sizes in use."""
        return sorted(r._level for r in self.base.select("_level").distinct().collect())

    @cached_property
    def cells(self) -> DataFrame:
        """``_level``, ``_band``, ``_col``, ``_poly``, ``odd`` (its corner is inside) and ``edges``, null where the whole cell is inside."""
        each = [self._cells_of(i) for i in self.levels]
        empty = self.base.sparkSession.createDataFrame([], "_level int, _band long, _col long, _poly long, odd boolean, edges array<struct<a_lat:double,a_lon:double,b_lat:double,b_lon:double>>")
        return materialize(reduce(DataFrame.unionByName, each, empty))

    def _cells_of(self, level: int) -> DataFrame:
        deg = F.lit(SIZES[level] / geo.CELL_METRES_PER_DEGREE)
        low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
        bands = F.sequence(F.floor(low / deg), F.floor(high / deg))
        banded = self.edges.where(F.col("_level") == level).withColumn("_band", F.explode(bands))
        width = _width(F.col("_band"), SIZES[level])
        # The part of the edge in its band, and the columns it passes there.
        at = lambda y: F.coalesce(_crossing_lon(F.col, y), F.col("a_lon"))
        y0, y1 = F.greatest(low, F.col("_band") * deg), F.least(high, (F.col("_band") + 1) * deg)
        flat = F.col("a_lat") == F.col("b_lat")
        x0, x1 = F.when(flat, F.col("a_lon")).otherwise(at(y0)), F.when(flat, F.col("b_lon")).otherwise(at(y1))
        west, east = F.greatest(F.least(x0, x1), F.least("a_lon", "b_lon")), F.least(F.greatest(x0, x1), F.greatest("a_lon", "b_lon"))
        columns = F.sequence(F.floor((F.least(west, east) - SLACK) / width), F.floor((F.greatest(west, east) + SLACK) / width))
        corner = (F.col("_band") + 0.5) * deg
        spans = (F.col("a_lat") > corner) != (F.col("b_lat") > corner)
        passed = materialize(banded.withColumns({"_cols": columns, "_x": F.when(spans, _crossing_lon(F.col, corner))}))

        edge = F.struct("a_lat", "a_lon", "b_lat", "b_lon")
        boundary = passed.withColumn("_col", F.explode("_cols")).groupBy("_poly", "_band", "_col").agg(F.collect_list(edge).alias("edges"))
        rows = passed.groupBy("_poly", "_band").agg(F.min(F.array_min("_cols")).alias("_w"), F.max(F.array_max("_cols")).alias("_e"), F.collect_list("_x").alias("_xs"))
        across = rows.select("_poly", "_band", "_xs", F.explode(F.sequence("_w", "_e")).alias("_col"))
        odd = F.size(F.filter("_xs", lambda x: x > (F.col("_col") + 1) * width)) % 2 == 1
        whole = across.withColumn("odd", odd).drop("_xs").join(boundary, ["_poly", "_band", "_col"], "left")
        return whole.where(F.col("odd") | F.col("edges").isNotNull()).select(F.lit(level).alias("_level"), "_band", "_col", "_poly", "odd", "edges")


def _width(band: Column, size_m: float) -> Column:
    """Width of a band's columns in degrees, as ``geo.cell_sql`` has it."""
    deg = size_m / geo.CELL_METRES_PER_DEGREE
    far = F.least(F.greatest(F.abs(band), F.abs(band + 1)) * deg, F.lit(85.0))
    return F.lit(deg) / F.cos(F.radians(far))


def polygon_layer(polygons: DataFrame) -> PolygonLayer:
    """A layer of a table with ``ring`` and, where polygons have them, ``holes``; holes don't overlap."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    tall = (F.array_max(lats) - F.array_min(lats)) * geo.METRES_PER_DEGREE
    wide = (F.array_max(lons) - F.array_min(lons)) * geo.METRES_PER_DEGREE * F.cos(F.radians(F.least(F.array_min(F.transform(lats, F.abs)), F.lit(85.0))))
    span = F.greatest(tall, wide)
    level = F.lit(len(SIZES) - 1)
    for i in reversed(range(len(SIZES) - 1)):
        level = F.when(span <= SIZES[i] * CELLS_ACROSS, F.lit(i)).otherwise(level)
    holes = F.col("holes") if "holes" in polygons.columns else F.lit(None).cast("array<array<struct<lat:double,lon:double>>>")
    with_holes = polygons.withColumn("holes", holes)
    made = {
        "_poly": F.monotonically_increasing_id(), "_level": level, "_area": geo.area_sqm(F.col("ring"), F.col("holes")), "_centre": geo.ring_centroid(F.col("ring")),
    }
    return PolygonLayer(materialize(with_holes.where(F.size("ring") >= 3).withColumns(made)))


def _crossings(edges: Column, lat: Column, lon: Column, corner_lat: Column, corner_lon: Column) -> Column:
    """How often the way from a point east to its cell's border, and along it to the corner, crosses an edge."""

    def passes(e: Column) -> Column:
        f = _field(e)
        at = _crossing_lon(f, lat)
        eastward = ((f("a_lat") > lat) != (f("b_lat") > lat)) & (lon < at) & (at <= corner_lon)
        run = f("b_lon") - f("a_lon")
        up = f("a_lat") + (corner_lon - f("a_lon")) * (f("b_lat") - f("a_lat")) / F.when(run != 0, run)
        along = ((f("a_lon") > corner_lon) != (f("b_lon") > corner_lon)) & ((lat >= up) != (corner_lat >= up))
        return F.when(eastward, 1).otherwise(0) + F.when(along, 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + passes(e))


def pairs_inside(points: DataFrame, layer: PolygonLayer) -> DataFrame:
    """(lat, lon, ``_poly``) for every polygon that holds the point; lower and left edges count as inside."""
    out = []
    for level in layer.levels:
        size = SIZES[level]
        deg = size / geo.CELL_METRES_PER_DEGREE
        placed = points.selectExpr("lat", "lon", f"{geo.cell_sql('lat', 'lon', size)} AS _c").selectExpr("lat", "lon", "_c.band AS _band", "_c.col AS _col")
        met = placed.join(layer.cells.where(F.col("_level") == level), ["_band", "_col"])
        corner_lat, corner_lon = (F.col("_band") + 0.5) * F.lit(deg), (F.col("_col") + 1) * _width(F.col("_band"), size)
        sides = _crossings(F.col("edges"), F.col("lat"), F.col("lon"), corner_lat, corner_lon) + F.col("odd").cast("int")
        out.append(met.where(F.col("edges").isNull() | (sides % 2 == 1)).select("lat", "lon", "_poly"))
    return reduce(DataFrame.unionByName, out, points.limit(0).select("lat", "lon", F.lit(0).cast("long").alias("_poly")))


def edge_distances(points: DataFrame, layer: PolygonLayer, radius_m: float) -> DataFrame:
    """(lat, lon, ``_poly``, ``_d``): least distance to the edges of every polygon with one within the radius."""
    reach = radius_m * LONG_EDGE
    length = geo.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    pieces = F.greatest(F.lit(1), F.ceil(length / F.lit(reach))).cast("int")
    cut = layer.edges.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def end(axis: str, i: Column) -> Column:
        a, b = F.col(f"a_{axis}"), F.col(f"b_{axis}")
        return F.when(i == 0, a).when(i == F.col("_n"), b).otherwise(a + (b - a) * i / F.col("_n"))

    short = cut.select(
        "_poly", end("lat", F.col("_i")).alias("p_lat"), end("lon", F.col("_i")).alias("p_lon"), end("lat", F.col("_i") + 1).alias("q_lat"), end("lon", F.col("_i") + 1).alias("q_lon")
    )
    around = geo.cells_around_sql("least(p_lat, q_lat)", "greatest(p_lat, q_lat)", "least(p_lon, q_lon)", "greatest(p_lon, q_lon)", radius_m)
    right = short.selectExpr("*", f"explode({around}) AS _c").selectExpr("*", "_c.band AS _band", "_c.col AS _col").drop("_c")
    left = points.selectExpr("lat", "lon", f"{geo.cell_sql('lat', 'lon', radius_m)} AS _c").selectExpr("lat", "lon", "_c.band AS _band", "_c.col AS _col")
    d = geo.segment_distance_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"), F.col("q_lat"), F.col("q_lon"))
    near = left.join(right, ["_band", "_col"]).withColumn("_d", d).where(F.col("_d") <= radius_m)
    return near.groupBy("lat", "lon", "_poly").agg(F.min("_d").alias("_d"))


def pairs_touching(points: DataFrame, layer: PolygonLayer, radius_m: float) -> DataFrame:
    """(lat, lon, ``_poly``) for every polygon that comes within the radius of the point, once."""
    near = edge_distances(points, layer, radius_m).select("lat", "lon", "_poly")
    return near.unionByName(pairs_inside(points, layer)).distinct()
