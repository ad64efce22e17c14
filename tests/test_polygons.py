"""The tessellated layer against ray casting and plain edge distances."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravalor.functions import geo
from terravalor.operators import polygons, spatial

RINGS = "array<struct<lat:double,lon:double>>"


def star(dice, lat, lon, size, corners):
    """A ring with deep bays."""
    out = []
    for i in range(corners):
        a, r = 2 * math.pi * i / corners, size * dice.uniform(0.35, 1.0)
        out.append((lat + r * math.sin(a), lon + r * math.cos(a) * 1.5))
    return out


def layer_rows(dice):
    rows = [(i, star(dice, 49.2 + 0.1 * dice.random(), -123.2 + 0.2 * dice.random(), dice.choice([0.0005, 0.01, 0.05]), dice.choice([3, 7, 40])), None) for i in range(25)]
    big = star(dice, 49.25, -123.1, 0.3, 400)
    hole = [(49.25 + 0.05 * math.sin(a / 9), -123.1 + 0.05 * math.cos(a / 9)) for a in range(56)]
    rows.append((90, big, [hole]))
    rows.append((91, [(49.20, -123.15), (49.20, -123.05), (49.30, -123.05), (49.30, -123.15)], None))
    return rows


def test_cells_and_edges_agree_with_rings(spark):
    dice = random.Random(8)
    zones = spark.createDataFrame(layer_rows(dice), f"zone int, ring {RINGS}, holes array<{RINGS}>")
    places = [(49.1 + 0.3 * dice.random(), -123.4 + 0.5 * dice.random()) for _ in range(1500)]
    # On corners and edges of the box, and on places that many cells begin at.
    places += [(49.20, -123.15), (49.20, -123.10), (49.30, -123.10), (49.25, -123.05), (49.25, -123.15), (49.30, -123.05)]
    points = spark.createDataFrame(places, "lat double, lon double")
    layer = polygons.polygon_layer(zones)
    every = points.crossJoin(F.broadcast(zones)).withColumns({
        "inside": geo.inside_area(F.col("lat"), F.col("lon"), F.col("ring"), F.col("holes")), "d": geo.area_distance_m(F.col("lat"), F.col("lon"), F.col("ring"), F.col("holes")),
    }).select("lat", "lon", "zone", "inside", "d").collect()
    got = {(r.lat, r.lon, r.zone) for r in spatial.containing(points, layer).collect()}
    assert got == {(r.lat, r.lon, r.zone) for r in every if r.inside}
    near = polygons.pairs_touching(points, layer, 400.0).join(layer.attributes.select("_poly", "zone"), "_poly")
    assert {(r.lat, r.lon, r.zone) for r in near.collect()} == {(r.lat, r.lon, r.zone) for r in every if r.d <= 400.0}
    least: dict = {}
    for r in every:
        least[r.lat, r.lon] = min(least.get((r.lat, r.lon), math.inf), r.d)
    for r in spatial.polygon_distance(points, layer, "d", 3_000.0).collect():
        want = least[r.lat, r.lon]
        assert (r.d is None) == (want > 3_000.0) and (r.d is None or abs(r.d - want) < 1e-6)


def test_a_long_coast_is_cut_into_small_rows(spark):
    n = 100_000
    coast = spark.range(n).select(
        F.collect_list(F.struct((49.25 + 0.2 * F.sin(2 * math.pi * F.col("id") / n) * (1 + 0.02 * F.sin(F.col("id") * 0.7))).alias("lat"),
                                (-123.1 + 0.3 * F.cos(2 * math.pi * F.col("id") / n)).alias("lon"))).over(Window.orderBy("id").rowsBetween(-n, n)).alias("ring")
    ).limit(1).withColumn("zone", F.lit(1))
    layer = polygons.polygon_layer(coast)
    assert layer.edges.count() == n
    most, inner, rows = layer.cells.agg(F.max(F.size("edges")), F.count(F.when(F.col("edges").isNull(), 1)), F.count(F.lit(1))).first()
    assert most < n / 50 and inner > 0.5 * rows
    points = spark.createDataFrame([(49.25, -123.1), (49.25, -122.7), (49.05, -123.1), (49.449, -123.1)], "lat double, lon double")
    got = {(r.lat, r.lon): r.hit for r in spatial.inside_any(points, layer, "hit").collect()}
    ring = coast.crossJoin(F.broadcast(points)).select("lat", "lon", geo.inside_ring(F.col("lat"), F.col("lon"), F.col("ring")).alias("hit"))
    assert got == {(r.lat, r.lon): r.hit for r in ring.collect()}


def test_no_ring_is_broadcast_or_joined(spark, sf):
    from terravalor.plans.tables import Tables

    t = Tables(spark, sf)
    layer = spatial.as_layer(spatial.with_ring(t("px_zone")))
    plan = polygons.pairs_touching(t.locations, layer, 500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "ring" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_layers_hold_nothing(spark):
    points = spark.createDataFrame([(49.2, -123.1)], "lat double, lon double")
    empty = polygons.polygon_layer(spark.createDataFrame([], f"zone int, ring {RINGS}"))
    assert spatial.inside_any(points, empty, "hit").first().hit is False and spatial.polygon_distance(points, empty, "d").first().d is None


def test_nearest_is_that_of_all_pairs_at_any_density_and_latitude(spark):
    dice = random.Random(12)
    base = [(0.0, 0.0), (49.2, -123.1), (70.0, 20.0), (84.0, 50.0)]
    rows, asked = [], []
    for lat, lon in base:
        rows += [(lat + dice.gauss(0, s), lon + dice.gauss(0, 2 * s)) for s in (0.0005, 0.01, 0.05) for _ in range(40)]
        asked += [(lat + dice.gauss(0, s), lon + dice.gauss(0, 2 * s)) for s in (0.001, 0.02, 0.1) for _ in range(40)]
    places = spark.createDataFrame(rows, "y double, x double")
    points = spark.createDataFrame(asked, "lat double, lon double")
    every = points.crossJoin(F.broadcast(places)).withColumn("d", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")))
    want = {(r.lat, r.lon): r.d for r in every.groupBy("lat", "lon").agg(F.min("d").alias("d")).collect()}
    got = spatial.nearest_distance(points, spatial.point_layer(places, "y", "x"), "d").collect()
    assert len(got) == len(want) and any(r.d is not None for r in got)
    for r in got:
        w = want[r.lat, r.lon]
        assert (r.d is None and w > spatial.NEAREST_LIMIT_M) or abs(r.d - w) < 1e-6
