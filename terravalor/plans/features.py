"""Assembly of the enriched property table from the input views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravalor.operators import layers, spatial


def spatial_table(t) -> DataFrame:
    """All spatial groups per distinct property location."""
    poi = t("px_poi")

    def kind(name: str) -> DataFrame:
        return poi.where(F.col("kind") == name)

    def zone(name: str) -> DataFrame:
        return spatial.with_ring(t("px_zone").where(F.col("kind") == name))

    points = t.locations
    return spatial.feature_table(
        points,
        [
            spatial.transit_features(points, t("px_stops"), kind("transit")),
            spatial.school_features(points, kind("school").withColumnRenamed("poi_id", "school_id")),
            spatial.park_features(points, kind("park"), spatial.with_ring(t("px_zone"))),
            spatial.environmental_features(points, zone("alr"), zone("floodplain"), kind("contaminated")),
            spatial.location_features(points),
            spatial.rental_features(points, kind("str")),
        ],
    )


def enriched(t) -> DataFrame:
    """Served properties with spatial groups, census figures and their footprint."""
    from terravalor.session import materialize

    footprints = spatial.as_layer(spatial.with_ring(t("px_footprint")))
    table = spatial_table(t).join(spatial.match_footprints(t.locations, footprints), ["lat", "lon"], "left")
    props = layers.join_census(spatial.attach(t.properties, table))
    lots = t("px_property").select("pid", "lot_size_sqft")
    return materialize(props.join(lots, "pid", "left"))
