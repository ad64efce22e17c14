"""Constant reference layers of the library joined onto properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.operators import spatial
from terravalor.operators.polygons import PolygonLayer
from terravalor.session import fixed_table

CENSUS_COLUMNS = (
    "census_median_income", "census_pop_density", "census_pct_owner_occupied",
    "census_pct_immigrants", "census_pct_university",
)


def census_table(spark) -> DataFrame:
    rows = [(code, name, *K.CENSUS_BY_AREA[name]) for code, name in K.AREA_NAMES.items()]
    schema = "neighbourhood_code string, area_name string, " + ", ".join(f"{c} double" for c in CENSUS_COLUMNS)
    return fixed_table(spark, rows, schema)


def join_census(props: DataFrame) -> DataFrame:
    """Census figures of the area; properties of unknown areas keep nulls."""
    return props.join(census_table(props.sparkSession), "neighbourhood_code", "left")


def area_code_of(name: Column) -> Column:
    """struct<code, name> of the known area that a written name means; null for none.

    An equal name goes first, but for case and blanks around it; else a known name that holds it
    or is held by it, the longest of several, the lowest code of equally long ones. The known
    areas are a short constant list.
    """
    said = F.upper(F.trim(name))
    known = F.array(*[F.struct(F.lit(-len(n)).alias("o"), F.lit(c).alias("code"), F.lit(n).alias("name")) for c, n in K.AREA_NAMES.items()])
    equal = F.filter(known, lambda k: F.upper(k["name"]) == said)
    within = F.filter(known, lambda k: F.contains(F.upper(k["name"]), said) | F.contains(said, F.upper(k["name"])))
    best = F.when(F.size(equal) > 0, F.get(equal, F.lit(0))).when(F.size(within) > 0, F.array_min(within))
    return F.when(said != "", F.when(best.isNotNull(), F.struct(best["code"].alias("code"), best["name"].alias("name"))))


def area_of_points(points: DataFrame, areas: PolygonLayer, area_id: str = "area_id", name: str = "area_name") -> DataFrame:
    """(lat, lon) with the code and name of the area that holds the point: the boundary's own name where no code fits."""
    held = spatial.area_attributes(points, areas, area_id, [name])
    code = area_code_of(F.col(name))
    return held.select("lat", "lon", code["code"].alias("neighbourhood_code"), F.coalesce(code["name"], F.trim(F.col(name))).alias("neighbourhood_name"))


def corridor_table(spark) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(K.CORRIDORS)]
    return fixed_table(
        spark, rows,
        "corridor_id int, corridor string, lat_min double, lat_max double, lon_min double, lon_max double, base_premium double",
    )


def project_table(spark) -> DataFrame:
    return fixed_table(
        spark, [tuple(p) for p in K.PROJECTS],
        "project string, p_lat double, p_lon double, units int, tenure string, status string",
    )


def station_table(spark) -> DataFrame:
    return fixed_table(spark, list(K.STATIONS), "s_lat double, s_lon double")
