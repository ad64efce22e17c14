"""Readers for landed files: explicit schemas, no inference, projections pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravalor.functions.text import number_or_null

TAX_ROLL = (
    "PID string, LAND_COORDINATE string, FROM_CIVIC_NUMBER string, TO_CIVIC_NUMBER string, STREET_NAME string, "
    "PROPERTY_POSTAL_CODE string, NEIGHBOURHOOD_CODE string, ZONING_DISTRICT string, LEGAL_TYPE string, "
    "CURRENT_LAND_VALUE string, CURRENT_IMPROVEMENT_VALUE string, PREVIOUS_LAND_VALUE string, "
    "PREVIOUS_IMPROVEMENT_VALUE string, YEAR_BUILT string"
)
TRENDS = "neighbourhood_code string, tax_assessment_year double, property_type string, median double, count int"
GTFS = {
    "stops": "stop_id string, stop_name string, lat double, lon double, location_type int",
    "routes": "route_id string, route_short_name string, route_type int",
    "trips": "trip_id string, route_id string",
    "stop_times": "trip_id string, stop_id string, stop_sequence int",
    "calendar": "service_id string, start_date string, end_date string",
}
GEOJSON = (
    "features array<struct<properties: map<string, string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)
POLYGON, MULTIPOLYGON = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, **options) -> DataFrame:
    """Headed CSV; without a schema every column is text, so no pass infers types."""
    settings = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", **options}
    reader = spark.read.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in settings.items()})
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def strip_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_tax_roll(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Roll partitioned by TAX_ASSESSMENT_YEAR; a year reads its folder only."""
    roll = read_csv(spark, path, TAX_ROLL + ", TAX_ASSESSMENT_YEAR int")
    return roll.where(F.col("TAX_ASSESSMENT_YEAR") == year) if year is not None else roll


def read_latin1(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, encoding="ISO-8859-1")


def read_gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of an unpacked feed; a missing file gives an empty typed table."""
    return {name: optional_layer(spark, f"{folder}/{name}.txt", schema) for name, schema in GTFS.items()}


def optional_layer(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV layer, or an empty frame of its schema when the source is not there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema)


def read_paged_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Pages of {"records": [{"fields": {...}}]} to one row per record."""
    pages = spark.read.schema(f"records array<struct<fields: struct<{fields}>>>").json(path)
    return pages.select(F.explode("records").alias("r")).select("r.fields.*")


def read_observations(spark: SparkSession, path: str, series: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """{"observations": [{"d": date, "<series>": {"v": text}}]} to (date, series, value)."""
    pages = spark.read.schema(f"observations array<struct<d: string, `{series}`: struct<v: string>>>").json(path)
    rows = pages.select(F.explode("observations").alias("o")).select(
        F.to_date("o.d").alias("date"), F.lit(series).alias("series"), number_or_null(F.col(f"o.`{series}`.v")).alias("value")
    )
    if start:
        rows = rows.where(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.where(F.col("date") <= F.to_date(F.lit(end)))
    return rows


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections, one per file, to ring rows (see ``rings_of``)."""
    return rings_of(spark.read.schema(GEOJSON).option("multiLine", True).json(path))


def rings_of(collections: DataFrame) -> DataFrame:
    """One row per area of every Polygon or MultiPolygon: outer ring, holes, bounds."""
    from terravalor.operators.spatial import add_bounds

    features = collections.select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, POLYGON))).when(kind == "MultiPolygon", F.from_json(text, MULTIPOLYGON))
    rings = features.select(F.col("f.properties").alias("properties"), F.posexplode(polygons).alias("part", "polygon"))

    def opened(points: Column) -> Column:
        ring = F.transform(points, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
        closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
        return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    outer = opened(F.element_at("polygon", 1))
    holes = F.transform(F.slice("polygon", 2, F.greatest(F.size("polygon") - 1, F.lit(0))), opened)
    return add_bounds(rings.select("properties", "part", outer.alias("ring"), holes.alias("holes")))


def files_by_header(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Data files of a folder in name order, by their first line; only that line of each is read here."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[str]] = {}
    for status in sorted(store.listStatus(path), key=lambda f: f.getPath().getName()):
        name = status.getPath().getName()
        if status.isFile() and name[0] not in "._":
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(store.open(status.getPath()), "UTF-8"))
            first = reader.readLine()
            reader.close()
            if first:
                found.setdefault(first.lstrip("\ufeff"), []).append(status.getPath().toString())
    return found


def read_listing_exports(spark: SparkSession, folder: str) -> list[DataFrame]:
    """All exports of a folder: one frame of text columns for each header, with the file of origin."""
    groups = files_by_header(spark, folder).values()
    return [strip_bom(read_csv(spark, files)).withColumn("source_file", F.input_file_name()) for files in groups]


def census_profile(rows: DataFrame, wanted: dict[int, str], key: str = "geo") -> DataFrame:
    """Long profile (geo, characteristic_id, value) to one row per place; names are known, so no scan finds them."""
    names = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    kept = rows.where(F.col("characteristic_id").isin(*wanted)).withColumn("name", names[F.col("characteristic_id")])
    return kept.groupBy(key).pivot("name", list(wanted.values())).agg(F.first("value", ignorenulls=True))


def read_boundaries(polygons: DataFrame, province: str, region: str | None = None) -> DataFrame:
    """Boundary rows of a province, then of a region by name."""
    out = polygons.where(F.col("properties")["province"] == province)
    return out.where(F.col("properties")["region"] == region) if region else out


def stack(frames: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
