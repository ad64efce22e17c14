"""Work that costs more than the bytes it reads runs in more than one task, and predictions are worked out once."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from terravalor.operators import spatial
from terravalor.operators.universe import classify
from terravalor import plans
from terravalor.plans import registry
from terravalor.plans.tables import Tables


def parts(df):
    return df.rdd.getNumPartitions()


def test_rows_of_one_split_are_dealt_to_all_cores(spark, sf):
    t = Tables(spark, sf)
    assert parts(spark.read.parquet(f"{sf}/part.parquet")) == 1
    assert parts(t("part")) >= 4 and parts(t("customer")) >= 4 and t("part").exceptAll(spark.read.parquet(f"{sf}/part.parquet")).isEmpty()
    assert parts(t("px_panel")) >= 4 and parts(t.locations) >= 4


def test_backtest_is_not_repeated_for_each_figure(spark, sf):
    plan = entry.queries()["t07_worst_segments"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_brand" not in plan


def test_queries_of_matched_sales_write_the_columns_they_need(spark, sf):
    plans.load()
    for name in ("a05_ratio_table", "x16_ratio_estimate", "a27_fill_audit", "k07_matched_export"):
        t = Tables(spark, sf)
        registry.QUERIES[name](t)
        assert not {"sold", "matched"} & set(t.__dict__)
    rows = t.matched_with("mls_number", "matched_pid", "maint_fee")
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.parquet(folder).columns == ["mls_number", "matched_pid", "maint_fee"]
    assert rows.exceptAll(t.matched.select(*rows.columns)).isEmpty() and rows.count() == t.matched.count() > 0


def test_a_filter_on_the_type_reads_the_zone_once(spark):
    rows = spark.range(10).select(F.concat(F.lit("rs-"), F.col("id")).alias("z"), F.lit("LAND").alias("l"))
    kept = rows.withColumn("kind", classify(F.col("z"), F.col("l"))).where("kind = 'detached'")
    condition = kept._jdf.queryExecution().optimizedPlan().toString().split("Filter", 1)[1].split("\n")[0]
    assert condition.count("rs-") == 1 and kept.count() == 10


def test_nearest_rows_of_crowded_lonely_and_empty_places(spark):
    dice = random.Random(3)
    crowded = [(i, 49.25 + dice.gauss(0, 0.001), -123.1 + dice.gauss(0, 0.001)) for i in range(60)]
    lonely = [(100 + i, 49.35 + dice.gauss(0, 0.006), -123.0 + dice.gauss(0, 0.006)) for i in range(6)]
    twins = [(i, 49.25, -123.1) for i in range(200, 205)]
    schools = [*crowded, *lonely, *twins]
    rows = spark.createDataFrame([(i, a, b, float(i % 90)) for i, a, b in schools], "school_id long, latitude double, longitude double, school_score double")
    places = [(49.25, -123.1), (49.2505, -123.0995), (49.262, -123.1), (49.35, -123.0), (49.0, -122.0)]
    points = spark.createDataFrame(places, "lat double, lon double")
    layer = spatial.point_layer(rows, "latitude", "longitude", by=["school_id"])
    assert parts(layer.df) >= 4

    def away(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    got: dict[tuple, set] = {p: set() for p in places}
    for r in spatial.nearest_within(points, layer, 10, 3_000.0, "school_id").collect():
        assert r.school_id not in got[(r.lat, r.lon)]
        got[(r.lat, r.lon)].add(r.school_id)
    for p in places:
        near = sorted((round(away(*p, a, b), 6), i) for i, a, b in schools if away(*p, a, b) <= 3_000)
        assert got[p] == {i for _, i in near[:10]}
    assert len(got[places[0]]) == 10 and 0 < len(got[places[3]]) < 10 and not got[places[4]]

