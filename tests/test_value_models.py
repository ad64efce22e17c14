"""Value models on planted values, the model store, resumable runs, and valuations of all requests."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from terravalor.operators import models
from terravalor.operators import value_models as V
from terravalor.plans import runs, value
from terravalor.plans.tables import Tables
from terravalor.session import landing_path, materialize
from terravalor.sources.model_store import ModelStore

QUICK = V.Settings(rounds=120, depth=4)


@pytest.fixture(scope="module")
def planted(spark):
    """Values that follow place, age and type with a tenth of noise; one area is too small for a model."""
    u = lambda seed: F.rand(seed)
    rows = spark.range(12_000, numPartitions=4).select(
        F.format_string("%09d", "id").alias("pid"), (49.2 + u(1) * 0.1).alias("latitude"), (-123.2 + u(2) * 0.2).alias("longitude"),
        F.when(u(3) < 0.5, "condo").otherwise("detached").alias("property_type"), F.when(u(4) < 0.01, "9").when(u(5) < 0.5, "1").otherwise("2").alias("neighbourhood_code"),
        F.when(u(6) < 0.1, None).otherwise((1950 + u(7) * 70).cast("int")).alias("year_built"), (u(8) < 0.3).alias("in_alr"), F.lit("R1-1").alias("zoning_district"), u(9).alias("pool"), F.randn(10).alias("noise"),
    )
    log_value = (
        F.lit(13.0) + F.when(F.col("property_type") == "condo", -0.6).otherwise(0.0) + 6 * (F.col("latitude") - 49.25) - F.abs(F.col("longitude") + 123.1) * 5
        + F.coalesce((F.col("year_built") - 1985) / 100, F.lit(-0.5)) - F.when(F.col("in_alr"), 0.4).otherwise(0.0) + 0.1 * F.col("noise")
    )
    return materialize(rows.withColumn("total_assessed_value", F.exp(log_value)))


@pytest.fixture(scope="module")
def fitted(spark, planted):
    features = V.feature_set(planted)
    codes = V.encoder(V.encoded(planted, features), features)
    folder = landing_path(spark, "planted")
    matrix = V.write_matrix(planted, features, codes, f"{folder}/matrix", target=F.log("total_assessed_value"))
    return features, codes, matrix, V.fit_segments(matrix, QUICK, 200, f"{folder}/models")


def test_features_are_those_of_registry_and_library(fitted):
    features = fitted[0]
    assert set(features.numeric) == {"latitude", "longitude", "year_built", "in_alr"} and features.flagged == ("year_built",)
    assert set(features.categorical) == {"neighbourhood_code", "property_type", "zoning_district"}
    assert features.difference(["latitude", "pool", "pid"]) == ([c for c in features.names() if c != "latitude"], ["pid", "pool"])


def test_every_qualifying_segment_has_a_model_and_trees_grow_on(fitted):
    entries = {e["name"]: e for e in fitted[3]}
    assert set(entries) == {"1__condo", "1__detached", "2__condo", "2__detached", "citywide__condo", "citywide__detached", "citywide__all"}
    assert all(e["settings"]["rounds_used"] > 15 and e["settings"]["weight"] > 0.9 for e in entries.values())


def test_trees_beat_the_median_benchmark_and_intervals_cover(fitted, planted):
    _, _, matrix, entries = fitted
    held = V.predict(matrix.rows().where("part IN ('calibrate', 'check')"), entries)
    levels = materialize(V.interval_levels(held.where("part = 'calibrate'")))
    scored = materialize(V.with_levels(held, levels).withColumn("total_assessed_value", F.exp("label")))
    assert {r.model_segment for r in scored.where("neighbourhood_code = '9'").select("model_segment").distinct().collect()} == {"citywide__condo", "citywide__detached"}
    assert {r.segment_used for r in scored.where("neighbourhood_code = '9'").select("segment_used").distinct().collect()} == {"citywide__condo", "citywide__detached"}
    check = scored.where("part = 'check'")
    beside = models.benchmark(check, planted).first()
    assert beside.model_mape < 0.4 * beside.benchmark_mape and beside.win_pct > 75
    assert check.where("NOT (lower <= predicted AND predicted <= upper)").count() == 0
    for r in V.coverage(check, ["property_type"], "total_assessed_value").collect():
        assert abs(r.covered_pct - 80) < 300 * math.sqrt(0.16 / r.n) + 2  # three standard errors, and what calibration rows leave open


def test_absent_columns_count_as_null(fitted, planted):
    features, codes, _, entries = fitted
    rows = V.encoded(planted.limit(50).drop("year_built", "in_alr").withColumn("label", F.lit(None).cast("double")), features)
    vectors = codes.transform(rows).select("pid", "label", "features", "property_type", "neighbourhood_code")
    assert V.predict(vectors, entries).where("prediction IS NOT NULL").count() == 50
    assert V.predict(vectors.limit(0), entries).count() == 0


def test_levels_have_the_conformal_ranks(spark):
    dice = random.Random(4)
    rows = [(dice.gauss(0, 1), 0.0, "1", "condo") for _ in range(99)] + [(dice.gauss(5, 1), 0.0, "2", "condo") for _ in range(7)]
    scored = spark.createDataFrame(rows, "label double, prediction double, neighbourhood_code string, property_type string")
    got = {r.segment: r for r in V.interval_levels(scored, minimum=20).collect()}
    assert set(got) == {"1__condo", "citywide__condo", "citywide__all"}
    own = sorted(r[0] for r in rows[:99])
    assert got["1__condo"].q10 == own[9] and got["1__condo"].q90 == own[89] and got["1__condo"].q50 == pytest.approx(statistics.median(own))


def test_the_search_is_no_worse_than_the_default(spark, fitted):
    matrix = fitted[2]
    folds = spark.createDataFrame([("1", 0), ("2", 1), ("9", 1)], "neighbourhood_code string, fold int")
    best, trials = V.search(matrix, folds, budget=3, eta=3, base=V.Settings(rounds=25, depth=3))
    last = [t for t in trials if t[1] == 1.0]
    mean = lambda s: statistics.mean(t[4] for t in last if t[3] == value.as_text(s))
    assert {t[0] for t in trials} == {0, 1} and mean(best) <= mean(V.Settings(rounds=25, depth=3))


def test_ratios_of_few_sales_take_the_median(spark, fitted, planted):
    features, codes = fitted[:2]
    condos = planted.where("property_type = 'condo'").limit(600).withColumn("ratio", F.when(F.col("in_alr"), 0.8).otherwise(1.2) + F.randn(1) * 0.01)
    rest = planted.where("property_type = 'detached'").limit(20).withColumn("ratio", F.lit(1.1))
    folder = landing_path(spark, "ratios")
    matrix = V.write_matrix(materialize(condos.unionByName(rest)), features, codes, f"{folder}/m", target=F.col("ratio"))
    entries = V.ratio_models(matrix, folder, V.Settings(rounds=40, depth=3, loss="absolute"), folds=3)
    by_name = {e["name"]: e for e in entries}
    assert by_name["ratio__detached"]["path"] == "" and by_name["ratio__detached"]["settings"]["median"] == pytest.approx(1.1)
    assert by_name["ratio__condo"]["metrics"]["cv_mae"] < 0.5 * by_name["ratio__condo"]["metrics"]["median_mae"]
    got = V.predict_ratio(matrix.rows(), entries)
    assert got.count() == 620 and got.where("property_type = 'detached' AND abs(predicted_ratio - 1.1) < 1e-9").count() == 20


def test_a_version_exists_once_its_manifest_does(spark):
    store = ModelStore(spark, landing_path(spark, "store"))
    assert store.latest() is None and store.inventory().count() == 0
    first, folder = store.begin()
    spark.range(3).write.parquet(f"{folder}/half")
    assert store.latest() is None
    second, _ = store.begin()
    store.commit(second, [{"name": "a", "kind": "value", "path": "p", "rows": 3, "settings": {"depth": 2}}])
    assert first < second and store.versions() == [second] and store.inventory().first()["name"] == "a"


def test_a_rerun_skips_what_finished(spark):
    ran, ledger = [], landing_path(spark, "ledger")

    def stage(name, fails=False):
        def job():
            ran.append(name)
            if fails and ran.count(name) == 1:
                raise ValueError("broke off")
            return 5
        return job

    stages = {"one": stage("one"), "two": stage("two", fails=True)}
    first = {r.stage: r.status for r in runs.run_stages(spark, stages, ledger).collect()}
    again = runs.run_stages(spark, stages, ledger)
    assert first == {"one": "success", "two": "failed"} and ran == ["one", "two", "two"]
    assert {r.stage: (r.status, r.rows) for r in again.collect()} == {"one": ("skipped", 5), "two": ("success", 5)}
    assert {r.status: r.overall_status for r in runs.run_summary(again).collect()} == {"skipped": "success", "success": "success"}


def test_every_request_is_valued(spark, sf):
    t = Tables(spark, sf)
    done = materialize(value.value_requests(t))
    assert done.count() == t("px_request").count() == done.select("request_id").distinct().count()
    assert done.where("point_estimate IS NULL OR NOT (interval_low <= point_estimate AND point_estimate <= interval_high) OR grade IS NULL").count() == 0
    assert done.where("model_estimate IS NULL").count() == 0
    known = value.trained(t)
    assert known.version == value.store_of(t).latest() and runs.status(t).where("kind = 'value'").first().models == len(known.entries)
