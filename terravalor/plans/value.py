"""Trained value models over the input tables, and the full valuation of requests with them."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravalor.operators import comps, features, market, models, rules, serve
from terravalor.operators import value_models as V
from terravalor.plans.features import enriched
from terravalor.session import materialize, session_dir
from terravalor.sources.model_store import ModelStore

#: Rows a segment needs for a model of its own.
MINIMUM = 200


def store_of(t) -> ModelStore:
    """The models trained in this session from one input folder."""
    return ModelStore(t.spark, f"{session_dir(t.spark)}/models-{hashlib.md5(t.sf_dir.encode()).hexdigest()[:12]}")


@dataclass(frozen=True)
class Trained:
    """A committed version: what is needed to encode and score rows."""

    version: str
    folder: str
    features: V.FeatureSet
    codes: PipelineModel
    entries: list[dict]
    ratio_entries: list[dict]
    table: DataFrame
    matrix: DataFrame
    levels: DataFrame
    metrics: DataFrame
    trials: DataFrame

    def score(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of the feature table (with ``key``) scored by the most specific model; absent features count as null."""
        vectors = self.codes.transform(V.encoded(rows.withColumn("label", F.lit(None).cast("double")), self.features))
        return V.predict(vectors.select(key, "label", "features", "property_type", "neighbourhood_code"), self.entries)


def feature_table(t) -> DataFrame:
    """Enriched properties with derived features and proxies: what models see, and the value itself."""
    return features.add_proxies(features.add_derived_features(enriched(t)))


def ratio_table_rows(t, table: DataFrame) -> DataFrame:
    """Trimmed sales on the features of their property, with the sale ratio."""
    sales = t.matched.where("matched_pid IS NOT NULL").select(
        "mls_number", F.col("matched_pid").alias("pid"), "neighbourhood_code", F.col("assessed_type").alias("property_type"),
        F.col("sale_to_assessment_ratio").alias("ratio"),
    )
    return models.ratio_model_rows(sales).join(table.drop("neighbourhood_code", "property_type"), "pid")


def train(t, settings: V.Settings = V.Settings(), minimum: int = MINIMUM, search_budget: int = 0) -> str:
    """Train everything the valuation needs and commit it as one version; the version's name.

    With a search budget the settings are looked for first. Nothing of a run that breaks off is
    ever loaded: the manifest is written last.
    """
    store = store_of(t)
    version, folder = store.begin()
    feature_table(t).write.parquet(f"{folder}/table")
    table = t.spark.read.parquet(f"{folder}/table")
    chosen = V.feature_set(table)
    valued = table.where(F.col("total_assessed_value") > 0)
    codes = V.encoder(V.encoded(valued, chosen), chosen)
    codes.write().overwrite().save(f"{folder}/encoder")
    matrix = V.write_matrix(valued, chosen, codes, f"{folder}/matrix", target=F.log("total_assessed_value"))

    trials: list[tuple] = []
    if search_budget:
        settings, trials = V.search(matrix, models.spatial_folds(t.universe), search_budget, base=settings)
    t.spark.createDataFrame(trials, "rung int, share double, fold int, settings string, log_error double").write.parquet(f"{folder}/trials")
    entries = V.fit_segments(matrix, settings, minimum, f"{folder}/value")

    held = V.predict(matrix.rows().where(F.col("part").isin("calibrate", "check")), entries)
    V.interval_levels(held.where("part = 'calibrate'")).write.parquet(f"{folder}/levels")
    levels = t.spark.read.parquet(f"{folder}/levels")
    checked = materialize(V.with_levels(held.where("part = 'check'"), levels).withColumn("total_assessed_value", F.exp("label")).drop("segment_used").withColumnRenamed("model_segment", "segment_used"))
    covered = V.coverage(checked.withColumn("scope", F.explode(F.array(F.lit("all"), F.concat(F.lit("type:"), "property_type")))), ["scope"], "total_assessed_value")
    models.metrics(checked).join(covered.drop("n"), "scope", "left").write.parquet(f"{folder}/metrics")

    sales = ratio_table_rows(t, table)
    ratios = V.write_matrix(sales, chosen, codes, f"{folder}/ratio-matrix", key="mls_number", target=F.col("ratio"))
    entries += V.ratio_models(ratios, f"{folder}/ratio")
    about = {"name": "features", "kind": "encoder", "path": folder, "settings": asdict(chosen) | {"minimum": minimum}, "features": chosen.names()}
    store.commit(version, [about, *entries])
    return version


def load(t, version: str) -> Trained:
    """A committed version."""
    store = store_of(t)
    rows = store.manifest(version).collect()  # a row a segment and type
    about = next(r for r in rows if r.kind == "encoder")
    known = json.loads(about.settings)
    chosen = V.FeatureSet(*[tuple(known[k]) for k in ("numeric", "flagged", "categorical")])
    read = lambda name: t.spark.read.parquet(f"{about.path}/{name}")
    of = lambda kind: [{"name": r.name, "path": r.path, "rows": r.rows, "settings": json.loads(r.settings), "metrics": json.loads(r.metrics)} for r in rows if r.kind == kind]
    return Trained(
        version, about.path, chosen, PipelineModel.load(f"{about.path}/encoder"), of("value"), of("ratio"),
        read("table"), read("matrix"), read("levels"), read("metrics"), read("trials"),
    )


def trained(t, **how) -> Trained:
    """The newest version of this session, trained now if there is none."""
    latest = store_of(t).latest()
    return load(t, latest or train(t, **how))


def matrix_of(known: Trained) -> V.Matrix:
    """The version's matrix, as fits and searches take it."""
    bins = max([32, *[len(labels) + 2 for labels in known.codes.stages[0].labelsArray]])
    return V.Matrix(known.matrix.sparkSession, f"{known.folder}/matrix", known.matrix.schema, bins, known.features.vector_names())


def as_text(settings: V.Settings) -> str:
    return json.dumps(asdict(settings), sort_keys=True)


def contributions(known: Trained, rows: DataFrame, key: str = "pid", top: int = 10) -> DataFrame:
    """Drivers per row: change of the score when one feature takes its typical value.

    The rows are repeated once per feature and scored together; a row's own model scores its copies.
    """
    f = known.features
    encoded = V.encoded(rows.withColumn("label", F.lit(None).cast("double")), f)
    typical = encoded.agg(
        *[F.percentile_approx(f"f_{c}", 0.5).alias(f"f_{c}") for c in f.numeric], *[F.mode(f"k_{c}", True).alias(f"k_{c}") for c in f.categorical]
    ).first()
    columns = [f"f_{c}" for c in f.numeric] + [f"k_{c}" for c in f.categorical]
    repeated = encoded.withColumn("_swap", F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])))
    swapped = repeated.withColumns({c: F.when(F.col("_swap") == c, F.lit(typical[c])).otherwise(F.col(c)) for c in columns})
    vectors = known.codes.transform(swapped).select(key, "_swap", "label", "features", "property_type", "neighbourhood_code")
    scored = V.predict(vectors, known.entries).select(key, "_swap", "prediction")
    base = F.max(F.when(F.col("_swap") == "", F.col("prediction")))
    each = F.collect_list(F.when(F.col("_swap") != "", F.struct(F.expr("substring(_swap, 3)").alias("feature"), "prediction")))
    per_row = scored.groupBy(key).agg(base.alias("_base"), each.alias("_each"))
    pushed = F.transform("_each", lambda e: F.struct((-F.abs(F.col("_base") - e["prediction"])).alias("o"), e["feature"].alias("feature"), (F.col("_base") - e["prediction"]).alias("contribution")))
    best = per_row.select(key, F.posexplode(F.slice(F.array_sort(pushed), 1, top)).alias("rank", "x"))
    return best.select(key, "x.feature", "x.contribution", (F.col("rank") + 1).alias("rank"))


def tree_backtest(t, test_year: int, settings: V.Settings = V.Settings(), minimum: int = MINIMUM) -> DataFrame:
    """Errors on one year of trees fitted on the years before, by scope, beside those of the median benchmark.

    The features are those of the panel; what a model of the valuation has beyond them is named
    missing at plan time and counts as null.
    """
    panel = models.add_distance(models.panel_rows(t("px_panel"))).where(F.col("total_assessed_value") > 0)
    panel = panel.withColumn("key", F.concat_ws("-", "pid", "tax_assessment_year"))
    folder = f"{session_dir(t.spark)}/backtest-{uuid.uuid4().hex}"
    before, after = panel.where(F.col("tax_assessment_year") < test_year), panel.where(F.col("tax_assessment_year") == test_year)
    chosen = V.feature_set(before)
    codes = V.encoder(V.encoded(before, chosen), chosen)
    matrix = V.write_matrix(before, chosen, codes, f"{folder}/matrix", key="key", target=F.log("total_assessed_value"))
    entries = V.fit_segments(matrix, settings, minimum, f"{folder}/models")
    tested = V.write_matrix(after, chosen, codes, f"{folder}/tested", key="key", target=F.log("total_assessed_value"))
    scored = V.predict(tested.rows(), entries).withColumns({"predicted": F.exp("prediction"), "total_assessed_value": F.exp("label")}).withColumnRenamed("model_segment", "segment_used")
    scored = materialize(scored)
    beside = models.benchmark(scored, before).first()
    out = models.metrics(scored).where("scope NOT LIKE 'segment:%'").select("scope", "n_samples", "mape", "mean_ape", "r2", "bias")
    return out.withColumns({"benchmark_mape": F.when(F.col("scope") == "all", F.lit(beside["benchmark_mape"])), "win_pct": F.when(F.col("scope") == "all", F.lit(beside["win_pct"]))})


# ---- requests ----------------------------------------------------------------------------------------


def request_subjects(t) -> DataFrame:
    """Every request with the property it is about: by number, else the nearest; a peer's value where there is none."""
    asked = t("px_request").select(
        "request_id", "pid", F.lit(None).cast("string").alias("address"), F.col("req_lat").alias("latitude"), F.col("req_lon").alias("longitude"), F.col("req_type").alias("property_type")
    )
    return materialize(serve.resolve_subjects(asked, t.properties))


def value_requests(t, as_of: str = "2026-03-15") -> DataFrame:
    """Full valuation of every request, one row each.

    The subject's features, with the request's own figures in place of stored ones, are scored by
    the most specific model; rules adjust the score, comparables are blended in, and the
    calibrated interval is scaled along. A subject without a model rests on its comparables, then
    on the sale ratio, then on its assessed or a peer's value.
    """
    known = trained(t)
    subjects = request_subjects(t)
    asked = t("px_request").select("request_id", F.col("req_type").alias("_type"), "bedrooms_override", "area_override")
    table = known.table.drop("total_assessed_value", "current_land_value", "current_improvement_value")
    rows = materialize(
        subjects.join(asked, "request_id").join(table, "pid", "left").join(t("px_rule_inputs"), "pid", "left")
        .withColumn("property_type", F.coalesce("property_type", "_type"))
        .withColumn("assessment_date", F.make_date(F.col("tax_assessment_year") - 1, F.lit(7), F.lit(1)))
    )
    with_own = serve.with_overrides(rows, {"bedrooms": "bedrooms_override", "living_area_sqft": "area_override"})
    scored = known.score(with_own.where(F.col("pid").isNotNull()), "request_id")
    bounds = V.with_levels(scored, known.levels).select("request_id", "model_segment", F.col("predicted").alias("model_estimate"), "lower", "upper")

    vectors = known.codes.transform(V.encoded(with_own.where(F.col("pid").isNotNull()).withColumn("label", F.lit(None).cast("double")), known.features))
    by_ratio = V.predict_ratio(vectors.select("request_id", "label", "features", "property_type", "neighbourhood_code"), known.ratio_entries)
    ratios = market.ratio_table(
        t.matched.select("neighbourhood_code", F.col("assessed_type").alias("property_type"), F.col("sale_to_assessment_ratio").alias("ratio"))
    )
    on_market = comps.ratio_estimate(
        rows.select("request_id", "neighbourhood_code", "property_type", "total_assessed_value").join(by_ratio.select("request_id", "predicted_ratio"), "request_id", "left"),
        ratios, F.col("predicted_ratio"),
    ).select("request_id", "market_estimate", "ratio_source")

    adjusted = rules.apply_rules(rows.join(bounds, "request_id", "left"), "model_estimate", as_of)
    found = comps.comparable_properties(t.properties.join(rows.select("pid").distinct(), "pid", "left_semi"), t.properties, 5)
    ranges = comps.comparable_range(comps.adjusted_comparables(found)).withColumnRenamed("s_pid", "pid")
    joined = adjusted.join(ranges, "pid", "left").join(on_market, "request_id", "left").withColumn("comparable_count", F.coalesce("comparable_count", F.lit(0)))

    blend = comps.blend_with_comparables(F.col("adjusted_value"), F.col("range_median"), F.col("comparable_count"))
    by_model = F.col("model_estimate").isNotNull()
    estimate = F.when(by_model, F.col("_b.value")).otherwise(F.coalesce("range_median", "market_estimate", "total_assessed_value"))
    scale = F.col("point_estimate") / F.col("model_estimate")
    valued = joined.withColumn("_b", blend).withColumn("point_estimate", estimate).withColumns({
        "divergence_pct": F.col("_b.divergence_pct"),
        "_i": rules.sane_interval(
            F.when(by_model, F.col("lower") * scale).otherwise(F.col("range_low")), F.when(by_model, F.col("upper") * scale).otherwise(F.col("range_high")), F.col("point_estimate")
        ),
    })
    primary = F.coalesce("market_estimate", "point_estimate")
    valued = valued.withColumn("primary_estimate", primary)
    headline = rules.rescaled_interval(F.col("_i.lower"), F.col("_i.upper"), F.col("point_estimate"), F.col("primary_estimate"))
    scored = features.completeness(
        valued.withColumn("_p", headline), ["year_built", "effective_age", "yoy_change_pct", "latitude", "property_postal_code", "lot_frontage_ft"]
    )
    width = (F.col("_i.upper") - F.col("_i.lower")) / F.when(F.col("point_estimate") > 0, F.col("point_estimate")) * 100
    return scored.select(
        "request_id", "pid", "resolved_by", "property_type", "total_assessed_value", "model_segment", "model_estimate", "adjusted_value", "total_adjustment_pct",
        "comparable_count", "point_estimate", "divergence_pct", F.col("_i.lower").alias("interval_low"), F.col("_i.upper").alias("interval_high"),
        "market_estimate", "ratio_source", "primary_estimate", F.col("_p.lower").alias("primary_low"), F.col("_p.upper").alias("primary_high"),
        rules.confidence_grade(F.col("completeness_pct"), F.col("comparable_count"), width).alias("grade"),
    )
