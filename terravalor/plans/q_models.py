"""Modelling queries. Lines and evaluation have oracles; tree models are checked on planted values and by invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravalor.operators import market, models, value_models
from terravalor.plans import runs, value
from terravalor.plans.proxies import ORACLE_ONLY
from terravalor.plans.q_spatial import hav
from terravalor.plans.registry import query, rounded

_D = hav("latitude", "longitude", "49.2827", "-123.1207")
ORACLE_ONLY["o_dist"] = f"SELECT *, {_D} AS d, ln(total_assessed_value) AS lv FROM o_properties WHERE total_assessed_value > 0 AND latitude IS NOT NULL"
ORACLE_ONLY["o_line"] = """
SELECT segment, count(*) AS n, regr_intercept(lv, d) AS a, regr_slope(lv, d) AS b FROM (
  SELECT unnest([neighbourhood_code || '__' || property_type, 'citywide__' || property_type, 'citywide__all']) AS segment, lv, d FROM o_dist) s
GROUP BY 1 HAVING count(*) >= 25
"""
ORACLE_ONLY["o_pred"] = """
SELECT p.*, coalesce(x.segment, y.segment, z.segment) AS segment_used,
  exp(CASE WHEN x.segment IS NOT NULL THEN x.a + x.b * d WHEN y.segment IS NOT NULL THEN y.a + y.b * d ELSE z.a + z.b * d END) AS predicted
FROM o_dist p LEFT JOIN o_line x ON x.segment = neighbourhood_code || '__' || property_type
LEFT JOIN o_line y ON y.segment = 'citywide__' || property_type LEFT JOIN o_line z ON z.segment = 'citywide__all'
"""
ORACLE_ONLY["o_panel"] = f"""
SELECT *, {_D} AS d, ln(v) AS lv FROM (SELECT *, current_land_value + current_improvement_value AS v,
  CASE WHEN zoning_district IN ('RS-1', 'RT-5', 'R1-1') THEN 'detached' WHEN zoning_district = 'RM-3A' THEN 'townhome' WHEN zoning_district = 'RM-5B' THEN 'condo'
       WHEN zoning_district IN ('C-2', 'CD-1 (12)') AND legal_type = 'STRATA' THEN 'condo' ELSE 'development_land' END AS property_type FROM px_panel) x WHERE property_type <> 'development_land'
"""
ORACLE_ONLY["o_bt_line"] = """
SELECT segment, regr_intercept(lv, d) AS a, regr_slope(lv, d) AS b, median(v) AS naive, count(*) AS n FROM (
  SELECT unnest([neighbourhood_code || '__' || property_type, 'citywide__' || property_type, 'citywide__all']) AS segment, lv, d, v FROM o_panel WHERE tax_assessment_year < 2026) s GROUP BY 1
"""
ORACLE_ONLY["o_bt"] = """
SELECT p.*, CASE WHEN x.n >= 25 THEN x.segment WHEN y.n >= 25 THEN y.segment ELSE z.segment END AS segment_used,
  exp(CASE WHEN x.n >= 25 THEN x.a + x.b * d WHEN y.n >= 25 THEN y.a + y.b * d ELSE z.a + z.b * d END) AS predicted,
  coalesce(x.naive, y.naive, z.naive) AS naive
FROM o_panel p LEFT JOIN o_bt_line x ON x.segment = neighbourhood_code || '__' || property_type
LEFT JOIN o_bt_line y ON y.segment = 'citywide__' || property_type LEFT JOIN o_bt_line z ON z.segment = 'citywide__all'
WHERE tax_assessment_year = 2026
"""


def lots(t):
    return models.add_distance(t.properties.join(t("px_property").select("pid", "lot_size_sqft"), "pid"))


def backtest(t):
    return models.backtest_lines(models.add_distance(models.panel_rows(t("px_panel"))), 2026, 25)


@query(
    "m05_price_gradient",
    """WITH l AS (SELECT property_type, regr_intercept(lv, d) AS a, regr_slope(lv, d) AS b FROM o_dist GROUP BY 1 HAVING count(*) >= 10)
       SELECT pid, round(lv - (a + b * d), 6) AS log_value_residual FROM o_dist LEFT JOIN l USING (property_type)""",
)
def m05(t):
    return rounded(models.price_gradient(models.add_distance(t.properties)).select("pid", "log_value_residual"), 6)


@query("m06_segment_lines", "SELECT segment, n, round(a, 6) AS intercept, round(b, 9) AS slope FROM o_line")
def m06l(t):
    out = models.segment_lines(models.add_distance(t.properties), 25)
    return out.select("segment", "n", F.round("intercept", 6).alias("intercept"), F.round("slope", 9).alias("slope"))


@query(
    "m09_residual_quantiles",
    """SELECT segment_used AS segment, count(*) AS n, round(quantile_cont(lv - ln(predicted), 0.10), 6) AS q10, round(quantile_cont(lv - ln(predicted), 0.25), 6) AS q25,
       round(quantile_cont(lv - ln(predicted), 0.50), 6) AS q50, round(quantile_cont(lv - ln(predicted), 0.75), 6) AS q75, round(quantile_cont(lv - ln(predicted), 0.90), 6) AS q90 FROM o_pred GROUP BY 1""",
)
def m09(t):
    rows = models.add_distance(t.properties)
    return rounded(models.residual_levels(models.predict_lines(rows, models.segment_lines(rows, 25))), 6)


@query(
    "m10_scores_with_intervals",
    """WITH q AS (SELECT segment_used, quantile_cont(lv - ln(predicted), 0.10) AS lo, quantile_cont(lv - ln(predicted), 0.90) AS hi FROM o_pred GROUP BY 1)
       SELECT pid, segment_used, round(predicted, 2) AS predicted, round(predicted * exp(lo), 2) AS lower, round(predicted * exp(hi), 2) AS upper FROM o_pred JOIN q USING (segment_used)""",
)
def m10(t):
    rows = models.add_distance(t.properties)
    pred = models.predict_lines(rows, models.segment_lines(rows, 25))
    return rounded(models.with_intervals(pred, models.residual_levels(pred)).select("pid", "segment_used", "predicted", "lower", "upper"), 2)


@query("m13_backtest", "SELECT pid, segment_used, round(v, 2) AS actual, round(predicted, 2) AS predicted FROM o_bt")
def m13(t):
    return rounded(backtest(t).select("pid", "segment_used", F.col("total_assessed_value").alias("actual"), "predicted"), 2)


METRICS_SQL = """WITH s AS (SELECT unnest(['all', 'type:' || property_type, 'area:' || neighbourhood_code, 'segment:' || segment_used]) AS scope, v AS y, predicted AS p FROM o_bt)
       SELECT scope, count(*) AS n_samples, round(avg(abs(y - p) / y * 100), 5) AS mean_ape, round(avg(abs(y - p)), 2) AS mae, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse,
         round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(CASE WHEN abs(y - p) / y <= 0.05 THEN 1 ELSE 0 END) * 100, 4) AS hit_rate_5pct,
         round(avg(p - y) / avg(y) * 100, 5) AS bias, round(median(abs(y - p) / y * 100), 5) AS mape, round(median(abs(y - p)), 2) AS median_ae
       FROM s GROUP BY 1 HAVING scope = 'all' OR count(*) >= 5"""


def _rounded_metrics(df):
    return df.select(
        "scope", "n_samples", F.round("mean_ape", 5).alias("mean_ape"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("r2", 6).alias("r2"),
        F.round("hit_rate_5pct", 4).alias("hit_rate_5pct"), F.round("bias", 5).alias("bias"), F.round("mape", 5).alias("mape"), F.round("median_ae", 2).alias("median_ae"),
    )


@query("m14_metrics", METRICS_SQL)
def m14(t):
    return _rounded_metrics(models.metrics(backtest(t)))


@query(
    "t07_worst_segments",
    f"""SELECT scope, n_samples, mean_ape FROM ({METRICS_SQL}) q WHERE scope LIKE 'segment:%' ORDER BY mean_ape DESC, scope LIMIT 5""",
)
def t07_segments(t):
    """The five segments of the largest mean error in the backtest."""
    errors = _rounded_metrics(models.metrics(backtest(t))).where("scope LIKE 'segment:%'")
    return errors.select("scope", "n_samples", "mean_ape").orderBy(F.col("mean_ape").desc(), "scope").limit(5)


@query(
    "t07_worst_areas",
    f"""SELECT scope, n_samples, mean_ape FROM ({METRICS_SQL}) q WHERE scope LIKE 'area:%' ORDER BY mean_ape DESC, scope LIMIT 5""",
)
def t07_areas(t):
    """The five areas of the largest mean error in the backtest."""
    errors = _rounded_metrics(models.metrics(backtest(t))).where("scope LIKE 'area:%'")
    return errors.select("scope", "n_samples", "mean_ape").orderBy(F.col("mean_ape").desc(), "scope").limit(5)


@query(
    "m15_j18_benchmark",
    """WITH e AS (SELECT abs(v - predicted) / v * 100 AS m, abs(v - naive) / v * 100 AS b FROM o_bt)
       SELECT round(avg(CASE WHEN m < b THEN 1 ELSE 0 END) * 100, 4) AS win_pct, round(median(m), 5) AS model_mape, round(median(b), 5) AS benchmark_mape,
         round((median(b) - median(m)) / median(b) * 100, 4) AS improvement_pct FROM e""",
)
def m15(t):
    train = models.panel_rows(t("px_panel")).where("tax_assessment_year < 2026")
    out = models.benchmark(backtest(t), train)
    return out.select(
        F.round("win_pct", 4).alias("win_pct"), F.round("model_mape", 5).alias("model_mape"), F.round("benchmark_mape", 5).alias("benchmark_mape"),
        F.round("improvement_pct", 4).alias("improvement_pct"),
    )


@query(
    "w14_spatial_folds",
    """WITH a AS (SELECT DISTINCT CAST(neighbourhood_code AS INT) AS c FROM o_universe),
       s AS (SELECT c, CASE WHEN c IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 22) THEN 0 ELSE 1 END AS side FROM a),
       r AS (SELECT c, side, row_number() OVER (PARTITION BY side ORDER BY c) AS i FROM s)
       SELECT CAST(c AS STRING) AS neighbourhood_code, (row_number() OVER (ORDER BY i, side) - 1) % 5 AS fold FROM r""",
)
def w14(t):
    return models.spatial_folds(t.universe)


@query(
    "m04_nearest_centre",
    """WITH l AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
       m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM l GROUP BY 1, 2),
       e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
       d AS (SELECT e.vec_id, m.label, sum((CAST(e.v AS DOUBLE) - m.m) * (CAST(e.v AS DOUBLE) - m.m)) AS d FROM e JOIN m USING (i) GROUP BY 1, 2)
       SELECT vec_id, arg_min(label, d) AS cluster FROM d GROUP BY 1""",
)
def m04(t):
    centres = models.label_centres(t("embeddings"))
    return models.assign_centres(t("embeddings"), centres, "vec_id")


@query("m03_micro_neighbourhoods")
def m03(t):
    props = t.properties.withColumn("log_value", F.log("total_assessed_value"))
    return models.micro_neighbourhoods(props, ["log_value", "land_ratio", "year_built"])[0]


@query("m01_m02_feature_matrix")
def m01(t):
    """The encoded matrix of all valued properties: label, width and sum of each vector."""
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("features")
    return value.trained(t).matrix.select("pid", "label", "part", F.size(v).alias("width"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("checksum"))


@query("m06_value_model")
def m06(t):
    """Every segment's model: rows, rounds grown, weight against the middle, and its error and coverage on rows that nothing was fitted on."""
    known = value.trained(t)
    rows = [(e["name"], e["rows"], e["settings"]["rounds_used"], e["settings"]["weight"]) for e in known.entries]
    fitted = t.spark.createDataFrame(rows, "segment string, rows long, rounds_used int, weight double")
    errors = known.metrics.select(F.expr("substring(scope, 9)").alias("segment"), "n_samples", "mape", "mean_ape", "covered_pct", F.col("scope").startswith("segment:").alias("_of"))
    return fitted.join(errors.where("_of").drop("_of"), "segment", "left")


@query("m06_check_metrics")
def m06c(t):
    """Errors and interval coverage on the check rows, by all, type, area and segment."""
    return value.trained(t).metrics


@query("m07_parameter_search")
def m07(t):
    """Successive halving over nine settings: every trial with its rung, share of rows, fold and error."""
    known = value.trained(t)
    matrix = value.matrix_of(known)
    best, trials = value_models.search(matrix, models.spatial_folds(t.universe), budget=9)
    rows = [(*trial, trial[3] == value.as_text(best)) for trial in trials]
    return t.spark.createDataFrame(rows, "rung int, share double, fold int, settings string, log_error double, is_best boolean")


@query("m08_ratio_model")
def m08(t):
    """The ratio model of each type, or its median: rows, rounds and error over folds beside that of the median."""
    rows = [
        (e["name"].removeprefix("ratio__"), e["rows"], "trees" if e["path"] else "median", e["settings"].get("rounds_used"), e["metrics"].get("cv_mae"), e["metrics"]["median_mae"])
        for e in value.trained(t).ratio_entries
    ]
    return t.spark.createDataFrame(rows, "property_type string, n long, way string, rounds_used int, cv_mae double, median_mae double")


@query("m09_interval_levels")
def m09c(t):
    """Calibrated residual levels per area and type, type and city."""
    return value.trained(t).levels


@query("m10_model_scores")
def m10m(t):
    """Every property scored by its most specific model, with its 80 % interval."""
    known = value.trained(t)
    scored = value_models.predict(known.matrix, known.entries)
    return rounded(value_models.with_levels(scored, known.levels).select("pid", "model_segment", "predicted", "lower", "upper"), 2)


@query("m11_t08_importances")
def m11(t):
    """The ten features that weigh most in the city's model."""
    city = next(e for e in value.trained(t).entries if e["name"] == value_models.CITY)
    rows = sorted(city["metrics"]["importances"].items(), key=lambda x: (-x[1], x[0]))[:10]
    return t.spark.createDataFrame(rows, "feature string, importance double")


@query("m12_contributions")
def m12(t):
    """The ten drivers of every property's score."""
    known = value.trained(t)
    return value.contributions(known, known.table.where("total_assessed_value > 0"))


@query("m13_tree_backtest")
def m13t(t):
    """Trees fitted on the years before, against the median of area and type, on the last year."""
    return value.tree_backtest(t, 2026)


@query("u06_feature_difference")
def u06(t):
    """Per model: features that the plain property table lacks, and its columns that are no feature."""
    known = value.trained(t)
    missing, extra = known.features.difference(t.properties.columns)
    rows = [(e["name"], "missing", c) for e in known.entries for c in missing] + [(e["name"], "extra", c) for e in known.entries for c in extra]
    return t.spark.createDataFrame(rows, "model string, side string, feature string")


@query("k06_model_inventory")
def k06i(t):
    """What the store holds of the newest version."""
    known = value.trained(t)
    return value.store_of(t).inventory().where(F.col("version") == known.version).select("name", "kind", "rows", "settings", F.size("features").alias("n_features"))


@query("m16_a28_batch_run")
def m16(t):
    return runs.batch_run(t).drop("seconds")


@query("a28_stage_summary")
def a28(t):
    """Stages by status, and the errors of all segments' models."""
    known = value.trained(t)
    return runs.run_summary(runs.batch_run(t, data_only=True)).drop("min_seconds", "mean_seconds", "max_seconds").withColumns({c: e for c, e in runs.error_summary(known.metrics).items()})


@query("m17_daily_run")
def m17(t):
    return runs.daily_run(t, "2000-06-15").drop("seconds")


@query("k06_metrics_as_json", METRICS_SQL)
def k06(t):
    """All metrics written as JSON and read back."""
    from terravalor.session import landing_path

    out = landing_path(t.spark, "metrics")
    done = models.metrics(backtest(t))
    done.write.json(out)
    return _rounded_metrics(t.spark.read.schema(done.schema).json(out))
