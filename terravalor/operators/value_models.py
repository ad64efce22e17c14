"""Value models by segment: boosted trees fitted side by side, stopped by held-out rows, with calibrated intervals.

The features of all rows are encoded once and written by type and area, so that a
segment's model reads its own folders. Segments are fitted by a few threads at a
time, each fit a distributed job of its own. Rows are dealt by hash into four
parts: ``fit`` grows trees, ``stop`` ends their growth, ``calibrate`` sets the
intervals and ``check`` is seen by none of them.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravalor.functions.quantiles import Rank, exact_percentiles
from terravalor.operators import models, registry_table
from terravalor.operators.boosting import Boosted, fit_in_task
from terravalor.operators.features import null_shares
from terravalor.operators.serve import segment_fallback
from terravalor.session import landing_path, materialize, names_in, small_side

CITY = "citywide__all"
#: Hundredths of the rows: the last of fit, stop and calibrate; check has the rest.
PARTS = {"fit": 65, "stop": 75, "calibrate": 90, "check": 100}
#: Fits or scorings at a time, at least; and rows for a task of a distributed fit.
SIDE_BY_SIDE = 8
ROWS_A_TASK = 50_000
#: Features times rows up to which a fit is one task's: so many bytes it holds. Above, each level of a tree is a distributed job.
CELLS_IN_TASK = 64 << 20
#: Rows from which a group's own residuals set its intervals.
CALIBRATED = 60
#: Columns that may be null in more rows than this share are no features.
SPARSE = 0.80

#: Columns of the enriched table that are features beside those of the registry.
OWN_FEATURES = (
    "neighbourhood_code", "property_type", "zoning_district", "legal_type", "tax_assessment_year", "to_civic_number", "construction_type", "building_age_bucket", "tod_tier",
    "dist_nearest_transit_m", "dist_nearest_rail_m", "transit_stops_400m", "transit_stops_800m", "unique_routes_400m", "has_rail_800m", "transit_wealth_interaction",
    "dist_nearest_school_m", "nearest_school_score", "dist_nearest_elementary_m", "dist_nearest_secondary_m", "nearest_secondary_score", "schools_within_1km",
    "parks_within_500m", "park_area_within_1km_sqm", "in_alr", "dist_alr_m", "in_floodplain", "dist_floodplain_m", "contaminated_sites_500m", "dist_nearest_contaminated_m",
    "dist_downtown_m", "str_count_500m", "str_avg_price_500m", "str_density_per_km2", "building_footprint_sqm",
    "census_median_income", "census_pop_density", "census_pct_owner_occupied", "census_pct_immigrants", "census_pct_university",
)
#: Features of the registry that are made from the value itself.
VALUE_DERIVED = ("land_to_total_ratio", "strata_fee_to_price_ratio", "list_to_sale_ratio")


@dataclass(frozen=True)
class Settings:
    """Of one boosted model; rounds end as soon as the held-out rows get no better."""

    rounds: int = 400
    depth: int = 5
    step: float = 0.1
    sample: float = 0.8
    min_rows: int = 10
    loss: str = "squared"

    def trees(self, bins: int) -> GBTRegressor:
        return GBTRegressor(
            labelCol="label", validationIndicatorCol="held", validationTol=0.0, maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step,
            subsamplingRate=self.sample, minInstancesPerNode=self.min_rows, lossType=self.loss, maxBins=bins, seed=7,
        )


# ---- feature matrix -----------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureSet:
    """The features a model was fitted with: numbers, those of them with a missing flag, and categories."""

    numeric: tuple[str, ...]
    flagged: tuple[str, ...]
    categorical: tuple[str, ...]

    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def vector_names(self) -> list[str]:
        return [*self.numeric, *[f"missing_{c}" for c in self.flagged], *self.categorical]

    def difference(self, columns: Iterable[str]) -> tuple[list[str], list[str]]:
        """(missing, extra): features that a table lacks, and its columns that are no feature; the schema is enough."""
        have = set(columns)
        return [c for c in self.names() if c not in have], sorted(have - set(self.names()))


def feature_set(df: DataFrame, phase: int = 4) -> FeatureSet:
    """Features of a table: those of the registry up to a phase and the library's own, without value-derived and sparse ones."""
    chosen = registry_table.select_features(df, phase, extra=OWN_FEATURES).drop(*VALUE_DERIVED)
    shares = null_shares(chosen)
    kinds = {f.name: f.dataType for f in chosen.schema.fields if shares[f.name] <= SPARSE}
    numeric = tuple(c for c, k in kinds.items() if isinstance(k, (T.NumericType, T.BooleanType)))
    return FeatureSet(numeric, tuple(c for c in numeric if shares[c] > 0), tuple(c for c, k in kinds.items() if isinstance(k, T.StringType)))


def encoded(df: DataFrame, features: FeatureSet) -> DataFrame:
    """Numbers with -1 for missing ones, flags and categories; an absent column counts as null in every row."""
    have = set(df.columns)

    def own(c: str, kind: str) -> Column:
        return F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)

    columns = {f"f_{c}": F.coalesce(own(c, "double"), F.lit(-1.0)) for c in features.numeric}
    columns |= {f"missing_{c}": own(c, "double").isNull().cast("double") for c in features.flagged}
    columns |= {f"k_{c}": F.coalesce(own(c, "string"), F.lit("none")) for c in features.categorical}
    return df.withColumns(columns)


def encoder(rows: DataFrame, features: FeatureSet) -> PipelineModel:
    """Category numbers by frequency, and the vector; a category that was never seen gets a number of its own."""
    index = StringIndexer(inputCols=[f"k_{c}" for c in features.categorical], outputCols=[f"i_{c}" for c in features.categorical], handleInvalid="keep")
    inputs = [f"f_{c}" for c in features.numeric] + [f"missing_{c}" for c in features.flagged] + [f"i_{c}" for c in features.categorical]
    return Pipeline(stages=[index, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(rows)


def part_of(key: str) -> Column:
    """The part a row is dealt to."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(100))
    out = F.lit("check")
    for name in ("calibrate", "stop", "fit"):
        out = F.when(place < PARTS[name], F.lit(name)).otherwise(out)
    return out


def segment_keys() -> list[Column]:
    """Segments of a row, the most specific first."""
    return [
        F.concat(F.col("neighbourhood_code"), F.lit("__"), F.col("property_type")), F.concat(F.lit("citywide__"), F.col("property_type")), F.lit(CITY),
    ]


# ---- fitting ----------------------------------------------------------------------------------------


@dataclass
class Matrix:
    """Encoded rows as written: key, property_type, neighbourhood_code, label, part and features."""

    spark: SparkSession
    path: str
    schema: T.StructType
    bins: int
    columns: list[str] = field(default_factory=list)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def of(self, segment: str) -> DataFrame:
        """A segment's rows: its own folders only."""
        area, kind = segment.split("__")
        rows = self.rows()
        rows = rows if area == "citywide" else rows.where(F.col("neighbourhood_code") == area)
        return rows if kind == "all" else rows.where(F.col("property_type") == kind)


def write_matrix(df: DataFrame, features: FeatureSet, codes: PipelineModel, path: str, key: str = "pid", target: Column | None = None) -> Matrix:
    """Encode and write rows by type and area; without a target the label is null."""
    label = F.lit(None).cast("double") if target is None else target.cast("double")
    rows = encoded(df.withColumn("label", label), features)
    out = codes.transform(rows).select(key, "label", part_of(key).alias("part"), "features", "property_type", "neighbourhood_code")
    # Spark splits what is too large of a type and area over several tasks.
    out.hint("rebalance", "property_type", "neighbourhood_code").write.partitionBy("property_type", "neighbourhood_code").parquet(path)
    bins = max([32, *[len(labels) + 2 for labels in codes.stages[0].labelsArray]])
    # The written vector keeps its metadata: which places are categories.
    return Matrix(df.sparkSession, path, out.schema, bins, features.vector_names())


def qualifying(matrix: Matrix, minimum: int) -> dict[str, int]:
    """Rows of each segment that has enough; the city as a whole always has."""
    each = matrix.rows().where(F.col("label").isNotNull()).select(F.explode(F.array_compact(F.array(*segment_keys()))).alias("segment"))
    counts = each.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return {r.segment: r.n for r in counts.where((F.col("n") >= minimum) | (F.col("segment") == CITY)).orderBy("segment").collect()}


def side_by_side(jobs: list[Callable[[], object]], spark: SparkSession, threads: int = SIDE_BY_SIDE) -> list:
    """Run some Spark jobs at a time, as many as there are cores; the first error ends the call."""
    threads = max(threads, spark.sparkContext.defaultParallelism)
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs, chunksize=1)


def fit(rows: DataFrame, settings: Settings, bins: int, n: int, width: int = 100) -> GBTRegressionModel | Boosted:
    """One model on rows with ``label``, ``features`` and ``held``: by one task where it can hold them, else by many."""
    if n * width <= CELLS_IN_TASK:
        return fit_in_task(rows, asdict(settings) | {"seed": 7}, bins, n)
    return settings.trees(bins).fit(rows.select("features", "label", "held").coalesce(max(1, n // ROWS_A_TASK)))


def save_model(model: GBTRegressionModel | Boosted, spark: SparkSession, path: str) -> None:
    if isinstance(model, Boosted):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> GBTRegressionModel | Boosted:
    return GBTRegressionModel.load(path) if "metadata" in names_in(spark, path) else Boosted.load(spark, path)


@dataclass(frozen=True)
class Shrunk:
    """A model drawn toward the middle of its rows: where trees say little about held-out rows, little is kept of them."""

    base: float
    weight: float

    def of(self, prediction: Column) -> Column:
        return F.lit(self.base) + F.lit(self.weight) * (prediction - F.lit(self.base))


def shrink(model: GBTRegressionModel | Boosted, rows: DataFrame) -> Shrunk:
    """The middle label of the fitted rows, and the weight in 0 to 1 that serves the held-out ones best."""
    base = rows.where(~F.col("held")).agg(F.percentile_approx("label", 0.5)).first()[0]
    by_tree, wanted = F.col("prediction") - F.lit(base), F.col("label") - F.lit(base)
    r = model.transform(rows.where("held")).agg(F.sum(by_tree * wanted).alias("both"), F.sum(by_tree * by_tree).alias("own")).first()
    return Shrunk(base, 1.0 if not r.own else min(max(r.both / r.own, 0.0), 1.0))


def fit_segments(matrix: Matrix, settings: Settings, minimum: int, folder: str) -> list[dict]:
    """Fit and save a model for every segment with enough rows; an entry for each."""
    known = qualifying(matrix, minimum)

    def job(segment: str, n: int) -> dict:
        rows = matrix.of(segment).where(F.col("label").isNotNull() & F.col("part").isin("fit", "stop")).withColumn("held", F.col("part") == "stop")
        model = fit(rows, settings, matrix.bins, n, len(matrix.columns))
        path = f"{folder}/{segment}"
        save_model(model, matrix.spark, path)
        drawn = shrink(model, rows)
        weights = dict(zip(matrix.columns, map(float, getattr(model.featureImportances, "toArray", lambda: model.featureImportances)()), strict=True))
        return {
            "name": segment, "kind": "value", "path": path, "rows": n, "settings": asdict(settings) | asdict(drawn) | {"rounds_used": model.getNumTrees},
            "metrics": {"importances": {c: w for c, w in weights.items() if w > 0}}, "features": matrix.columns,
        }

    largest_first = sorted(known.items(), key=lambda x: (-x[1], x[0]))
    return sorted(side_by_side([lambda s=s, n=n: job(s, n) for s, n in largest_first], matrix.spark), key=lambda e: e["name"])


# ---- scoring ----------------------------------------------------------------------------------------


def predict(rows: DataFrame, entries: list[dict]) -> DataFrame:
    """The rows with ``model_segment`` and ``prediction`` (log value) of the most specific model there is.

    Rows are written by the segment whose model scores them, and each model reads its own folder.
    """
    spark = rows.sparkSession
    known = {e["name"]: e for e in entries}
    used = F.coalesce(*[F.when(k.isin(list(known)), k) for k in segment_keys()])
    dealt, out = landing_path(spark, "to-score"), landing_path(spark, "scored")
    dealt_rows = rows.withColumn("model_segment", used).where(F.col("model_segment").isNotNull())
    dealt_rows.hint("rebalance", "model_segment").write.partitionBy("model_segment").parquet(dealt)
    schema = dealt_rows.schema
    present = [r.model_segment for r in spark.read.schema(schema).parquet(dealt).select("model_segment").distinct().collect()]

    def job(segment: str) -> None:
        entry = known[segment]
        model, drawn = load_model(spark, entry["path"]), Shrunk(entry["settings"]["base"], entry["settings"]["weight"])
        mine = spark.read.schema(schema).parquet(dealt).where(F.col("model_segment") == segment)
        model.transform(mine).drop("features").withColumn("prediction", drawn.of(F.col("prediction"))).write.parquet(f"{out}/{present.index(segment)}")

    side_by_side([lambda s=s: job(s) for s in present], spark)
    wanted = T.StructType([f for f in schema.fields if f.name != "features"] + [T.StructField("prediction", T.DoubleType())])
    if not present:
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).parquet(*[f"{out}/{i}" for i in range(len(present))])


# ---- intervals --------------------------------------------------------------------------------------


def conformal_rank(q: float) -> Rank:
    """The rank among n held-out residuals whose level a new one keeps with at least the wanted probability."""

    def rank(n: Column) -> tuple[Column, Column, Column]:
        k = F.floor((n + 1) * F.lit(q)) if q < 0.5 else F.ceil((n + 1) * F.lit(q))
        return k - 1, k - 1, F.lit(0.0)

    return rank


def interval_levels(scored: DataFrame, levels: dict[str, float] = models.LEVELS, minimum: int = CALIBRATED) -> DataFrame:
    """Residual levels of log value per (area, type), type and city, from rows that no model was fitted on.

    Ranks are exact and those of split-conformal prediction: floor((n + 1) q) below the middle and
    ceil((n + 1) q) above, so a level never rests on more than the rows can say. Groups with fewer
    than ``minimum`` rows have none, but for the city.
    """
    residual = (F.col("label") - F.col("prediction")).alias("residual")
    stacked = scored.where(F.col("label").isNotNull()).select(residual, F.explode(F.array_compact(F.array(*segment_keys()))).alias("segment"))
    ranks = {name: 0.5 if q == 0.5 else conformal_rank(q) for name, q in levels.items()}
    out = exact_percentiles(stacked, ["segment"], "residual", ranks)
    return out.where((F.col("n") >= minimum) | (F.col("segment") == CITY))


def with_levels(scored: DataFrame, levels: DataFrame, low: str = "q10", high: str = "q90") -> DataFrame:
    """Adds ``predicted``, ``lower`` and ``upper`` in money, and ``segment_used`` that set the interval."""
    known = segment_fallback(scored, levels, [low, high])
    value = F.exp("prediction")
    return known.withColumns({"predicted": value, "lower": value * F.exp(F.col(low)), "upper": value * F.exp(F.col(high))}).drop(low, high)


def coverage(intervals: DataFrame, keys: list[str], actual: str) -> DataFrame:
    """Share of rows whose actual value lies in its interval."""
    inside = (F.col(actual) >= F.col("lower")) & (F.col(actual) <= F.col("upper"))
    return intervals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.avg(inside.cast("int")) * 100).alias("covered_pct"))


# ---- search -----------------------------------------------------------------------------------------


def draw_settings(n: int, seed: int = 7, base: Settings = Settings()) -> list[Settings]:
    """The default and n - 1 others drawn from the space: depth, step (by its logarithm), sampling rate, rows a leaf, rounds."""
    dice = random.Random(seed)
    drawn = [
        replace(
            base, depth=dice.randint(3, 7), step=round(0.02 * 15 ** dice.random(), 4), sample=round(dice.uniform(0.5, 1.0), 3), min_rows=dice.choice([1, 5, 10, 20, 50]),
            rounds=dice.choice([base.rounds // 2, base.rounds, 2 * base.rounds]),
        )
        for _ in range(n - 1)
    ]
    return [base, *drawn]


def search(matrix: Matrix, folds: DataFrame, budget: int = 9, eta: int = 3, seed: int = 7, base: Settings = Settings()) -> tuple[Settings, list[tuple]]:
    """Successive halving over the city's rows: (best settings, trials as (rung, share of rows, fold, settings, log error)).

    All settings are tried on a small hash sample, the best 1 / eta on one eta times as large, and
    so on. The finalists, of which the default is always one, are fitted on all rows and judged on
    every area fold, which none of them saw; the least mean error wins.
    """
    dealt = materialize(matrix.rows().where(F.col("label").isNotNull()).join(small_side(folds), "neighbourhood_code").withColumn("place", F.pmod(F.xxhash64("features", F.lit("rung")), F.lit(1000))))
    counts = {r.fold: r.n for r in dealt.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, folds_there = sum(counts.values()), sorted(counts)

    def trial(settings: Settings, share: float, fold: int) -> float:
        some = dealt.where(F.col("place") < 1000 * share)
        train = some.where(F.col("fold") != fold).withColumn("held", F.col("part") == "stop")
        model = fit(train, settings, matrix.bins, int(total * share), len(matrix.columns))
        wrong = F.avg(F.abs(shrink(model, train).of(F.col("prediction")) - F.col("label")))
        return model.transform(dealt.where(F.col("fold") == fold)).agg(wrong).first()[0]

    rungs = 0
    while eta ** (rungs + 1) <= budget:
        rungs += 1
    alive, trials = draw_settings(budget, seed, base), []
    for rung in range(rungs):
        share, fold = float(eta) ** (rung - rungs), folds_there[rung % len(folds_there)]
        errors = side_by_side([lambda s=s: trial(s, share, fold) for s in alive], matrix.spark)
        trials += [(rung, share, fold, json.dumps(asdict(s), sort_keys=True), e) for s, e in zip(alive, errors, strict=True)]
        order = sorted(range(len(alive)), key=lambda i: errors[i])
        alive = [alive[i] for i in order[: max(1, len(alive) // eta)]]
    finalists = list(dict.fromkeys([base, *alive]))
    pairs = [(s, f) for s in finalists for f in folds_there]
    errors = side_by_side([lambda s=s, f=f: trial(s, 1.0, f) for s, f in pairs], matrix.spark)
    trials += [(rungs, 1.0, f, json.dumps(asdict(s), sort_keys=True), e) for (s, f), e in zip(pairs, errors, strict=True)]
    mean = {s: sum(e for (x, _), e in zip(pairs, errors, strict=True) if x == s) / len(folds_there) for s in finalists}
    return min(finalists, key=lambda s: mean[s]), trials


# ---- ratio models -----------------------------------------------------------------------------------


def ratio_models(matrix: Matrix, folder: str, settings: Settings = Settings(rounds=300, depth=3, loss="absolute"), folds: int = 5, minimum: int = 30) -> list[dict]:
    """A model of the sale ratio per property type, with its error over folds; the median where a type has too few sales."""
    counts = {r.property_type: r.n for r in matrix.rows().groupBy("property_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    fold = F.pmod(F.xxhash64("features", F.lit("fold")), F.lit(folds))
    mids = {r.property_type: r.mid for r in exact_percentiles(matrix.rows(), ["property_type"], "label", {"mid": 0.5}).collect()}

    wrong = lambda x: F.avg(F.abs(x - F.col("label")))

    def rows_of(kind: str) -> DataFrame:
        return matrix.of(f"citywide__{kind}").withColumns({"held": F.col("part") == "stop", "fold": fold})

    def fold_error(kind: str, n: int, f: int) -> float | None:
        train = rows_of(kind).where(F.col("fold") != f)
        model = fit(train, settings, matrix.bins, n, len(matrix.columns))
        return model.transform(rows_of(kind).where(F.col("fold") == f)).agg(wrong(shrink(model, train).of(F.col("prediction")))).first()[0]

    def whole(kind: str, n: int) -> dict:
        rows = rows_of(kind)
        entry = {"name": f"ratio__{kind}", "kind": "ratio", "rows": n, "features": matrix.columns, "path": ""}
        naive = rows.agg(wrong(F.lit(mids[kind]))).first()[0]
        if n < minimum:
            return entry | {"settings": {"median": mids[kind]}, "metrics": {"median_mae": naive}}
        model = fit(rows, settings, matrix.bins, n, len(matrix.columns))
        path = f"{folder}/ratio__{kind}"
        save_model(model, matrix.spark, path)
        drawn = asdict(settings) | asdict(shrink(model, rows)) | {"rounds_used": model.getNumTrees}
        return entry | {"path": path, "settings": drawn, "metrics": {"median_mae": naive}}

    # All fits of all types side by side, the largest first.
    jobs: list[tuple[str, Callable[[], object]]] = []
    for kind, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        jobs.append((kind, lambda k=kind, n=n: whole(k, n)))
        if n >= minimum:
            jobs += [(kind, lambda k=kind, n=n, f=f: fold_error(k, n, f)) for f in range(folds)]
    done = list(zip([kind for kind, _ in jobs], side_by_side([job for _, job in jobs], matrix.spark), strict=True))
    entries = {kind: out for kind, out in done if isinstance(out, dict)}
    for kind, entry in entries.items():
        errors = [out for k, out in done if k == kind and isinstance(out, float)]
        if entry["path"]:
            entry["metrics"] = {"cv_mae": sum(errors) / len(errors), "folds": len(errors)} | entry["metrics"]
    return [entries[kind] for kind in sorted(entries)]


def predict_ratio(rows: DataFrame, entries: list[dict]) -> DataFrame:
    """The rows with ``predicted_ratio`` of their type's model or median."""
    by_type = [e | {"name": f"citywide__{e['name'].removeprefix('ratio__')}"} for e in entries]
    fitted = [e for e in by_type if e["path"]]
    kind = F.concat(F.lit("citywide__"), "property_type")
    modelled = F.coalesce(kind.isin([e["name"] for e in fitted]), F.lit(False))
    by_model = predict(rows.where(modelled), fitted).drop("model_segment").withColumnRenamed("prediction", "predicted_ratio")
    mid = F.lit(None).cast("double")
    for e in by_type:
        if not e["path"]:
            mid = F.when(kind == e["name"], F.lit(e["settings"]["median"])).otherwise(mid)
    return by_model.unionByName(rows.drop("features").where(~modelled).withColumn("predicted_ratio", mid))
