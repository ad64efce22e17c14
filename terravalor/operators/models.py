"""Value models: price lines per segment, boosted trees, clusters, intervals, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor import constants as K
from terravalor.functions import geo
from terravalor.functions.quantiles import exact_percentiles, medians
from terravalor.operators.serve import segment_fallback
from terravalor.session import materialize, small_side

LEVELS = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}


def add_distance(df: DataFrame) -> DataFrame:
    d = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(K.DOWNTOWN[0]), F.lit(K.DOWNTOWN[1]))
    return df.withColumn("dist_downtown_m", d)


def panel_rows(panel: DataFrame) -> DataFrame:
    """Panel rows with a type and a total, ready for a temporal split."""
    from terravalor.operators.universe import add_type

    typed = add_type(panel)
    return typed.withColumn("total_assessed_value", F.col("current_land_value") + F.col("current_improvement_value")).where(
        F.col("property_type").isin(*K.RESIDENTIAL_TYPES)
    )


# ---- price gradient and segment lines ---------------------------------------------------------


def _line(value: Column, distance: Column) -> list[Column]:
    log_value = F.log(value)
    return [
        F.count(F.lit(1)).alias("n"), F.regr_intercept(log_value, distance).alias("intercept"),
        F.regr_slope(log_value, distance).alias("slope"),
    ]


def price_gradient(df: DataFrame, minimum: int = 10) -> DataFrame:
    """Residual of log value on the distance to downtown, one line per type."""
    usable = (F.col("total_assessed_value") > 0) & F.col("dist_downtown_m").isNotNull()
    lines = small_side(
        df.where(usable).groupBy("property_type").agg(*_line(F.col("total_assessed_value"), F.col("dist_downtown_m"))).where(F.col("n") >= minimum)
    )
    fit = F.col("intercept") + F.col("slope") * F.col("dist_downtown_m")
    joined = df.join(lines, "property_type", "left")
    return joined.withColumn("log_value_residual", F.when(usable, F.log("total_assessed_value") - fit)).drop("n", "intercept", "slope")


def segment_labels() -> Column:
    return F.array(
        F.concat_ws("__", "neighbourhood_code", "property_type"), F.concat_ws("__", F.lit("citywide"), "property_type"), F.lit("citywide__all")
    )


def segment_lines(df: DataFrame, minimum: int = 200) -> DataFrame:
    """One line per segment with enough rows; citywide segments come from the same scan."""
    usable = df.where(
        (F.col("total_assessed_value") > 0) & F.col("dist_downtown_m").isNotNull() & F.col("neighbourhood_code").isNotNull()
    )
    stacked = usable.select("total_assessed_value", "dist_downtown_m", F.explode(segment_labels()).alias("segment"))
    return stacked.groupBy("segment").agg(*_line(F.col("total_assessed_value"), F.col("dist_downtown_m"))).where(F.col("n") >= minimum)


def predict_lines(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Predicted value from the most specific segment that has a line."""
    out = segment_fallback(df, lines, ["intercept", "slope"])
    return out.withColumn("predicted", F.exp(F.col("intercept") + F.col("slope") * F.col("dist_downtown_m"))).drop("intercept", "slope")


def residual_levels(predicted: DataFrame, actual: str = "total_assessed_value") -> DataFrame:
    """Exact residual quantiles of log value per used segment: monotone by construction."""
    rows = predicted.where((F.col(actual) > 0) & (F.col("predicted") > 0)).select(
        F.col("segment_used").alias("segment"), (F.log(actual) - F.log("predicted")).alias("residual")
    )
    return exact_percentiles(rows, ["segment"], "residual", LEVELS)


def with_intervals(predicted: DataFrame, levels: DataFrame, low: str = "q10", high: str = "q90") -> DataFrame:
    """Bounds around the prediction; swapped if crossed, never below zero."""
    side = levels.select(F.col("segment").alias("segment_used"), F.col(low).alias("_lo"), F.col(high).alias("_hi"))
    a, b = F.col("predicted") * F.exp("_lo"), F.col("predicted") * F.exp("_hi")
    return predicted.join(side, "segment_used", "left").withColumns(
        {"lower": F.greatest(F.least(a, b), F.lit(0.0)), "upper": F.greatest(F.greatest(a, b), F.lit(0.0))}
    ).drop("_lo", "_hi")


def backtest_lines(panel: DataFrame, test_year: int, minimum: int = 200) -> DataFrame:
    """Train before the year, predict the year, fall back along segments."""
    train = panel.where(F.col("tax_assessment_year") < test_year)
    test = panel.where(F.col("tax_assessment_year") == test_year)
    return predict_lines(test, segment_lines(train, minimum)).where(F.col("predicted").isNotNull())


# ---- evaluation --------------------------------------------------------------------------------


def metrics(predictions: DataFrame, actual: str = "total_assessed_value", predicted: str = "predicted", minimum: int = 5) -> DataFrame:
    """Errors overall, by type, by area and by segment, from predictions that are worked out once and stacked."""
    y, p = F.col("_y"), F.col("_p")
    # Read several times below: the predictions' joins run once.
    valid = materialize(predictions.where((F.col(actual) > 0) & F.col(predicted).isNotNull()).select(
        F.col(actual).alias("_y"), F.col(predicted).alias("_p"), "property_type", "neighbourhood_code", "segment_used"
    ))
    stacked = valid.select(
        "_y", "_p",
        F.explode(
            F.array(
                F.lit("all"), F.concat(F.lit("type:"), "property_type"), F.concat(F.lit("area:"), "neighbourhood_code"),
                F.concat(F.lit("segment:"), "segment_used"),
            )
        ).alias("scope"),
    ).where("scope IS NOT NULL").withColumns({"_ape": F.abs(y - p) / y * 100, "_ae": F.abs(y - p)})
    err = y - p
    stats = stacked.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("_ape").alias("mean_ape"), F.avg("_ae").alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.when(F.var_pop(y) > 0, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        *[(F.avg((F.col("_ape") <= x).cast("int")) * 100).alias(f"hit_rate_{x}pct") for x in (5, 10, 15)],
        (F.avg(p - y) / F.avg(y) * 100).alias("bias"),
    )
    mids = medians(stacked, ["scope"], {"mape": "_ape", "median_ae": "_ae"})
    return stats.join(mids, "scope").where((F.col("scope") == "all") | (F.col("n_samples") >= minimum))


def benchmark(predictions: DataFrame, train: DataFrame, actual: str = "total_assessed_value") -> DataFrame:
    """Against the median of (area, type), else type, else all: error of both and share of wins."""
    stacked = train.where(F.col(actual) > 0).select(actual, F.explode(segment_labels()).alias("segment"))
    mids = exact_percentiles(stacked, ["segment"], actual, {"naive": 0.5})
    rows = segment_fallback(predictions.drop("segment_used"), mids, ["naive"])
    y = F.col(actual)
    tagged = rows.withColumns(
        {"_m": F.abs(y - F.col("predicted")) / y * 100, "_b": F.abs(y - F.col("naive")) / y * 100, "scope": F.lit("all")}
    )
    wins = tagged.groupBy("scope").agg((F.avg((F.col("_m") < F.col("_b")).cast("int")) * 100).alias("win_pct"))
    both = medians(tagged, ["scope"], {"model_mape": "_m", "benchmark_mape": "_b"})
    return wins.join(both, "scope").withColumn(
        "improvement_pct", (F.col("benchmark_mape") - F.col("model_mape")) / F.when(F.col("benchmark_mape") > 0, F.col("benchmark_mape")) * 100
    ).drop("scope")


def spatial_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Fold per area: west, east and other areas interleaved, then dealt in turn."""
    from terravalor.operators.market import area_names

    areas = area_names(df.where(F.col("neighbourhood_code").isNotNull()).select("neighbourhood_code").distinct())
    known = F.col("neighbourhood_code").isin(*K.AREA_NAMES)
    side = F.when(F.col("neighbourhood_name").isin(*K.WEST_SIDE_AREAS), 0).when(known, 1).otherwise(2)
    order = F.coalesce(F.col("neighbourhood_code").try_cast("int"), F.lit(0))
    in_side = areas.withColumn("_side", side).withColumn(
        "_i", F.row_number().over(Window.partitionBy("_side").orderBy(order, "neighbourhood_code"))
    )
    # The window orders the list of areas, not properties.
    turn = F.row_number().over(Window.orderBy("_i", "_side")) - 1
    return in_side.withColumn("fold", turn % folds).select("neighbourhood_code", "fold")


# ---- micro-neighbourhoods -----------------------------------------------------------------------


#: Rounds after which centres that still move are an error; they rest after some tens.
MOST_ROUNDS = 1_000


def micro_neighbourhoods(df: DataFrame, features: list[str], k: int = 3, min_size: int = 50, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(properties with cluster, centres): k-means of all areas at once.

    Every round is one join with the short table of centres and one aggregate;
    no area is ever gathered in one place. Features are standardized per area.
    Rounds go on until no centre moves more than the tolerance.
    """
    present = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    rows = df.where(F.col("neighbourhood_code").isNotNull() & present).select("pid", "neighbourhood_code", *features)
    stats = rows.groupBy("neighbourhood_code").agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    stats = small_side(stats.withColumn("_k", F.greatest(F.lit(1), F.least(F.lit(k), F.floor(F.col("_n") / min_size)))))
    z = [F.coalesce((F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")), F.lit(0.0)) for f in features]
    points = materialize(rows.join(stats, "neighbourhood_code").select("pid", "neighbourhood_code", "_k", F.array(*z).alias("x")))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    cuts = small_side(points.groupBy("neighbourhood_code").agg(F.percentile_approx(total, [i / k for i in range(1, k)], 1000).alias("_cuts")))
    start = points.join(cuts, "neighbourhood_code").withColumn(
        "cluster", F.least(F.aggregate("_cuts", F.lit(0), lambda a, c: a + F.when(total > c, 1).otherwise(0)), F.col("_k").cast("int") - 1)
    )

    def centres_of(assigned: DataFrame) -> DataFrame:
        means = [F.avg(F.col("x")[i]).alias(f"_c{i}") for i in range(len(features))]
        one = assigned.groupBy("neighbourhood_code", "cluster").agg(*means).select(
            "neighbourhood_code", F.struct("cluster", F.array(*[F.col(f"_c{i}") for i in range(len(features))]).alias("c")).alias("_e")
        )
        return small_side(one.groupBy("neighbourhood_code").agg(F.sort_array(F.collect_list("_e")).alias("centres")))

    def assign(centres: DataFrame) -> DataFrame:
        return points.join(centres, "neighbourhood_code").withColumn("cluster", closest(F.col("x"), F.col("centres")))

    def way(old: DataFrame, new: DataFrame) -> float:
        """The farthest that a centre moved; a cluster that came or went counts as far."""
        pair = old.select("neighbourhood_code", F.col("centres").alias("_old")).join(new, "neighbourhood_code")
        before_of = lambda e: F.get(F.filter("_old", lambda o: o["cluster"] == e["cluster"]), F.lit(0))["c"]
        steps = F.transform("centres", lambda e: F.coalesce(F.sqrt(squared_distance(before_of(e), e["c"])), F.lit(float("inf"))))
        gone = F.exists("_old", lambda o: ~F.exists("centres", lambda e: e["cluster"] == o["cluster"]))
        return pair.agg(F.max(F.when(gone, F.lit(float("inf"))).otherwise(F.array_max(steps)))).first()[0] or 0.0

    centres, moved, rounds = centres_of(start), float("inf"), 0
    while moved > tolerance:
        if rounds == MOST_ROUNDS:
            raise RuntimeError(f"centres still moved by {moved} after {MOST_ROUNDS} rounds")
        before, centres, rounds = centres, centres_of(assign(centres)), rounds + 1
        moved = way(before, centres)
    label = F.concat_ws("_", "neighbourhood_code", "cluster")
    done = assign(centres).select("pid", "neighbourhood_code", "cluster", label.alias("micro_neighbourhood"))
    rest = df.where(F.col("neighbourhood_code").isNotNull() & ~present).select("pid", "neighbourhood_code").withColumn("cluster", F.lit(0))
    return done.unionByName(rest.withColumn("micro_neighbourhood", label)), centres


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def closest(x: Column, centres: Column) -> Column:
    """Label of the nearest of a short array of struct<cluster, c>; the lowest label of ties."""
    scored = F.transform(centres, lambda e: F.struct(squared_distance(x, e["c"]).alias("d"), e["cluster"].alias("cluster")))
    return F.array_min(scored)["cluster"]


def label_centres(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per label, as one row: array<struct<cluster, c>>."""
    long = vectors.select(label, F.posexplode(vector).alias("i", "v"))
    means = long.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    per_label = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"))
    return per_label.agg(
        F.sort_array(F.collect_list(F.struct(F.col(label).alias("cluster"), F.transform("p", lambda e: e["m"]).alias("c")))).alias("centres")
    )


def assign_centres(vectors: DataFrame, centres: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Nearest of a short list of centres per vector."""
    x = F.transform(vector, lambda v: v.cast("double"))
    pairs = vectors.select(key, x.alias("x"), F.explode(centres.scalar()).alias("e"))
    best = pairs.groupBy(key).agg(F.min(F.struct(squared_distance(F.col("x"), F.col("e.c")).alias("d"), F.col("e.cluster").alias("cluster"))).alias("b"))
    return best.select(key, F.col("b.cluster").alias("cluster"))


# ---- sales for the ratio model ------------------------------------------------------------------


def ratio_model_rows(sales: DataFrame, sparse_limit: float = 0.60) -> DataFrame:
    """Valid, trimmed sales with features for the ratio model; sparse columns dropped."""
    from terravalor.operators.features import drop_sparse
    from terravalor.operators.market import trim_outliers

    valid = sales.where(F.col("ratio").between(0.5, 2.0) & F.col("neighbourhood_code").isNotNull())
    return drop_sparse(trim_outliers(valid, ["neighbourhood_code", "property_type"], "ratio"), sparse_limit, inclusive=True)
