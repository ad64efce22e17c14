"""The learner of bounded row sets: its splits by hand, beside pyspark.ml on the same rows, and one job a fit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from terravalor.operators import boosting
from terravalor.operators import value_models as V
from terravalor.session import landing_path, materialize


def test_a_tree_splits_where_the_variance_falls_most():
    values = np.array([[0.0, 2.0], [1.0, 0.0], [2.0, 2.0], [3.0, 1.0], [4.0, 1.0], [5.0, 0.0]])
    edges = [boosting.edges_of(values[:, 0], 32).tolist(), []]
    assert edges[0] == [0.5, 1.5, 2.5, 3.5, 4.5]
    x = boosting.binned(values, edges, [0, 3])
    assert x.tolist() == [[0, 1, 2, 3, 4, 5], [2, 0, 2, 1, 1, 0]]
    by_number = boosting.grow_tree(x, [6, 3], [0, 3], np.arange(6), np.array([1.0, 1.0, 1.0, 9.0, 9.0, 9.0]), 2, 1)
    assert by_number[0]["f"] == 0 and by_number[0]["left"] == [1, 1, 1, 0, 0, 0] and [n["v"] for n in by_number[1:]] == [1.0, 9.0]
    by_class = boosting.grow_tree(x, [6, 3], [0, 3], np.arange(6), np.array([5.0, 1.0, 5.0, 1.0, 1.0, 1.0]), 1, 1)
    assert by_class[0]["f"] == 1 and by_class[0]["left"] == [1, 1, 0]
    assert len(boosting.grow_tree(x, [6, 3], [0, 3], np.arange(6), np.arange(6.0), 3, 4)) == 1


def test_bins_hold_even_counts():
    edges = boosting.edges_of(np.arange(1_000.0), 10)
    assert len(edges) == 9 and np.bincount(boosting.binned(np.arange(1_000.0)[:, None], [edges.tolist()], [0])[0]).tolist() == [100] * 10


@pytest.mark.parametrize("loss", ["squared", "absolute"])
def test_it_does_what_the_distributed_learner_does(spark, monkeypatch, loss):
    rows = spark.range(6_000, numPartitions=2).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.floor(F.rand(3) * 4).cast("double").alias("c"), F.randn(4).alias("noise"))
    rows = rows.withColumn("label", F.sin(6 * F.col("a")) + F.col("b") * (F.col("c") % 2) + 0.1 * F.col("noise"))
    rows = materialize(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).withColumn("held", F.col("noise") > 1.2))
    settings = V.Settings(rounds=60, depth=3, sample=1.0, loss=loss)
    off = lambda m: m.transform(rows.where("held")).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"boost-{loss}", "one fit")
    one = V.fit(rows, settings, 32, 6_000)
    assert len(jobs.getJobIdsForGroup(f"boost-{loss}")) <= 3
    spark.sparkContext.setJobGroup("other", "")
    monkeypatch.setattr(V, "CELLS_IN_TASK", 0)
    many = V.fit(rows, settings, 32, 6_000)
    assert off(one) == pytest.approx(off(many), rel=0.1) and one.featureImportances == pytest.approx(many.featureImportances.toArray(), abs=0.05)
    for model, kind in ((one, boosting.Boosted), (many, type(many))):
        path = landing_path(spark, "model")
        V.save_model(model, spark, path)
        again = V.load_model(spark, path)
        assert isinstance(again, kind) and off(again) == off(model) and again.getNumTrees == model.getNumTrees
