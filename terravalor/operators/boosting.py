"""Boosted regression trees of bounded row sets, each grown by one task from binned features.

The method is that of ``pyspark.ml``'s boosted trees: features in bins drawn from a sample,
categories ordered by their mean in each node, splits by variance, a first tree on the labels
and the next ones on the negative gradient, ended by the first round that does the held-out
rows no good. There a level of a tree is a Spark job, so a fit of few rows waits more than it
computes; here a fit is one task and many fits run side by side. Rows are held as a byte or two
a feature, and the caller bounds them.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows drawn to place the bins.
SAMPLE_ROWS = 20_000


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last: between all distinct values where they are few, else at even counts."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) >= bins:
        reached = np.cumsum(counts)[:-1] * bins // max(len(values), 1)
        between = between[np.flatnonzero(np.diff(reached, prepend=0) > 0)]
    return between


def binned(values: np.ndarray, edges: list, categories: list[int]) -> np.ndarray:
    """(features, rows): the bin of each value; a category is its own bin."""
    widest = max([len(e) + 1 for e in edges] + categories, default=1)
    out = np.empty((values.shape[1], values.shape[0]), np.uint8 if widest <= 256 else np.uint16)
    for f in range(values.shape[1]):
        out[f] = np.clip(values[:, f], 0, categories[f] - 1) if categories[f] else np.searchsorted(edges[f], values[:, f], side="left")
    return out


def vectors(column: pa.Array) -> np.ndarray:
    """An Arrow column of arrays of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spread_leaves(tree: list, x: np.ndarray, rows: np.ndarray, out: np.ndarray, weight: float) -> None:
    """Add a tree's values to the rows."""
    todo = [(0, rows)]
    while todo:
        at, mine = todo.pop()
        node = tree[at]
        if "f" not in node:
            out[mine] += weight * node["v"]
            continue
        left = np.asarray(node["left"], bool).take(x[node["f"]].take(mine))
        todo += [(node["l"], mine[left]), (node["r"], mine[~left])]


def _histograms(x: np.ndarray, sizes: list[int], features: list[int], rows: np.ndarray, target: np.ndarray) -> list[tuple]:
    """Rows and sum of the target in each bin of each feature."""
    mine, out = target[rows], []
    for f in features:
        b = x[f].take(rows).astype(np.intp)
        out.append((np.bincount(b, minlength=sizes[f]), np.bincount(b, mine, minlength=sizes[f])))
    return out


def _best_split(stats: list[tuple], features: list[int], categories: list[int], n: int, total: float, least: int) -> tuple | None:
    """(gain, feature, bins that go left) of the split that lowers the variance most."""
    best = None
    for f, (counts, sums) in zip(features, stats, strict=True):
        order = np.arange(len(counts))
        if categories[f]:
            means = np.divide(sums, counts, out=np.full(len(counts), np.inf), where=counts > 0)
            order = np.argsort(means, kind="stable")
        on_left, sum_left = np.cumsum(counts[order])[:-1], np.cumsum(sums[order])[:-1]
        valid = (on_left >= max(least, 1)) & (n - on_left >= max(least, 1))
        if not valid.any():
            continue
        at_left, at_right = np.maximum(on_left, 1), np.maximum(n - on_left, 1)
        gains = np.where(valid, sum_left**2 / at_left + (total - sum_left) ** 2 / at_right - total**2 / n, -np.inf)
        k = int(np.argmax(gains))
        if gains[k] > 1e-12 * n and (best is None or gains[k] > best[0]):
            left = np.zeros(len(counts), bool)
            left[order[: k + 1]] = True
            best = (float(gains[k]), f, left)
    return best


def grow_tree(x: np.ndarray, sizes: list[int], categories: list[int], rows: np.ndarray, target: np.ndarray, depth: int, least: int) -> list[dict]:
    """A tree as a list of nodes: bins that go left, children and gain, or a value."""
    features = [f for f in range(len(sizes)) if sizes[f] > 1]
    tree: list[dict] = [{}]
    level = [(0, rows, _histograms(x, sizes, features, rows, target))]
    for deep in range(depth + 1):
        below = []
        for at, mine, stats in level:
            n, total = len(mine), float(target[mine].sum())
            tree[at]["v"] = total / n if n else 0.0
            split = _best_split(stats, features, categories, n, total, least) if deep < depth and n >= 2 * least else None
            if split is None:
                continue
            gain, f, left = split
            goes = left.take(x[f].take(mine))
            sides = (mine[goes], mine[~goes])
            tree[at] |= {"f": f, "left": left.astype(int).tolist(), "gain": gain, "l": len(tree), "r": len(tree) + 1}
            tree += [{}, {}]
            parts: list = [None, None]
            if deep + 1 < depth:
                # The smaller side is counted, the larger is what remains.
                few = int(len(sides[1]) < len(sides[0]))
                parts[few] = _histograms(x, sizes, features, sides[few], target)
                parts[1 - few] = [(c - a, s - b) for (c, s), (a, b) in zip(stats, parts[few], strict=True)]
            below += [(tree[at]["l"], sides[0], parts[0]), (tree[at]["r"], sides[1], parts[1])]
        level = below
    return tree


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray, sizes: list[int], categories: list[int], s: dict) -> tuple[list, list[float]]:
    """Trees and their weights; growth ends with the first round after which the held-out error isn't lower."""
    dice, rows = np.random.default_rng(s["seed"]), np.arange(len(y), dtype=np.int32)
    train, absolute = rows[~held], s["loss"] == "absolute"
    score, trees, weights, best, kept = np.zeros(len(y)), [], [], None, 1
    for turn in range(s["rounds"]):
        target = y if turn == 0 else np.sign(y - score) if absolute else 2.0 * (y - score)
        drawn = train if s["sample"] >= 1.0 else train[dice.random(len(train)) < s["sample"]]
        trees.append(grow_tree(x, sizes, categories, drawn, target, s["depth"], s["min_rows"]))
        weights.append(1.0 if turn == 0 else s["step"])
        spread_leaves(trees[-1], x, rows, score, weights[-1])
        off = y[held] - score[held]
        error = float(np.mean(np.abs(off) if absolute else off**2)) if len(off) else float("nan")
        if best is not None and not error < best:
            break
        best, kept = error, turn + 1
    return trees[:kept], weights[:kept]


class Boosted:
    """A grown model: bins of the features, trees and their weights."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.about = json.loads(text)

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - as pyspark.ml names it
        return len(self.about["trees"])

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802 - as pyspark.ml names it
        """Gain of each feature over all trees, as shares."""
        out = np.zeros(len(self.about["edges"]))
        for tree in self.about["trees"]:
            for node in tree:
                if "f" in node:
                    out[node["f"]] += node["gain"]
        return out / out.sum() if out.sum() > 0 else out

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``."""
        about = self.about

        @F.arrow_udf("double")
        def predicted(column: pa.Array) -> pa.Array:
            score = np.zeros(len(column))
            if len(column):
                x = binned(vectors(column), about["edges"], about["categories"])
                at = np.arange(len(column))
                for tree, weight in zip(about["trees"], about["weights"], strict=True):
                    spread_leaves(tree, x, at, score, weight)
            return pa.array(score)

        return rows.withColumn("prediction", predicted(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        return Boosted(spark.read.schema("model string").parquet(path).first().model)


def fit_in_task(rows: DataFrame, settings: dict, bins: int, n: int) -> Boosted:
    """Fit on rows with ``label``, ``features`` and ``held``; the bins come from a sample, as those of pyspark.ml do."""
    attributes = rows.schema["features"].metadata.get("ml_attr", {})
    named = {a["idx"]: len(a["vals"]) for a in attributes.get("attrs", {}).get("nominal", [])}
    drawn = rows.where("NOT held").select(vector_to_array("features").alias("x"))
    if n > SAMPLE_ROWS:
        drawn = drawn.sample(fraction=SAMPLE_ROWS / n, seed=7)
    some = vectors(drawn.toArrow().column("x"))
    categories = [named.get(f, 0) for f in range(some.shape[1])]
    edges = [[] if categories[f] else edges_of(some[:, f], bins).tolist() for f in range(some.shape[1])]
    sizes = [c or len(e) + 1 for c, e in zip(categories, edges, strict=True)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels, held = [], [], []
        for batch in batches:
            if batch.num_rows:
                parts.append(binned(vectors(batch.column("x")), edges, categories))
                labels.append(batch.column("label").to_numpy(zero_copy_only=False))
                held.append(batch.column("held").to_numpy(zero_copy_only=False))
        x = np.concatenate(parts, axis=1)
        parts.clear()
        trees, weights = boost(x, np.concatenate(labels), np.concatenate(held).astype(bool), sizes, categories, settings)
        text = json.dumps({"edges": edges, "categories": categories, "trees": trees, "weights": weights})
        yield pa.RecordBatch.from_pydict({"model": [text]})

    one = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), "held").coalesce(1)
    return Boosted(one.mapInArrow(grow, "model string").collect()[0].model)


# Functions for Python workers travel whole, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
