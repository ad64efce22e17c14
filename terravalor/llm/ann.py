"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table cuts Gaussian projections of the vectors into cells. A query visits
its own bucket and then those beside it in order of the estimated probability
that a neighbour lies there, until that adds up to the table's target; what the
tables bring is merged and ranked by the exact distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor.session import materialize, small_side

TABLES = 2
#: Estimated probability that a neighbour lies in some visited bucket of some table.
TARGET = 0.97
#: Rows that the cell widths are fitted on: those of the smallest hashes of their ids.
SAMPLE = 2048
#: Vectors of one bucket that a task compares at a time; more are dealt to parts.
PART = 2048
SEED = 20_240_501


def projections(rows: int) -> int:
    """Projections of a table: one more for every sixteenfold growth, so that buckets grow slower than the table."""
    return max(3, round(math.log2(max(rows, 2)) / 4))


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, all components finite numbers, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit(sample: np.ndarray) -> float:
    """The distance at which neighbours are looked for: nine of ten sample vectors have one within it."""
    if len(sample) < 2:
        return 0.0
    square = (sample**2).sum(axis=1)
    d = square[:, None] + square[None, :] - 2 * sample @ sample.T
    np.fill_diagonal(d, np.inf)
    return float(np.sqrt(np.maximum(np.quantile(d.min(axis=1), 0.9), 0)))


class Tables:
    """The hash functions: ``tables`` times ``m`` projections for each dimension, cells twice the radius wide."""

    def __init__(self, radii: dict[int, float], m: int, tables: int = TABLES) -> None:
        self.radii, self.m, self.tables = radii, m, tables

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers (vector, table, projection) and positions within the cells, 0 to 1."""
        dim = vectors.shape[1]
        radius = self.radii.get(dim, 0.0)
        draw = np.random.default_rng([SEED, dim])
        a = draw.normal(size=(dim, self.tables * self.m))
        shift = draw.uniform(size=self.tables * self.m)
        if radius <= 0:  # nothing known of this dimension: one bucket holds all
            return np.zeros((len(vectors), self.tables, self.m), dtype=np.int64), np.full((len(vectors), self.tables, self.m), 0.5)
        at = (vectors @ a / (2 * radius) + shift).reshape(len(vectors), self.tables, self.m)
        cell = np.floor(at)
        return cell.astype(np.int64), at - cell

    def probes(self, cell: np.ndarray, inside: np.ndarray, target: float) -> Iterator[np.ndarray]:
        """Buckets of one table by falling probability, until they add up to the target.

        A neighbour's projection is normal around the query's with the radius as deviation: the
        cells are two deviations wide.
        """
        phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        mass = [[phi(2 * (s + 1 - x)) - phi(2 * (s - x)) for s in (-1, 0, 1)] for x in inside]
        moves = sorted((math.log(p[1]) - math.log(max(p[s + 1], 1e-300)), i, s) for i, p in enumerate(mass) for s in (-1, 1))
        own = math.prod(p[1] for p in mass)
        yield cell
        reached, heap = own, [(moves[0][0], (0,))]
        while heap and reached < target:
            cost, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < len(moves):
                heapq.heappush(heap, (cost + moves[last + 1][0], (*chosen, last + 1)))
                heapq.heappush(heap, (cost - moves[last][0] + moves[last + 1][0], (*chosen[:-1], last + 1)))
            if len({moves[c][1] for c in chosen}) == len(chosen):
                beside = cell.copy()
                for c in chosen:
                    beside[moves[c][1]] += moves[c][2]
                reached += own * math.exp(-cost)
                yield beside


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _by_dimension(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in frame.groupby(frame["vector"].map(len), sort=False):
        yield part


def nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest of the vectors but itself: (query's place, ids, distances), ties to smaller ids.

    Products pick what may be among the k nearest; these are measured by differences.
    """
    rough = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2 * queries @ vectors.T
    slack = 1e-9 * ((queries**2).sum(axis=1) + (vectors**2).sum(axis=1).max())
    for i in range(len(queries)):
        row = rough[i]
        row[ids == own[i]] = np.inf
        limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
        some = np.flatnonzero((row <= limit + slack[i]) & (row < np.inf))
        if len(some):
            distance = np.sqrt(((vectors[some] - queries[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[some], distance))[:k]
            yield i, ids[some][order], distance[order]


def _compare(k: int):
    """Members of a part come first, then the queries that visit it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, vectors = None, [], []
        for frame in frames:
            if not len(frame):
                continue
            names = list(zip(frame["bucket"], frame["part"], strict=True))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[a] != part:
                    part, ids, vectors = names[a], [], []
                piece = frame.iloc[a:b]
                asks = piece["asks"].to_numpy()
                members = piece[~asks]
                if len(members):
                    ids.append(members["id"].to_numpy())
                    vectors.append(_stack(members["vector"]))
                queries = piece[asks]
                if len(queries) and ids:
                    all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
                    for at in range(0, len(queries), 256):
                        some = queries.iloc[at : at + 256]
                        own = some["id"].to_numpy()
                        for i, found, distance in nearest(_stack(some["vector"]), all_ids, all_vectors, own, k):
                            out.append(pd.DataFrame({"query_id": own[i], "vec_id": found, "score": distance}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def _scan(members: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Each probe (bucket, id, vector) against all members of its bucket, which is dealt to parts of a bounded size."""
    sizes = small_side(members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    held = members.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "vector")
    asked = probes.join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "vector")
    dealt = held.unionByName(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "asks")
    return dealt.mapInPandas(_compare(k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for the rows where ``asks`` holds, by Euclidean distance.

    Every usable row is indexed; widths are fitted on a sample of SAMPLE rows. A query for which
    the visited buckets hold fewer than k is compared with all rows, in parts. Rows with a null id
    and unusable vectors take no part; vectors meet only those of their own length; rows of one id
    are one candidate, the nearest. A bucket of many equal vectors is dealt to parts. An empty
    table, or one without queries, gives an empty result. Other columns are not read.
    """
    rows = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = materialize(rows)
    sample: dict[int, list] = {}
    for row in materialize(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector")).collect():
        sample.setdefault(len(row.vector), []).append(row.vector)
    tables = Tables({d: fit(np.array(v)) for d, v in sample.items()}, projections(rows.count()))
    each = 1 - (1 - target) ** (1 / tables.tables)

    def bucket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _by_dimension(frame):
                cells, _ = tables.cells(_stack(part["vector"]))
                for t in range(tables.tables):
                    names = [f"{cells.shape[0] and len(v)}:{t}:" + ",".join(map(str, c)) for v, c in zip(part["vector"], cells[:, t].tolist(), strict=True)]
                    yield pd.DataFrame({"bucket": names, "id": part["id"].to_numpy(), "vector": part["vector"].to_numpy()})

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _by_dimension(frame):
                cells, inside = tables.cells(_stack(part["vector"]))
                for n, (i, v) in enumerate(zip(part["id"], part["vector"], strict=True)):
                    names = [f"{len(v)}:{t}:" + ",".join(map(str, c.tolist())) for t in range(tables.tables) for c in tables.probes(cells[n, t], inside[n, t], each)]
                    yield pd.DataFrame({"bucket": names, "id": i, "vector": [v] * len(names)})

    schema = "bucket string, id long, vector array<double>"
    queries = rows.where("asks").select("id", "vector")
    found = materialize(_best(_scan(rows.select("id", "vector").mapInPandas(bucket, schema), queries.mapInPandas(visit, schema), k), k))
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = materialize(queries.join(full, F.col("id") == F.col("query_id"), "left_anti"))
    if short.limit(1).count():
        own = F.size("vector").cast("string").alias("bucket")
        rest = _best(_scan(rows.select(own, "id", "vector"), short.select(own, "id", "vector"), k), k)
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found
