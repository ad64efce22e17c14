"""A written index of the pieces of keys, for searches by fragment.

Every key is cut into grams of a few characters; the postings (gram, key) lie in
folders by a hash of the gram, ordered by gram, so a search reads little beside
the grams it asks for. A fragment is looked up by its rarest gram and verified.
The index is as long as the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravalor.session import landing_path, materialize

#: Characters of a gram, keys that the head of a gram holds, and folders.
SIZE = 3
HEAD = 100
FOLDERS = 32


def grams_of(key: Column, size: int = SIZE) -> Column:
    """Distinct grams of a key; a key shorter than a gram is one itself."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - size + 1, F.lit(1))), lambda i: F.substr(key, i, F.lit(size)))
    return F.array_distinct(cut)


@dataclass
class GramIndex:
    """Postings by gram, how many each has, and the first keys of each."""

    spark: SparkSession
    path: str
    counts: DataFrame
    heads: DataFrame
    size: int
    head: int

    def postings(self, grams: list[str]) -> DataFrame:
        """Keys of some grams: only their folders are read, and of those only row groups that may hold them."""
        folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder()).distinct().collect()] if grams else []
        return _written(self.spark, self.path).where(F.col("folder").isin(folders) & F.col("gram").isin(grams)).drop("folder")


def _folder() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")


def _written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, gram string, folder int").parquet(path)


def build(keys: DataFrame, key: str, size: int = SIZE, head: int = HEAD) -> GramIndex:
    """Write the index of a table's distinct keys; null and empty ones are left out."""
    spark, path = keys.sparkSession, landing_path(keys.sparkSession, "grams")
    each = keys.where(F.length(key) > 0).select(F.col(key).alias("key")).distinct().select("key", F.explode(grams_of(F.col("key"), size)).alias("gram"))
    # A hot gram is split over several files of its folder.
    placed = each.withColumn("folder", _folder()).hint("rebalance", "folder").sortWithinPartitions("folder", "gram")
    placed.write.partitionBy("folder").parquet(path)
    written = _written(spark, path)
    first = written.withColumn("place", F.row_number().over(Window.partitionBy("gram").orderBy("key"))).where(F.col("place") <= head)
    return GramIndex(spark, path, materialize(written.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))), materialize(first.select("gram", "key")), size, head)


def search(fragments: DataFrame, index: GramIndex, limit: int) -> DataFrame:
    """``fragment``, ``key``, ``rank``: the first ``limit`` keys, in their order, that contain each distinct fragment.

    Fragments no longer than a gram are answered from the heads of the grams that contain them:
    the first keys of a union are among the first of its parts. Longer ones are looked up by
    their rarest gram; a fragment with a gram that no key has finds nothing, nor does an empty one.
    """
    wanted = materialize(fragments.select("fragment").where(F.length("fragment") > 0).distinct())
    short = wanted.where(F.length("fragment") <= index.size)
    long = wanted.where(F.length("fragment") > index.size).select("fragment", F.explode(grams_of(F.col("fragment"), index.size)).alias("gram"))
    known = long.join(index.counts, "gram", "left").groupBy("fragment").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    )
    probes = materialize(known.where("best.n > 0").select("fragment", F.col("best.gram").alias("gram")))
    asked = [r.gram for r in probes.select("gram").distinct().collect()]  # grams, not keys
    found = probes.join(index.postings(asked), "gram").where(F.contains("key", F.col("fragment"))).select("fragment", "key")
    # Every piece of a gram leads to it.
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.transform(F.sequence(F.lit(1), F.length("gram") - n + 1), lambda i: F.substr(F.col("gram"), i, n)))))
    held = index.counts.select("gram", F.explode(pieces).alias("fragment")).join(short, "fragment")
    if limit <= index.head:
        keys = held.join(index.heads, "gram")
    else:
        keys = held.join(index.postings([r.gram for r in held.select("gram").distinct().collect()]), "gram")
    every = found.unionByName(keys.select("fragment", "key").distinct())
    place = F.row_number().over(Window.partitionBy("fragment").orderBy("key"))
    return every.withColumn("rank", place).where(F.col("rank") <= limit)
