"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard scores a key by its own hash, scaled by its weight; the best score
takes the record. A further shard can only take records into itself, so growing
from n to n + 1 moves about one record in n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor.llm.common import bits_of, packed, unpacked
from terravalor.session import materialize, small_side

#: Slots are numbered in this many parts of each shard, each part in a task of its own.
PARTS = 1024


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key: the largest weight / -ln(u), u uniform from the key and the shard's number.

    A null key is a key of its own. Equal keys share a shard. Weights are positive.
    """
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def score(i: int, weight: float) -> Column:
        u = (bits_of(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 13) + 0.5) / float(1 << 52)
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(i).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights)]
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign(records: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """The records with their shard, row by row without a shuffle; an input column of that name gives way."""
    return unpacked(packed(records, **{name: shard_of(F.col(key), weights)}), name)


def number(records: DataFrame, shard: str, order: list[str], name: str = "slot", parts: int = PARTS) -> DataFrame:
    """Gapless slots from 0 within each shard for (shard, order...) rows, repeated rows told apart.

    Equal rows are first counted, so a key with a third of all rows is one row; the rest spreads
    over hash parts of each shard, which are ranked apart and moved by the sizes of the parts
    before them. That table has shards x parts rows at most.
    """
    counted = records.groupBy(shard, *order).agg(F.count(F.lit(1)).alias("_copies"))
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    counted = counted.withColumn("_part", F.pmod(bits_of(digest, 1, 8), F.lit(parts)).cast("int"))
    within = Window.partitionBy(shard, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = materialize(counted.withColumn("_end", F.sum("_copies").over(within)))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(shard, "_part").agg(F.max("_end").alias("_size"))
    offsets = small_side(sizes.select(shard, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from")))
    placed = ranked.join(offsets, [shard, "_part"])
    first = F.col("_from") + F.col("_end") - F.col("_copies")
    return placed.select(shard, *order, F.explode(F.sequence(first, first + F.col("_copies") - 1)).alias(name))
