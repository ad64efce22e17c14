"""A blocked Bloom filter of bounded size: built on the executors, tested in Python workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8  # of 64 bits in a block
BITS = 8  # set for each key
#: Bits of filter for each key, and the most blocks: 64 bytes each, so 16 MB. More keys fill the
#: filter further and let more rows pass to the exact join; the result is the same.
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 18


def hashes(key: Column) -> tuple[Column, Column]:
    """What ``passes`` is asked with: the hash that picks the block and the one that picks its bits."""
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def build(keys: DataFrame, key: str) -> np.ndarray:
    """The filter of a table's keys: blocks x 8 words. Words are put together on the executors; MAX_BLOCKS rows at most come here."""
    count = keys.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * WORDS * 64 < count * BITS_PER_KEY:
        blocks *= 2
    first, second = hashes(F.col(key))
    bits = [F.shiftrightunsigned(second, 7 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(BITS)]
    each = keys.select(F.pmod(first, F.lit(blocks)).cast("int").alias("block"), F.explode(F.array(*bits)).alias("bit"))
    word = [F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    out = np.zeros((blocks, WORDS), dtype=np.int64)
    table = each.groupBy("block").agg(*word).toArrow()
    for w in range(WORDS):
        out[table["block"].to_numpy(), w] = table[f"w{w}"].to_numpy()
    return out.view(np.uint64)


def passes(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether keys of these hashes may be in the filter."""
    block, h, hit = first % len(words), second.view(np.uint64), np.ones(len(first), dtype=bool)
    for i in range(BITS):
        bit = (h >> np.uint64(7 * i)) & np.uint64(511)
        hit &= (words[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return hit
