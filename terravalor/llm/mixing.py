"""Mixing sources to target weights by hash thresholds.

Every row has a uniform hash. Sizes are summed by source and leading hash bits;
the bucket in which a source's budget runs out is summed by the next bits, and
so on until the boundary is a single hash. Rows below it are taken: the mix is a
filter, and a smaller budget takes a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor.llm.common import bits_of, packed, text_of, unpacked, words_of
from terravalor.session import materialize, small_side

BITS = 60
#: Bits of the hash that each histogram tells apart.
STEP = 12


def row_hash(columns: list[str]) -> Column:
    """60 uniform bits of the columns' values; equal rows share them."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]
    return bits_of(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` of a table (source, source_size) with a row a source.

    Sources in code point order, a null one last, weigh ``weights`` in turn and share ``share``
    of all sizes. A target stops at ``most`` times its source's size; what is above goes to the
    others by weight. Sources fill up in the order of size to weight: with those filled so far
    taken out, a source is full if its part of the rest is no less than its limit.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))))
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    ahead = Window.orderBy(F.col("limit") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "rest": F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)),
    })
    rows = rows.withColumn("full", F.col("limit") * F.col("open") <= F.col("rest") * F.col("weight"))
    # The first source that isn't full ends the filling.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("place"), (F.col("rest") / F.col("open")).alias("level")))).over(everything)["level"]
    return rows.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("level"))).alias("target")
    )


def thresholds(digests: DataFrame, goals: DataFrame) -> DataFrame:
    """``source``, target columns, ``passes``, ``edge``, ``edge_rows``, ``edge_taken``: how to take each source.

    digests: source, h, size of every row. A source is taken ``passes`` times as a whole and once
    more below the hash ``edge``; of the rows at the edge ``edge_taken``. Each level reads only
    the rows of its boundary buckets.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("passes", whole).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    state = small_side(state.select("source", "source_size", "target", "passes", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")))
    rows = digests
    for level in range(BITS // STEP):
        left = BITS - STEP * (level + 1)
        bucket = F.shiftright("h", left)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("edge_rows"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = sums.withColumn("end", F.sum("sum").over(order)).alias("s").join(state.select("source", "rest", "below").alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        start = F.col("below") + F.col("end") - F.col("sum")
        inside = running.where(F.col("below") + F.col("end") >= F.col("rest"))
        edge = inside.groupBy(F.col("t.source").alias("source")).agg(F.min(F.struct("bucket", start.alias("below"), "sum", "edge_rows")).alias("e"))
        state = small_side(
            state.drop("prefix", "edge_rows", "sum").withColumnRenamed("below", "was").alias("t")
            .join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
            .select("t.source", "source_size", "target", "passes", "rest", F.col("e.bucket").alias("prefix"), F.coalesce(F.col("e.below"), F.col("was")).alias("below"), F.col("e.sum").alias("sum"), F.coalesce(F.col("e.edge_rows"), F.lit(0)).cast("long").alias("edge_rows"))
        )
        if left:
            marks = state.select(F.col("source").alias("of"), "prefix").where(F.col("prefix").isNotNull())
            rows = materialize(rows.join(marks, F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("prefix"))).select("source", "h", "size"))
    each = F.col("sum") / F.col("edge_rows")
    taken = F.when(each > 0, F.greatest(F.lit(0), F.least(F.col("edge_rows"), F.ceil((F.col("rest") - F.col("below")) / each - 0.5)))).otherwise(F.lit(0))
    return state.select("source", "source_size", "target", "passes", F.col("prefix").alias("edge"), "edge_rows", taken.cast("long").alias("edge_taken"))


def size_of(text: str) -> Column:
    """The number of words of a text; 0 for a null one."""
    return F.size(words_of(text_of(text))).cast("long")


def mix(docs: DataFrame, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id", "text"), weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``copies``, the times it is taken.

    A source's taken sizes differ from its target by half of one document at most. Rows that
    agree in ``keys`` have one hash; where the boundary falls among them, they are counted and so
    many of them are taken (they must then agree in all columns of a groupable type or are told
    apart by them). A null text has size 0, a null source is a source of its own, an empty table
    gives an empty result, and an input column named like an output gives way. Reruns agree.
    """
    rows = packed(docs, source=F.col(source), size=size_of(text), h=row_hash(list(keys)))
    digests = materialize(rows.select("source", "h", "size"))
    goals = targets(digests.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = small_side(thresholds(digests, goals)).withColumnRenamed("source", "of")
    # The written plan is one row a source: broadcast when small, else AQE splits a hot source's rows.
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    at_edge = F.col("h").eqNullSafe(F.col("edge"))
    split = at_edge & (F.col("edge_taken") > 0) & (F.col("edge_taken") < F.col("edge_rows"))
    more = F.when(F.col("edge").isNull() | (F.col("h") < F.col("edge")) | (at_edge & (F.col("edge_taken") > 0)), F.lit(1)).otherwise(F.lit(0))
    more = F.when(F.col("target") == F.col("passes") * F.col("source_size"), F.lit(0)).otherwise(more)
    out = joined.select("row", "size", "source_size", "target", (F.col("passes") + more).cast("int").alias("copies"), split.alias("split"), "passes", "edge_taken", "source")
    if plan.where((F.col("edge_taken") > 0) & (F.col("edge_taken") < F.col("edge_rows"))).limit(1).count():
        keep = ["row", "size", "source_size", "target", "copies"]
        same = out.where("split").groupBy(*keep, "passes", "edge_taken", "source").agg(F.count(F.lit(1)).alias("n"))
        # Equal rows are one here; only rows that differ outside the keys are put in order.
        order = Window.partitionBy("source").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = same.withColumn("end", F.sum("n").over(order)).select(*keep, "passes", "edge_taken", "end", "n", F.explode(F.expr("sequence(1L, n)")).alias("i"))
        taken = (F.col("end") - F.col("n") + F.col("i") <= F.col("edge_taken")).cast("int")
        each = each.withColumn("copies", (F.col("passes") + taken).cast("int"))
        out = out.where(~F.col("split")).select(*keep).unionByName(each.select(*keep))
    return unpacked(out, "size", "source_size", "target", "copies")
