"""Exact group percentiles that never hold a whole group in one task.

``percentile`` and ``median`` keep every distinct value of a group in one
aggregation buffer. A group holding a third of a very large table does not fit.
Here each wanted rank has a bracket that starts as the whole group. While a
bracket holds more rows than a bound, it is cut into cells, the cells are counted
map-side, and the cell that holds the rank becomes the bracket, with the rows
below it counted: the rank is in it by count, not by estimate. The few values of
the last brackets are ranked. The result is exact and interpolates linearly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor.session import materialize, small_side

#: Rows that a bracket may hold to be ranked, and the most cells that a larger one is cut into.
BOUND = 20_000
CELLS = 4_096

UPPER_MEDIAN = "upper_median"

#: Zero-based lower rank, upper rank and weight of the upper one, from the number of rows.
Rank = Callable[[Column], tuple[Column, Column, Column]]


def _target_ranks(p: float | str | Rank, n: Column) -> tuple[Column, Column, Column]:
    if callable(p):
        return p(n)
    if p == UPPER_MEDIAN:
        mid = F.floor(n / 2)
        return mid, mid, F.lit(0.0)
    r = F.lit(float(p)) * (n - 1)
    lower = F.floor(r)
    return lower, F.ceil(r), r - lower


def _cell(v: Column, low: Column, high: Column, cells: Column, logarithmic: bool) -> Column:
    """The cell of a value between the ends of its bracket; each end has a cell of its own, so a bracket always shrinks.

    Rounds by difference and by logarithm take turns: the first suits values of one size, the
    second those of many. Both grow with the value.
    """
    scale = (lambda x: F.signum(x) * F.log1p(F.abs(x))) if logarithmic else (lambda x: x / 2)
    share = (scale(v) - scale(low)) / (scale(high) - scale(low))
    inner = F.least(F.greatest(F.floor(F.nanvl(share, F.lit(0.0)) * (cells - 2)), F.lit(0)), cells - 3) + 1
    return F.when(v == low, F.lit(0)).when(v == high, cells - 1).otherwise(inner).cast("int")


class _Base:
    """The rows of all groups, and how brackets are brought to them."""

    def __init__(self, rows: DataFrame, keys: list[str]) -> None:
        self.rows, self.keys = rows, keys

    def within(self, brackets: DataFrame) -> DataFrame:
        """Each row once for each bracket of its group (``_low``, ``_high`` and the rows it holds) that holds it."""
        if self.keys:
            listed = brackets.groupBy(*self.keys).agg(F.collect_set(F.struct("_low", "_high", "_rows")).alias("_brackets"))
            joined = self.rows.join(listed, self.keys)  # made from a written table, whose size decides the join
        else:  # two brackets a probability at most: literals of the pass
            known = brackets.select("_low", "_high", "_rows").distinct().collect()
            literals = [F.struct(*[F.lit(r[c]).alias(c) for c in ("_low", "_high", "_rows")]) for r in known]
            joined = self.rows.withColumn("_brackets", F.array(*literals).cast("array<struct<_low:double,_high:double,_rows:bigint>>"))
        each = joined.select(*self.keys, "_v", "_c", F.explode("_brackets").alias("_b"))
        return each.where((F.col("_v") >= F.col("_b._low")) & (F.col("_v") <= F.col("_b._high"))).select(*self.keys, "_v", "_c", "_b.*")


def _narrowed(base: _Base, targets: DataFrame, bound: int, logarithmic: bool) -> DataFrame:
    """The same targets, each in the cell that holds its rank."""
    keys = base.keys
    inside = base.within(targets.select(*keys, "_low", "_high", "_rows").distinct())
    parts = F.least(F.lit(CELLS), 16 + F.floor(8 * F.col("_rows") / bound))
    cells = inside.groupBy(*keys, "_low", "_high", _cell(F.col("_v"), F.col("_low"), F.col("_high"), parts, logarithmic).alias("_cell")).agg(
        F.sum("_c").alias("_rows"), F.min("_v").alias("_first"), F.max("_v").alias("_last")
    )
    before = Window.partitionBy(*keys, "_low", "_high").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_cell")
    met = targets.drop("_rows").join(counted, [*keys, "_low", "_high"])
    start = F.col("_below") + F.col("_before")
    held = met.where((start <= F.col("_rank")) & (F.col("_rank") < start + F.col("_rows")))
    return held.select(*keys, "_t", "_rank", start.alias("_below"), F.col("_first").alias("_low"), F.col("_last").alias("_high"), "_rows")


def _values(base: _Base, targets: DataFrame) -> DataFrame:
    """``_t`` and ``_value`` of targets whose brackets hold few rows."""
    keys = base.keys
    inside = base.within(targets.where("_low < _high").select(*keys, "_low", "_high", "_rows").distinct())
    counted = inside.groupBy(*keys, "_low", "_high", "_v").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*keys, "_low", "_high").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    start = F.col("_below") + F.col("_before")
    met = targets.where("_low < _high").join(ranked, [*keys, "_low", "_high"])
    found = met.where((start <= F.col("_rank")) & (F.col("_rank") < start + F.col("_n"))).select(*keys, "_t", F.col("_v").alias("_value"))
    return found.unionByName(targets.where(~F.expr("_low < _high")).select(*keys, "_t", F.col("_low").alias("_value")))


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float | str | Rank], bound: int = BOUND, weight: str | None = None
) -> DataFrame:
    """One row per key group: keys, one column per entry of ``probs``, and ``n``.

    A probability is a number in [0, 1] (linear interpolation), ``UPPER_MEDIAN`` (the value at
    position n // 2 in ascending order) or a function from the number of rows to (lower rank,
    upper rank, weight of the upper); a rank outside the group gives null. Rows with a null value
    or a null key do not count; with ``weight`` a row counts as often as that (null and below 1:
    not at all). No task ranks more than ``bound`` rows of a group, but for rows of equal value,
    which are one.
    """
    count = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    present = F.col(value).isNotNull() & (count > 0)
    for key in keys:
        present = present & F.col(key).isNotNull()
    # 0.0 and -0.0 are one value.
    base = _Base(df.where(present).select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"), count.alias("_c")), keys)
    stats = base.rows.groupBy(*keys).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    ranks = [r.cast("long") for p in probs.values() for r in _target_ranks(p, F.col("_n"))[:2]]
    stats = small_side(stats.withColumn("_ranks", F.array(*ranks)))
    each = stats.select(*keys, "_n", "_lo", "_hi", F.posexplode("_ranks").alias("_t", "_rank")).where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n")))
    targets = each.select(*keys, "_t", "_rank", F.lit(0).cast("long").alias("_below"), F.col("_lo").alias("_low"), F.col("_hi").alias("_high"), F.col("_n").alias("_rows"))
    wide = (F.col("_rows") > bound) & (F.col("_low") < F.col("_high"))
    logarithmic = False
    while not targets.where(wide).isEmpty():
        targets = materialize(targets.where(~wide).unionByName(_narrowed(base, targets.where(wide), bound, logarithmic)))
        logarithmic = not logarithmic

    values = _values(base, targets)
    one = [F.max(F.when(F.col("_t") == t, F.col("_value"))).alias(f"_{t}") for t in range(2 * len(probs))]
    wide_values = values.groupBy(*keys).agg(*one) if keys else values.agg(*one)
    # Without keys both are one row.
    joined = stats.join(wide_values, keys, "left") if keys else stats.withColumn("_k", F.lit(0)).join(wide_values.withColumn("_k", F.lit(0)), "_k", "left")
    out = []
    for i, (name, p) in enumerate(probs.items()):
        a, b, w = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), _target_ranks(p, F.col("_n"))[2]
        out.append(F.when(a == b, a).otherwise(a + (b - a) * w).alias(name))
    return joined.select(*keys, *out, F.col("_n").alias("n"))


def medians(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Exact medians of several columns in one pass: {output name: column}."""
    names = list(values)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("m"), F.col(values[name]).cast("double").alias("v"))
                    for name in names
                ]
            )
        ).alias("_mv"),
    ).select(*keys, F.col("_mv.m").alias("_m"), F.col("_mv.v").alias("_val"))
    each = exact_percentiles(long, keys + ["_m"], "_val", {"_med": 0.5})
    return each.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_m") == name, F.col("_med"))).alias(name) for name in names]
    )
