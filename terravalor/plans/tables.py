"""The input tables of one scale folder, and the views derived from them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravalor.plans.proxies import PROXIES
from terravalor.session import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

#: Narrow tables with a row a key that the views widen and copy; a file of them is a split or two, however many rows it holds.
SPREAD = {"part": "p_partkey", "customer": "c_custkey"}

_SERIES = re.compile(r"@SERIES\((-?\d+),\s*(-?\d+)\)@")


def macros(sql: str, engine: str) -> str:
    """Row-generating calls differ between the engines; everything else is shared."""
    if engine == "spark":
        return _SERIES.sub(r"explode(sequence(\1, \2))", sql)
    return _SERIES.sub(r"CAST(unnest(generate_series(\1, \2)) AS INTEGER)", sql)


class Tables:
    """Lazy access by name: ``t("part")`` or ``t("px_property")``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}
        self._narrow: DataFrame | None = None

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE:
                table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                self._known[name] = spread(table, SPREAD[name]) if name in SPREAD else table
            else:
                self._known[name] = self._view(PROXIES[name])
        return self._known[name]

    def _view(self, text: str) -> DataFrame:
        names = BASE + list(PROXIES)
        pattern = re.compile(r"\b(?:" + "|".join(sorted(names, key=len, reverse=True)) + r")\b")
        used = {n: self(n) for n in dict.fromkeys(pattern.findall(text))}
        body = pattern.sub(lambda m: "{" + m.group(0) + "}", macros(text, "spark"))
        return self.spark.sql(body, **used)

    # ---- tables the library itself derives -----------------------------------

    @cached_property
    def universe(self) -> DataFrame:
        from terravalor.operators import universe
        from terravalor.session import materialize

        return materialize(universe.build_universe(self("px_tax_roll"), self("px_parcels")))

    @cached_property
    def properties(self) -> DataFrame:
        """Universe after the serving fixes (inclusive zone, duplex lots)."""
        from terravalor.operators import universe
        from terravalor.session import materialize

        return materialize(universe.mark_duplex(universe.fix_inclusive_zone(self.universe)))

    @cached_property
    def pid_index(self):
        """Property numbers by their pieces, written once."""
        from terravalor.operators import gram_index

        return gram_index.build(self.properties, "pid")

    @cached_property
    def sold(self) -> DataFrame:
        from terravalor.operators import ingest
        from terravalor.session import materialize

        return materialize(ingest.latest_listings(self("px_sold").where(F.col("sold_price") > 0)))

    @cached_property
    def matched(self) -> DataFrame:
        from terravalor.operators import match
        from terravalor.session import materialize

        return materialize(match.match_sales(self.sold, self.properties))

    def sold_with(self, *columns: str) -> DataFrame:
        """Some columns of ``sold``: a query that needs few shuffles and writes no others of its sales."""
        from terravalor.operators import ingest
        from terravalor.session import materialize

        if "sold" in self.__dict__:
            return self.sold.select(*columns)
        if self._narrow is None or not set(columns) <= set(self._narrow.columns):
            listed = ingest.latest_listings(self("px_sold").where(F.col("sold_price") > 0))
            self._narrow = materialize(listed.select(*[c for c in listed.columns if c in columns]))
        return self._narrow.select(*columns)

    def matched_with(self, *columns: str) -> DataFrame:
        """Some columns of ``matched``: a query that needs few shuffles and writes no others of its sales."""
        from terravalor.operators import match
        from terravalor.session import materialize

        if "matched" in self.__dict__:
            return self.matched.select(*columns)
        needed = {*columns, "address", "sold_price"}  # what a match is made of
        sold = self.sold_with(*[c for c in self("px_sold").columns if c in needed])
        return materialize(match.match_sales(sold, self.properties).select(*columns))

    @cached_property
    def locations(self) -> DataFrame:
        """Distinct property points: spatial features depend on nothing else."""
        from terravalor.operators import spatial
        from terravalor.session import materialize

        return materialize(spread(spatial.distinct_points(self.universe), "lat", "lon"))
