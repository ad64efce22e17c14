"""URL filter: a blocked Bloom filter before an exact join.

Listed URLs, in canonical form, set eight bits in one 512-bit block each. Pages
whose block lacks one of their bits are surely not listed; the rest are joined
with the list itself, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor.llm import bloom
from terravalor.llm.common import packed, unpacked

#: Parameters that do not change the page.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A to Z in lower case; empty without ://."""
    rest = _after(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without .html, index file and closing slashes, other parameters than
    tracking ones in order; null for a null URL or one without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}(=|$)")))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.instr(F.coalesce(url, F.lit("")), "://") > 0, whole)


def listed_pages(pages: DataFrame, blocklist: DataFrame, url: str = "url", listed_url: str = "url", name: str = "listed") -> DataFrame:
    """The pages with ``name``: whether their canonical URL is that of a listed one.

    Null URLs and those without :// are never listed, on either side. Repeated rows and list
    entries change nothing; a hot URL is dealt by Spark's skewed join. An empty list lists none, an
    empty table gives an empty result; an input column of the output's name gives way.
    """
    spark = pages.sparkSession
    canon = blocklist.select(canonical(F.col(listed_url)).alias("canon")).where(F.col("canon").isNotNull()).distinct()
    table = spark.sparkContext.broadcast(bloom.build(canon, "canon"))  # bounded by its most blocks

    @F.pandas_udf("boolean")
    def possible(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, second in frames:
            yield pd.Series(bloom.passes(table.value, first.to_numpy(), second.to_numpy()))

    rows = packed(pages, canon=canonical(F.col(url)))
    rows = rows.withColumn("maybe", F.when(F.col("canon").isNotNull(), possible(*bloom.hashes(F.col("canon")))).otherwise(F.lit(False)))
    hits = rows.select(F.when(F.col("maybe"), F.col("canon")).alias("canon"), "row")
    # A null key joins nothing and stays where it is; only possible hits need the exact answer.
    sure = canon.withColumnRenamed("canon", "on_list")
    joined = hits.where(F.col("canon").isNotNull()).join(sure, F.col("canon") == F.col("on_list"), "left")
    out = joined.select("row", F.col("on_list").isNotNull().alias(name)).unionByName(hits.where(F.col("canon").isNull()).select("row", F.lit(False).alias(name)))
    return unpacked(out, name)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule (host, path, action): for its host and all subdomains, and paths that start with its own.

    The rules are a fixed list; the rule is written as host and path joined, null if none fits.
    """
    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, act in reversed(ordered):
        rule = F.when(fits(h, p), F.lit(h + p)).otherwise(rule)
        action = F.when(fits(h, p), F.lit(act)).otherwise(action)
    return rule, action
