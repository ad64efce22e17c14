"""Line dedup by site-relative frequency.

A line that stands on a large share of a site's pages is boilerplate there. Pages
holding each line are counted per site, divided by the site's pages, and lines
above the ratio are dropped from that site's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor.llm.common import packed, text_of, unpacked
from terravalor.session import materialize, small_side

#: A line is boilerplate above this share of its site's pages, from so many pages on.
MAX_RATIO = 0.02
MIN_PAGES = 3

_BLANKS = " \t\x0b\x0c\r"


def _hash(line: Column) -> Column:
    """64 bits of a trimmed line; null for a blank one."""
    return F.xxhash64(F.nullif(F.trim(line, F.lit(_BLANKS)), F.lit("")))


def boilerplate(pages: DataFrame, site: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``site`` and ``hashes``: the lines to drop there; sites without any are left out.

    Without ``copies`` rows of equal text weigh as one page of their site, in a line's pages and in the site's.

    A site has at most (lines a page / ratio) such lines, however many pages it has. Lines are
    counted map-side by hash before the shuffle, so a hot site or line costs one row a task.
    """
    each = pages.select(F.col(site).alias("site"), F.array_distinct(_lines(text_of(text))).alias("lines"), F.xxhash64(text_of(text)).alias("page"))
    if not copies:
        each = materialize(each.dropDuplicates(["site", "page"]))
    lines = each.select("site", F.explode("lines").alias("h")).where(F.col("h").isNotNull())
    counted = lines.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = each.groupBy(F.col("site").alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    often = counted.join(small_side(totals), F.col("site").eqNullSafe(F.col("of"))).where(F.col("n") > max_ratio * F.col("pages"))
    return often.groupBy("site").agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def _lines(text: Column) -> Column:
    blank = F.xxhash64(F.lit(None).cast("string"))
    return F.transform(F.split(text, "\n"), lambda x: F.nullif(_hash(x), blank))


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """The pages with their text cleaned, ``n_lines`` and ``n_dropped``.

    Lines are what newlines separate, compared without blanks at their ends; blank lines are
    never boilerplate. A null site is a site of its own. A null text stays null with no lines;
    a text that loses every line becomes empty. Repeated rows each count as a page, unless
    ``copies`` is false: then rows of equal text on a site are one. Long texts
    are cut in place, by row. An empty table gives an empty result; an input column named like
    an output gives way. Lines are compared by 64-bit hash.
    """
    drop = small_side(boilerplate(pages, site, text, max_ratio, min_pages, copies))
    rows = packed(pages, site=F.col(site), t=F.col(text))
    # The written side's size decides: broadcast when small, else AQE splits a hot site's pages.
    joined = rows.join(drop.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of")), "left")
    lines = joined.select("row", "t", F.split("t", "\n").alias("lines"), "hashes")
    kept = F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("hashes", _hash(x))))
    out = lines.select("row", "t", "lines", kept.alias("kept")).select(
        "row",
        F.when(F.size("kept") == F.size("lines"), F.col("t")).otherwise(F.array_join("kept", "\n")).alias(text),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    order = pages.columns
    flat = unpacked(out, text, "n_lines", "n_dropped")
    return flat.select(*[c for c in order if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
