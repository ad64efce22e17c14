"""Benchmark decontamination: a prefix-filtered join of word windows.

Each benchmark item is cut into windows of consecutive words, and a window into
shingles of a few words, each at its place. Shingles are ordered by rarity over
the documents; a window that must find m of its n shingles needs one of its
n - m + 1 rarest, so only those are joined. Place and length rule out windows
that would start before or end after the text, and what is left is verified
shingle by shingle over a stretch of the document of the window's own size.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravalor.llm.common import text_of, unpacked
from terravalor.session import materialize, small_side

#: Words in a window, words in a shingle, share of a window's shingles that must be found.
WINDOW = 10
SHINGLE = 3
SHARE = 1.0
#: 64-bit words of the filter of item shingles: 512 KB, however many items there are. A fuller
#: filter lets more document shingles through to the exact join; the result is the same.
FILTER_WORDS = 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of digits, letters a to z and anything beyond ASCII, once A to Z are in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _NO_WORD), "")


def _joined(words: Column | str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def item_windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """``item_id``, ``window`` (its words), ``length`` and ``shingles`` (in place): distinct windows of each item.

    An item of fewer words than a window is one window; one without words has none.
    """
    words = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(text_of(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = words.select("item_id", "words", F.explode(starts).alias("start"))
    cut = each.select("item_id", F.slice("words", F.col("start") + 1, F.lit(window)).alias("words"))
    size = F.least(F.lit(shingle), F.size("words"))
    parts = F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: _joined("words", i, size))
    return cut.select("item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("length"), parts.alias("shingles")).distinct()


def _key(words: Column, at: Column, length: int) -> Column:
    """Hash of the words of a shingle; null where the text ends before."""
    parts = [F.get(words, at + i) for i in range(length)]
    return F.when(at + length <= F.size(words), F.xxhash64(*parts))


def _bit(key: Column) -> tuple[Column, Column]:
    """The word of the filter and the bit in it."""
    return F.pmod(F.shiftright(key, 6), F.lit(FILTER_WORDS)).cast("int"), F.pmod(key, F.lit(64)).cast("int")


def _filter(shingles: DataFrame, lengths: list[int]) -> DataFrame:
    """One row: the filter as an array of FILTER_WORDS words, one bit for each distinct shingle."""
    parts = F.split("shingle", " ")
    key = F.coalesce(*[F.when(F.size(parts) == n, _key(parts, F.lit(0), n)) for n in lengths])
    word, bit = _bit(key)
    bits = shingles.select(word.alias("w"), F.lit(1).cast("long").alias("one"), bit.alias("b"))
    bits = bits.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v"))
    every = shingles.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("w"))
    dense = every.join(bits, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("bits"))


def _scan(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """``digest``, ``n``, ``at``, ``shingle``: places of texts that may hold an item's shingle, and rows without one at each text's end.

    ``texts`` has ``digest`` and ``t``. Each place is tested in the bounded filter while the row
    is at hand, so words are never shuffled.
    """
    lengths = [r.n for r in shingles.select(F.size(F.split("shingle", " ")).alias("n")).distinct().orderBy("n").collect()]
    words = texts.select("digest", words_of(F.col("t")).alias("words"))
    places = words.select("digest", "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at"))
    if not lengths:
        return places.where(F.col("at") == F.col("n")).select("digest", "n", "at", F.lit(None).cast("string").alias("shingle"))
    bits = materialize(_filter(shingles, lengths)).scalar()
    hits = []
    for n in lengths:
        word, bit = _bit(_key(F.col("words"), F.col("at"), n))
        hits.append(F.coalesce(F.getbit(F.get(bits, word), bit) == 1, F.lit(False)))
    found = places.where(reduce(or_, hits, F.col("at") == F.col("n")))
    kept = [F.when(hit, F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(n)])) for hit, n in zip(hits, lengths, strict=True)]
    # The words stay behind here: what follows may copy rows.
    found = found.select("digest", "n", "at", F.array(*kept).alias("shingles")) if len(kept) > 1 else found.select("digest", "n", "at", kept[0].alias("shingle"))
    return found if len(kept) == 1 else found.select("digest", "n", "at", F.explode("shingles").alias("shingle"))


def _prefixes(windows: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """``window``, ``length``, ``need``, ``place``, ``shingle``: the rarest shingles, of which a window that occurs has one."""
    each = windows.select("window", "length", F.size("shingles").alias("m"), F.posexplode("shingles").alias("place", "shingle"))
    known = each.join(counts, "shingle", "left").groupBy("window", "length", "m").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "place", "shingle"))).alias("by_rarity")
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(share)).cast("int"))
    known = known.withColumn("need", need).where(F.size(F.filter("by_rarity", lambda x: x["rows"] > 0)) >= F.col("need"))
    first = F.slice("by_rarity", F.lit(1), F.col("m") - F.col("need") + 1)
    return known.select("window", "length", "need", F.explode(first).alias("x")).where("x.rows > 0").select("window", "length", "need", "x.place", "x.shingle")


def occurrences(places: DataFrame, windows: DataFrame, share: float = SHARE) -> DataFrame:
    """``digest``, ``start``, ``length``, ``window``: every stretch of a text that holds a window.

    ``places`` has the shingles of each text at their places (``digest``, ``n``, ``at``,
    ``shingle``), ``windows`` distinct windows (``window``, ``length``, ``shingles``).
    """
    counts = small_side(places.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")))
    prefixes = small_side(_prefixes(windows, counts, share))
    begun = places.join(prefixes, "shingle").select("digest", "n", (F.col("at") - F.col("place")).alias("start"), "length", "need", "window")
    begun = begun.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))).drop("n").distinct()
    parts = small_side(windows.select("window", F.posexplode("shingles").alias("place", "shingle")))
    probes = begun.join(parts, "window").select("digest", (F.col("start") + F.col("place")).alias("at"), "shingle", "start", "length", "need", "window")
    met = probes.join(places.select("digest", "at", "shingle"), ["digest", "at", "shingle"])
    counted = met.groupBy("digest", "start", "length", "need", "window").agg(F.count(F.lit(1)).alias("found"))
    return counted.where(F.col("found") >= F.col("need")).select("digest", "start", "length", "window")


def _hit_words(found: DataFrame) -> DataFrame:
    """``digest`` and ``n_hit``: words inside any stretch, each once."""
    before = Window.partitionBy("digest").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    stretches = found.select("digest", "start", "length").distinct().withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    return stretches.groupBy("digest").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).cast("long").alias("n_hit"))


def mark(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, share: float = SHARE, keep_text: bool = True,
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``n_items``, ``item_ids`` (sorted as strings) and ``contaminated``.

    A word is hit inside any stretch of a window's size that holds at least ``share`` of the
    window's shingles, each in its place; at 1.0 the stretch equals the window. Null and empty
    texts have no words. Copies of a text are searched once. Rows with one item id are one item
    with the windows of all; a null id marks words but isn't counted or listed. Repeated rows are
    marked alike; an empty table gives an empty result, no items mark nothing. An input column
    named like an output gives way. Without ``keep_text`` the text is left out.
    """
    windows = materialize(item_windows(items, item_id, item_text, window, shingle))
    distinct = windows.select("window", "length", "shingles").distinct()
    shingles = small_side(distinct.select(F.explode("shingles").alias("shingle")).distinct())
    texts = docs.select(F.md5(text_of(text)).alias("digest"), text_of(text).alias("t"))
    seen = materialize(_scan(texts, shingles))
    places = materialize(seen.where(F.col("shingle").isNotNull()).join(shingles, "shingle", "left_semi").distinct())
    found = materialize(occurrences(places, distinct, share))
    named = found.select("digest", "window").distinct().join(small_side(windows.select("window", "item_id")), "window").select("digest", "item_id").distinct()
    listed = named.groupBy("digest").agg(F.count("item_id").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    sizes = seen.where(F.col("at") == F.col("n")).select("digest", F.col("n").cast("long").alias("n_words")).distinct()
    results = small_side(sizes.join(_hit_words(found), "digest", "left").join(listed, "digest", "left"))
    carried = [c for c in docs.columns if keep_text or c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.md5(text_of(text)).alias("digest"))
    joined = rows.join(results, "digest").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    return unpacked(joined, "n_words", "n_hit", "n_items", "item_ids", "contaminated")
