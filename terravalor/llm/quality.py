"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
with those of its language over the corpus by Jensen-Shannon distance. Texts too
short for a histogram to mean anything are not judged by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravalor.llm.common import SPACE, text_of, unpacked, words_of
from terravalor.session import materialize

#: Frequent function words of each language with a reference.
COMMON_WORDS = {
    "en": "the of and to in is that it for was".split(),
    "fr": "de la le et les des en un du que".split(),
    "de": "der die und in den von zu das ist mit".split(),
    "es": "de la que el en y a los del se".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
CLASSES = ("lower", "space", "upper", "digit", "stop", "symbol", "letter", "other")

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

#: Guards and limits of the method.
MIN_CHARS = 200
MIN_COMMON_BASE = 50
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.2
WORD_NOISE = 1.0


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """Counts of each document beside its row: ``row`` and the columns below, in one pass without a shuffle.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long; classes: counts by ``CLASSES``;
    commons: counts by ``VOCABULARY`` among the words, then of all others; base_failed: boolean.
    """
    dropped = docs if keep_text else docs.drop(text)
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in dropped.columns]).alias("row"), text_of(text).alias("t"), F.col(lang).alias("lang"))
    step = step.select("row", "lang", "t", words_of(F.col("t")).alias("w"), F.regexp_replace("t", r"\p{Ll}+", "").alias("t1"), F.split("t", "\n").alias("lines"))
    step = step.select(
        "row", "lang", "t", "t1",
        F.size("w").cast("long").alias("n_words"),
        F.regexp_replace("t1", SPACE, "").alias("t2"),
        F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("words"),
        F.concat(F.lit("<"), F.array_join(F.filter("w", lambda x: x.isin(VOCABULARY)), "><"), F.lit(">")).alias("found"),
    )
    # Hashes of 2, 4 and 8 words. A repeated window holds five repeated runs of four words; the few texts with those go on.
    step = step.withColumn("pairs", F.transform("words", lambda x, i: F.xxhash64(x, F.get("words", i + 1))))
    step = step.withColumn("fours", F.transform("pairs", lambda x, i: F.xxhash64(x, F.get("pairs", i + 2))))
    windows = F.slice(F.transform("fours", lambda x, i: F.xxhash64(x, F.get("fours", i + 4))), F.lit(1), F.greatest(F.lit(0), F.size("fours") - (WINDOW - 1)))
    repeats = F.size("fours") - F.size(F.array_distinct("fours")) > WINDOW // 2
    step = step.withColumn("h", F.when(repeats, windows).otherwise(F.array().cast("array<long>"))).drop("words", "pairs", "fours")
    step = step.select(
        "row", "lang", "n_words", "h", "t2",
        F.length("t").cast("long").alias("n"), F.length("t1").cast("long").alias("n1"), F.length("t2").cast("long").alias("n2"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "found",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"),
    )
    twice = lambda e, k: e["h"].eqNullSafe(F.get("s", k - 1)["h"]) | e["h"].eqNullSafe(F.get("s", k + 1)["h"])
    step = step.select(
        "*",
        F.sort_array(F.transform(F.filter("s", twice), lambda e: e["i"])).alias("at"),
        F.array(*[((F.length("found") - F.length(F.replace("found", F.lit(f"<{w}>"), F.lit("")))) / (len(w) + 2)).cast("long") for w in VOCABULARY]).alias("counts"),
        *_residues("t2"),
    )
    covered = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))))
    out = step.select(
        "row", "lang", "n_words", "n_dup_lines",
        (F.col("n") - F.col("n1") + F.col("n2")).alias("word_chars"),
        F.col("r_symbol").alias("n_symbols"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(F.col("n") - F.col("n1"), F.col("n1") - F.col("n2"), *[F.col(f"r_{c}") for c in CLASSES[2:-1]], F.col("n2") - sum(F.col(f"r_{c}") for c in CLASSES[2:-1])).alias("classes"),
        F.concat("counts", F.array(F.col("n_words") - F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).alias("commons"),
        F.col("n").alias("n_classes"), F.col("n_words").alias("n_commons"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _residues(rest: str) -> list[Column]:
    """How many characters of each class are left once lower-case letters and spaces are gone."""
    patterns = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "stop": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>]+", "letter": r"[\p{Lt}\p{Lm}\p{Lo}]+"}
    return [(F.length(rest) - F.length(F.regexp_replace(rest, p, ""))).cast("long").alias(f"r_{c}") for c, p in patterns.items()]


def references(measured: DataFrame) -> DataFrame:
    """Pooled histograms of each listed language over all documents that pass the base rules: four rows at most."""
    sums = [F.sum(F.get(name, F.lit(i))).alias(f"{name}_{i}") for name, n in (("classes", len(CLASSES)), ("commons", len(VOCABULARY) + 1)) for i in range(n)]
    pooled = measured.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums)
    shares = [_shares([F.col(f"{name}_{i}") for i in range(n)]).alias(f"ref_{name}") for name, n in (("classes", len(CLASSES)), ("commons", len(VOCABULARY) + 1))]
    return pooled.select(F.col("lang").alias("ref_lang"), *shares)


def _shares(sums: list[Column]) -> Column:
    total = F.nullif(sum(sums[1:], sums[0]), F.lit(0)).cast("double")
    return F.array(*[s / total for s in sums])


def distance(counts: str, total: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of counts with their total and reference shares."""

    def term(a: Column, q: Column) -> Column:
        p = a / F.col(total)
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return (part(p) + part(q)) / 2

    shares = F.array(*[F.lit(float(x)) for x in reference])
    divergence = F.aggregate(F.zip_with(F.col(counts), shares, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), divergence))


def nearest(counts: str, total: str, least: int, references: list[list[float]]) -> Column:
    """Distance to the nearest reference; null below the length guard or without references."""
    each = [distance(counts, total, r) for r in references if r[0] is not None]
    if not each:
        return F.lit(None).cast("double")
    return F.when(F.col(total) >= least, F.least(*each) if len(each) > 1 else each[0])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """Every document with its counts, its two distances and ``kept``.

    Rejected are documents that fail the base rules (under 20 words; over 30 of 100 words in
    repeated 8-word windows) and those whose character classes (from 200 characters on) or
    common words (from 50 words on) are farther than the limit from every language's
    reference; the nearest counts, so a text in two languages or with a wrong or null language
    is not rejected for that. The limit for words allows for the noise of short texts. Where a
    guard is not met the distance is null and rejects nothing. Null texts count as empty and fail; repeated rows are judged
    alike; an empty table gives an empty result; an input column named like an output gives way.
    The references (a row for each of the four listed languages) come to the driver.
    """
    measured = materialize(measure(docs, text, lang, keep_text))
    known = references(measured).collect()
    judged = measured.withColumns({
        "class_distance": nearest("classes", "n_classes", MIN_CHARS, [r["ref_classes"] for r in known]),
        "word_distance": nearest("commons", "n_commons", MIN_COMMON_BASE, [r["ref_commons"] for r in known]),
    })
    far = (F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE + WORD_NOISE / F.sqrt("n_commons"))
    judged = judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return unpacked(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, in their own columns."""
    judged = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("text"), F.col("lang")), keep_text=False)
    return judged.where("kept").select("whole.*")
