"""Queries of the operators that judge or count texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terravalor.llm import line_dedup, quality, secret_scan, token_counts
from terravalor.llm.queries import query, table

_IN = ", ".join(f"'{w}'" for w in quality.VOCABULARY)
_PART = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (p.v + q.v)) ELSE 0 END"


def _histogram(name: str, parts: list[str], total: str, least: int) -> str:
    """CTEs: counts of each document as (r, i, v), pooled shares by language, distance to the nearest."""
    listed = "[" + ", ".join(parts) + "]"
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    part = "(" + _PART.format(x="p.v") + " + " + _PART.format(x="q.v") + ") / 2"
    return f"""
{name}_c AS (SELECT r, lang, base_failed, {total} AS total, unnest({listed}) AS v, unnest(range({len(parts)})) AS i FROM m),
{name}_s AS (SELECT lang, i, sum(v) AS v FROM {name}_c WHERE NOT base_failed AND lang IN ({langs}) GROUP BY ALL),
{name}_q AS (SELECT lang, i, v / nullif(sum(v) OVER (PARTITION BY lang), 0)::DOUBLE AS v FROM {name}_s),
{name}_p AS (SELECT r, i, v / total::DOUBLE AS v FROM {name}_c WHERE total >= {least}),
{name}_d AS (SELECT r, q.lang, sqrt(greatest(0, sum({part}))) AS d FROM {name}_p p JOIN {name}_q q USING (i) WHERE q.v IS NOT NULL GROUP BY ALL),
{name} AS (SELECT r, min(d) AS d FROM {name}_d GROUP BY r)"""


def _left(of: str, pattern: str) -> str:
    return f"length({of}) - length(regexp_replace({of}, '{pattern}', '', 'g'))"


_CLASSES = ["length(t) - length(t1)", "length(t1) - length(t2)", _left("t2", r"\p{Lu}+"), _left("t2", r"\p{Nd}+"), _left("t2", "[.,;:!?''\"()\\-]+"), _left("t2", r"[#*$%&|<>]+"), _left("t2", r"[\p{Lt}\p{Lm}\p{Lo}]+")]
_CLASSES.append("length(t2) - (" + " + ".join(_CLASSES[2:]) + ")")
_COMMONS = [f"len(list_filter(w, lambda x: x = '{w}'))" for w in quality.VOCABULARY] + [f"len(list_filter(w, lambda x: x NOT IN ({_IN})))"]

QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
e AS (SELECT r, doc_id, lang, t, regexp_replace(t, '\\p{{Ll}}+', '', 'g') AS t1, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
f AS (SELECT *, regexp_replace(t1, '[\\x20\\x09-\\x0D]+', '', 'g') AS t2,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM e),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM f WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(8)) AS k) GROUP BY r),
n AS (SELECT f.*, len(w)::BIGINT AS n_words, (length(t) - length(t1) + length(t2))::BIGINT AS word_chars,
  ({_CLASSES[5]})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN cov USING (r)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM n),
{_histogram("cls", _CLASSES, "length(t)", quality.MIN_CHARS)},
{_histogram("com", _COMMONS, "n_words", quality.MIN_COMMON_BASE)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cls.d > {quality.MAX_CLASS_DISTANCE}, false)
  AND NOT coalesce(com.d > {quality.MAX_WORD_DISTANCE} + {quality.WORD_NOISE} / sqrt(n_words), false) AS kept
FROM m LEFT JOIN cls USING (r) LEFT JOIN com USING (r)
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, nullif(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '') AS c FROM l),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT k.source, c FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source WHERE c IS NOT NULL
  GROUP BY k.source, c HAVING count(DISTINCT r) >= {line_dedup.MIN_PAGES} AND count(DISTINCT r) > {line_dedup.MAX_RATIO} * max(pages)),
j AS (SELECT r, i, line, b.c IS NULL AS kept FROM k LEFT JOIN b ON k.c = b.c AND k.source IS NOT DISTINCT FROM b.source),
a AS (SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT kept)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '') AS t FROM j GROUP BY r)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE t END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN a USING (r)
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan.scan(docs, path="source").select("doc_id", "start", "length", "finding", "score", "is_secret")
