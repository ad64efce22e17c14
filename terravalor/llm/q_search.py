"""Queries of the operators that search."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravalor.llm import ann, jaccard_join, packing, url_filter
from terravalor.llm.queries import query, table


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.classes(docs).select("doc_id", "copy_id", "class_id", "n_links")


@query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann.search(rows, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Rules of host and path: what they say goes before the list.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Pages on hosts with such a word are the list.
LISTED_WORDS = "adult|bets|casino|pills|spam|ads"

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
)
_ACTIONS = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for h, p, a in URL_RULES)

URLS_SQL = f"""
WITH a AS (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM a),
c AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{url_filter.TRACKING}(=|$)'))) AS kept FROM b),
d AS (SELECT *, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN
  regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') ||
  regexp_replace(regexp_replace(path, '(?:/index)?\\.html?$', ''), '/+$', '') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon,
  CASE {_FITS} END AS rule FROM c),
l AS (SELECT DISTINCT canon FROM d WHERE canon IS NOT NULL AND regexp_matches(host, '(^|[.-])({LISTED_WORDS})([.-]|$)'))
SELECT page_id, host, path, rule, coalesce(CASE rule {_ACTIONS} END, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM d
"""


@query("op7_url_filter", URLS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    listed = pages.where(host.rlike(f"(^|[.-])({LISTED_WORDS})([.-]|$)")).select("url")
    marked = url_filter.listed_pages(pages, listed)
    marked = marked.select("page_id", host.alias("host"), path.alias("path"), "listed")
    rule, action = url_filter.rule_of(F.col("host"), F.col("path"), URL_RULES)
    verdict = F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return marked.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
