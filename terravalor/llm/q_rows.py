"""Queries of the operators that deal out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravalor.llm import mixing, sharding
from terravalor.llm.queries import query, table

SHARDS = 16


def _score(i: int) -> str:
    u = f"(('0x' || substr(md5(k || ':{i}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
    return f"struct_pack(s := 1.0 / -ln({u}), i := {i})"


def _best(n: int) -> str:
    return "list_max([" + ", ".join(_score(i) for i in range(n)) + "]).i"


def _crc_table_bits() -> list[int]:
    """What each bit of a byte adds to a CRC-32."""
    out = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _crc(hexed: str) -> str:
    step = "xor(c, b) & 255"
    terms = "0::BIGINT"
    for bit, value in enumerate(_crc_table_bits()):
        terms = f"xor({terms}, ((({step}) >> {bit}) & 1) * {value}::BIGINT)"
    each = f"list_transform(range(0, length({hexed}) // 2), lambda j: ('0x' || substr({hexed}, 2 * j + 1, 2))::BIGINT)"
    return f"xor(list_reduce({each}, lambda c, b: xor(c >> 8, {terms}), 4294967295::BIGINT), 4294967295::BIGINT)"


SHARDING_SQL = f"""
WITH d AS (SELECT doc_id, text, hex(encode(text)) AS x, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS k FROM documents),
p AS (SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size, CASE WHEN text IS NOT NULL THEN {_crc("x")} END AS text_crc32,
  ({_best(SHARDS)})::INTEGER AS shard, ({_best(SHARDS + 1)})::INTEGER AS grown_shard FROM d),
o AS (SELECT *, ('0x' || substr(md5(concat_ws('|', doc_id, size, text_crc32, grown_shard)), 1, 8))::BIGINT % {sharding.PARTS} AS part FROM p)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard
  ORDER BY part, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot FROM o
"""


def shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    placed = sharding.assign(digest, "doc_id", [1.0] * SHARDS)
    placed = sharding.assign(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    slots = sharding.number(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op2_sharding", SHARDING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark, sf_dir)


@query("op3_mixing", """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws('|', coalesce('=' || doc_id::VARCHAR, ''), coalesce('=' || text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + place % 3]::DOUBLE AS weight, 2.0 * size AS cap, 1.5 * sum(size) OVER () AS budget FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM w),
l AS (SELECT
  arg_min((budget - used) / open, (cap / weight, place)) FILTER (cap * open > (budget - used) * weight) AS level FROM o),
t AS (SELECT o.source, o.size AS source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM o, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
r AS (SELECT d.*, source_size, target, passes, target - passes * source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (passes + CASE WHEN 2 * after - size < 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
