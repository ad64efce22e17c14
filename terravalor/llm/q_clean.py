"""Queries of the operators that hold a corpus against benchmarks and repair conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravalor.llm import conversation_repair, decontaminate, lexical_search
from terravalor.llm.q_rows import _crc
from terravalor.llm.queries import query, table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i + 1, i + {decontaminate.WINDOW}), ' ') AS g, least(len(w), {decontaminate.WINDOW}) AS l
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {decontaminate.WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT r, l, i, array_to_string(list_slice(w, i + 1, i + l), ' ') AS g FROM (SELECT r, w, l, unnest(range(greatest(len(w) - l + 1, 0))) AS i FROM d, lens)),
o AS (SELECT r, i, dw.l, iw.item_id FROM dw JOIN iw USING (g)),
h AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM o)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM o GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op12_decontamination", DECONTAMINATE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return marked.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM s),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
x AS (SELECT term, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g GROUP BY term),
y AS (SELECT p.r, p.term, s.doc_id, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS part FROM p JOIN s USING (r) JOIN x USING (term), g),
z AS (SELECT item_id, r, doc_id, sum(part)::BIGINT AS score FROM q JOIN y USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM z)
WHERE rank <= 50
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=50)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, and ``gone`` where a row is dropped: CRC-32 of conversation and turn says which."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    named = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), F.explode(times).alias("time")).drop("time")


def _way(letter: str, to: int | None, cost: str = "") -> str:
    """An edit of the last row looked at, as SQL: what it costs with the rest of the way, and its initials."""
    if to is None:
        return "struct_pack(c := 1000000000000, a := '~')"
    return f"struct_pack(c := v[{to + 1}].c + {cost}, a := '{letter}' || v[{to + 1}].a)"


def _base(state: int) -> str:
    stays = "(CASE WHEN up THEN 3 ELSE 0 END)"
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    cases = " ".join(f"WHEN '{x}' THEN {_way('K', kept[x].get(state), stays)}" for x in kept)
    none = _way("K", None)
    free = f"CASE WHEN x = 'x' THEN {none} ELSE"
    return f"list_min([{_way('D', state, '4')}, {free} {_way('R', conversation_repair.NEXT[state], stays + ' + 3')} END, CASE x {cases} ELSE {none} END])"


def _added(of: str) -> str:
    return f"struct_pack(c := {of}.c + 3, a := 'I' || {of}.a)"


REPAIR_SQL = f"""
WITH RECURSIVE k AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
c AS (SELECT *, ({_crc("h")}) % 20 AS code FROM k),
d AS (SELECT k, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE code WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) AS time FROM c),
o AS (SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail
  FROM d WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
l AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN i IN ('s', 'u', 'a') THEN CASE WHEN fault = 'truncated' THEN upper(i) ELSE i END
  ELSE CASE WHEN fault = 'truncated' THEN 'O' ELSE 'o' END END AS letter FROM f),
g AS (SELECT k, string_agg(letter, '' ORDER BY pos) AS sig, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY k),
r(sig, n, v) AS (
  SELECT DISTINCT sig, 0, [struct_pack(c := 0::BIGINT, a := ''), struct_pack(c := 6::BIGINT, a := 'II'), struct_pack(c := 3::BIGINT, a := 'I'), struct_pack(c := 0::BIGINT, a := '')] FROM g
  UNION ALL
  SELECT sig, n + 1, [list_min([b0, {_added("f2")}]), list_min([b1, {_added("f2")}]), f2, list_min([b3, {_added("b2")}])] FROM (
    SELECT *, list_min([b2, {_added("b3")}]) AS f2 FROM (
      SELECT sig, n, {", ".join(f"{_base(q)} AS b{q}" for q in range(4))} FROM (
        SELECT sig, n, v, lower(substr(sig, length(sig) - n, 1)) AS x, substr(sig, length(sig) - n, 1) IN ('S', 'U', 'A', 'O') AS up FROM r WHERE n < length(sig))))),
a AS (SELECT sig, v[1].c AS cost, v[1].a AS audit FROM r WHERE n = length(sig)),
e AS (SELECT k, j, substr(audit, j, 1) AS edit, count(*) FILTER (substr(audit, j, 1) <> 'I') OVER w AS pos, count(*) FILTER (substr(audit, j, 1) <> 'D') OVER w AS place
  FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS j FROM g JOIN a USING (sig)) WINDOW w AS (PARTITION BY k ORDER BY j)),
p AS (SELECT e.*, l.role, l.text, max(CASE WHEN edit = 'K' AND place = 1 AND l.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.k) AS led
  FROM e LEFT JOIN l ON e.k = l.k AND e.pos = l.pos AND edit <> 'I' WHERE edit <> 'D'),
t AS (SELECT k, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole FROM p GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM k) LEFT JOIN g USING (k) LEFT JOIN a USING (sig) LEFT JOIN t USING (k)
"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    done = conversation_repair.repair_conversations(rows, gone=F.col("gone"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
