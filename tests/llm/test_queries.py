"""The queries of the training-data operators against their SQL, and against brute force where SQL can't say them."""

from __future__ import annotations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from terravalor.llm import ann, jaccard_join, token_counts

TABLES = "documents embeddings pages benchmark labels conversations".split()
SQL = [n for n in entry.oracle_sql() if n.startswith("op")]


@pytest.fixture(scope="module")
def queries():
    return entry.queries()


@pytest.mark.parametrize("name", [n for n in SQL if n.split("_")[0] in {"op2", "op3", "op6", "op7", "op10"}])
def test_against_sql(spark, sf, queries, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    show = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    want = show([r[columns.index(c)] for c in sorted(columns)] for r in cursor.fetchall())
    assert show([r[c] for c in sorted(columns)] for r in df.collect()) == want


def test_every_operator_has_a_query(queries):
    found = {n.split("_")[0] for n in queries if n.startswith("op")}
    assert {f"op{i}" for i in range(1, 11)} <= found and "pipeline" in queries


def test_slots_have_no_gap_and_growth_moves_only_into_the_new_shard(spark, sf, queries):
    rows = queries["op2_sharding"](spark, sf).collect()
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)


def test_taken_words_come_near_the_targets(spark, sf, queries):
    df = queries["op3_mixing"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in df.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"), F.max("source_size").alias("n")).collect():
        assert abs(r.taken - r.target) <= r.most / 2 + 1e-6 and r.target <= 2 * r.n + 1e-6
    assert df.where("taken > 2 * size").count() == 0


def links_by_hand(texts: dict) -> dict:
    sets = {k: set(jaccard_join.shingles(t).tolist()) for k, t in texts.items()}
    keys = [k for k in sets if sets[k]]
    near = {k: set() for k in sets}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
                near[b].add(a)
    return near


def component(near: dict, start) -> set:
    seen, todo = {start}, [start]
    while todo:
        for other in near[todo.pop()] - seen:
            seen.add(other)
            todo.append(other)
    return seen


def test_jaccard_join_loses_no_link(spark, sf, queries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    near = links_by_hand(texts)
    for r in queries["op4_ngram_jaccard_join"](spark, sf).collect():
        assert r.n_links == len(near[r.doc_id]) and r.class_id == min(component(near, r.doc_id))


def test_jaccard_join_of_a_group_larger_than_a_block(spark):
    draw = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(700):
        words = list(base)
        for at in draw.integers(0, 120, 2):
            words[at] = f"x{draw.integers(0, 40)}"
        texts[i] = " ".join(words)
    near = links_by_hand(texts)
    rows = jaccard_join.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == 700
    lost = sum(r.n_links != len(near[r.doc_id]) for r in rows)
    assert lost == 0 and all(r.class_id == min(component(near, r.doc_id)) for r in rows)


@pytest.mark.parametrize("share", [0, 1])
def test_nearest_neighbours_reach_nine_of_ten(spark, share):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    if share:  # a third of all vectors equal: more than a part holds them in one bucket
        vectors[: len(vectors) // 3] = vectors[0]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1))
        d[at] = np.inf
        best = np.lexsort((ids, d))[:10]
        hits += len({v for v, _ in found} & set(ids[best].tolist()))
        assert all(abs(s - d[int(np.flatnonzero(ids == v)[0])]) < 1e-12 for v, s in found) and found == sorted(found, key=lambda x: (x[1], x[0]))
    assert len(got) == 20 and hits >= 0.9 * 200


def test_packed_ids_are_those_of_the_tokenizer(spark, sf, queries):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    # As the contract says: the added token in a text is one id.
    import zlib

    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = queries["op8_packing"](spark, sf).collect()
    met = {k: np.zeros(len(v), dtype=int) for k, v in ids.items()}
    sequences: dict[int, list] = {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == p.ids_crc32
        met[p.doc_id][p.start : p.start + p.length] += 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((m == 1).all() for m in met.values())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    full = sum(sum(n for _, n in parts) == 1024 for parts in sequences.values())
    assert full >= 0.95 * len(sequences)


def test_token_counts_are_those_of_each_word_alone(spark, sf, queries):
    pieces = token_counts.unigrams(public_tokenizers.path("piece_bpe_32k.model"))
    low = min(pieces.values()) - 10

    def plain(word: str) -> int:
        best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for end in range(1, len(word) + 1):
            ways = [(best[i][0] + pieces[word[i:end]], -best[i][1] + -1) for i in range(end) if word[i:end] in pieces]
            if word[end - 1] not in pieces:
                n = len(word[end - 1].encode())
                ways.append((best[end - 1][0] + n * low, -best[end - 1][1] - n))
            s, c = max(ways)
            best[end] = (s, -c)
        return best[-1][1]

    import re

    known: dict[str, int] = {}
    for r in queries["op9_token_counts"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").limit(60).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        for w in words:
            if w not in known:
                known[w] = plain(token_counts.MARK + w)
        assert r.n_pretokens == len(words) and r.n_tokens == sum(known[w] for w in words)


def test_long_pretokens_count_alike_without_the_trie():
    pieces = token_counts.unigrams(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.Trie(pieces)
    word = token_counts.MARK + "thereandback一\U0001f600" * 12
    assert len(word) <= token_counts.LONG and trie.tokens(word) == trie._along(word)
