"""Decontamination, ranked search and conversation repair: their SQL, brute force, odd rows and empty tables."""

from __future__ import annotations

import heapq
import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terravalor.llm import conversation_repair, decontaminate, lexical_search

NEW = ["op11_conversation_repair", "op12_decontamination", "op13_lexical_search"]


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    want = sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", ["op12_decontamination"])
def test_native_plans_have_no_python(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# ---- decontamination ------------------------------------------------------------------------------


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def marked_by_hand(docs, items, window, shingle, share):
    out = []
    for text in docs:
        w, hit, ids = words(text), set(), set()
        for item, passage in items:
            q = words(passage)
            for a in range(max(1, len(q) - window + 1)) if q else ():
                g = q[a : a + window]
                k = min(shingle, len(g))
                n = len(g) - k + 1
                for s in range(len(w) - len(g) + 1):
                    same = sum(w[s + i : s + i + k] == g[i : i + k] for i in range(n))
                    if same >= max(1, math.ceil(n * share)):
                        hit |= set(range(s, s + len(g)))
                        ids.add(item)
        out.append((len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_marks_are_those_of_brute_force(spark, share):
    dice = random.Random(5)
    vocabulary = ["a", "b", "c", "Of", "é1", "the", "x9"]
    items = [(i, " ".join(dice.choices(vocabulary, k=dice.choice([0, 1, 2, 5, 6, 8, 14])))) for i in range(12)]
    items += [(3, items[4][1]), (None, "only here once more"), (77, None)]
    docs = [" ".join(dice.choices(vocabulary, k=dice.choice([0, 1, 4, 30, 60]))) for _ in range(40)]
    docs += [f"zz {items[i][1]} - {items[i][1].upper()}!" for i in range(12)] + ["say: only, HERE once. more", None, "", " .,\n"] + docs[:2]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.mark(frame, bench, window=6, share=share).collect()}
    assert [got[i] for i in range(len(docs))] == marked_by_hand(docs, items, 6, decontaminate.SHINGLE, share)


def test_long_texts_extra_columns_and_empty_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    long = " ".join(["fill", passage] * 20_000)
    rows = [(1, long, 5, "a"), (1, long, 5, "a"), (2, None, None, None), (3, passage[:-7], 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, digest string")
    items = spark.createDataFrame([(9, passage, "x")], "item_id long, text string, window string")
    out = decontaminate.mark(docs, items).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.digest) for r in out] == [(1, 240_000, 220_000, "a")] * 2 + [(2, 0, 0, None), (3, 10, 10, "b")]
    assert decontaminate.mark(docs.limit(0), items).count() == 0
    clean = decontaminate.mark(docs, items.limit(0)).collect()
    assert len(clean) == 4 and not any(r.contaminated for r in clean) and {r.n_words for r in clean} == {240_000, 0, 10}


# ---- ranked search --------------------------------------------------------------------------------


def ranked_by_hand(docs, items, k):
    terms = {i: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for i, t in enumerate(docs)}
    n = {i: len(t) for i, t in terms.items() if t}
    df: dict[str, int] = {}
    for t in terms.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = set()
    for item, text in items:
        asked = {w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w in df}
        scored = []
        for d, size in n.items():
            m = 50 + (50 * size * len(n)) // sum(n.values())
            score = 0
            for w in asked:
                tf = terms[d].count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * len(n) + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d))
        out |= {(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_ranks_are_those_of_brute_force(spark, batch):
    dice = random.Random(11)
    vocabulary = [f"w{i}" for i in range(90)] + ["Été", "the", "of"]
    weights = [1] * 90 + [3, 40, 60]
    docs = [" ".join(dice.choices(vocabulary, weights, k=dice.choice([0, 1, 6, 40, 90]))) for _ in range(300)]
    docs += [docs[1]] * 30 + [None, "", "?!", "W1 w1 The"]
    items = [(i, " ".join(dice.choices(vocabulary, weights, k=dice.choice([1, 5, 30])))) for i in range(20)]
    items += [(100, " ".join(vocabulary)), (101, None), (102, "unknown words"), (103, "")]  # over 64 terms, and none
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r) for r in lexical_search.search(frame, bench, k=9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == ranked_by_hand(docs, items, 9)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 5} b{i % 3} c") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", f"a{i} c b{i % 2}", "x") for i in range(7)], "item_id string, text string, term string")
    whole = {tuple(r) for r in lexical_search.search(docs, items, k=5).collect()}
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 4)
    assert {tuple(r) for r in lexical_search.search(docs, items, k=5).collect()} == whole and whole


def test_search_with_odd_rows(spark):
    docs = spark.createDataFrame([(None, "red fish", 1), (4, "red fish", 2), (4, "red fish", 2), (2, "red fish", 3), (5, "blue " * 100_000, 4)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(None, "red"), (1, "fish"), (1, "Blue")], "item_id long, text string")
    got = [tuple(r) for r in lexical_search.search(docs, items).orderBy("item_id", "rank").collect()]
    assert [r[:3] for r in got] == [(None, 1, 2), (None, 2, 4), (None, 3, 4), (None, 4, None), (1, 1, 5), (1, 2, 2), (1, 3, 4), (1, 4, 4), (1, 5, None)]
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


# ---- conversation repair --------------------------------------------------------------------------


def cheapest(signature: str) -> tuple[int, str]:
    """The least (cost, audit) by search over all edits."""
    inserts = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    heap = [(0, "", 0, 0)]
    done = set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(signature) and state in (0, 3):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(heap, (cost + 3, audit + "I", at, inserts[state]))
        if at < len(signature):
            x = signature[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if x != "x":
                stays = 3 if x.isupper() else 0
                heapq.heappush(heap, (cost + stays + 3, audit + "R", at + 1, inserts[state]))
                if (x.lower(), state) in kept:
                    heapq.heappush(heap, (cost + stays, audit + "K", at + 1, kept[x.lower(), state]))
    raise AssertionError


def test_repairs_are_the_cheapest():
    dice = random.Random(2)
    every = ["".join(s) for n in range(4) for s in itertools.product("suaoxSUAO", repeat=n)]
    every += ["".join(dice.choices("suaoxSUAO", [1, 8, 8, 1, 2, 1, 2, 2, 1], k=dice.randint(4, 14))) for _ in range(3000)]
    order = sorted(set(every), key=lambda s: s[::-1])
    for signature, cost, audit, places, roles in conversation_repair.repair(iter(order)):
        assert (cost, audit) == cheapest(signature)
        kept = [signature[p] if p >= 0 else "" for p in places]
        final = "".join((r or k)[0].lower() for r, k in zip(roles, kept, strict=True))
        assert re.fullmatch("(s?(ua)+)?", final) and "x" not in kept


def test_each_suffix_is_worked_out_once(monkeypatch):
    order = sorted({"uaua", "aua", "sua", "ua", "xua", "uaxua", "uau"}, key=lambda s: s[::-1])
    made = []
    node = conversation_repair.Node
    monkeypatch.setattr(conversation_repair, "Node", lambda letter, after: made.append(letter) or node(letter, after))
    assert len(list(conversation_repair.repair(iter(order)))) == len(order)
    assert len(made) == 1 + len({s[i:] for s in order for i in range(len(s))})


def test_conversations_with_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi.", "p"), (1, 1, "user", "Hi.", "p"), (1, 2, "assistant", "Yes", "p"), (2, None, None, None, "p"), (2, 5, "tool", "x.", "p"),
        (None, 3, "user", "q?", "p"), (None, 9, "assistant", "a!", "p"), (3, 1, "system", "be short.", "p"),
    ]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"line {i}.", "p") for i in range(5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows string").repartition(5)
    got = {r.conv_id: r for r in conversation_repair.repair_conversations(frame).collect()}
    assert len(got) == 5
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (0, 0, 1, 1, 1, 7, "KDK")
    assert [(t.role, t.text) for t in one.turns] == [("user", "Hi."), ("assistant", "Yes")]
    two = got[2]
    assert (two.gaps, two.blank, two.illegal, two.cost, two.audit, two.turns) == (0, 1, 1, 8, "DD", [])
    assert (got[None].gaps, got[None].cost, got[None].audit) == (5, 0, "KK")
    assert (got[3].cost, got[3].audit) == (4, "D") and (got[4].cost, got[4].audit, len(got[4].turns)) == (0, "K" * 5000, 5000)
    gone = conversation_repair.repair_conversations(frame.where("conv_id = 3"), gone=F.lit(True)).first()
    assert (gone.conv_id, gone.gaps, gone.cost, gone.audit, gone.turns) == (3, 0, 0, "", [])
    assert conversation_repair.repair_conversations(frame.limit(0)).count() == 0
