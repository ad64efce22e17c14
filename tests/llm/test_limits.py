"""Pairs at a limit, copies that must not count twice, and neighbours that lie far apart in the files."""

from __future__ import annotations

import random

import public_tokenizers

import corpus_pipeline
from terravalor.llm import jaccard_join, line_dedup, packing


def test_pairs_at_the_limit_are_linked_and_those_below_are_not(spark):
    rows, want = [], {}
    for shared, one, other in [(12, 13, 14), (12, 12, 15), (28, 31, 32), (84, 94, 95), (116, 130, 131), (396, 445, 446), (12, 14, 14), (84, 95, 95), (396, 446, 446)]:
        common = [f"p{shared}x{one}y{other}w{i}" for i in range(shared + 4)]
        for side, size in enumerate((one, other)):
            name = f"{shared}/{one}/{other}/{side}"
            rows.append((name, " ".join(common + [f"{name}e{i}" for i in range(size - shared)])))
            want[name] = int(5 * shared >= 4 * (one + other - shared))
    got = {r.doc_id: r.n_links for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == want


def test_a_third_of_all_rows_being_copies_leaves_one(spark):
    copy = "first line of a page that was copied often\nits second line"
    rows = [(i, copy if i % 3 == 0 else f"head\nbody of page {i} alone", "a") for i in range(300)]
    rows += [(1000 + i, "clean and short text\nof a small source" if i < 3 else f"some other page {i}", "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = corpus_pipeline.without_boilerplate(spark, docs, "")
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert len(got) == 400 and got[0] == copy and got[1] == "body of page 1 alone" and got[1001] == "clean and short text\nof a small source"
    left = [r.text for r in jaccard_join.keep_one(cleaned).collect()]
    assert left.count(copy) == 1
    rowwise = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    assert rowwise[0] == "" and rowwise[1] == "body of page 1 alone"


def test_neighbours_far_apart_in_the_files_are_packed_together(spark):
    dice = random.Random(3)
    pairs = [" ".join("".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)) for _ in range(700)]
    rows = [(i, f"the page says {pairs[i % 700]} and so on") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False).collect()
    lies: dict[int, set] = {}
    for p in pieces:
        lies.setdefault(p.doc_id, set()).add(p.sequence_id)
    assert len(lies) == 1400 and sum(bool(lies[i] & lies[i + 700]) for i in range(700)) >= 500


def test_the_added_token_in_a_text_is_one_id(spark):
    from tokenizers import Tokenizer

    texts = ["one<|endoftext|>two", "<|endoftext|><|endoftext|>", "<|endof text|> plain", "é<|endoftext|>\n"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    for i, text in enumerate(texts):
        ids = [x for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start) for x in p.ids]
        assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
