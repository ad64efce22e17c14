"""Ranked lexical search by presence masks.

A posting table holds what each document has of the asked terms. Where a batch of
it lies, the documents of an item are grouped by the mask of the terms they match;
no document of a mask can score above the sum of its terms' highest parts, so
masks are evaluated from the highest sum down, until k documents score above all
that is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravalor.llm.common import text_of
from terravalor.session import materialize

#: Distinct terms of the items that are searched in one pass over the documents, about.
BLOCK_TERMS = 1 << 18
#: Documents scored at once, and documents whose terms are counted at once.
CHUNK = 256
COUNTED = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b if chr(b) in _LOWER or 0x30 <= b <= 0x39 or b >= 0x80 else b + 32 if chr(b) in _UPPER else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """Terms: runs of digits, letters and anything beyond ASCII, only A to Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _NO_TERM), "")


def _terms(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def _postings(vocabulary: dict[bytes, int]):
    """Per document with a term: its terms with repeats, and number and count of each that is asked for."""
    get, many = vocabulary.get, len(vocabulary)

    def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes, found = [], []
        for text in texts:
            terms = _terms(text) if text else []
            sizes.append(len(terms))
            found.append(np.fromiter(map(get, terms, repeat(-1)), np.int64, len(terms)))
        sizes = np.array(sizes, dtype=np.int64)
        ids = np.concatenate(found) if found else np.empty(0, np.int64)
        keys, tfs = np.unique((np.repeat(np.arange(len(sizes)), sizes) * many + ids)[ids >= 0], return_counts=True)
        return sizes, np.bincount(keys // many, minlength=len(sizes)), keys % many, tfs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                some = batch.slice(at, COUNTED)
                sizes, kinds, ids, tfs = counted(some.column("t").to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(kinds)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tfs)]
                out = pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(sizes > 0))

    return run


class Masks:
    """The documents of one batch, grouped by which of an item's terms they hold."""

    def __init__(self, documents: int, lists: list[np.ndarray]) -> None:
        words = np.zeros((documents, (len(lists) + 63) // 64), dtype=np.uint64)
        for j, docs in enumerate(lists):
            words[docs, j // 64] |= np.uint64(1) << np.uint64(j % 64)
        self.docs = np.flatnonzero(words.any(axis=1))
        held = words[self.docs]
        if held.shape[1] == 1:
            distinct, self.of = np.unique(held[:, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, self.of = np.unique(held, axis=0, return_inverse=True)
        self.of = self.of.reshape(-1)
        bits = np.arange(len(lists))
        self.has = (distinct[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1) == 1

    def by_bound(self, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents from the mask of the highest possible score down, and that score for each."""
        bound = self.has @ most
        mine = bound[self.of]
        order = np.argsort(-mine, kind="stable")
        return self.docs[order], mine[order]


class Best:
    """The k best documents of an item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.none, self.id = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def limit(self) -> int:
        """No document that scores less can be among the best; ties may."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        some = score >= self.limit()
        score, none, ids = (np.concatenate([a, b[some]]) for a, b in ((self.score, score), (self.none, none), (self.id, ids)))
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[order], none[order], ids[order]


def _score(docs: np.ndarray, lists: list[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(docs), dtype=np.int64)
    for held, part in zip(lists, parts, strict=True):
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        total += np.where(held[at] == docs, part[at], 0)
    return total


def _search(asks: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int):
    """The k best documents of a task's batches for each item: ``asks`` has their term numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asks]
        for batch in batches:
            ids = batch.column("doc_id")
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            n = batch.column("n").to_numpy()
            terms, tfs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            docs = np.repeat(np.arange(len(ids)), batch.column("terms").value_lengths().to_numpy())
            m = 50 + (50 * n * documents) // length
            order = np.argsort(terms, kind="stable")
            terms, docs, tfs = terms[order], docs[order], tfs[order]
            gain = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs]))
            starts = np.searchsorted(terms, np.arange(len(weights) + 1))
            for mine, top in zip(asks, best, strict=True):
                spans = [slice(starts[t], starts[t + 1]) for t in mine if weights[t] > 0 and starts[t] < starts[t + 1]]
                if not spans:
                    continue
                lists, parts = [docs[s] for s in spans], [gain[s] for s in spans]
                ranked, bound = Masks(len(ids), lists).by_bound(np.array([p.max() for p in parts]))
                at, step = 0, CHUNK
                while at < len(ranked) and bound[at] >= top.limit():
                    some = ranked[at : at + step]
                    top.add(_score(some, lists, parts), none[some], ids[some])
                    at, step = at + step, 2 * step
        for i, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.score), i), pa.int32()), pa.array(top.id, mask=top.none), pa.array(top.score)], names=["ask", "doc_id", "score"]
                )

    return run


def _block(texts: DataFrame, asked: list, k: int) -> DataFrame:
    """``ask`` (place in ``asked``), ``doc_id``, ``score``: the k best of each task for the items of one block."""
    vocabulary: dict[bytes, int] = {}
    asks = [np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in row.terms], dtype=np.int64) for row in asked]
    postings = materialize(texts.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"))
    documents, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    table = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    holding[table["term"].to_numpy()] = table["df"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) if df else 0 for df in holding], dtype=np.int64)
    held = postings.where(F.size("terms") > 0)
    return held.mapInArrow(_search(asks, weights, documents, length, k), "ask int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of each item, all whose score is above 0 if fewer.

    A document scores, for each distinct term of the item that it holds, the term's weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 20 m), with
    m = 50 + (50 n N) div L: n its terms, L all terms, N the documents with any. Equal scores
    rank by ascending id, null ids last; each row is a document, so repeated rows each rank. Null
    and empty texts hold no term and don't count. Rows of one item id are one item with the terms
    of all; a null id is an id. Items are searched in blocks of about BLOCK_TERMS terms, whose
    terms, counts and items come to the driver; each block is one pass over the documents, of
    which nothing does. No items, no terms or an empty table give an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    each = items.select(F.col(item_id).alias("item_id"), F.explode(terms_of(text_of(item_text))).alias("term")).distinct()
    terms = materialize(each.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")))
    total = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_TERMS))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))
    named = T.StructType([T.StructField("ask", T.IntegerType()), terms.schema["item_id"]])
    found = terms.limit(0).select("item_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for block in range(blocks):
        asked = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        if asked:
            names = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], named))  # the block's items
            found = found.unionByName(_block(texts, asked, k).join(names, "ask").drop("ask"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
