"""Lexical retrieval packing of documents into token sequences.

Long documents fill windows of their own. What is left of each is ordered by the
rare terms it shares with others, over the whole table, and goes into the inverted
index of its shard, a run of that order; a window opens with a seed and takes the unused
neighbour of the highest BM25 score to what it was opened with, again and again.
The last one is cut, so that windows are full, and its rest opens the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravalor.llm.tokens import Encoder, spread
from terravalor.session import materialize

WINDOW = 1024
#: Documents of one index shard, which one task holds at a time.
SHARD = 512
K1, B = 1.2, 0.75
#: Terms drawn of a document for its place in the order.
DRAWN = 4
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class Index:
    """An inverted index over bags of token ids with BM25 weights in its postings.

    ``idf`` by token and ``mean`` length are those of all bags of the table; tokens in over
    half of them have no positive weight and no postings.
    """

    def __init__(self, bags: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = len(bags)
        unique = [np.unique(bag, return_counts=True) for bag in bags]
        owner = np.repeat(np.arange(n), [len(u) for u, _ in unique])
        token = np.concatenate([u for u, _ in unique]).astype(np.int64)
        count = np.concatenate([c for _, c in unique]).astype(np.float64)
        sizes = np.array([len(b) for b in bags], dtype=np.float64)
        terms, where, df = np.unique(token, return_inverse=True, return_counts=True)
        idf = idf[terms]
        weight = idf[where] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[owner] / mean))
        useful = (idf[where] > 0) & (df[where] > 1)
        owner, where, weight = owner[useful], where[useful], weight[useful]
        order = np.argsort(where, kind="stable")
        self._owner, self._weight = owner[order], weight[order]
        self._ends = np.searchsorted(where[order], np.arange(len(terms)), side="right")
        self._starts = np.searchsorted(where[order], np.arange(len(terms)), side="left")
        at = np.argsort(owner, kind="stable")
        self._terms = np.split(where[at], np.searchsorted(owner[at], np.arange(1, n)))
        self.n = n

    def scores(self, document: int) -> np.ndarray:
        """BM25 of every document of the shard to the terms of one."""
        terms = self._terms[document]
        begin, length = self._starts[terms], self._ends[terms] - self._starts[terms]
        if not len(terms):
            return np.zeros(self.n)
        at = spread(begin, length)
        return np.bincount(self._owner[at], self._weight[at], self.n)


def inverse_frequencies(tokens: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """BM25 idf of ``n`` bags by token."""
    out = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1)
    out[tokens] = np.log((n - df + 0.5) / (df + 0.5))
    return out


def draws(idf: np.ndarray, n: int) -> np.ndarray:
    """For each token and draw when it comes up, by a hash and its idf; never where no second bag has it."""
    token = np.arange(len(idf), dtype=np.uint64)
    shared = (idf > 0) & (idf < np.log((n - 0.5) / 1.5) - 1e-9)
    out = np.full((DRAWN, len(idf)), np.inf)
    with np.errstate(over="ignore", divide="ignore"):
        for k in range(DRAWN):
            h = (token + np.uint64(1 + k * 0x10001)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
            out[k, shared] = -np.log(u[shared]) / idf[shared]
    return np.ascontiguousarray(out.T)


def order_keys(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """For each bag its first token in each draw (16 bytes, larger tokens later); bags that share rare terms agree in the first ones more often."""
    out = np.empty((len(starts), DRAWN), dtype=">u4")
    owner = np.repeat(np.arange(len(starts)), lengths)
    for k in range(DRAWN):
        times = drawn[values, k]
        least = np.minimum.reduceat(times, starts)
        hits = np.flatnonzero(times == least[owner])
        first = hits[np.searchsorted(owner[hits], np.arange(len(starts)))]
        out[:, k] = np.where(least < np.inf, values[first], 0xFFFFFFFF)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a column of lists without nulls."""
    lengths = column.value_lengths().to_numpy()
    return column.flatten().to_numpy(), np.cumsum(lengths) - lengths, lengths


def windows(lengths: list[int], bags: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length) over one shard; only the last may be short."""
    tails = []
    for doc, n in enumerate(lengths):
        yield from ([(doc, at, window)] for at in range(0, n - window + 1, window))
        if n % window:
            tails.append(doc)
    if not tails:
        return
    index = Index([bags[d][-(lengths[d] % window):] for d in tails], idf, mean)
    unused = np.ones(len(tails), dtype=bool)
    place, left = 0, None
    while True:
        if left is None:  # a new seed: the first unused in order
            while place < len(tails) and not unused[place]:
                place += 1
            if place == len(tails):
                return
            seed, at = place, lengths[tails[place]] // window * window
            unused[seed] = False
        else:
            seed, at = left
        pieces, room, left = [], window, None
        scores = None
        chosen = seed
        while True:
            doc = tails[chosen]
            take = min(room, lengths[doc] - at)
            pieces.append((doc, at, take))
            room -= take
            if at + take < lengths[doc]:
                left = (chosen, at + take)
            if not room or not unused.any():
                break
            if scores is None:
                scores = index.scores(seed)
            best = int(np.argmax(np.where(unused, scores, -1.0)))
            chosen, at = best, lengths[tails[best]] // window * window
            unused[best] = False
        yield pieces
        if left is None and not unused.any():
            return


def pack(docs: DataFrame, ranks_file: str, pattern: str, end_id: int = 0, text: str = "text", window: int = WINDOW, shard: int = SHARD, with_ids: bool = True) -> DataFrame:
    """One row a piece: the document's columns but its text, and start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Each document's ids, closed by ``end_id``, are cut into pieces; every id lies in one. Whole
    windows of a document are sequences as they are. The tails are written and brought into one
    order over the whole table: by tokens drawn of each, the rarer the likelier, then by their
    place in the files. A shard is a run of that order within a range of it, so a hot token or
    group of copies is cut by place into as many ranges and shards as it needs, and the memory
    is that of one shard. Document frequencies and the mean length are those of all tails; they
    come to the driver, a row for each token of the vocabulary at most. One window a shard at
    most is short. A null or empty text is its end id alone; repeated rows are documents of
    their own; an empty table gives an empty result. Input columns named like an output give way.
    """
    outputs = [c.split()[0] for c in SCHEMA.split(", ")]
    names = [c for c in docs.columns if c != text and c not in outputs]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)

    def framed(part: pa.RecordBatch | pa.Table, doc: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
        carried = part.select(names).take(pa.array(doc, pa.int64()))
        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in carried.columns]
        arrays = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in arrays]
        return pa.RecordBatch.from_arrays([*arrays, *columns], names=[*names, *outputs])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole windows as they come out; a tail has no sequence_id, and its place as its offset."""
        encode = Encoder(ranks_file, pattern).ids
        serial = TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for first in range(0, batch.num_rows, shard):
                part = batch.slice(first, shard)
                texts = [np.concatenate([encode(x), end]) for x in part.column("_text").to_pylist()]
                sizes = np.array([len(x) for x in texts], dtype=np.int64)
                doc = np.repeat(np.arange(len(texts)), -(-sizes // window))
                nth = spread(np.zeros(len(texts), dtype=np.int64), -(-sizes // window))
                start, total = nth * window, sizes[doc]
                length = np.minimum(window, total - start)
                whole = length == window
                pieces = [texts[d][a : a + n] for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                crc = pa.array([zlib.crc32(x) for x in pieces], pa.int64())
                place = serial + np.arange(len(pieces))
                kept = np.full(len(pieces), True) if with_ids else ~whole
                held = [x for x, k in zip(pieces, kept.tolist(), strict=True) if k]
                ends = np.concatenate([[0], np.cumsum(np.where(kept, length, 0))])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~kept, False)), pa.array(np.concatenate([*held, end[:0]]).astype(np.int32)))
                yield framed(
                    part, doc, pa.array(start), pa.array(length), crc, pa.array(total), pa.array(place, mask=~whole), pa.array(np.where(whole, 0, place)), ids
                )
                serial += len(pieces)

    cuts = materialize(rows.mapInArrow(cut, f"{kinds}{SCHEMA}"))
    tails = cuts.where("sequence_id IS NULL")
    n, total = tails.agg(F.count(F.lit(1)), F.sum("length")).first()
    known = tails.select(F.explode(F.array_distinct("ids")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).collect()
    idf = inverse_frequencies(np.array([r.token for r in known], dtype=np.int64), np.array([r.df for r in known], dtype=np.float64), n)
    corpus = docs.sparkSession.sparkContext.broadcast((idf, (total or 1) / max(n, 1), n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, _, n = corpus.value
        drawn = draws(idf, n)
        for batch in batches:
            if batch.num_rows:
                keys = order_keys(*_lists(batch.column("ids")), drawn)
                yield batch.append_column("_key", pa.array([k.tobytes() for k in keys], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, _ = corpus.value
        serial = (1 << 62) + (TaskContext.get().partitionId() << 33)
        for part in _shards(batches, shard):
            values, starts, _ = _lists(part.column("ids").combine_chunks())
            ids = np.split(values, starts[1:])
            begin, totals = part.column("start").to_numpy(), part.column("doc_tokens").to_numpy()
            packed = list(windows([len(x) for x in ids], ids, window, idf, mean))
            doc, at, size = (np.array(x, dtype=np.int64) for x in zip(*[piece for pieces in packed for piece in pieces], strict=True))
            counts = np.array([len(pieces) for pieces in packed])
            sequence = serial + np.repeat(np.arange(len(packed)), counts)
            before = np.cumsum(size) - size
            offset = before - np.repeat(before[np.cumsum(counts) - counts], counts)
            pieces = [ids[d][a : a + n] for d, a, n in zip(doc.tolist(), at.tolist(), size.tolist(), strict=True)]
            crc = pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in pieces], pa.int64())
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(pieces))) if with_ids else pa.nulls(len(pieces), pa.list_(pa.int32()))
            yield framed(part, doc, pa.array(begin[doc] + at), pa.array(size), crc, pa.array(totals[doc]), pa.array(sequence), pa.array(offset), kept)
            serial += len(packed)

    # Written, so that finding the ranges does not draw a second time.
    placed = materialize(tails.mapInArrow(place, f"{kinds}{SCHEMA}, _key binary")).repartitionByRange("_key", "offset").sortWithinPartitions("_key", "offset")
    return cuts.where("sequence_id IS NOT NULL").unionByName(placed.mapInArrow(run, f"{kinds}{SCHEMA}"))


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.Table]:
    """Runs of ``shard`` rows across batches; the last may be shorter."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table])
        whole = table.num_rows // shard * shard
        yield from (table.slice(at, shard) for at in range(0, whole, shard))
        left = table.slice(whole)
    if left is not None and left.num_rows:
        yield left
