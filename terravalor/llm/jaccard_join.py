"""N-gram Jaccard join along chosen paths.

Texts become sets of word shingles, sets become fixed-size sketches of minhash
tokens. A run of the join splits all sets recursively: at every level a node
draws a few of the sketch positions at random, and sets that agree in a drawn
token go on together, until a bucket is small or the path is deep enough that
chance company is unlikely. Pairs that meet are compared by sketch; runs repeat
until a pair at the limit is met with the target probability. What is linked by
sketch is then compared exactly, in blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravalor.llm import bloom
from terravalor.llm.common import WORD
from terravalor.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Minhash tokens of a set, levels of a path, draws of a node below the root, and the recall aimed at.
TOKENS = 128
DEPTH = 3
DRAWS = 3
RECALL = 0.99999
#: A bucket of more sets is split again; at the last level it is compared in pairs of blocks.
SMALL = 2048
BLOCK = 1024
#: Sets of a group in one block of the exact comparison.
EXACT_BLOCK = 256
#: Sketch similarity from which pairs go to the exact comparison: five deviations below the limit.
LOOSE = SIMILARITY - 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / TOKENS)

_SEED = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's runs of k words, sorted; of all its words if it has fewer."""
    from xxhash import xxh3_64_intdigest

    words = re.findall(WORD, text or "")
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = mixed(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = mixed(out * np.uint64(3) + h[i : i + n] + _SEED)
    return np.unique(out)


def sketch(items: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """For each position the smallest of the set's items under that position's hash, as 32 bits."""
    out = np.full(tokens, np.iinfo(np.uint64).max, dtype=np.uint64)
    keys = mixed(np.arange(1, tokens + 1, dtype=np.uint64) * _SEED)
    with np.errstate(over="ignore"):
        for at in range(0, len(items), 4096):
            part = items[at : at + 4096, None]
            out = np.minimum(out, ((part ^ keys) * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """Runs after which a pair at the limit has met with the wanted probability.

    A pair agrees in the token drawn at the root with probability ``similarity``, and in one of
    those drawn at a lower node unless it differs in all.
    """
    meets = similarity * (1 - (1 - similarity) ** DRAWS) ** (DEPTH - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def sets_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, text_hash, set_id, n_items, sketch); set_id, the digest of the shingles, is null for a text without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_hexdigest

        for frame in frames:
            found = [shingles(x) for x in frame.pop("text")]
            frame["set_id"] = [xxh3_128_hexdigest(x.tobytes()) if len(x) else None for x in found]
            frame["n_items"] = [len(x) for x in found]
            frame["sketch"] = [sketch(x).tobytes() if len(x) else None for x in found]
            yield frame

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, text_hash long, set_id string, n_items long, sketch binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come in order of the keys; one is held at a time."""
    left = None
    for frame in frames:
        frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        edges = [0, *cuts]
        for a, b in zip(edges, edges[1:], strict=False):
            yield frame.iloc[a:b]
        left = frame.iloc[edges[-1] :]
    if left is not None and len(left):
        yield left


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row of its component."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        low = np.where(reach, label, len(label)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _dealt(members: DataFrame, key: str, size: str, whole: int, block: int) -> DataFrame:
    """Members of groups dealt to pairs of blocks (key, b1, b2, mine): every two members meet in one.

    A group of up to ``whole`` is one block.
    """
    blocks = F.when(F.col(size) <= whole, F.lit(1)).otherwise(F.ceil(F.col(size) / block).cast("int"))
    rows = members.withColumn("_n", blocks).withColumn("mine", F.pmod(F.xxhash64("set_id", key), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumn("b1", F.least("mine", "_other")).withColumn("b2", F.greatest("mine", "_other")).drop("_n", "_other", size)


def _met(node: pd.DataFrame) -> np.ndarray:
    """Which rows may meet: all within one block, else only those of different blocks."""
    mine = node["mine"].to_numpy()
    if (node["b1"].iloc[0]) == (node["b2"].iloc[0]):
        out = np.ones((len(mine), len(mine)), dtype=bool)
    else:
        out = mine[:, None] != mine[None, :]
    np.fill_diagonal(out, False)
    return out


def _by_sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for node in _groups(frames, ["node", "b1", "b2"]):
        if len(node) < 2:
            continue
        marks = np.stack([np.frombuffer(x, dtype=np.uint32) for x in node["sketch"]])
        alike = np.zeros((len(marks), len(marks)), dtype=np.int32)
        for at in range(marks.shape[1]):
            alike += marks[:, at, None] == marks[None, :, at]
        roots = _roots(_met(node) & (alike >= LOOSE * marks.shape[1]))
        ids = node["set_id"].to_numpy()
        moved = roots != np.arange(len(roots))
        if moved.any():
            yield pd.DataFrame({"a": ids[moved], "b": ids[roots[moved]]})


def candidates(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that join all sets which a run brought together and whose sketches are alike.

    A bucket yields one edge a set at most, never its pairs. sets: set_id, sketch, each set once.
    """
    token = lambda at: F.substring("sketch", 4 * at + 1, 4)
    first = [F.xxhash64(F.lit(r), token(F.lit(r * 37 % TOKENS))) for r in range(runs_needed())]
    rows = materialize(sets.select("set_id", F.explode(F.array(*first)).alias("node")))
    edges: DataFrame | None = None
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
        here = materialize(rows.join(sizes, "node"))
        last = level == DEPTH
        leaves = here if last else here.where(F.col("size") <= SMALL)
        dealt = _dealt(leaves, "node", "size", SMALL, BLOCK).join(sets.select("set_id", "sketch"), "set_id")
        dealt = dealt.select("node", "b1", "b2", "mine", "set_id", "sketch").repartition("node", "b1", "b2").sortWithinPartitions("node", "b1", "b2")
        found = materialize(dealt.mapInPandas(_by_sketch, "a string, b string").distinct())
        edges = found if edges is None else edges.unionByName(found)
        if last:
            break
        draws = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS)).cast("int") for k in range(DRAWS)]))
        large = here.where(F.col("size") > SMALL).select("set_id", "node", draws.alias("at")).distinct().join(sets.select("set_id", "sketch"), "set_id")
        rows = materialize(large.select("set_id", F.xxhash64("node", "at", token(F.col("at"))).alias("node")))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node of the edges (a, b).

    Large-star and small-star rounds until no edge changes; each round is written.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        now = materialize(small.distinct())
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _reach(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs have the limit's similarity or more, in whole numbers: a pair at the limit is in."""
    limit = Fraction(str(SIMILARITY))
    return limit.denominator * shared >= limit.numerator * (sizes[:, None] + sizes[None, :] - shared)


def _exactly(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in _groups(frames, ["root", "b1", "b2"]):
        if len(group) < 2:
            continue
        items = [np.frombuffer(x, dtype=np.uint64) for x in group["items"]]
        sizes = np.array([len(x) for x in items], dtype=np.int64)
        owner = np.repeat(np.arange(len(items)), sizes)
        _, where, df = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        owner, where = owner[df[where] > 1], where[df[where] > 1]
        order = np.argsort(where, kind="stable")
        owner, where = owner[order], np.unique(where[order], return_inverse=True)[1]
        shared = np.zeros((len(items), len(items)), dtype=np.int64)
        for at in range(0, int(where[-1]) + 1 if len(where) else 0, 4096):
            a, b = np.searchsorted(where, [at, at + 4096])
            part = np.zeros((len(items), 4096), dtype=np.float32)
            part[owner[a:b], where[a:b] - at] = 1
            shared += (part @ part.T).astype(np.int64)
        linked = _met(group) & _reach(shared, sizes)
        counts = linked @ group["copies"].to_numpy().astype(np.int64)
        roots, ids = _roots(linked), group["set_id"].to_numpy()
        some = counts > 0
        if some.any():
            yield pd.DataFrame({"set_id": ids[some], "to": ids[roots[some]], "links": counts[some]})


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, set_id, copy_id, class_id, n_links, winner) for every document.

    copy_id: smallest doc_id with the same set of shingles; class_id: of all documents linked
    directly or through others; n_links: other documents of Jaccard similarity 0.8 or more, copies
    included; winner: whether the row's doc_id and text are those chosen to stand for the class.

    Copies are counted before the join and groups larger than a block are compared in pairs of
    blocks, so no group meets in one task and no pair leaves one. Texts under five words are one
    shingle of all their words; texts without words (and null ones) are linked to nothing and
    each its own class. Null ids are smallest last; repeated rows are copies of each other.
    """
    sets = materialize(sets_of(docs, doc_id, text))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = materialize(sets.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(one, F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch")))
    loose = components(candidates(distinct.select("set_id", "sketch")))
    near = materialize(loose.withColumnRenamed("node", "set_id").join(distinct.select("set_id", "first", "copies"), "set_id"))

    # Only texts that a bounded filter lets through are made into shingles again; no text is shuffled.
    wanted = materialize(near.select(F.col("first.text_hash").alias("wanted")).distinct())
    table = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "wanted"))

    def itemize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[bloom.passes(table.value, frame["first"].to_numpy(), frame["second"].to_numpy())].drop_duplicates("h")
            yield pd.DataFrame({"h": frame["h"], "items": [shingles(x).tobytes() for x in frame["text"]]})

    h = F.xxhash64(text)
    first, second = bloom.hashes(h)
    texts = docs.select(h.alias("h"), first.alias("first"), second.alias("second"), F.col(text).alias("text"))
    items = texts.mapInPandas(itemize, "h long, items binary").join(wanted, F.col("h") == F.col("wanted"), "left_semi")
    items = materialize(items.groupBy("h").agg(F.min("items").alias("items")))
    sized = near.join(near.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    dealt = _dealt(sized.withColumn("h", F.col("first.text_hash")).drop("first"), "root", "size", EXACT_BLOCK, EXACT_BLOCK).join(items, "h")
    dealt = dealt.select("root", "b1", "b2", "mine", "set_id", "copies", "items").repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")
    links = materialize(dealt.mapInPandas(_exactly, "set_id string, to string, links long"))

    groups = components(links.select(F.col("set_id").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy(F.col("set_id").alias("linked")).agg(F.sum("links").alias("links"))
    each = distinct.select("set_id", "first", "copies").join(counts, F.col("set_id") == F.col("linked"), "left").join(groups, F.col("set_id") == F.col("node"), "left")
    each = materialize(each.select("set_id", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_id").alias("root")))
    heads = each.groupBy("root").agg(F.min("first").alias("head"))
    each = each.join(heads, "root").select("set_id", F.col("first.doc_id").alias("copy_id"), "head", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = sets.select("doc_id", "text_hash", F.col("set_id").alias("own")).join(each, F.col("own") == F.col("set_id"), "left")
    alone = F.col("own").isNull()
    return out.select(
        "doc_id", "text_hash", F.col("own").alias("set_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))).alias("winner"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, in the columns of the input; texts without words all stay."""
    found = classes(docs, doc_id, text).where(F.col("winner") & F.col("set_id").isNotNull())
    won = materialize(found.groupBy(F.col("doc_id").alias("won_id"), F.col("text_hash").alias("won_hash")).agg(F.count(F.lit(1)).alias("rows")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(F.col(text).rlike(WORD), F.lit(False)).alias("worded"))
    joined = rows.where("worded").join(won, F.col("id").eqNullSafe(F.col("won_id")) & (F.col("hash") == F.col("won_hash")))
    single = joined.where("rows = 1").select("row")
    # Rows repeated with id and text: one of them, by a written choice of equal rows.
    repeated = joined.where("rows > 1").groupBy("id", "hash").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).unionByName(rows.where("not worded").select("row")).select("row.*")
