"""Token counts under a unigram model by dynamic programming over a trie.

The distinct pre-tokens of a task go into a trie. The best score of a prefix and
the number of tokens of its best segmentation depend on the prefix alone, so they
are computed once for all pre-tokens that share it; a pre-token's count is that
of the node where it ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravalor.llm.common import WORD

#: Nodes of a task's trie; it is started anew when it has more. Longer pre-tokens are scored without it.
NODES = 1_000_000
LONG = 256
#: Opens every pre-token.
MARK = "▁"


def unigrams(model_file: str) -> dict[str, float]:
    """Log probability of every plain piece of a vocabulary file: Zipf's law over its order, 1 / (rank + 2.7)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
    return {model.id_to_piece(i): -math.log(r + 2.7) - total for r, i in enumerate(ranked)}


class Trie:
    """Forward scores of prefixes. A character without any piece is its UTF-8 bytes, each ten below the lowest score."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.byte = min(pieces.values(), default=0.0) - 10
        #: Lengths of the pieces that may end at a place, by the last three characters there.
        ends: dict[str, set[int]] = {}
        for piece in pieces:
            ends.setdefault(piece[-3:], set()).add(len(piece))
        self.lengths = {}
        for end, found in ends.items():
            shorter = {n for n in (1, 2) if end[-n:] in pieces}
            self.lengths[end] = sorted(found | shorter)
        self.clear()

    def clear(self) -> None:
        self.next: dict[int, int] = {}
        self.score = [0.0]
        self.count = [0]
        self.counts: dict[str, int] = {}

    def _best(self, text: str, end: int, path, score: list[float], count: list[int]) -> tuple[float, int]:
        """Score and tokens of the best way to text[:end]; of equal scores the fewer tokens. path: where each prefix is kept."""
        best, tokens = -math.inf, 0
        last, pieces = text[end - 1], self.pieces
        known = self.lengths
        lengths = known.get(text[end - 3 : end] if end > 2 else text[:end]) or known.get(text[end - 2 : end] if end > 1 else last) or (1,)
        for n in lengths:
            if n > end:
                break
            piece = pieces.get(text[end - n : end])
            if piece is not None:
                at = path[end - n]
                s = score[at] + piece
                if s > best or (s == best and count[at] + 1 < tokens):
                    best, tokens = s, count[at] + 1
        if last not in pieces:
            size, at = len(last.encode("utf-8", "surrogatepass")), path[end - 1]
            s = score[at] + size * self.byte
            if s > best or (s == best and count[at] + size < tokens):
                best, tokens = s, count[at] + size
        return best, tokens

    def _along(self, text: str) -> int:
        score, count, path = [0.0], [0], range(len(text) + 1)
        for end in range(1, len(text) + 1):
            s, c = self._best(text, end, path, score, count)
            score.append(s)
            count.append(c)
        return count[-1]

    def tokens(self, text: str) -> int:
        """Tokens of a pre-token, remembered with it."""
        known = self.counts.get(text)
        if known is not None:
            return known
        if len(text) > LONG:
            return self._along(text)
        if len(self.score) > NODES:
            self.clear()
        after, score, count = self.next, self.score, self.count
        node, path = 0, [0]
        for end, char in enumerate(text, 1):
            key = node * 0x110000 + ord(char)
            child = after.get(key)
            if child is None:
                s, c = self._best(text, end, path, score, count)
                child = after[key] = len(score)
                score.append(s)
                count.append(c)
            node = child
            path.append(node)
        self.counts[text] = count[node]
        return count[node]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """The documents' other columns with ``n_pretokens`` and ``n_tokens``.

    Pre-tokens are the words of a text (runs of other than space and U+0009 to U+000D), each
    opened by a mark that counts as its first character. A null or empty text has none and no
    tokens. Rows are counted where they lie, without a shuffle; memory is bounded by the trie. Repeated
    rows are counted each; an empty table gives an empty result; an input column named like an
    output gives way.
    """
    added = ("n_pretokens", "n_tokens")
    names = [c for c in docs.columns if c != text and c not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"{c} long" for c in added])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, trie = re.compile(WORD), Trie(unigrams(model_file))
        for frame in frames:
            counts = [[trie.tokens(MARK + w) for w in words.findall(value)] for value in frame.pop("_text")]
            frame["n_pretokens"], frame["n_tokens"] = [len(c) for c in counts], [sum(c) for c in counts]
            yield frame

    return rows.mapInPandas(run, schema)
