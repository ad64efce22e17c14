"""Token ids of texts and the ragged reading that goes with them."""

from __future__ import annotations

import base64

import numpy as np


#: The added token of the vocabulary's JSON file, which a ranks file leaves out: its string in a text is this one id.
ADDED = {"<|endoftext|>": 50256}


class Encoder:
    """Ids of the byte-level BPE vocabulary of a ranks file and its added token."""

    def __init__(self, ranks_file: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED).encode_to_numpy

    def ids(self, text: str) -> np.ndarray:
        return self._encode(text, allowed_special=set(ADDED), disallowed_special=())


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one after another."""
    total = np.cumsum(lengths)
    if not len(total):
        return np.empty(0, dtype=np.int64)
    return np.arange(total[-1]) - np.repeat(total - lengths - starts, lengths)
