"""Token ids of public vocabularies, with a bounded cache of words.

A byte-level BPE never joins characters across its pre-tokens, and each space between two non-space characters begins
a pre-token. So a text whose spaces are all of that kind is cut there, and each piece is encoded once.
"""

from __future__ import annotations

import base64
import re

import numpy as np

LIMIT = 400_000  # words kept per Python worker
_ODD = re.compile(r" (?:\s|(?<=\s ))")


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCache(dict):
    """``encode(text)`` gives its ids as little-endian unsigned 32-bit bytes. A ``special`` string in a text is its own id, as the library of the contract has it."""

    def __init__(self, path: str, special: dict[str, int] | None = None):
        super().__init__()
        self.encoder = _encoder(path)
        self.special = special or {}

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(" " + word)
        if len(word) < 40:
            if len(self) >= LIMIT:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        for name, number in self.special.items():
            if name in text:
                return np.array([number], "<u4").tobytes().join(map(self.encode, text.split(name)))
        if text.startswith(" ") or text.endswith(" ") or _ODD.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))
