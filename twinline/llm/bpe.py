"""Byte-level BPE ids by the public vocabulary file, with a bounded cache of words.

The vocabulary's split pattern never joins a word to the space-separated word
before it, so a text falls apart at its single spaces and each part, with its
leading space, has ids of its own. Only where white space meets white space
across such a space does the pattern look further; those texts go whole to the
encoder. The result is the encoder's own for every text.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import public_tokenizers

RANKS = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json as ranks
VOCABULARY = 50_257
END_OF_TEXT = 50_256  # the vocabulary's own separator, which no text part yields
SEPARATOR = "<|endoftext|>"
CACHED_WORDS = 400_000
LONGEST_CACHED = 48  # characters
_ACROSS = re.compile(r"\s \s")


class _Words(dict):
    """Ids of a word, with its leading space, as little-endian 16-bit bytes.

    When full it takes no more words: those met first hold nearly all common ones.
    """

    def __init__(self, bpe):
        self.encode, self.piece = bpe.encode_ordinary, bpe._encode_single_piece
        self.marks = {mark: np.array(self.encode(mark), "<u2").tobytes() for mark in ".,"}

    def __missing__(self, word: str) -> bytes:
        body = word[1:-1]
        if word[-1] in self.marks and body.isalpha() and body.isascii():
            ids = self[word[:-1]] + self.marks[word[-1]]
        elif body.isalpha() and word[-1].isalpha():
            ids = array("H", self.piece(word)).tobytes()
        else:
            ids = array("H", self.encode(word)).tobytes()
        if len(self) < CACHED_WORDS and len(word) <= LONGEST_CACHED:
            self[word] = ids
        return ids


def encoder(path: str, special: bool = False):
    """A function from text to its ids as an array.

    Every task makes its own, in about a tenth of a second: a worker outlives its
    job, and an encoder kept in it would lie beside the tables of all later operators.

    With ``special`` the separator's own string in a text gives its id, as the
    vocabulary's ``Tokenizer`` does unless told otherwise; without, it is ordinary text.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    bpe = tiktoken.Encoding(
        "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    words = _Words(bpe)
    separator = np.array([END_OF_TEXT], "<u2")

    def encode(text: str) -> np.ndarray:
        if special and SEPARATOR in text:
            first, *rest = text.split(SEPARATOR)
            return np.concatenate([encode(first), *(x for part in rest for x in (separator, encode(part)))])
        if not text:
            return np.empty(0, "<u2")
        if _ACROSS.search(text):
            return np.array(bpe.encode_ordinary(text), "<u2")
        first, *rest = text.split(" ")
        parts = [array("H", bpe.encode_ordinary(first)).tobytes()]
        parts.extend(map(words.__getitem__, [" " + part for part in rest]))
        return np.frombuffer(b"".join(parts), "<u2")

    return encode


def default_path() -> str:
    return public_tokenizers.path(RANKS)
