"""Words and 64-bit hashes of texts inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
CACHED_HASHES = 300_000


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; bytes know just this white space and these letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return _WORD.findall(text.lower()) if text else []


class Hashes(dict):
    """XXH64 of words, with a bounded cache that keeps the words met first."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_HASHES:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
