"""Distinct words of a text as 64-bit hashes, the same on every worker."""

from __future__ import annotations

import re

import xxhash

_WORD = re.compile("[a-z0-9]+")
_CACHE: dict[str, int] = {}
_CACHE_LIMIT = 500_000


def word_hash(word: str) -> int:
    """Signed 64-bit hash of a word."""
    h = _CACHE.get(word)
    if h is None:
        if len(_CACHE) >= _CACHE_LIMIT:
            _CACHE.clear()
        h = xxhash.xxh64_intdigest(word)
        h = h - (1 << 64) if h >> 63 else h
        _CACHE[word] = h
    return h


def distinct_words(text: str | None) -> list[str]:
    """The distinct words in order of first occurrence: runs of a-z and 0-9 after lower-casing."""
    return list(dict.fromkeys(_WORD.findall(text.lower()))) if text else []
