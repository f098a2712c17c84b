"""Hashes of word sequences, computed on whole Arrow batches at a time.

A word's hash is the polynomial of its bytes, read off prefix sums over the batch, so no
Python code runs per word. Text must be words of a-z with one blank between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20  # bytes hashed at once: the arrays stay in the processor's cache
_POWERS: list[np.ndarray] = []


def words_of(text: Column) -> Column:
    """The maximal runs of a-z in the lower-cased text, one blank between; '' for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " ")), F.lit(""))


_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: str | None) -> str:
    """What ``words_of`` gives, for one text: whole texts are translated byte by byte, several times as fast as by an expression."""
    return b" ".join(text.lower().encode("ascii", "replace").translate(_LETTERS).split()).decode("ascii") if text else ""


def word_count(words: Column) -> Column:
    return F.when(F.length(words) == 0, F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 2 * _PIECE)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def _piece(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash), one for each distinct sequence of ``width`` words, sorted."""
    data = np.frombuffer((" ".join(texts) + " ").encode("ascii"), np.uint8)
    up, down = _powers(len(data) + 1)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * up[: len(data)], dtype=np.uint64)])
    word = mix((sums[ends] - sums[starts]) * down[starts])
    counts = np.array([t.count(" ") + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(word) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word[: len(word) - width + 1]
    for k in range(1, width):
        h = mix(h * np.uint64(0x9DDFEA08EB382D69) + word[k : len(word) - width + 1 + k])
    same = doc[: len(h)] == doc[width - 1 :]
    # the text's number stands in the top 12 bits, 52 bits of the hash below it: one sort does both
    key = np.sort((doc[: len(h)][same].astype(np.uint64) << np.uint64(52)) | (h[same] >> np.uint64(12)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)


def shingle_sets(texts: list[str], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text's number, text number within the piece, hash) for pieces of the texts, which must not be empty.

    Each text gets the set of hashes of its word sequences; one with fewer words than ``width`` gets none.
    """
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= _PIECE or k - start == 4095 or k == len(texts) - 1:
            doc, h = _piece(texts[start : k + 1], width)
            yield start, doc, h
            start, size = k + 1, 0
