"""Words and hashes of many UTF-8 texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after A-Z become a-z, which for
UTF-8 equals the pattern ``[^\\x20\\x09-\\x0D]+`` on code points. ``words`` gives each 128 bits of XXH3, by which words are
told apart. ``runs`` gives runs of byte classes a quick 64-bit hash, a polynomial over the bytes modulo 2**64 read off prefix sums, that serves
only to pick rows of a table: different runs may share it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_128_digest

from .bloom import mix

PIECE = 1 << 18
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _power or len(_power[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _power[:] = made
    return _power[0], _power[1]


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of about PIECE bytes; a longer text is cut at white space into several pieces."""
    owner: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                gap = re.compile(rb"[ \t-\r]").search(text, at + PIECE)
                end = gap.end() if gap else end
            owner.append(i)
            held.append(text[at:end])
            size += end - at
            at = end
            if size >= PIECE:
                yield owner, held
                owner, held, size = [], [], 0
    if held:
        yield owner, held


def words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of texts, words per text, (words, 2) hashes in order) of groups of about PIECE bytes; no text spans two."""
    first = size = 0
    counts: list[int] = []
    digests: list[bytes] = []
    for i, text in enumerate(texts):
        own = text.lower().split()  # bytes split at exactly 0x20 and 0x09-0x0D, and only A-Z become lower
        counts.append(len(own))
        digests.append(b"".join(map(xxh3_128_digest, own)))
        size += len(text)
        if size >= PIECE or i + 1 == len(texts):
            yield np.arange(first, i + 1), np.array(counts, np.int64), np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            first, size, counts, digests = i + 1, 0, [], []


#: Class of each byte: 0 separates, and a run is of one class. MARKS tells punctuation from words.
MARKS = (~_SPACE).astype(np.int8)
MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


def runs(texts: list[bytes], classes: np.ndarray, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, hash) of each maximal run of bytes of one class, in order, in pieces."""
    for owner, held in _pieces(texts):
        joined = b"\n".join(held)
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        kind = np.concatenate([np.zeros(1, np.int8), classes[data], np.zeros(1, np.int8)])
        edge = np.flatnonzero(kind[1:] != kind[:-1])
        start, end = edge[:-1], edge[1:]
        inside = kind[start + 1] > 0
        start, end = start[inside], end[inside]
        power, inverse = _powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        value = (total[end] - total[start]) * inverse[start] if len(start) else np.zeros(0, np.uint64)
        first = np.cumsum([0, *(len(h) + 1 for h in held)])[:-1]
        yield np.array(owner, np.int64)[np.searchsorted(first, start, "right") - 1], mix(value + (end - start).astype(np.uint64))


def whole(texts: list[bytes], classes: np.ndarray, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Like ``runs``, but no text spans two yields: (indices of texts, run counts, hashes)."""
    batch: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        batch.append(text)
        size += len(text)
        if size >= PIECE or i + 1 == len(texts):
            got = list(runs(batch, classes, lower))
            at = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in got)])
            yield np.arange(first, i + 1), np.bincount(at, minlength=len(batch)), np.concatenate([np.zeros(0, np.uint64), *(h for _, h in got)])
            batch, first, size = [], i + 1, 0
