"""Vectorised word hashes of UTF-8 texts."""

from __future__ import annotations

import hashlib

import numpy as np

HASH_BYTES = 1 << 20
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.full(HASH_BYTES + (1 << 16), _BASE, np.uint64), dtype=np.uint64)
_UNPOWER = np.cumprod(np.full(HASH_BYTES + (1 << 16), pow(_BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)

#: Bytes as they are, with words parted by ASCII white space.
SAME = np.arange(256, dtype=np.uint8)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters lower-cased, with words of digits, letters and non-ASCII characters.
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = True


def tokens(body: bytes, offsets: list[int], fold: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: a 64-bit hash of each word, the start byte of each, and the first word of each text (n + 1).

    fold maps bytes before anything else, letter says which of them make words. No word crosses two texts.
    """
    low = fold[np.frombuffer(body, np.uint8)]
    word = letter[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[np.asarray(offsets, np.int64)] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    hashes = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a > len(_POWER):  # one word of over a megabyte
            hashes[i] = int.from_bytes(hashlib.blake2b(low[a:b].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[low[a:b]] * _POWER[: b - a], dtype=np.uint64)])
            hashes[i:j] = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * _UNPOWER[starts[i:j] - a]
        i = j
    return hashes, starts, np.searchsorted(starts, np.asarray(offsets, np.int64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
