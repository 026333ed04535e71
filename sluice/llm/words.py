"""Words and word hashes of many UTF-8 texts at once, in numpy.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Its hash is 128 bits wide, in two
lanes of 64 with keys of their own: the word's length and then its 8-byte blocks go one by one through
a bijective finalizer (words of more than LONG bytes: keyed BLAKE2b). The hash of several words is made
the same way from theirs, by halves. None of it is a polynomial, so words that follow a pattern are as
unlikely to collide as others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of more bytes are hashed one at a time by a library.
LONG = 256
#: Keys of the two lanes.
_KEYS = (np.uint64(0x8C3F9A5D17E2B46B), np.uint64(0x51D7C0E94B8A3F25))
_KEY = b"word hashes"


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finalizer (the splitmix64 constants)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The hash of two hashes in their order; a bijection in either of them."""
    return mixed(a ^ mixed(b, salt), salt + 1)


@dataclass
class Words:
    """start, end: byte places of each word; doc: its text's index; first: the first word of each text, n + 1 long; hash: a lane, or both."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    other: np.ndarray | None = None


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int) -> list[np.ndarray]:
    """A uint64 array for each lane: the hashes of raw[start:end]."""
    size = (end - start).astype(np.int64)
    out = [mixed(size.astype(np.uint64) ^ key, 1) for key in _KEYS[:lanes]]
    if not len(size):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    # Eight bytes from any place, as values without an alignment.
    eights = np.ndarray((len(raw) + 1,), "V8", padded, 0, (1,))
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        block = eights[start[live] + at].view("<u8")
        rest = size[live] - at
        short = rest < 8
        if short.any():
            keep = (np.uint64(1) << (np.minimum(rest, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            block = np.where(short, block & keep, block)
        for lane, h in enumerate(out):
            h[live] = mixed(h[live] ^ (block if lane == 0 else mixed(block, 5)), 2)
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=16, key=_KEY).digest()
        for lane, h in enumerate(out):
            h[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out


def words_of(offsets: np.ndarray, raw: np.ndarray, lower: bool = False, lanes: int = 1) -> Words:
    """The words of texts laid end to end; no word crosses from one text to the next."""
    n = len(raw)
    if lower:
        raw = _LOWER[raw]
    edge = np.zeros(n + 1, np.int8)
    word = ~SPACE[raw]
    edge[:n] = word
    step = np.diff(edge, prepend=np.int8(0))
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[word[cut] & word[cut - 1]] if len(cut) else cut
    start = np.flatnonzero(step == 1)
    end = np.flatnonzero(step == -1)
    if len(cut):
        cut = np.unique(cut)
        start = np.sort(np.concatenate([start, cut]))
        end = np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, offsets, "left")
    first[-1] = len(start)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, doc, first, *word_hashes(raw, start, end, lanes))


def window_hashes(h: np.ndarray, k: int, salt: int = 2) -> np.ndarray:
    """The hash of each k consecutive values, len(h) - k + 1 of them (none if fewer)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    size, now = 1, mixed(h, 16 * salt)
    while 2 * size <= k:
        now = joined(now[:-size], now[size:], 16 * salt + size.bit_length())
        size *= 2
    rest = k - size  # windows of `size`, two of which cover k
    return joined(now[: n - k + 1], now[rest : rest + n - k + 1], 16 * salt + 15)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 3) -> np.ndarray:
    """The hash of h[start:end] for each pair of a few values."""
    size = end - start
    out = mixed(size.astype(np.uint64), 16 * salt)
    for k in range(int(size.max()) if len(size) else 0):
        live = np.flatnonzero(size > k)
        out[live] = joined(out[live], h[start[live] + k], 16 * salt + 1)
    return out


def set_hashes(values: np.ndarray, ends: np.ndarray, salt: int = 7) -> np.ndarray:
    """For each run values[ends[i]:ends[i + 1]] of distinct values a hash that doesn't depend on their order; empty runs have that of their size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values, 16 * salt), dtype=np.uint64)])
    return joined(total[ends[1:]] - total[ends[:-1]], np.diff(ends).astype(np.uint64), 16 * salt + 1)
