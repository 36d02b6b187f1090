"""Words and word hashes of Arrow text columns, as numpy arrays over whole batches.

A word is a maximal run of bytes other than space and 0x09-0x0D, which on UTF-8 is the same as
a match of ``[^\\x20\\x09-\\x0D]+``. All functions take every word of every text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Spans over this many bytes are hashed one by one.
LONG = 1024
BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * K2
    x = (x ^ (x >> np.uint64(27))) * K3
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array | pa.ChunkedArray, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of at most ``most`` bytes in all
    (a longer text comes alone). A null text has no bytes."""
    at = 0
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.cast(pa.large_binary()).fill_null(b"")
        if not len(part):
            continue
        _, where, data = part.buffers()
        ends = np.frombuffer(where, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
            yield at + i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            i = j
        at += len(part)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end: first byte, byte after the last, and for each text
    (and one more) the number of words before it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    begin, final = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    final[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = word[inner]
    final[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(final) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time, for all spans that still have some."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * K1 + K2)
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    huge = np.flatnonzero(size > LONG)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(live):
        x = eights[starts[live] + at] & KEEP[np.minimum(size[live] - at, 8)]
        out[live] = mix((out[live] ^ x) * K1 + K3)
        at += 8
        live = live[size[live] > at]
    for i in huge:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text (and one more) the number of words before it."""
    starts, ends, first = spans(data, offsets)
    return hash_spans(LOWER[data] if lower else data, starts, ends), first


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    full = [np.full(n, b, dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64))]
    for x in full:
        x[:1] = 1
    return np.cumprod(full[0]), np.cumprod(full[1])


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all runs of ``width`` words that lie in one text, and the first word of each.

    With prefix sums S of hash * BASE**i modulo 2**64, a window's hash is (S[i + width] - S[i]) / BASE**i.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(1 << max(16, int(n).bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    at = np.flatnonzero(room >= width)
    return mix((total[at + width] - total[at]) * down[at]), at


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``width`` words that begins at one of ``at``."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]
