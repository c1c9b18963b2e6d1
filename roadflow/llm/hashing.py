"""Hashes of strings in a byte array.

``Ranks``: strings of a few bytes at every place, by running sums of byte values times powers of an odd base, modulo 2**64.
``hashed_words``: words of any length, by mixes that are not linear.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are looked at together, so that the arrays stay in the processor's cache.
BLOCK = 1 << 16
FIRST, SECOND = 0xA24BAED4963EE407, 0x9FB21C651E98DF25

_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


class Ranks:
    """Ranks of strings in a block of bytes: equal strings have equal ranks, wherever they lie."""

    _tables: dict[int, tuple] = {}

    def __init__(self, data: np.ndarray, base: int = FIRST):
        values, powers, self._back = self._table(base, len(data))
        self._run = np.empty(len(data) + 1, _U)
        self._run[0] = 0
        np.cumsum(values[data] * powers[: len(data)], out=self._run[1:])

    @classmethod
    def _table(cls, base: int, size: int) -> tuple:
        found = cls._tables.get(base)
        if found is None or len(found[1]) < size + 1:
            n = max(size + 1, BLOCK + 256)
            values = spread(spread(np.arange(1, 257, dtype=_U) * _U(base)) + _U(base >> 7))
            up = np.cumprod(np.r_[_U(1), np.full(n - 1, base, _U)], dtype=_U)
            back = np.cumprod(np.r_[_U(1), np.full(n - 1, pow(base, -1, 1 << 64), _U)], dtype=_U)
            found = cls._tables[base] = (values, up, back)
        return found

    def sums(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The strings' sums, their first byte at power 0."""
        return (self._run[end] - self._run[start]) * self._back[start]

    def sum(self, start: int, end: int) -> int:
        return int(self.sums(np.array([start]), np.array([end]))[0])

    def all(self, size: int) -> np.ndarray:
        """The rank of the string of ``size`` bytes at each place."""
        n = max(0, len(self._run) - size)
        return spread((self._run[size:] - self._run[:n]) * self._back[:n])

    def at(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return spread(self.sums(start, start + size) + size.astype(_U))


#: Bytes up to which words are hashed together in arrays; longer ones go to xxHash one by one.
LANES = 4


def word_spans(data: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words: runs without the bytes that ``gap`` marks, of any length."""
    edges, before = [], True
    for a in range(0, len(data), BLOCK):
        blank = gap[data[a : a + BLOCK]]
        if blank[0] != before:
            edges.append(np.array([a]))
        edges.append(np.flatnonzero(blank[1:] != blank[:-1]) + (a + 1))
        before = bool(blank[-1])
    if not before:
        edges.append(np.array([len(data)]))
    turn = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    return turn[::2], turn[1::2]


def _hash_spans(eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One value for each word of at most 8 * LANES bytes: eight bytes at a time go through a mix that is not linear."""
    value = size.astype(_U)
    left = size
    alive = np.arange(len(start))
    for lane in range(LANES):
        at, n = start[alive] + 8 * lane, left[alive]
        part = eight[at]
        short = n < 8
        part[short] &= (_U(1) << (n[short].astype(_U) * _U(8))) - _U(1)
        # a bijection of the eight bytes: words of one lane never collide with each other
        value[alive] = spread((spread(value[alive] * _U(0x9E3779B97F4A7C15)) ^ part) * _U(0xA24BAED4963EE407))
        left = left - 8
        alive = np.flatnonzero(left > 0)
        if not len(alive):
            break
    return value


def hashed_words(data: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where it starts).

    Words of up to 32 bytes are folded eight bytes at a time, longer ones are hashed by XXH3; neither is a sum over bytes, so no
    pattern of letters makes different words equal.
    """
    import xxhash

    start, end = word_spans(data, gap)
    if not len(start):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size = end - start
    out = np.empty(len(start), _U)
    for a in range(0, len(start), BLOCK):
        one = slice(a, a + BLOCK)
        low, high = int(start[a]), int(end[one][-1])
        part = np.zeros(high - low + 8, np.uint8)
        part[: high - low] = data[low:high]
        eight = np.ndarray((high - low + 1,), "<u8", part, 0, (1,))
        few = np.flatnonzero(size[one] <= 8 * LANES)
        out[a + few] = _hash_spans(eight, start[one][few] - low, size[one][few])
        for i in np.flatnonzero(size[one] > 8 * LANES).tolist():
            out[a + i] = xxhash.xxh3_64_intdigest(data[start[a + i] : end[a + i]].data, seed=8)
    return spread(spread(out) * _U(0x9E3779B97F4A7C15)), start
