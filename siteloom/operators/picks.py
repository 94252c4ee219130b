"""Reproducible picks by md5, many at a time: what ``inference.pick`` gives, worked out on arrays of messages."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Messages worked on together; a few arrays of so many words stay in a core's cache.
BLOCK = 32_768
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [*range(16)] + [(5 * i + 1) % 16 for i in range(16)] + [(3 * i + 5) % 16 for i in range(16)] + [7 * i % 16 for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _decades(low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(digits, from, to) of the numbers from low up to but without high, by their number of digits."""
    digits = len(str(low))
    while low < high:
        end = min(high, 10**digits)
        yield digits, low, end
        low, digits = end, digits + 1


def _words(numbers: np.ndarray, digits: int, at: int, prefix: bytes, suffix: bytes) -> np.ndarray:
    """Little-endian words (word, number) of messages that hold prefix, number and suffix from byte ``at`` on, and zeros elsewhere."""
    size = at + len(prefix) + digits + len(suffix)
    text = np.zeros((len(numbers), -(-size // 4) * 4), np.uint8)
    text[:, at : at + len(prefix)] = np.frombuffer(prefix, np.uint8)
    at += len(prefix)
    for i in range(digits):
        text[:, at + i] = numbers // 10 ** (digits - 1 - i) % 10 + 48
    text[:, at + digits : size] = np.frombuffer(suffix, np.uint8)
    return np.ascontiguousarray(text.view("<u4").T)


def _first_words(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first word of md5 over one block: words are numbers, or arrays of n.

    The last three steps don't bear on the first word. Steps before the first array are done on numbers.
    """
    a, b, c, d = _START
    first = next(i for i, w in enumerate(words) if not isinstance(w, int))
    for i in range(first):
        f = d ^ (b & (c ^ d))
        t, s = (a + f + _K[i] + words[i]) & 0xFFFFFFFF, _TURN[0][i % 4]
        a, d, c, b = d, c, b, (b + (t << s | t >> (32 - s))) & 0xFFFFFFFF
    a, b, c, d = (np.full(n, v, np.uint32) for v in (a, b, c, d))
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(first, 61):
        kind, w = i // 16, words[_WORD[i]]
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(w, int):
            np.add(f, np.uint32((w + _K[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(_K[i]), out=f)
            np.add(f, w, out=f)
        s = _TURN[kind][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=g)
        np.left_shift(f, np.uint32(s), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    # what is newest after step 61 is the first of the four after step 64
    return b + np.uint32(_START[0])


def digests(key: bytes, draws: tuple[int, int], slots: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """The first 32 bits of md5 of 'key-draw-slot' over ranges of both, in parts (first draw, first slot, draws by slots)."""
    long = len(f"-{draws[1]}-{slots[1]}") + len(key) > 55  # more than a block of md5
    for sd, s_low, s_high in _decades(*slots):
        for low in range(s_low, s_high, BLOCK):
            high = min(s_high, low + BLOCK)
            each = max(1, BLOCK // (high - low))
            for dd, d_low, d_high in _decades(*draws):
                for first in range(d_low, d_high, each):
                    last = min(d_high, first + each)
                    yield first, low, _long(key, first, last, low, high) if long else _short(key, dd, first, last, sd, low, high)


def _long(key: bytes, d_low: int, d_high: int, s_low: int, s_high: int) -> np.ndarray:
    every = [hashlib.md5(b"%b-%d-%d" % (key, d, s)).digest()[:4] for d in range(d_low, d_high) for s in range(s_low, s_high)]
    return np.frombuffer(b"".join(every), ">u4").reshape(d_high - d_low, s_high - s_low).astype(np.uint32)


def _short(key: bytes, dd: int, d_low: int, d_high: int, sd: int, s_low: int, s_high: int) -> np.ndarray:
    """Draws of dd digits by slots of sd digits, whose messages are all as long and take one block."""
    size = len(key) + dd + sd + 2
    a = _words(np.arange(d_low, d_high), dd, 0, key + b"-", b"-")
    b = _words(np.arange(s_low, s_high), sd, len(key) + dd + 2, b"", b"\x80")
    n, m = a.shape[1], b.shape[1]
    words: list[np.ndarray | int] = [0] * 16
    for i in range(len(b)):
        if 4 * i + 4 <= len(key) + 1:
            words[i] = int(a[i, 0])
        elif 4 * i >= len(key) + dd + 2:
            words[i] = np.tile(b[i], n)
        elif i == len(a) - 1:
            words[i] = (a[i][:, None] | b[i][None, :]).ravel()
        else:
            words[i] = np.repeat(a[i], m)
    words[14] = 8 * size
    return _first_words(words, n * m).byteswap().reshape(n, m)


def means(key: bytes, draws: tuple[int, int], sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of each draw's picks from units with these sums and sizes: a pick for every unit."""
    u, (low, high) = len(sums), draws
    total, n = np.zeros(high - low), np.zeros(high - low, np.int64)
    alike = len(sizes) > 0 and bool((sizes == sizes[0]).all())
    for first, _, found in digests(key, draws, (0, u)):
        picked = found % np.uint32(u) if u < 2**32 else found
        own = slice(first - low, first - low + len(found))
        total[own] += sums[picked].sum(axis=1)
        n[own] += int(sizes[0]) * found.shape[1] if alike else sizes[picked].sum(axis=1)
    return total / n
