"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash.

Every 23-bit word lies within distance 3 of exactly one codeword. A word at distance 3 from its codeword has five more
codewords at distance 4; a word nearer than that has none. Two words at distance 1 or 2 have a codeword among these in
common, since the nearest codeword of a word between them is within 4 of both.

All functions work on numpy arrays.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

N, K = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _remainder(w: int) -> int:
    for i in range(N - 1, N - K - 1, -1):
        if w >> i & 1:
            w ^= GENERATOR << (i - (N - K))
    return w


def _tables():
    unit = [_remainder(1 << i) for i in range(N)]

    def linear(lo: int, bits: int) -> np.ndarray:
        t = np.zeros(1 << bits, np.int32)
        for i in range(bits):
            t[1 << i : 2 << i] = t[: 1 << i] ^ unit[lo + i]
        return t

    lead = np.zeros(1 << (N - K), np.int32)
    others: dict[int, list[int]] = {}
    for weight in range(5):
        for at in combinations(range(N), weight):
            s = p = 0
            for i in at:
                s ^= unit[i]
                p |= 1 << i
            if weight < 4:
                lead[s] = p
            elif int(lead[s]).bit_count() == 3:
                others.setdefault(s, []).append(p)
    near = np.repeat(lead[:, None], 6, axis=1)
    for s, ps in others.items():
        near[s, 1:] = ps
    return linear(0, 12), linear(12, 11), lead, near


_LOW, _HIGH, _LEAD, _NEAR = _tables()


def syndrome(w: np.ndarray) -> np.ndarray:
    return _LOW[w & 0xFFF] ^ _HIGH[w >> 12]


def nearest(w: np.ndarray) -> np.ndarray:
    """The 12-bit index of the nearest codeword."""
    return (w ^ _LEAD[syndrome(w)]) >> (N - K)


def nearby(w: np.ndarray) -> np.ndarray:
    """(len(w), 6): the nearest codeword's index first, then those at distance 4 (or the nearest again)."""
    return (w[:, None] ^ _NEAR[syndrome(w)]) >> (N - K)


def one_apart_keys(w: np.ndarray) -> np.ndarray:
    """(len(w), 6): indices such that words at distance 0 or 1 have one in common; repeats fill up.

    A word of even weight gives its nearest codeword only. At distance 1 one word is even and the other, odd, gives
    the nearest codewords of all words one bit away, the even one among them.
    """
    k = nearby(w)
    even = np.bitwise_count(w.astype(np.uint32)) % 2 == 0
    k[even, 1:] = k[even, :1]
    return k
