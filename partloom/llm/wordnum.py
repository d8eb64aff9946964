"""Words of many texts as numpy arrays: positions, 64-bit word hashes and n-gram hashes.

Texts are joined with a line feed, which no word pattern used here accepts, so words never run across documents.
Hashes are polynomial sums over the ring of 64-bit integers, finished by a bijective mixer.  They do not depend on
the process, the batch or the platform, so values made by different executors can be compared."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(31))
    x = x * U(0x9FB21C651E98DF25)
    x = x ^ (x >> U(28))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n; base is odd, so it has an inverse."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


#: two independent hash families: values of the bytes and the base of the polynomial
_BYTE = _mix(np.arange(1, 257, dtype=U)), _mix(np.arange(1001, 1257, dtype=U))
_BYTE_BASE, _WORD_BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03), 0xC2B2AE3D27D4EB4F

#: white space words: everything but space and the controls 9 to 13
SPACE = np.ones(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = False
#: lower-cased letters, digits and every non-ASCII byte
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """Words of a list of texts.  ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    def __init__(self, texts: list[bytes], accept: np.ndarray = SPACE):
        self.data = b"\n" + b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.data, np.uint8)
        inside = accept[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate(([1], 1 + np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def last(self) -> np.ndarray:
        """For each word, the index after its text's last word."""
        return np.repeat(self.first[1:], self.counts)

    def hashes(self, family: int = 0) -> np.ndarray:
        """64-bit hash of every word, made in blocks so that one long text needs no more memory than many short."""
        out = np.empty(len(self.start), U)
        w = 0
        while w < len(out):
            to = max(w + 1, int(np.searchsorted(self.end, self.start[w] + BLOCK, side="right")))
            a, b = int(self.start[w]), int(self.end[to - 1])
            n = 1 << max(19, (b - a).bit_length())
            up, down = _powers(_BYTE_BASE[family], n)
            sums = np.zeros(b - a + 1, U)
            np.cumsum(_BYTE[family][self.buf[a:b]] * up[: b - a], out=sums[1:])
            s = self.start[w:to] - a
            out[w:to] = _mix((sums[self.end[w:to] - a] - sums[s]) * down[s])
            w = to
        return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; entry i covers i to i + n - 1, the last n - 1 entries are absent."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U)
    base = U(_WORD_BASE)
    g = h[:m].copy()
    for j in range(1, n):
        g *= base
        g += h[j : j + m]
    return _mix(g + U(n))


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Boolean mask over ``total`` words: inside any run of n words that begins at one of ``starts``."""
    delta = np.zeros(total + n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + n, -1)
    return np.cumsum(delta[:total]) > 0


def member(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, place): which values are in the sorted array ``of``, and where."""
    if not len(of):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values, at
