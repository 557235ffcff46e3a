"""Vectorised kernels over the UTF-8 bytes of many documents at once.

A batch of texts is joined by a separator byte into one ``uint8`` array. Word
limits come from a table of 256 classes; word hashes from differences of a
polynomial prefix sum modulo 2**64, so nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Multiplier of the byte polynomial and its inverse modulo 2**64 (odd, 5 mod 8).
_R = 0x9E3779B97F4A7C15 | 1
_R = _R - (_R % 8) + 5
_RINV = pow(_R, -1, 1 << 64)
#: The same for polynomials over words.
_Q = 0xC2B2AE3D27D4EB4F
_Q = _Q - (_Q % 8) + 5
_QINV = pow(_Q, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: One random value for each lower-cased byte.
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]

#: Words split by ASCII white space, and runs of ASCII letters, digits and non-ASCII bytes.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        out = np.empty(size, U64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = U64(pow(base, filled, 1 << 64))
            take = min(filled, size - filled)
            out[filled : filled + take] = out[:take] * step
            filled += take
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def batches(texts: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of one longer text."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > most:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of a batch of texts: byte limits, 64-bit hashes, and the text each belongs to."""

    def __init__(self, texts: list[bytes], table: np.ndarray, sep: bytes = b" "):
        self.raw = sep.join(texts)
        self.buf = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        inside = np.empty(len(self.buf) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = table[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        #: words of text i are first[i]:first[i+1]
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start)).astype(np.int64)
        self.n = np.diff(self.first)
        self.texts = len(texts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, letters A-Z lower-cased; needs no loop over words."""
        if not len(self.start):
            return np.zeros(0, U64)
        total = np.empty(len(self.buf) + 1, U64)
        total[0] = 0
        np.cumsum(_VALUES[self.buf] * powers(_R, len(self.buf)), out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(_RINV, len(self.buf))[self.start]
        return mix(h ^ ((self.end - self.start).astype(U64) * U64(0x632BE59BD9B4E019)))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.n)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].lower()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; callers leave out those that cross texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.empty(len(h) + 1, U64)
    total[0] = 0
    np.cumsum(h * powers(_Q, len(h)), out=total[1:])
    return mix((total[k:] - total[:n]) * powers(_QINV, len(h))[:n])


def gram_starts(first: np.ndarray, n: np.ndarray, k: int, total: int) -> np.ndarray:
    """True where k consecutive words from this one lie in one text."""
    ok = np.zeros(max(total - k + 1, 0), bool)
    if not len(ok):
        return ok
    edge = np.zeros(total + 1, np.int32)
    has = n >= k
    np.add.at(edge, first[:-1][has], 1)
    np.add.at(edge, first[:-1][has] + n[has] - k + 1, -1)
    return np.cumsum(edge)[: len(ok)] > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    if have < w and len(out):
        rest = w - have
        out = np.minimum(out[: len(out) - rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def utf8(column) -> list[bytes]:
    """The bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
