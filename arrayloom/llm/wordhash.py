"""Words, word hashes and shingles of many texts at once, with numpy.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in the lower-cased
text. Its hash is a polynomial over its bytes, taken from prefix sums over the whole buffer.
All arithmetic is modulo 2**64 and the same on every machine.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE))
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
ODD = mix(np.arange(1, 65, dtype=U)) | U(1)


#: Bytes whose powers and sums are held at once.
BLOCK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, BLOCK)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size, b, U)])) for b in (BASE, INVERSE)]
    return _POWERS


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of each text's first word; one more index at the end)."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, back = _powers(hi - lo)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(VALUES[data[lo:hi]] * power[: hi - lo], dtype=U)])
        a, z = starts[i:j] - lo, ends[i:j] - lo
        hashes[i:j] = mix((sums[z] - sums[a]) * back[a] + (z - a).astype(U))
        i = j
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    return hashes, np.searchsorted(starts, at)


def portions(texts: list[str], rows: int = 200, size: int = 1 << 20):
    """(first, last + 1) of neighbouring texts of so many rows and, unless it is one, characters at most."""
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == rows or held + len(t) > size):
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def shingles(texts: list[str], size: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashes of its shingles of so many words, and how often each occurs. Fewer words: one shingle of them all; none: no shingle."""
    hashes, first = words(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), U)
    for j in range(size if n >= size else 0):
        rolled += hashes[j : n - size + 1 + j] * ODD[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1], return_counts=True))
        else:
            short = mix((hashes[a:b] * ODD[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))[: int(b > a)]
            out.append((short, np.ones(len(short), np.int64)))
    return out
