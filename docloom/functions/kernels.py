"""Array kernels over the white-space terms of a batch of texts.

A *term* is a maximal run of characters that are no white space, case kept.  A
batch is laid out as one array of code points and every step is a numpy pass
over it, so no Python object exists per term.  Nulls count as the empty text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Code points that one table of powers spans; longer batches are hashed in windows.
WINDOW = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _white() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x3100):
        out[c] = chr(c).isspace()
    return out


@lru_cache(maxsize=1)
def _mixed() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(0x51ED270B))


@lru_cache(maxsize=8)
def _table(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every term in order, and the number of terms of each row."""
    texts = [t or "" for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]).astype(np.int64)
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32) if texts else np.empty(0, np.uint32)
    edge = np.diff((~_white()[cps]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(offsets, start, "right") - 1
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(end, base + WINDOW, "right")))
        s, e = start[at:stop] - base, end[at:stop] - base
        size = int(e[-1])
        n = max(64, 1 << (size - 1).bit_length())
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed()[cps[base : base + size]] * _table(n, False)[:size])])
        out[at:stop] = mix((total[e] - total[s]) * _table(n, True)[s] + (e - s).astype(np.uint64))
        at = stop
    return row, out, np.bincount(row, minlength=len(texts))


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, by row, and how often each stands."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.empty(0, np.int64)
    return row[at], h[at], np.diff(np.append(at, len(row)))
