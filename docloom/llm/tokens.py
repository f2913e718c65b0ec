"""Array kernels over the words of a batch of texts.

A *word* is a maximal run of Unicode letters or digits, lower-cased.  All
functions work on a whole Arrow batch at once: the texts are laid out as one
array of code points and every step is a numpy pass over that array, so the
cost is a few nanoseconds a character and no Python object exists per word.

Nulls count as the empty text.  Hashes are 64-bit and the same in every process
(they do not use ``hash()``).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_LIMIT = 0x110000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alnum flag, simple lower-case and letter flag of every code point."""
    alnum = np.zeros(_LIMIT, bool)
    alpha = np.zeros(_LIMIT, bool)
    lower = np.arange(_LIMIT, dtype=np.uint32)
    for c in range(_LIMIT):
        s = chr(c)
        if s.isalnum():
            alnum[c] = True
            alpha[c] = s.isalpha()
            low = s.lower()
            if low != s:
                lower[c] = ord(low[0])
    return alnum, lower, alpha


@lru_cache(maxsize=1)
def _mixed_lower() -> np.ndarray:
    return mix64(_tables()[1].astype(np.uint64) + np.uint64(0x51ED270B))


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        np.cumprod(np.full(n - 1, _BASE, np.uint64), out=out[1:])
    return out


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, from a table of the next power of two."""
    return _powers_table(n)[:n]


def _powers_table(n: int) -> np.ndarray:
    return _powers(max(64, 1 << int(max(1, n) - 1).bit_length()))


def layout(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one line feed after each, and the n + 1 offsets."""
    texts = [t or "" for t in texts]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    flat = ("\n".join(texts) + "\n") if texts else ""
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32), offsets


class Words:
    """Words of a batch: ``hash``, ``doc`` (row in the batch), ``start``, ``end`` (offsets in that row's text)."""

    def __init__(self, texts: list[str | None]):
        cps, offsets = layout(texts)
        alnum = _tables()[0][cps]
        edge = np.diff(alnum.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n_docs = len(offsets) - 1
        self.doc = (np.searchsorted(offsets, start, "right") - 1).astype(np.int64)
        self.hash = run_hash(cps, start, end)
        self.start, self.end = start - offsets[self.doc], end - offsets[self.doc]
        self.counts = np.bincount(self.doc, minlength=self.n_docs)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of each run of ``width`` words inside one row, in order."""
        h, d = self.hash, self.doc
        m = len(h) - width + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        out = np.zeros(m, np.uint64)
        for k in range(width):
            out += h[k : k + m] * powers(width + 2)[k + 2]
        ok = d[:m] == d[width - 1 :]
        return d[:m][ok], mix64(out[ok])


@lru_cache(maxsize=4)
def _inverse_powers(n: int) -> np.ndarray:
    """Powers of the base's inverse modulo 2**64 (the base is odd)."""
    out = np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


#: Code points that one power table spans; longer batches are hashed in windows.
WINDOW = 1 << 19


def run_hash(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lower-cased code points of each run [start, end): the sum of c[i] * base**i, from one running sum."""
    out = np.empty(len(start), np.uint64)
    lower, at = _mixed_lower(), 0
    while at < len(start):
        base = start[at]
        stop = max(at + 1, int(np.searchsorted(end, base + WINDOW, "right")))
        s, e = start[at:stop] - base, end[at:stop] - base
        size = int(e[-1])
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(lower[cps[base : base + size]] * powers(size), out=total[1:])
        inverse = _inverse_powers(len(_powers_table(size)))
        out[at:stop] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def by_row(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by row (below 2**16), then hash: one sort of a packed key, and the full one only where packed keys collide."""
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    order = np.argsort(key)
    key, full = key[order], h[order]
    return np.lexsort((h, doc)) if ((key[1:] == key[:-1]) & (full[1:] != full[:-1])).any() else order


def together(*cols: np.ndarray) -> np.ndarray:
    """An order in which rows with equal values in all columns are neighbours."""
    key = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        key = mix64(key * np.uint64(31) + c.astype(np.uint64))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    for c in cols:
        c = c[order]
        if (same & (c[1:] != c[:-1])).any():
            return np.lexsort(cols)
    return order


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The stable order by a small number."""
    return np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, hash) pairs in order of doc, then hash."""
    order = by_row(doc, h)
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]
