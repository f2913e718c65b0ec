"""Exact set-similarity joins without pairwise comparison: shared machinery.

A text becomes the set of its distinct word shingles.  All sets are ordered by
one global order, rare shingles first, taken from a count sketch that is filled
by every shingle of every row and sized by the input (``sketch_bits``).  Any
global order keeps the prefix filter exact, so the sketch's collisions cost
time, never rows.

The order is what makes templates harmless: a shingle that stands in a third
of all rows sorts last and lies outside the indexed prefix.

For a Jaccard threshold t, sets of n1 and n2 members that qualify share at
least ``need(n1, n2) = ceil(t/(1+t) (n1+n2))`` members.  In the global order
the first ``ell`` shared members then lie at places p with
``n - p >= need - ell + 1`` in both sets; fewer than ``ell`` such matches rule
a pair out (``ell`` is at most ``need``).

Postings travel as column blobs, one row per task and bucket, instead of one
row per posting: that is about 8 bytes a posting in the shuffle.  A bucket is
one reduce task of about ``BUCKET`` postings.  A shingle that stands in more
than ``CELL`` rows is no single key: its members and its askers are cut into
blocks of that size, and each pair of blocks is a cell with a bucket of its own
(a pair of sets meets in exactly one cell of a shingle).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tokens import Words, by_bucket, by_row, distinct, mix64, together
from docloom.session import in_buckets, materialise, n_buckets

#: Bytes in one block of the sketch, and its fewest and most counters (binary logarithms).
BLOCK, LEAST_BITS, MOST_BITS = 1 << 16, 20, 26
#: Postings in one bucket, and rows above which a shingle is cut into cells.
BUCKET, CELL = 1_500_000, 1 << 16
#: Bits by which classes, groups and, within a bucket, shingles travel; what meets by chance is told apart by the exact check.
CLASS_BITS, GROUP_BITS, TOKEN_BITS = 48, 40, 24
#: Rows that one pass of the kernels holds at once, and the most code points.
STEP, STEP_CHARS = 500, 1_000_000
#: Counted pairs that a reduce task holds before it hands them on.
PAIRS = 4_000_000
#: What a posting does in its cell: both, only ask, only be asked.
BOTH, ASK, MEMBER = 0, 1, 2


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of at most STEP rows and about STEP_CHARS code points."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= STEP or size + len(t or "") > STEP_CHARS):
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*Words(texts).shingles(width))


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(df: DataFrame) -> int:
    """About one counter for 64 bytes of the input's files, between 2**20 and 2**26 (64 MB); 2**22 where the size is unknown."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, (size // 64).bit_length())) if size < 1 << 60 else 22


def sketch(df: DataFrame, text: str, width: int) -> tuple[np.ndarray, int]:
    """One byte per counter, about eight times the binary logarithm of its occurrences in all rows; and the number of all shingles.

    Each task counts its rows in saturating bytes and sends the blocks that
    hold something, sparse ones as places and counts; the blocks are added up
    by a group-by, and at most 64 MB reach the driver.
    """
    bits = sketch_bits(df)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size, n = np.zeros(1 << bits, np.uint8), [], 0, 0

        def add() -> None:
            slot, c = np.unique(np.concatenate(held), return_counts=True)
            total[slot] = np.minimum(total[slot] + np.minimum(c, 255), 255).astype(np.uint8)

        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in steps(texts):
                held.append(_slot(Words(texts[s:e]).shingles(width)[1], bits))
                size, n = size + len(held[-1]), n + len(held[-1])
                if size > 2_000_000:
                    add()
                    held, size = [], 0
        if size:
            add()
        block, at, counts = [-1], [b""], [n.to_bytes(8, "little")]
        for i in range(0, 1 << bits, BLOCK):
            part = total[i : i + BLOCK]
            full = np.flatnonzero(part)
            if len(full):
                block.append(i // BLOCK)
                sparse = 3 * len(full) < BLOCK
                at.append(full.astype(np.uint16).tobytes() if sparse else b"")
                counts.append((part[full] if sparse else part).tobytes())
        yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int32()), "at": pa.array(at, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def union(table: pa.Table) -> pa.Table:
        block = table.column("block")[:1].cast(pa.int32())
        if block[0].as_py() < 0:
            ranks = sum(int.from_bytes(x.as_py(), "little") for x in table.column("counts")).to_bytes(8, "little")
        else:
            total = np.zeros(BLOCK, np.float64)
            for at, counts in zip(table.column("at").to_pylist(), table.column("counts").to_pylist(), strict=True):
                if at:
                    total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.uint8)
                else:
                    total += np.frombuffer(counts, np.uint8)
            ranks = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8).tobytes()
        return pa.table({"block": block, "ranks": pa.array([ranks], pa.binary())})

    out, n = np.zeros(1 << bits, np.uint8), 0
    for r in df.select(text).mapInArrow(count, "block int, at binary, counts binary").groupBy("block").applyInArrow(union, "block int, ranks binary").collect():
        if r.block < 0:
            n = int.from_bytes(r.ranks, "little")
        else:
            out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.ranks, np.uint8)
    return out, n


def set_hash(doc: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each row's whole set, from its distinct members in order of the row."""
    n = np.bincount(doc, minlength=rows)
    out, full = np.zeros(rows, np.uint64), np.flatnonzero(n > 0)
    if len(full):
        out[full] = np.add.reduceat(mix64(h + np.uint64(1)), (np.cumsum(n) - n)[full])
    return mix64(out + n.astype(np.uint64))


class Sets:
    """The sets of some rows in the global order: ``doc``, ``token``, ``pos``, and by row ``n``, ``cls`` (hash of the whole set)."""

    def __init__(self, texts: list[str | None], width: int, ranks: np.ndarray):
        doc, h = Words(texts).shingles(width)
        rank = ranks[_slot(h, len(ranks).bit_length() - 1)].astype(np.uint64)
        # (row, rank, hash) in one sortable number: the row's number is below STEP; repeats become neighbours
        key = (doc.astype(np.uint64) << np.uint64(48)) | (rank << np.uint64(40)) | (h >> np.uint64(24))
        order = np.argsort(key)
        twin, same = key[order[1:]] == key[order[:-1]], h[order[1:]] == h[order[:-1]]
        if (twin & ~same).any():  # packed numbers collide
            order = np.lexsort((h, key))
            twin, same = key[order[1:]] == key[order[:-1]], h[order[1:]] == h[order[:-1]]
        order = order[np.concatenate([[True], ~(twin & same)])] if len(order) else order
        doc, h, rank = doc[order], h[order], rank[order]
        self.doc, self.token, self.rank = doc, h, rank
        self.n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)
        self.pos = np.arange(len(doc)) - self.first[self.doc]
        self.cls = set_hash(doc, h, len(texts))

    def bitmap(self, words: int) -> np.ndarray:
        """One row of ``64 * words`` bits per set: a bit stands where some member hashes to it."""
        out = np.zeros((len(self.n), words), np.uint64)
        bit = (self.token & np.uint64(64 * words - 1)).astype(np.int64) if words else None
        at = np.flatnonzero(self.n > 0)
        for w in range(words):
            value = np.where(bit >> 6 == w, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0))
            if len(at):
                out[at, w] = np.bitwise_or.reduceat(value, self.first[at])
        return out


def need(n1: np.ndarray, n2: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (n1 + n2) - 1e-9).astype(np.int64)


def shortest(n: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * n - 1e-9).astype(np.int64)


def longest(n: np.ndarray, t: float) -> np.ndarray:
    return np.floor(n / t + 1e-9).astype(np.int64)


def _bytes(a: np.ndarray, bits: int = 64) -> bytes:
    """Byte planes, so that the high bytes of small numbers compress to nothing; of numbers below 2**bits only the planes they fill."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize)[:, : bits // 8].T).tobytes()


def _array(b: bytes, kind: type, bits: int = 64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(b, np.uint8).reshape(min(size, bits // 8), -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


def short_class(cls: np.ndarray) -> np.ndarray:
    return cls & np.uint64((1 << CLASS_BITS) - 1)


BLOB = "bucket int, cls binary, grp binary, n binary, flag binary, sig binary, cnt binary, tok binary, pos binary"
DOC = "dcls long, dgrp long, dn long, df int"


def n_parts(shingles: int, t: float, least: int) -> int:
    """Buckets for the prefixes of so many shingles: about BUCKET postings in each, and at least ``least``."""
    return max(1, least, -(-int(shingles * (1 - t)) // BUCKET))


def _cells(tok: np.ndarray, rank: np.ndarray, asks: np.ndarray, member: np.ndarray, ask_key: np.ndarray, member_key: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, token of the cell, role) of every copy of the postings: one for ordinary shingles, one per cell for hot ones."""
    side = np.maximum(1, np.ceil(2.0 ** (rank / 8.0) / cell)).astype(np.int64)
    role = np.where(asks & member, BOTH, np.where(asks, ASK, MEMBER))
    if (side == 1).all():
        return np.arange(len(tok)), tok, role
    plain, hot = np.flatnonzero(side == 1), np.flatnonzero(side > 1)
    at, token, roles = [plain], [tok[plain]], [role[plain]]
    i = hot[member[hot]]
    copy = np.repeat(i, side[i])
    j = np.arange(len(copy)) - np.repeat(np.cumsum(side[i]) - side[i], side[i])
    own = (member_key[copy] % side[copy].astype(np.uint64)).astype(np.int64)
    at.append(copy), token.append(mix64(tok[copy] + (own * side[copy] + j).astype(np.uint64))), roles.append(np.full(len(copy), MEMBER))
    i = hot[asks[hot]]
    copy = np.repeat(i, side[i])
    j = np.arange(len(copy)) - np.repeat(np.cumsum(side[i]) - side[i], side[i])
    own = (ask_key[copy] % side[copy].astype(np.uint64)).astype(np.int64)
    at.append(copy), token.append(mix64(tok[copy] + (j * side[copy] + own).astype(np.uint64))), roles.append(np.full(len(copy), ASK))
    return np.concatenate(at), np.concatenate(token), np.concatenate(roles)


def postings(width: int, t: float, ell: int, ranks, buckets: int, group: Callable, sides: Callable, name: Callable, words: int, cell: int, flush: int = 2_000_000) -> Callable:
    """For mapInArrow over (k, text, flag): a row for each record with a set, and the prefix postings of each distinct (set, flag) as blobs by bucket of the cell.

    ``group(sets)`` gives a 64-bit group for each row; ``flag`` is a small
    integer below 64 carried along (0 where unused); ``sides(flag)`` tells which
    rows ask and which are asked; ``name(cls, flag)`` is the class a record
    belongs to; ``words`` is the size of a bitmap of each set, which bounds
    overlaps of small sets.
    """
    names = [c.split()[0] for c in BLOB.split(", ")]

    def out(parts: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        cls, grp, n, flag, sig = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 8))
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])[:-1]])
        doc = np.concatenate([p[4] + b for p, b in zip(parts, base, strict=True)])
        tok, pos, rank = (np.concatenate([p[i] for p in parts]) for i in (5, 6, 7))
        # copies of a set count once
        _, keep = np.unique(cls + mix64(flag.astype(np.uint64) + np.uint64(7)), return_index=True)
        once = np.zeros(len(cls), bool)
        once[keep] = True
        ok = once[doc]
        doc, tok, pos, rank = doc[ok], tok[ok], pos[ok], rank[ok]
        short = short_class(name(cls, flag))
        asks, member = sides(flag)
        at, tok, role = _cells(tok, rank, asks[doc], member[doc], mix64(cls + np.uint64(1))[doc], mix64(np.where(grp == 0, cls, grp) + np.uint64(2))[doc], cell)
        doc, pos = doc[at] * 4 + role, pos[at]
        bucket = ((tok >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        if len(at) and (np.diff(doc) < 0).any():
            order = np.argsort(doc, kind="stable")
            order = order[by_bucket(bucket[order])]
        else:
            order = by_bucket(bucket)
        doc, tok, pos, bucket = doc[order], tok[order], pos[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows: dict[str, list] = {k: [] for k in names}
        for k in range(buckets):
            s, e = edges[k], edges[k + 1]
            if s == e:
                continue
            docs, cnt = np.unique(doc[s:e], return_counts=True)
            d, what = docs >> 2, (docs & 3) << 6
            for key, v in (("bucket", k), ("cls", _bytes(short[d], CLASS_BITS)), ("grp", _bytes(grp[d], GROUP_BITS)), ("n", _bytes(n[d].astype(np.uint32))), ("flag", (flag[d] | what).astype(np.uint8).tobytes()), ("sig", sig[d].tobytes()), ("cnt", _bytes(cnt.astype(np.uint32))), ("tok", _bytes(tok[s:e].astype(np.uint32), TOKEN_BITS)), ("pos", _bytes(pos[s:e].astype(np.uint32)))):
                rows[key].append(v)
        if rows["bucket"]:
            m = len(rows["bucket"])
            cols = [pa.array(rows[k], pa.int32() if k == "bucket" else pa.binary()) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, kind), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.int32())], [*names, "k", "dcls", "dgrp", "dn", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, turn, kind = [], 0, 0, None
        for b in batches:
            kind = b.column(0).type
            texts, flags = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, e in steps(texts):
                x = Sets(texts[s:e], width, ranks.value)
                # the prefix for the longest partner to come, and ell - 1 more
                ok = x.n[x.doc] - x.pos >= shortest(x.n[x.doc], t) - ell + 1
                grp = group(x)
                parts.append((x.cls, grp, x.n, flags[s:e], x.doc[ok], x.token[ok], x.pos[ok], x.rank[ok], x.bitmap(words)))
                held += int(ok.sum())
                full = np.flatnonzero(x.n > 0)
                m = len(full)
                cols = [pa.array(((full + turn) % buckets).astype(np.int32)), *[pa.nulls(m, pa.binary())] * (len(names) - 1), b.column(0).slice(s, e - s).take(pa.array(full))]
                cols += [pa.array(name(x.cls, flags[s:e])[full].view(np.int64)), pa.array(grp[full].view(np.int64)), pa.array(x.n[full]), pa.array(flags[s:e][full].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [*names, "k", "dcls", "dgrp", "dn", "df"])
                turn += e - s
            if held > flush:
                yield from out(parts, kind)
                parts, held = [], 0
        if parts:
            yield from out(parts, kind)

    return run


PAIR = "bucket int, a binary, cnt binary, b binary, m binary"


def reduce_cells(probe: Callable) -> Callable:
    """For mapInArrow over one bucket: the rows of records as they are, and blobs of the counted pairs that ``probe`` makes of the postings."""
    names = [c.split()[0] for c in PAIR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, kind = [], None
        for b in batches:
            kind = b.column("k").type
            doc = b.column("cls").is_null()
            d = b.filter(doc)
            if d.num_rows:
                yield pa.RecordBatch.from_arrays([*(d.column(c) for c in ("k", "dcls", "dgrp", "dn", "df")), pa.nulls(d.num_rows, pa.int32()), *[pa.nulls(d.num_rows, pa.binary())] * 4], ["k", "cls", "grp", "n", "f", *names])
            p = b.filter(pa.compute.invert(doc))
            if p.num_rows:
                blobs.append(p.select([c.split()[0] for c in BLOB.split(", ")]))
        if not blobs:
            return
        for t in probe(pa.Table.from_batches(blobs)):
            for p in t.to_batches():
                m = p.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.int32()), *p.columns], ["k", "cls", "grp", "n", "f", *names])

    return run


def candidates(rows: DataFrame, width: int, t: float, ell: int, group: Callable, sides: Callable, name: Callable, probe: Callable, words: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(records, pairs) of rows (k, t, f): records (k, cls, short, grp, n, f), and (a, b) with at least ``ell`` counted matches, both by the short class or group.

    One scan fills the sketch, a second describes the records and makes the
    postings; both kinds of rows take one shuffle.
    """
    spark = rows.sparkSession
    counts, shingles = sketch(rows, "t", width)
    ranks = spark.sparkContext.broadcast(counts)
    buckets = n_parts(shingles, t, n_buckets(rows))
    key = dict(rows.dtypes)["k"]
    sent = rows.mapInArrow(postings(width, t, ell, ranks, buckets, group, sides, name, words, cell), f"{BLOB}, k {key}, {DOC}")
    met = materialise(in_buckets(sent, buckets, reduce_cells(probe(buckets)), f"k {key}, cls long, grp long, n long, f int, {PAIR}"), "set-join")
    records = met.filter("bucket is null").select("k", "cls", F.col("cls").bitwiseAND((1 << CLASS_BITS) - 1).alias("short"), "grp", "n", "f")
    pairs = in_buckets(met.filter("bucket is not null").select("bucket", "a", "cnt", "b", "m"), buckets, add_pairs(ell), "a long, b long")
    return records, pairs


def read_blobs(table: pa.Table, words: int = 0) -> dict[str, np.ndarray]:
    """The postings of a bucket, one element per posting, without copies of the same (set, flag, token); tokens of one set alone are left out."""
    cols = {k: [] for k in ("cls", "grp", "n", "flag", "tok", "pos", *["sig"] * bool(words))}
    for r in table.to_pylist():
        cnt = _array(r["cnt"], np.uint32)
        for k, kind, bits in (("cls", np.uint64, CLASS_BITS), ("grp", np.uint64, GROUP_BITS), ("n", np.uint32, 64), ("flag", np.uint8, 64)):
            cols[k].append(np.repeat(_array(r[k], kind, bits), cnt))
        if words:
            cols["sig"].append(np.repeat(np.frombuffer(r["sig"], np.uint64).reshape(-1, words), cnt, axis=0))
        cols["tok"].append(_array(r["tok"], np.uint32, TOKEN_BITS))
        cols["pos"].append(_array(r["pos"], np.uint32))
    x = {k: np.concatenate(v) for k, v in cols.items()}
    order = np.argsort(x["tok"])
    tok = x["tok"][order]
    twin = np.zeros(len(tok), bool)
    twin[1:] = tok[1:] == tok[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    x = {k: v[order] for k, v in x.items()}
    # copies are neighbours; should packed keys collide, one counts twice, which opens a pair more
    order = np.argsort((x["tok"].astype(np.uint64) << np.uint64(32)) | (mix64(x["cls"] + x["flag"]) >> np.uint64(32)))
    x = {k: v[order] for k, v in x.items()}
    keep = np.ones(len(order), bool)
    keep[1:] = (x["tok"][1:] != x["tok"][:-1]) | (x["cls"][1:] != x["cls"][:-1]) | (x["flag"][1:] != x["flag"][:-1])
    x = {k: v[keep] for k, v in x.items()}
    x["n"], x["pos"] = x["n"].astype(np.int64), x["pos"].astype(np.int64)
    x["role"], x["flag"] = x["flag"] >> 6, x["flag"] & 63
    return x


def expand(lo: np.ndarray, hi: np.ndarray, most: int = 131_072) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with lo[i] <= j < hi[i], in pieces of about ``most``."""
    size = np.maximum(hi - lo, 0)
    total = np.cumsum(size)
    s = 0
    while s < len(size):
        e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + most, "right")))
        part = size[s:e]
        i = np.repeat(np.arange(s, e), part)
        j = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + lo[i]
        yield i, j
        s = e


class Counted:
    """Counted pairs of a bucket, summed up now and then, handed on in tables of at most about PAIRS pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray, buckets: int):
        self.a, self.b, self.buckets = a, b, buckets
        self.held, self.size = [], 0

    def add(self, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> Iterator[pa.Table]:
        self.held.append(np.stack([i * len(self.b) + j, weight]))
        self.size += len(i)
        if self.size > PAIRS:
            self._sum()
            if self.size > PAIRS // 2:
                yield from self.rest()

    def _sum(self) -> None:
        pair, weight = np.concatenate(self.held, axis=1)
        order = np.argsort(pair)
        pair, weight = pair[order], weight[order]
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        self.held, self.size = [np.stack([pair[at], np.add.reduceat(weight, at)])], len(at)

    def rest(self) -> Iterator[pa.Table]:
        if self.size:
            self._sum()
            pair, weight = self.held[0]
            yield pair_blobs(self.a[pair // len(self.b)], self.b[pair % len(self.b)], weight, self.buckets)
        self.held, self.size = [], 0


def pair_blobs(a: np.ndarray, b: np.ndarray, m: np.ndarray, buckets: int) -> pa.Table:
    """Counted pairs as blobs by bucket of ``a``."""
    bucket = (mix64(a) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(a)
    order = order[by_bucket(bucket[order])]
    a, b, m, bucket = a[order], b[order], m[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: dict[str, list] = {k: [] for k in ("bucket", "a", "cnt", "b", "m")}
    for k in range(buckets):
        s, e = edges[k], edges[k + 1]
        if s == e:
            continue
        keys, cnt = np.unique(a[s:e], return_counts=True)
        for key, v in (("bucket", k), ("a", _bytes(keys, CLASS_BITS)), ("cnt", _bytes(cnt.astype(np.uint32))), ("b", _bytes(b[s:e], CLASS_BITS)), ("m", np.minimum(m[s:e], 255).astype(np.uint8).tobytes())):
            rows[key].append(v)
    return pa.table({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})


def add_pairs(ell: int) -> Callable:
    """For mapInArrow over one bucket: pairs whose counts add up to ``ell``, as rows (a long, b long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, m = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
        for batch in batches:
            for r in batch.to_pylist():
                a.append(np.repeat(_array(r["a"], np.uint64, CLASS_BITS), _array(r["cnt"], np.uint32)))
                b.append(_array(r["b"], np.uint64, CLASS_BITS))
                m.append(np.frombuffer(r["m"], np.uint8))
        a, b, m = np.concatenate(a), np.concatenate(b), np.concatenate(m).astype(np.int64)
        if not len(a):
            return
        order = together(a, b)
        a, b, m = a[order], b[order], m[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        ok = np.add.reduceat(m, at) >= ell
        yield pa.RecordBatch.from_arrays([pa.array(a[at][ok].view(np.int64)), pa.array(b[at][ok].view(np.int64))], ["a", "b"])

    return run


#: The most bits of a Bloom filter (64 MB); its two bits for each key among 16 let one in about 70 others through.
MOST_BLOOM, BLOOM_BLOCK = 1 << 29, 1 << 20


def bloom(df: DataFrame, key: str, bits_per_key: int = 16) -> tuple[np.ndarray, int] | None:
    """A Bloom filter of the long column ``key``, with ``bits_per_key`` bits a key; none where that is over MOST_BLOOM bits.

    A filter before a join, never in its place: without one the join alone
    drops what is not wanted, and moves each row once.
    """
    n = df.count()
    bits = 1 << max(13, int(n * bits_per_key - 1).bit_length())
    if bits > MOST_BLOOM:
        return None
    block = min(bits, BLOOM_BLOCK)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.sort(np.concatenate(_bits(b.column(0).to_numpy(zero_copy_only=False), bits)))
            if len(at):
                number = at // block
                cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                parts = np.split((at % block).astype(np.uint32), cut[1:])
                yield pa.RecordBatch.from_pydict({"at": pa.array(number[cut].astype(np.int32)), "part": pa.array([x.tobytes() for x in parts], pa.binary())})

    def union(table: pa.Table) -> pa.Table:
        have = np.zeros(block, bool)
        for x in table.column("part"):
            have[np.frombuffer(x.as_py(), np.uint32)] = True
        return pa.table({"at": table.column("at")[:1].cast(pa.int32()), "part": pa.array([np.packbits(have).tobytes()], pa.binary())})

    have = np.zeros(bits // 8, np.uint8)
    for r in df.select(F.col(key).cast("long")).mapInArrow(places, "at int, part binary").groupBy("at").applyInArrow(union, "at int, part binary").collect():
        have[r["at"] * block // 8 : (r["at"] + 1) * block // 8] = np.frombuffer(r.part, np.uint8)
    return have, bits


def _bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys.astype(np.int64).view(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def in_bloom(filter_: tuple[np.ndarray, int] | None, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    if filter_ is not None:
        have, bits = filter_
        for x in _bits(keys, bits):
            ok &= (have[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
    return ok


def overlap(left: list[str | None], right: list[str | None], sets: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row over two lists of texts: the members common to both sets (``sets(texts)`` gives rows and hashes), and the size of each."""
    out = np.zeros((3, len(left)), np.int64)
    both = [len(a or "") + len(b or "") for a, b in zip(left, right, strict=True)]
    start = 0
    while start < len(left):
        end, size = start, 0
        while end < len(left) and end - start < STEP and (end == start or size + both[end] <= STEP_CHARS):
            size += both[end]
            end += 1
        n = end - start
        da, ha = sets(left[start:end])
        db, hb = sets(right[start:end])
        doc, h = np.concatenate([da, db]), np.concatenate([ha, hb])
        order = by_row(doc, h)
        doc, h = doc[order], h[order]
        twin = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
        out[:, start:end] = np.bincount(doc[1:][twin], minlength=n), np.bincount(da, minlength=n), np.bincount(db, minlength=n)
        start = end
    return out[0], out[1], out[2]


def jaccard(left: list[str | None], right: list[str | None], sets: Callable) -> np.ndarray:
    """Exact Jaccard similarity, row by row; 0 where both sets are empty."""
    common, a, b = overlap(left, right, sets)
    return common / np.maximum(a + b - common, 1)


def _texts_of(filter_, width: int, name: Callable) -> Callable:
    """For mapInArrow over (k, t, f, h): the class and text of each record whose key may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bloom(filter_.value, b.column(3).to_numpy(zero_copy_only=False))))
            texts, flags = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, e in steps(texts):
                cls = name(set_hash(*shingle_sets(texts[s:e], width), e - s), flags[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), b.column(1).slice(s, e - s)], ["cls", "t"])

    return run


def _similar(width: int, t: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = jaccard(b.column(2).to_pylist(), b.column(3).to_pylist(), lambda texts: shingle_sets(texts, width))
            ok = sim >= t - 1e-12
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(sim[ok])], ["ca", "cb", "similarity"])

    return run


def verify(pairs: DataFrame, rows: DataFrame, width: int, t: float, name: Callable) -> DataFrame:
    """The pairs (ca, cb, ra, rb) of classes whose sets reach the threshold, as (ca, cb, similarity).

    rows (k, t, f) holds the texts; ra and rb are keys of one record of either
    class.  Only texts whose key a pair names leave the scan.  They meet the
    pairs by their class, so a key that repeats with other texts stands for
    each of them, and of one class any text will do.
    """
    spark = rows.sparkSession
    wanted = pairs.select(F.explode(F.array("ra", "rb")).alias("k")).distinct().select(F.xxhash64("k").alias("h"))
    filter_ = spark.sparkContext.broadcast(bloom(wanted, "h"))
    texts = rows.select("k", "t", "f", F.xxhash64("k").alias("h")).mapInArrow(_texts_of(filter_, width, name), "cls long, t string").dropDuplicates(["cls"])
    return (
        pairs.join(texts.select(F.col("cls").alias("ca"), F.col("t").alias("ta")), "ca")
        .join(texts.select(F.col("cls").alias("cb"), F.col("t").alias("tb")), "cb")
        .select("ca", "cb", "ta", "tb")
        .mapInArrow(_similar(width, t), "ca long, cb long, similarity double")
    )
