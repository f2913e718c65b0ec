"""Sets gathered around the commonest sets they are near to, exactly.

Within a group, the *head* of a set is the commonest of all sets with which it
reaches the Jaccard threshold (the greater name on a tie), itself included.  A
cluster is a head with every set near to it, so a set may stand in several.

Candidates come from the prefix filter: of two sets that reach the threshold t,
the first ``k - ceil(t k) + 1`` of the k members of each, in any one order, have
one in common.  The order is rare members first, by a count sketch whose
collisions cost time, never links.  Sets that share such a member are compared
exactly, commonest first, and a set stops at the first it is near to: a
thousand variants of one line cost a thousand comparisons.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import setjoin as sj
from docloom.llm.tokens import mix64
from docloom.session import in_buckets, materialise, n_buckets

#: Counters of the sketch (binary logarithm) and counters in one block of it; prefix members and pairs that a task holds at once.
BITS, BLOCK, POSTINGS, PAIRS = 22, 1 << 16, 200_000, 100_000


def _members(b: pa.RecordBatch, grp: int, sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, member and counter of the members of all sets of a batch."""
    lists = b.column(sets)
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    group = b.column(grp).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return row, value, (mix64(value + mix64(group)[row]) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(sets: DataFrame) -> np.ndarray:
    """How many members fall on each counter; 16 MB reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for b in batches:
            total += np.bincount(_members(b, 0, 1)[2], minlength=len(total)).astype(np.uint32)
        parts = [(i // BLOCK, total[i : i + BLOCK]) for i in range(0, len(total), BLOCK) if total[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array([i for i, _ in parts], pa.int32()), "n": pa.array([x.tobytes() for _, x in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.uint32)
        for x in table.column("n").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(1 << BITS, np.uint32)
    for r in sets.select("grp", "set").mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.n, np.uint32)
    return out


def prefixes(counts, large, t: float, buckets: int, whole_sets: bool = True):
    """For mapInArrow over (grp, id, n, set, k): each set once for each member of its prefix that another set may have, with the bucket of its group, or of the member where the group is ``large``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                b = batch.slice(s, 2000)
                row, value, slot = _members(b, 0, 3)
                order = np.lexsort((value, counts.value[slot], row))
                row, value, slot = row[order], value[order], slot[order]
                size = np.bincount(row, minlength=b.num_rows)
                first = np.cumsum(size) - size
                ok = (np.arange(len(row)) - first[row] <= size[row] - sj.shortest(size[row], t)) & (counts.value[slot] > 1)
                group = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                spread = np.isin(group, large.value)[row[ok]]
                bucket = (mix64(np.where(spread, slot[ok].astype(np.uint64), group.view(np.uint64)[row[ok]])) % np.uint64(buckets)).astype(np.int32)
                row, w = row[ok], value[ok].view(np.int64)
                order = np.lexsort((bucket, row))
                row, bucket, w = row[order], bucket[order], w[order]
                # a set and its name travel once to a bucket, however many of its members are there
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])])[: len(row)]
                sets = [(value[first[i] : first[i] + size[i]].tobytes() if whole_sets else b"") if o else None for i, o in zip(row.tolist(), once.tolist(), strict=True)]
                at, named = pa.array(row), pa.array(row, mask=~once)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0).take(at), pa.array(w), b.column(4).take(at), b.column(1).take(named), b.column(2).take(named), pa.array(sets, pa.binary())], ["bucket", "grp", "w", "k", "id", "n", "set"])

    return run


class _Bucket:
    """The postings of a bucket by (group, member), commonest set first: ``run`` (start of its member's postings), ``of`` (number of its set); a set's number is its rank, the commonest 0."""

    def __init__(self, batches: list[pa.RecordBatch], sets_of: Callable | None):
        x = pa.Table.from_batches(batches)
        grp, w, k = (x.column(c).to_numpy().astype(np.int64) for c in ("grp", "w", "k"))
        sets = x.filter(x.column("set").is_valid())
        name = sets.column("id").combine_chunks().dictionary_encode()
        code = np.empty(len(name.dictionary), np.int64)
        code[pc.sort_indices(name.dictionary).to_numpy()] = np.arange(len(code))
        order = np.lexsort((-code[name.indices.to_numpy()], -sets.column("n").to_numpy().astype(np.int64)))
        self.table = sets.take(pa.array(order))
        own = self.table.column("k").to_numpy().astype(np.int64)
        order = np.argsort(own)
        of = order[np.searchsorted(own[order], k)]
        if sets_of:
            names, members, sizes = self.table.column("id").to_pylist(), [], []
            for s, e in sj.steps(names):
                row, h = sets_of(names[s:e])
                members.append(h)
                sizes.append(np.bincount(row, minlength=e - s))
            self.size = np.concatenate(sizes)
        else:
            members = [np.frombuffer(v, np.uint64) for v in self.table.column("set").to_pylist()]
            self.size = np.array([len(m) for m in members], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.member = np.unique(np.concatenate(members), return_inverse=True)[1].astype(np.int64)
        self.width = int(self.member.max()) + 1
        self.order = np.lexsort((of, w, grp))
        grp, w, self.of = grp[self.order], w[self.order], of[self.order]
        head = np.concatenate([[True], (grp[1:] != grp[:-1]) | (w[1:] != w[:-1])])
        at = np.flatnonzero(head)
        self.run = at[np.cumsum(head) - 1]
        self.end = np.append(at[1:], len(w))[np.cumsum(head) - 1]

    def near(self, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Which pairs of sets reach the threshold."""
        out = sj.shortest(np.maximum(self.size[a], self.size[b]), t) <= np.minimum(self.size[a], self.size[b])
        todo = np.flatnonzero(out)
        cut = np.cumsum(self.size[a[todo]] + self.size[b[todo]])
        s = 0
        while s < len(todo):
            e = max(s + 1, int(np.searchsorted(cut, (cut[s - 1] if s else 0) + 20 * PAIRS, "right")))
            i = todo[s:e]
            keys = np.concatenate([self._keys(a[i]), self._keys(b[i])])
            keys.sort()
            common = np.bincount(keys[1:][keys[1:] == keys[:-1]] // self.width, minlength=len(i))
            out[i] = common >= t * (self.size[a[i]] + self.size[b[i]] - common) - 1e-9
            s = e
        return out

    def _keys(self, sets: np.ndarray) -> np.ndarray:
        size = self.size[sets]
        pair = np.repeat(np.arange(len(sets)), size)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        return pair * self.width + self.member[self.first[sets][pair] + inner]

    def rows(self, a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
        """Group, name of a, count and name of b."""
        a, b = self.table.take(pa.array(a)), self.table.take(pa.array(b))
        return [x.combine_chunks() for x in (a.column("grp"), a.column("id"), b.column("n"), b.column("id"))]


def _first(t: float, sets_of: Callable | None):
    """For mapInArrow over one bucket: for each set the commonest one before it that it is near to and shares a prefix member of the bucket with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = _Bucket(held, sets_of)
        best = np.arange(len(x.size))
        open_, place = np.arange(len(x.of)), 0
        while True:
            # the posting's candidate of this place; past the best head so far, or the set itself, there is nothing to gain
            at = x.run[open_] + place
            ok = at < open_
            open_, at = open_[ok], at[ok]
            ok = x.of[at] < best[x.of[open_]]
            open_, at = open_[ok], at[ok]
            if not len(open_):
                break
            a, b = x.of[open_], x.of[at]
            hit = x.near(a, b, t)
            np.minimum.at(best, a[hit], b[hit])
            open_, place = open_[~hit], place + 1
        found = np.flatnonzero(best < np.arange(len(best)))
        if len(found):
            yield pa.RecordBatch.from_arrays(x.rows(found, best[found]), ["grp", "id", "hn", "head"])

    return run


def _around(t: float, sets_of: Callable | None):
    """For mapInArrow over one bucket: the sets near to each set that ``leads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = _Bucket(held, sets_of)
        leads = x.table.column("leads").to_numpy().astype(bool)
        head = np.flatnonzero(leads[x.of])
        for i, j in sj.expand(x.run[head], x.end[head], PAIRS):
            pair = np.unique(x.of[j] * len(x.size) + x.of[head[i]])
            a, b = pair // len(x.size), pair % len(x.size)
            ok = a != b
            a, b = a[ok], b[ok]
            ok = x.near(a, b, t)
            if ok.any():
                yield pa.RecordBatch.from_arrays(x.rows(a[ok], b[ok]), ["grp", "id", "hn", "head"])

    return run


def near_heads(sets: DataFrame, t: float, sets_of: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(heads, clusters) of ``sets`` (grp long, id string, n long, set array<long>, members distinct): (grp, id, head) of every set, and of every set near a head, the head included.

    Where ``sets_of(names)`` gives (row, member) of the sets by their names, in order of the row, only names travel.
    """
    sets = materialise(sets.select("grp", "id", "n", "set", F.xxhash64("grp", "id").alias("k")), "sets")
    sizes = sets.groupBy("grp").agg(F.sum(F.ceil(F.size("set") * (1 - t)) + 1).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    buckets = max(n_buckets(sets), -(-int(total) // POSTINGS))
    spark = sets.sparkSession
    # groups past a quarter of a bucket; there are at most four for each bucket
    large = spark.sparkContext.broadcast(np.array([r.grp for r in sizes.filter(F.col("size") > POSTINGS // 4).collect()], np.int64))
    counts = spark.sparkContext.broadcast(_counts(sets))
    posted = sets.mapInArrow(prefixes(counts, large, t, buckets, sets_of is None), "bucket int, grp long, w long, k long, id string, n long, set binary")
    link = "grp long, id string, hn long, head string"
    first = in_buckets(posted, buckets, _first(t, sets_of), link).groupBy("grp", "id").agg(F.max(F.struct("hn", "head")).alias("h"))
    heads = materialise(sets.select("grp", "id").join(first, ["grp", "id"], "left").select("grp", "id", F.coalesce("h.head", "id").alias("head")), "set-heads")
    leads = heads.select("grp", F.col("head").alias("id")).distinct().withColumn("leads", F.lit(True))
    flagged = posted.join(leads.select(F.xxhash64("grp", "id").alias("k"), "leads"), "k", "left").select("bucket", "grp", "w", "k", "id", "n", "set", F.coalesce("leads", F.lit(False)).alias("leads"))
    around = in_buckets(flagged, buckets, _around(t, sets_of), link).select("grp", "id", "head").distinct()
    return heads, around.unionByName(leads.select("grp", "id", F.col("id").alias("head")))
