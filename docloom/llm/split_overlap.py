"""Problem 6: records of the evaluation splits that also stand, exactly or almost, in the training split.

Exact prefix-filter bipartite join: the sets of all rows are ordered with rare
shingles first; the evaluation sets' prefixes form the index, the training
sets' prefixes probe it under a length and a place filter and a bitmap bound on
the overlap, and the pairs that remain are compared exactly.  Copies meet as one set on either side and are
expanded only in the report of pairs.

Defined results: null, empty and word-less texts match nothing; a null split
or key leaves the row out; split names are compared without case and
surrounding space; rows that repeat a key with other texts count with each of
their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import setjoin as sj
from docloom.llm.tokens import mix64
from docloom.session import materialise


def bare(text: Column) -> Column:
    """The text without retrieval prefixes at its start, however often they stand there."""
    return F.regexp_replace(text, r"(?i)^\s*(?:(?:query|passage)\s*:\s*)+", "")


def _keyed(cls: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return mix64(cls + mix64(kind.astype(np.uint64) + np.uint64(99)))


#: 64-bit words of the bitmaps that bound overlaps.
WORDS = 2


def _probe(t: float, ell: int):
    def probe(buckets: int):
        def run(table: pa.Table) -> Iterator[pa.Table]:
            x = sj.read_blobs(table, WORDS)
            train = (x["flag"] & 1) == 0
            kind = (x["flag"] >> 1).astype(np.int64)
            key = x["cls"]
            run_of = x["tok"].astype(np.int64) * 32 + kind
            ev, tr = np.flatnonzero(~train), np.flatnonzero(train)
            if not len(ev) or not len(tr):
                return
            cap = (1 << 25) - 1
            ev = ev[np.lexsort((x["n"][ev], run_of[ev]))]
            order = (run_of[ev] << 25) | np.minimum(x["n"][ev], cap)
            n, pos = x["n"][tr], x["pos"][tr]
            top = np.minimum(np.floor((n - pos + ell - 1) * (1 + t) / t + 1e-9).astype(np.int64) - n, sj.longest(n, t))
            lo = np.searchsorted(order, (run_of[tr] << 25) | np.minimum(sj.shortest(n, t), cap))
            hi = np.searchsorted(order, (run_of[tr] << 25) | np.clip(top, 0, cap), "right")
            ts, ti = np.unique(key[tr], return_inverse=True)
            es, ei = np.unique(key[ev], return_inverse=True)
            found = sj.Counted(ts, es, buckets)
            e_n, e_left, t_left = x["n"][ev], (x["n"] - x["pos"])[ev], n - pos
            e_sig, t_sig = x["sig"][ev], x["sig"][tr]
            # the least overlap and the least rest of a set behind a first match, by the sum of both sizes
            least_of = sj.need(np.arange(int(n.max() + e_n.max()) + 1), 0, t)
            rest_of = least_of - np.minimum(ell, least_of) + 1
            for i, j in sj.expand(lo, hi):
                both = n[i] + e_n[j]
                rest = rest_of[both]
                ok = np.flatnonzero((t_left[i] >= rest) & (e_left[j] >= rest))
                i, j, both = i[ok], j[ok], both[ok]
                least = least_of[both]
                # members that one set lacks: at least the bits that differ
                differ = np.zeros(len(i), np.int64)
                for w in range(WORDS):
                    differ += np.bitwise_count(t_sig[i, w] ^ e_sig[j, w])
                ok = np.flatnonzero(both - differ >= 2 * least)
                yield from found.add(ti[i[ok]], ei[j[ok]], -(-ell // np.maximum(np.minimum(ell, least[ok]), 1)))
            yield from found.rest()

        return run

    return probe


def _sides(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training rows ask, evaluation rows are asked."""
    return (flag & 1) == 0, (flag & 1) == 1


def _class(cls: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return _keyed(cls, flag >> 1)


def cross_split_links(df: DataFrame, key: str, split: str, fields: list[str], width: int = 1, threshold: float = 0.7, ell: int = 1, cell: int = sj.CELL) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (k, field, eval, cls); links (train_cls, eval_cls, similarity) between the distinct sets of both sides."""
    spark = df.sparkSession
    name = F.lower(F.trim(F.col(split)))
    parts = F.array(*[F.struct(bare(F.col(f)).alias("t"), (F.lit(2 * i) + F.when(name == "train", 0).otherwise(1)).alias("f")) for i, f in enumerate(fields)])
    rows = df.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).select(F.col(key).alias("id"), F.explode(parts).alias("x")).select(F.struct("id", F.col("x.f").alias("f")).alias("k"), F.col("x.t").alias("t"), F.col("x.f").alias("f")).filter("t is not null")
    docs, near = sj.candidates(rows, width, threshold, ell, lambda x: np.zeros(len(x.n), np.uint64), _sides, _class, _probe(threshold, ell), WORDS, cell)
    train = docs.filter("f % 2 = 0").groupBy("cls", "short").agg(F.min("k").alias("ra"))
    held = docs.filter("f % 2 = 1").groupBy("cls", "short").agg(F.min("k").alias("rb"))
    pairs = materialise(near.join(train.withColumnsRenamed({"cls": "ca", "short": "a"}), "a").join(held.withColumnsRenamed({"cls": "cb", "short": "b"}), "b").select("ca", "cb", "ra", "rb"), "split-pairs")
    links = sj.verify(pairs, rows, width, threshold, _class).select(F.col("ca").alias("train_cls"), F.col("cb").alias("eval_cls"), "similarity")
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), (F.col("f") / 2).cast("int") + 1)
    return docs.select(F.col("k.id").alias("k"), names.alias("field"), (F.col("f") % 2 == 1).alias("eval"), "cls").distinct(), links


def cross_split_pairs(df: DataFrame, key: str, split: str, fields: list[str], width: int = 1, threshold: float = 0.7, **how: int) -> DataFrame:
    """(train, eval, field): every pair of a training and an evaluation row that reach the threshold in the field."""
    members, links = cross_split_links(df, key, split, fields, width, threshold, **how)
    left = members.filter("not eval").select(F.col("k").alias("train"), "field", F.col("cls").alias("train_cls"))
    right = members.filter("eval").select(F.col("k").alias("eval"), F.col("cls").alias("eval_cls"))
    return links.join(left, "train_cls").join(right, "eval_cls").select("train", "eval", "field").distinct()


def cross_split_report(df: DataFrame, key: str, split: str, source: str, fields: list[str], width: int = 1, threshold: float = 0.7) -> DataFrame:
    """Per split, source and field: rows, and rows with a near copy in training; expands no pairs."""
    members, links = cross_split_links(df, key, split, fields, width, threshold)
    touched = members.filter("eval").join(links.select(F.col("eval_cls").alias("cls")).distinct(), "cls", "left_semi").select("k", "field").distinct()
    rows = df.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).select(F.col(key).alias("k"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source")).filter("split <> 'train'")
    each = rows.select("k", "split", "source", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return each.join(touched.withColumn("hit", F.lit(1)), ["k", "field"], "left").groupBy("split", "source", "field").agg(F.countDistinct("k").alias("n_rows"), F.countDistinct(F.when(F.col("hit") == 1, F.col("k"))).alias("n_overlapping"))
