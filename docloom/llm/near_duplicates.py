"""Problem 1: groups of records that say the same with small edits.

Token-group matrix: texts with the same shingle set form one class; classes
with a common minimum hash over their rare shingles and a like size form one
group.  The matrix keeps, for each token of a group's union, the sizes and the
earliest place of the group's members.  A class reads the matrix along its own
tokens; the count of tokens it shares with a group bounds the overlap with any
member, and only groups that reach the bound are opened, whose members are
then compared exactly.

Defined results: a null, empty or shingle-less text has no pair.  Copies have
similarity 1.  Rows with a null key are left out; rows that repeat a key with
the same text count once, and with other texts stand for each of them (a key is
no pair with itself).  Other columns of the input are ignored.  Very long texts
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import setjoin as sj
from docloom.llm.tokens import mix64, together
from docloom.session import materialise

#: Sizes in one group differ by at most this factor (and one).
SPREAD = 1.1


def _group(x: sj.Sets) -> np.ndarray:
    """Minimum hash over each row's rarest third of tokens, joined with the step of its size."""
    out = np.full(len(x.n), 0, np.uint64)
    ok = x.pos <= x.n[x.doc] // 3
    if ok.any():
        doc = x.doc[ok]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[first]] = np.minimum.reduceat(mix64(x.token[ok] ^ np.uint64(0xA5A5A5A5)), first)
    step = np.floor(np.log(np.maximum(x.n, 1)) / np.log(SPREAD)).astype(np.uint64)
    return mix64(out + step) >> np.uint64(64 - sj.GROUP_BITS)


def _read_matrix(t: float, ell: int):
    def probe(buckets: int):
        def run(table: pa.Table) -> Iterator[pa.Table]:
            x = sj.read_blobs(table)
            member, ask = x["role"] != sj.ASK, np.flatnonzero(x["role"] != sj.MEMBER)
            if not member.any() or not len(ask):
                return
            # the matrix: one entry for each token of a group's union
            m = {k: x[k][member] for k in ("tok", "grp", "n", "pos")}
            order = together(m["tok"], m["grp"])
            m = {k: v[order] for k, v in m.items()}
            at = np.flatnonzero(np.concatenate([[True], (m["tok"][1:] != m["tok"][:-1]) | (m["grp"][1:] != m["grp"][:-1])]))
            e_tok, e_grp = m["tok"][at].astype(np.int64), m["grp"][at]
            e_min, e_max, e_pos = np.minimum.reduceat(m["n"], at), np.maximum.reduceat(m["n"], at), np.minimum.reduceat(m["pos"], at)
            e_many = np.diff(np.append(at, len(order))) > 1
            cap = (1 << 31) - 1
            key = (e_tok << 31) | np.minimum(e_max, cap)
            order = np.argsort(key)
            key, e_grp, e_min, e_max, e_pos, e_many = (v[order] for v in (key, e_grp, e_min, e_max, e_pos, e_many))
            # a class asks for members at least as large as itself
            n, pos, tok = x["n"][ask], x["pos"][ask], x["tok"][ask].astype(np.int64)
            top = np.minimum(np.floor((n - pos + ell - 1) * (1 + t) / t + 1e-9).astype(np.int64) - n, sj.longest(n, t))
            ok = np.flatnonzero(top >= n)
            ask, n, pos, tok, top = ask[ok], n[ok], pos[ok], tok[ok], top[ok]
            lo = np.searchsorted(key, (tok << 31) | np.minimum(n, cap))
            hi = np.searchsorted(key, (tok << 31) | np.minimum((top * SPREAD).astype(np.int64) + 2, cap), "right")
            qs, qi = np.unique(x["cls"][ask], return_inverse=True)
            gs, gi = np.unique(e_grp, return_inverse=True)
            own = x["grp"][ask]
            found = sj.Counted(qs, gs, buckets)
            for i, j in sj.expand(lo, hi):
                low = np.maximum(e_min[j], n[i])
                high = np.minimum(e_max[j], sj.longest(n[i], t))
                least = sj.need(n[i], low, t)
                fewest = np.minimum(ell, least)
                ok = (low <= top[i]) & (n[i] - pos[i] >= least - fewest + 1)
                ok &= high - e_pos[j] >= sj.need(n[i], high, t) - fewest + 1
                ok &= (e_grp[j] != own[i]) | e_many[j]
                i, j, fewest = i[ok], j[ok], fewest[ok]
                yield from found.add(qi[i], gi[j], -(-ell // np.maximum(fewest, 1)))
            yield from found.rest()

        return run

    return probe


def _both(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(flag), bool), np.ones(len(flag), bool)


def _class(cls: np.ndarray, flag: np.ndarray) -> np.ndarray:  # noqa: ARG001
    return cls


def near_duplicate_classes(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, ell: int = 6, cell: int = sj.CELL) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (k, cls, n), one row per distinct key and set; links (ca, cb, similarity) between different classes, ca < cb.

    No link between different texts is lost; copies share a class.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lit(0).alias("f")).filter("k is not null and t is not null")
    docs, opened = sj.candidates(rows, width, threshold, ell, _group, _both, _class, _read_matrix(threshold, ell), 0, cell)
    classes = docs.groupBy("cls", "short").agg(F.min("k").alias("rep"), F.min("grp").alias("grp"), F.min("n").alias("n"))
    c, d = classes.alias("c"), classes.alias("d")
    pairs = (
        opened.join(c, F.col("a") == F.col("c.short"))
        .select(F.col("c.cls").alias("a"), "b", F.col("c.rep").alias("ra"), F.col("c.n").alias("na"))
        .join(d, F.col("b") == F.col("d.grp"))
        .filter((F.col("a") != F.col("d.cls")) & (F.col("d.n") >= F.col("na")) & (F.col("na") >= F.lit(threshold) * F.col("d.n") - 1e-9))
        .select(F.least("a", "d.cls").alias("ca"), F.greatest("a", "d.cls").alias("cb"), F.when(F.col("a") < F.col("d.cls"), F.col("ra")).otherwise(F.col("d.rep")).alias("ra"), F.when(F.col("a") < F.col("d.cls"), F.col("d.rep")).otherwise(F.col("ra")).alias("rb"))
        .distinct()
    )
    pairs = materialise(pairs, "tgm-pairs")
    links = sj.verify(pairs, rows, width, threshold, _class).select("ca", "cb", "similarity")
    return docs.select("k", "cls", "n").distinct(), links


def near_duplicate_pairs(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, **how: int) -> DataFrame:
    """(a, b) with a < b: every pair of keys whose texts reach the threshold, copies included."""
    members, links = near_duplicate_classes(df, key, text, width, threshold, **how)
    m, o = members.alias("m"), members.alias("o")
    between = links.join(m, F.col("ca") == F.col("m.cls")).select("cb", F.col("m.k").alias("x")).join(o, F.col("cb") == F.col("o.cls")).select("x", F.col("o.k").alias("y"))
    copied = members.join(members.groupBy("cls").agg(F.count("*").alias("c")).filter("c > 1").select("cls"), "cls")
    within = copied.alias("m").join(copied.alias("o"), "cls").filter(F.col("m.k") < F.col("o.k")).select(F.col("m.k").alias("x"), F.col("o.k").alias("y"))
    return between.unionByName(within).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
