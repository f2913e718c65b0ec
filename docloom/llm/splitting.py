"""Problem 4: cutting oversized items at natural boundaries, with overlap.

Sizes are counted in pieces between white space (words); ``limit`` tokens are
``(3 * limit + 2) // 4`` words.  Boundaries are line ends and sentence ends;
where a stretch between two of them is over the limit by itself, its word gaps
become boundaries too, and a piece that ends at one is a hard cut.

All items of a batch are cut at once.  The piece after one that ends at a
boundary steps back by the overlap: to the farthest natural boundary inside it
where that keeps at least half of it, else to the word gap that gives it whole
(``start_natural`` says which).  Only where the next boundary would then be out
of reach, because a sentence nearly fills a piece, is the overlap cut to what
the limit leaves; ``overlap_tokens`` states what each piece shares with the one
before.  So each boundary has one farthest legal successor.  The table of
successors is squared again and again: after r rounds every end up to 2**r
pieces from an item's beginning is marked, so even an item of a million pieces
takes twenty rounds.

Defined results: null, empty and small items give no piece (they need no cut);
nulls among an item's lines are skipped; text is never changed, pieces are
slices of it; the pieces of an item cover all of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import setjoin as sj
from docloom.llm.tokens import layout


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x3100):
        out[c] = chr(c).isspace()
    return out


def words_for(limit: int) -> int:
    """The most words whose floor(4 w / 3) is at most ``limit``."""
    return (3 * limit + 2) // 4


def cut(texts: list[str], limit: int, overlap: int) -> dict[str, np.ndarray]:
    """Pieces of all texts: ``item``, ``piece`` (from 0), ``start``, ``end`` (code points), ``words``, ``hard``, ``shared`` (words), ``natural`` (start)."""
    most, back = words_for(limit), words_for(overlap) if overlap else 0
    if back >= most:
        raise ValueError("the overlap must be smaller than the limit")
    cps, offsets = layout(texts)
    solid = ~_space()[cps]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    w_start, w_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    item = np.searchsorted(offsets, w_start, "right") - 1
    count = np.bincount(item, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    # a natural boundary stands after a word that ends a sentence or a line
    breaks = np.concatenate([[0], np.cumsum(cps == 10)])
    nxt = np.append(w_start[1:], len(cps))
    natural = np.isin(cps[w_end - 1], [46, 33, 63]) | (breaks[nxt] > breaks[w_end])
    some = np.flatnonzero(count) if len(w_start) else np.empty(0, np.int64)
    natural[(first + count - 1)[some]] = True
    # boundary b lies before word b; word gaps count inside stretches over the limit
    ends = np.flatnonzero(natural) + 1
    size = np.diff(np.concatenate([[0], ends]))
    bound = np.flatnonzero(natural | np.repeat(size > most, size)) + 1
    own = item[bound - 1]
    stop = (first + count)[own]
    hard = ~natural[bound - 1]
    # where the piece after each boundary starts
    low = np.maximum(bound - back, np.append(bound[1:], 0) - most)
    low = np.where(bound < stop, np.clip(low, first[own], bound), bound)
    at = np.append(np.concatenate([first[some], ends]), len(item) + most)
    at.sort()
    near = at[np.searchsorted(at, low)]
    aligned = (near == low) | ((near < bound) & (2 * (bound - near) >= back))
    start = np.where(aligned, near, low)
    # the farthest legal successor of each boundary; one state stands for "done"
    done = len(bound)
    reach = lambda s, e: np.searchsorted(bound, np.minimum(s + most, e), "right") - 1
    table = np.append(np.where(bound < stop, reach(start, stop), done), done)
    marked = np.zeros(done + 1, bool)
    marked[reach(first[some], (first + count)[some])] = True
    while True:
        new = marked.copy()
        new[table[np.flatnonzero(marked)]] = True
        if (new == marked).all():
            break
        marked = new
        table = table[table]
    cuts = np.flatnonzero(marked[:done])
    to, of = bound[cuts], own[cuts]
    head = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.empty(0, bool)
    place = np.arange(len(of)) - np.maximum.accumulate(np.where(head, np.arange(len(of)), 0)) if len(of) else of
    before = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
    begin = np.where(head, first[of], start[before]) if len(cuts) else cuts
    return {
        "item": of, "piece": place, "start": w_start[begin] - offsets[of], "end": w_end[to - 1] - offsets[of], "words": to - begin, "hard": hard[cuts],
        "shared": np.where(head, 0, bound[before] - begin) if len(cuts) else cuts, "natural": head | aligned[before] if len(cuts) else head,
    }


def lines_text(lines: Column) -> Column:
    """The texts of an array of font lines in order of line_no, one a line."""
    ordered = F.array_sort(F.transform(lines, lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")


def split_oversized(df: DataFrame, keys: list[str], text: Column, limit: int = 512, overlap: int = 50, with_text: bool = True) -> DataFrame:
    """The pieces of every item over ``limit`` tokens: keys, piece, piece_start, piece_end, n_tokens, hard, overlap_tokens, start_natural (and piece_text)."""
    most = words_for(limit)
    rows = df.select(*keys, text.alias("_text")).filter("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            large = [i for i, t in enumerate(texts) if len(t) >= 2 * most and len(t.split()) > most]
            chosen = [texts[i] for i in large]
            for s, e in sj.steps(chosen):
                x = cut(chosen[s:e], limit, overlap)
                at = pa.array(np.array(large[s:e], np.int64)[x["item"]])
                cols = [b.column(i).take(at) for i in range(len(keys))]
                cols += [pa.array(x["piece"].astype(np.int32)), pa.array(x["start"].astype(np.int32)), pa.array(x["end"].astype(np.int32)), pa.array((4 * x["words"] // 3).astype(np.int32)), pa.array(x["hard"]), pa.array((4 * x["shared"] // 3).astype(np.int32)), pa.array(x["natural"])]
                names = [*keys, "piece", "piece_start", "piece_end", "n_tokens", "hard", "overlap_tokens", "start_natural"]
                if with_text:
                    cols.append(pa.array([chosen[s + i][p:q] for i, p, q in zip(x["item"], x["start"], x["end"], strict=True)], pa.string()))
                    names.append("piece_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["piece int, piece_start int, piece_end int, n_tokens int, hard boolean, overlap_tokens int, start_natural boolean"] + ["piece_text string"] * with_text)
    return rows.mapInArrow(run, schema)
