"""Problem 7: held-out passages inside a training corpus.

Each shard of the corpus (the rows of a task, up to ``SHARD_WORDS`` words) gets
an FM-index over its words: suffix array, Burrows-Wheeler transform in a
wavelet matrix, and a sample of the suffix positions.  All phrases of the
held-out items are searched backward at once; the ranges that remain are
located by walking to the next sampled position, and adjacent hits merge into
removal spans.  The corpus is never shuffled.

A phrase cannot contain a word that no item has, so such words only separate:
maximal runs of item words shorter than a phrase are left out of the index.
Words are symbols by some bits of their hash; a located hit is compared by the
whole hashes of its words, so symbols that meet by chance report nothing.

The items are the stated query set.  They are read in blocks of bounded size
(``BLOCK_CHARS`` characters: about 60 MB on the driver while it is prepared, 25
MB when sent), and long items in pieces.  A shard is indexed once and searched
for one block after the other, so there is one scan however many items there
are, and neither the driver nor a task holds more than one block.

Defined results: null, empty and short texts match nothing; rows with a null
key are left out; rows that repeat a key are searched each; equal items are
all reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import setjoin as sj
from docloom.llm.tokens import Words, mix64, powers
from docloom.session import materialise

#: Words in one index; characters of items in one block, and of a long item in one piece; distance of sampled suffix positions.
SHARD_WORDS, BLOCK_CHARS, PIECE_CHARS, SAMPLE = 1 << 20, 8_000_000, 1_000_000, 8
#: Most words of items by which corpus words are left out (32 MB); where items have more, all words are kept.
MOST_WORDS = 4_000_000
END, BREAK, FIRST = 0, 1, 2


class WaveletMatrix:
    """Rank and access over a sequence of small integers."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        # where each symbol's block starts in the last level
        self.begin = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            one = self.ones[k][i]
            i = np.where((c >> (self.depth - 1 - k)) & 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before place i."""
        return self._descend(c, i) - self.begin[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        c = np.zeros(len(i), np.int64)
        for k in range(self.depth):
            one = self.ones[k][i]
            bit = self.ones[k][i + 1] - one
            c = c * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + one, i - one)
        return c, i - self.begin[c]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol is unique and smallest."""
    n, k = len(seq), 1
    _, rank = np.unique(seq, return_inverse=True)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else after[: n - k]
        key = rank * (n + 1) + after
        order = np.argsort(key)
        sorted_key = key[order]
        step = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, n_symbols: int):
        sa = suffix_array(seq)
        self.matrix = WaveletMatrix(seq[sa - 1].astype(np.int64), n_symbols)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))[:-1]]).astype(np.int64)
        sampled = sa % SAMPLE == 0
        self.sampled = sampled
        self.before = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int64)
        self.values = sa[sampled]
        self.n = len(seq)

    def ranges(self, symbols: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all phrases, ``width`` symbols from each start, by backward search."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        alive = np.arange(len(start))
        for k in range(width - 1, -1, -1):
            c = symbols[start[alive] + k].astype(np.int64)
            lo[alive] = self.less[c] + self.matrix.rank(c, lo[alive])
            hi[alive] = self.less[c] + self.matrix.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        gone = np.ones(len(start), bool)
        gone[alive] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to a sampled position."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            here = rows[open_]
            found = self.sampled[here]
            done = open_[found]
            out[done] = self.values[self.before[rows[done]]] + steps
            open_ = open_[~found]
            c, before = self.matrix.access(rows[open_])
            rows[open_] = self.less[c] + before
            steps += 1
        return out


def _symbols(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32) + FIRST


def _phrase_hash(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on."""
    m = max(0, len(h) - width + 1)
    out = np.zeros(m, np.uint64)
    for k in range(width):
        out += h[k : k + m] * powers(width + 2)[k + 2]
    return mix64(out)


class Phrases:
    """The distinct runs of ``width`` words of a block of items.

    ``symbols`` holds the words of all items once; a phrase is its ``start``
    among them, its ``hash``, and the items ``owner[at[p]:at[p + 1]]``, places
    in ``ids``.
    """

    def __init__(self, texts: list[str], ids: pa.Array, width: int, bits: int):
        words = Words(texts)
        self.width, self.bits, self.ids = width, bits, ids
        self.symbols = _symbols(words.hash, bits)
        self.words = np.unique(words.hash)
        h = _phrase_hash(words.hash, width)
        ok = np.flatnonzero(words.doc[: len(h)] == words.doc[width - 1 :]) if len(h) else np.empty(0, np.int64)
        self.hash, first, of = np.unique(h[ok], return_index=True, return_inverse=True)
        self.start = ok[first].astype(np.int32)
        pair = np.unique(of.ravel() * (len(texts) + 1) + words.doc[ok])
        phrase, owner = pair // (len(texts) + 1), pair % (len(texts) + 1)
        self.owner, self.at = owner.astype(np.int32), np.searchsorted(phrase, np.arange(len(self.hash) + 1))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}


def _kept_runs(words: Words, known: np.ndarray | None, width: int) -> np.ndarray:
    """Indices of words in maximal runs, inside one text, of at least ``width`` item words."""
    if known is None:
        good = np.ones(len(words.hash), bool)
    elif len(known):
        good = known[np.minimum(np.searchsorted(known, words.hash), len(known) - 1)] == words.hash
    else:
        good = np.zeros(len(words.hash), bool)
    edge = np.concatenate([[True], (words.doc[1:] != words.doc[:-1]) | (good[1:] != good[:-1])]) if len(good) else good
    run = np.cumsum(edge) - 1
    size = np.bincount(run) if len(run) else run
    return np.flatnonzero(good & (size[run] >= width)) if len(run) else run


def _search(blocks: list, known, width: int, bits: int):
    """For mapInArrow over (k, text): (k, item, span_start, span_end) in code points, merged per item."""

    def shard(keys: list, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        row, word, h, start, end = (np.concatenate([x[i] for x in parts]) for i in range(5))
        gap = np.concatenate([[False], (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)])
        place = np.arange(len(row)) + np.cumsum(gap)
        seq = np.full(int(place[-1]) + 2, BREAK, np.int64)
        seq[place] = _symbols(h, bits)
        seq[-1] = END
        at = np.full(len(seq), -1, np.int64)
        at[place] = np.arange(len(row))
        index = FMIndex(seq, (1 << bits) + FIRST)
        table = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys])
        phrase = np.append(_phrase_hash(h, width), np.zeros(min(len(h), width - 1), np.uint64))
        for block in blocks:
            p: Phrases = block.value
            lo, hi = index.ranges(p.symbols, p.start, width)
            hits = []
            for i, j in sj.expand(lo, hi):
                w = at[index.locate(j)]
                same = phrase[w] == p.hash[i]
                i, w = i[same], w[same]
                for k, own in sj.expand(p.at[i], p.at[i + 1]):
                    hits.append(np.stack([row[w[k]], p.owner[own], w[k]]))
            if len(blocks) > 1:
                block.unpersist_here()
            if not hits:
                continue
            r, item, w = np.concatenate(hits, axis=1)
            order = np.lexsort((w, item, r))
            r, item, w = r[order], item[order], w[order]
            # by the place in the text: words that are not kept part two passages
            head = np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (word[w[1:]] > word[w[:-1]] + width)])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(r)) - 1
            yield pa.RecordBatch.from_arrays([table.take(pa.array(r[first])), p.ids.take(pa.array(item[first])), pa.array(start[w[first]].astype(np.int32)), pa.array(end[w[last] + width - 1].astype(np.int32))], ["k", "item", "span_start", "span_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, base, held = [], [], 0, 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in sj.steps(texts):
                words = Words(texts[s:e])
                at = _kept_runs(words, known.value, width)
                if len(at):
                    docs, row = np.unique(words.doc[at], return_inverse=True)
                    keys.append(b.column(0).slice(s, e - s).take(pa.array(docs)))
                    parts.append((row + base, at, words.hash[at], words.start[at], words.end[at]))
                    base += len(docs)
                    held += len(at)
                if held >= SHARD_WORDS:
                    yield from shard(keys, parts)
                    keys, parts, base, held = [], [], 0, 0
        if parts:
            yield from shard(keys, parts)

    return run


class _Block:
    """A broadcast that a worker can let go of again, to be read from disk when it is next asked for."""

    def __init__(self, sent):
        self.sent = sent

    @property
    def value(self) -> Phrases:
        return self.sent.value

    def unpersist_here(self) -> None:
        if hasattr(self.sent, "_path") and hasattr(self.sent, "_value"):
            del self.sent._value


def _pieces(width: int):
    """For mapInArrow over (i, t): long texts in pieces that share ``width`` - 1 words, so every phrase is whole in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, part = [], [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                w = Words([t]) if len(t) > PIECE_CHARS else None
                start = 0
                while w is not None and start + width <= len(w.hash) and len(t) - w.start[start] > PIECE_CHARS:
                    end = max(start + width, int(np.searchsorted(w.end, w.start[start] + PIECE_CHARS, "right")))
                    at.append(n), texts.append(t[w.start[start] : w.end[end - 1]]), part.append(len(part))
                    start = end - width + 1
                if w is None or start < len(w.hash):
                    at.append(n), texts.append(t if w is None else t[w.start[start] :]), part.append(len(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(texts, pa.string()), pa.array(part, pa.int32())], ["i", "t", "part"])

    return run


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(k, item, span_start, span_end): passages of at least ``width`` consecutive words that a row shares with an item."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    held = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    kinds = dict(rows.dtypes) | {"i": dict(held.dtypes)["i"]}
    held = materialise(held.mapInArrow(_pieces(width), f"i {kinds['i']}, t string, part int"), "leak-items")
    chars = int(held.agg(F.sum(F.length("t"))).first()[0] or 0)
    n = -(-chars // block_chars) or 1
    bits = min(22, max(8, (chars // 8).bit_length()))
    blocks, known = [], np.empty(0, np.uint64)
    for k in range(n):
        part = held.filter(F.pmod(F.xxhash64("i", "t", "part"), F.lit(n)) == k).orderBy("i", "part").select("i", "t").toArrow()
        p = Phrases(part.column("t").to_pylist(), part.column("i").combine_chunks(), width, bits)
        blocks.append(_Block(spark.sparkContext.broadcast(p)))
        known = None if known is None or len(known) > MOST_WORDS else np.union1d(known, p.words)
    words = spark.sparkContext.broadcast(known)
    return rows.mapInArrow(_search(blocks, words, width, bits), f"k {kinds['k']}, item {kinds['i']}, span_start int, span_end int")


def removal_spans(found: DataFrame) -> DataFrame:
    """(k, span_start, span_end): the leaked passages of each row, merged over the items."""
    w = Window.partitionBy("k").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.select("k", "span_start", "span_end").distinct().withColumn("_new", F.when(F.col("span_start") <= reach, 0).otherwise(1))
    return rows.withColumn("_run", F.sum("_new").over(w)).groupBy("k", "_run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("_run")
