"""Problem 5: lines that recur over the documents of one source.

Every line is masked: to its letters in lower case, which drops numbers, dates
in numbers, punctuation and spacing, with one sign for each name (a capitalised
word inside a line that is half in small words, so months as well).  Masks get
MinHash band keys over their five-letter runs, and the letters as they are one
key more; within a source, a key that stands in many documents is a hot bucket.
Each distinct line of the hot buckets joins the cluster of the commonest of all
these lines of its source to which it is near (exactly, by the prefix filter),
and every line has a cluster of its own; clusters that stand in many
documents are removed.

Band keys are counted per task in arrays and added up by bucket of the key, so
a source with a third of all rows is spread like any other; only lines of hot
buckets leave the second scan, and from there on each distinct line of a source
is one row.  The keys of frequent lines go back to the scan in blocks of
bounded size, so texts are cut where they are read and never shuffled.

Defined results: null and empty texts have no repeated line and come back as
they are; rows without a source or key take no part; lines without letters are
never repeated; a line that stands twice in one document counts once for the
frequency, and each of its places is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import near_heads as nh
from docloom.llm import setjoin as sj
from docloom.llm.tokens import _mixed_lower, _tables, by_bucket, distinct, layout, mix64, powers, together
from docloom.session import in_buckets, materialise, n_buckets

#: Letters in a run, MinHash rows in a band, bands; the key of the letters comes before the bands.
RUN, ROWS, BANDS = 5, 3, 5
KEYS = BANDS + 1
#: The sign of a name in a mask: a letter without case that no text uses for words.
NAME = 0x0298
#: Bits of a bucket's key as it is counted, and keys of frequent lines that one scan takes along (64 MB).
KEY_BITS, AT_ONCE = 48, 8_000_000
_ODD = mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _runs_hash(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each owner's values in order, and the number of its values; owners come in order."""
    size, out = np.bincount(owner, minlength=n), np.zeros(n, np.uint64)
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
    if len(head):
        place = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
        out[owner[head]] = mix64(np.add.reduceat(value * powers(int(place.max()) + 1)[place], head) + size[owner[head]].astype(np.uint64))
    return out, size


class Lines:
    """The lines of a batch: ``doc``, ``line_no`` (from 1), ``n`` letters, ``key`` (hash of the letters); with ``bands`` also ``keys`` (n × KEYS) and ``mask(i)``."""

    def __init__(self, texts: list[str | None], bands: bool = True):
        cps, offsets = layout(texts)
        alpha, lower = _tables()[2], _tables()[1]
        feed = cps == 10
        ends = np.flatnonzero(feed)
        self.doc = np.searchsorted(offsets, ends, "right") - 1
        first = np.searchsorted(self.doc, np.arange(len(offsets) - 1))
        self.line_no = np.arange(len(ends)) - first[self.doc] + 1
        at = np.flatnonzero(alpha[cps])
        line = np.cumsum(feed)[at]
        letter = _mixed_lower()[cps[at]]
        self.key, self.n = _runs_hash(letter, line, len(ends))
        if not bands:
            return
        self.keys = np.zeros((len(ends), KEYS), np.uint64)
        self.keys[:, 0] = self.key
        self.small, self.first = lower[cps[at]], np.searchsorted(line, np.arange(len(ends) + 1))
        if not len(at):
            return
        # names: capitalised words that do not begin a line, in lines half of whose words are small
        new = np.concatenate([[True], at[1:] != at[:-1] + 1])
        word, head = np.cumsum(new) - 1, np.flatnonzero(new)
        of = line[head]
        upper = lower[cps[at]] != cps[at]
        long = np.diff(np.append(head, len(at))) > 1
        capital = upper[head] & long & ~upper[np.minimum(head + 1, len(at) - 1)]
        plain = np.bincount(of[~upper[head]], minlength=len(ends)) * 2 >= np.bincount(of, minlength=len(ends))
        name = capital & plain[of] & np.concatenate([[False], of[1:] == of[:-1]])
        kept = ~name[word] | new
        sign = (name[word] & new)[kept]
        self.small, line, letter = self.small[kept], line[kept], letter[kept]
        self.small[sign], letter[sign] = NAME, _mixed_lower()[NAME]
        self.first = np.searchsorted(line, np.arange(len(ends) + 1))
        own, size = _runs_hash(letter, line, len(ends))
        gram = letter.copy()
        for k in range(1, RUN):
            gram[:-k] += letter[k:] * powers(RUN + 1)[k]
        gram = mix64(gram)
        # a run must end in its own line; a shorter line counts as one run
        inside = np.zeros(len(line), bool)
        inside[: max(0, len(line) - RUN + 1)] = line[: max(0, len(line) - RUN + 1)] == line[RUN - 1 :]
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        short = head[size[line[head]] < RUN]
        inside[short] = True
        gram[short] = own[line[short]]
        gram, owner = gram[inside], line[inside]
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for b in range(BANDS):
            key = np.full(len(head), b + 1, np.uint64)
            for r in range(ROWS):
                key = mix64(key * np.uint64(31) + np.minimum.reduceat(gram * _ODD[b * ROWS + r], head))
            self.keys[owner[head], b + 1] = key
        self.keys &= np.uint64((1 << KEY_BITS) - 1)

    def mask(self, i: int) -> str:
        return self.small[self.first[i] : self.first[i + 1]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def gram_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the runs of letters of each text; none for a shorter text."""
    cps, offsets = layout(texts)
    at = np.flatnonzero(_tables()[2][cps])
    doc = np.searchsorted(offsets, at, "right") - 1
    m = len(at) - RUN + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    letter = _mixed_lower()[cps[at]]
    gram = np.zeros(m, np.uint64)
    for k in range(RUN):
        gram += letter[k : k + m] * powers(RUN + 1)[k]
    inside = doc[:m] == doc[RUN - 1 :]
    return distinct(doc[:m][inside], mix64(gram[inside]))


COUNTS = "bucket int, src binary, cnt binary, band binary, df binary"


def _count(buckets: int):
    """For mapInArrow over (src, text): in how many texts each (source, key) stands."""

    def out(src: np.ndarray, band: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        bucket = (band % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(src)
        order = order[by_bucket(bucket[order])]
        src, band, df, bucket = src[order], band[order], df[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows: dict[str, list] = {k: [] for k in ("bucket", "src", "cnt", "band", "df")}
        for k in range(buckets):
            s, e = edges[k], edges[k + 1]
            if s < e:
                keys, cnt = np.unique(src[s:e], return_counts=True)
                for name, v in (("bucket", k), ("src", sj._bytes(keys)), ("cnt", sj._bytes(cnt.astype(np.uint32))), ("band", sj._bytes(band[s:e], KEY_BITS)), ("df", sj._bytes(df[s:e].astype(np.uint32)))):
                    rows[name].append(v)
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})

    def add(src: np.ndarray, band: np.ndarray, df: np.ndarray):
        order = together(src, band)
        src, band, df = src[order], band[order], df[order]
        at = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (band[1:] != band[:-1])])) if len(src) else np.empty(0, np.int64)
        return src[at], band[at], np.add.reduceat(df, at) if len(at) else df[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            texts, srcs = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, e in sj.steps(texts):
                x = Lines(texts[s:e])
                ok = x.n > 0
                doc, band = distinct(np.repeat(x.doc[ok], KEYS), x.keys[ok].ravel())
                held.append(add(srcs[s:e].view(np.uint64)[doc], band, np.ones(len(doc), np.int64)))
                size += len(held[-1][0])
            if size > 800_000:
                yield out(*add(*(np.concatenate(c) for c in zip(*held, strict=True))))
                held, size = [], 0
        if size:
            yield out(*add(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return run


def _frequent(least: int):
    """For mapInArrow over one bucket: (src, band, df) with df >= least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, band, df = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
        for batch in batches:
            for r in batch.to_pylist():
                src.append(np.repeat(sj._array(r["src"], np.uint64), sj._array(r["cnt"], np.uint32)))
                band.append(sj._array(r["band"], np.uint64, KEY_BITS))
                df.append(sj._array(r["df"], np.uint32))
        src, band, df = np.concatenate(src), np.concatenate(band), np.concatenate(df).astype(np.int64)
        if not len(src):
            return
        order = together(src, band)
        src, band, df = src[order], band[order], df[order]
        at = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (band[1:] != band[:-1])]))
        total = np.add.reduceat(df, at)
        ok = total >= least
        yield pa.RecordBatch.from_arrays([pa.array(src[at][ok].view(np.int64)), pa.array(band[at][ok].view(np.int64)), pa.array(total[ok])], ["src", "band", "df"])

    return run


def _pick(filter_):
    """For mapInArrow over (k, src, text): the lines with a key in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, srcs = b.column(2).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, e in sj.steps(texts):
                x = Lines(texts[s:e])
                slot = (x.keys ^ srcs[s:e].view(np.uint64)[x.doc][:, None]).view(np.int64)
                hit = sj.in_bloom(filter_.value, slot.ravel()).reshape(slot.shape) & (x.n > 0)[:, None]
                at = np.flatnonzero(hit.any(axis=1))
                if not len(at):
                    continue
                doc, key = x.doc[at], x.key[at]
                order = np.lexsort((x.line_no[at], key, doc))
                first = np.zeros(len(at), bool)
                d, k = doc[order], key[order]
                first[order] = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(s, e - s).take(pa.array(doc)),
                        pa.array(srcs[s:e][doc]),
                        pa.array(x.line_no[at].astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(first.astype(np.int32)),
                        pa.array([x.mask(i) for i in at], pa.string()),
                    ],
                    ["k", "src", "line_no", "line_key", "first", "mask"],
                )

    return run


def _gram_lists():
    """For mapInArrow over (grp, id, n): each mask with the runs of its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = b.column(1).to_pylist()
            for s, e in sj.steps(masks):
                row, h = gram_sets(masks[s:e])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=e - s))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.slice(s, e - s).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["grp", "id", "n", "set"])

    return run


class RepeatedLines:
    """``lines`` (k, src, line_no, line_key, first, mask): lines of hot buckets; ``nodes`` (src, line_key, df, n, enough): the distinct ones with the documents they stand in."""

    def __init__(self, df: DataFrame, key: Column, text: Column, source: Column, least: int = 5, share: float = 0.1, threshold: float = 0.8):
        spark = df.sparkSession
        self.least, self.share = least, share
        named = df.select(key.alias("k"), source.alias("source"), text.alias("t")).filter("k is not null and source is not null")
        self.rows = named.select("k", F.xxhash64("source").alias("src"), "t")
        sizes = self.rows.groupBy("src").agg(F.count("*").alias("n"))
        buckets = n_buckets(self.rows)
        counted = self.rows.filter("t is not null").select("src", "t").mapInArrow(_count(buckets), COUNTS)
        frequent = in_buckets(counted, buckets, _frequent(least), "src long, band long, df long")
        self.hot = materialise(frequent.join(sizes, "src").filter(self._enough(F.col("df"))).repartition(max(1, buckets // 8)), "hot-buckets")

        filter_ = spark.sparkContext.broadcast(sj.bloom(self.hot.select(F.col("src").bitwiseXOR(F.col("band")).alias("h")), "h"))
        kind = dict(self.rows.dtypes)["k"]
        self.lines = materialise(self.rows.filter("t is not null").mapInArrow(_pick(filter_), f"k {kind}, src long, line_no int, line_key long, first int, mask string"), "hot-lines")
        # one row for each distinct line and mask of a source, however often it stands
        spelled = materialise(self.lines.groupBy("src", "line_key", "mask").agg(F.sum("first").alias("df")), "line-spellings")
        self.nodes = materialise(spelled.groupBy("src", "line_key").agg(F.sum("df").alias("df")).join(sizes, "src").withColumn("enough", self._enough(F.col("df"))), "line-nodes")
        self.members = materialise(self._clusters(spelled, threshold), "line-clusters")

    def _enough(self, df: Column) -> Column:
        return (df >= self.least) & (df >= F.lit(self.share) * F.col("n") - 1e-9)

    def _clusters(self, spelled: DataFrame, threshold: float) -> DataFrame:
        """(src, line_key, head) of every line: its letters, its masks, and the commonest of all masks of the source that one of its masks is near to."""
        masks = spelled.groupBy(F.col("src").alias("grp"), F.col("mask").alias("id")).agg(F.sum("df").alias("n"))
        heads = nh.near_heads(masks.mapInArrow(_gram_lists(), "grp long, id string, n long, set array<long>"), threshold, gram_sets)[0]
        met = spelled.select("src", "line_key", "mask").join(heads.select(F.col("grp").alias("src"), F.col("id").alias("mask"), "head"), ["src", "mask"])
        # masks are letters, so a key in digits is no head's name
        return met.select("src", "line_key", F.explode(F.array("mask", "head", F.col("line_key").cast("string"))).alias("head")).distinct()

    def frequent_clusters(self) -> DataFrame:
        """(src, line_key) of every line in a cluster that stands in enough documents.

        A cluster with one line that stands in enough needs no count; only
        where the sum over its lines could reach it are documents counted.
        """
        met = self.members.join(self.nodes.select("src", "line_key", "df", "n", "enough"), ["src", "line_key"])
        sums = met.groupBy("src", "head").agg(F.max("enough").alias("sure"), F.sum("df").alias("most"), F.max("n").alias("n"))
        doubtful = sums.filter(~F.col("sure") & self._enough(F.col("most"))).select("src", "head", "n")
        counted = self.lines.select("k", "src", "line_key").distinct().join(self.members.join(doubtful, ["src", "head"]), ["src", "line_key"]).groupBy("src", "head", "n").agg(F.count_distinct("k").alias("df")).filter(self._enough(F.col("df")))
        heads = sums.filter("sure").select("src", "head").unionByName(counted.select("src", "head"))
        return self.members.join(heads, ["src", "head"], "left_semi").select("src", "line_key").distinct()

    def _blocks(self, keys: DataFrame) -> list[tuple[Column, np.ndarray]]:
        """The keys in sorted arrays of at most about AT_ONCE, each with the filter of the rows it is for."""
        whole = keys.limit(AT_ONCE + 1).toArrow()
        if whole.num_rows <= AT_ONCE:
            return [(F.lit(True), _slots(whole))]
        keys = materialise(keys, "frequent-lines")
        n = -(-keys.count() // AT_ONCE)
        mine = [F.pmod(F.xxhash64("src"), F.lit(n)) == i for i in range(n)]
        return [(m, _slots(keys.filter(m).toArrow())) for m in mine]

    def _over(self, rows: DataFrame, keys: DataFrame, run, schema: str) -> DataFrame:
        """``run`` (a function of the broadcast keys) over the rows, once for each block of keys; a row is in one block."""
        out = None
        for mine, known in self._blocks(keys):
            part = rows.filter(mine).mapInArrow(run(rows.sparkSession.sparkContext.broadcast(known)), schema)
            out = part if out is None else out.unionByName(part)
        return out

    def found(self) -> DataFrame:
        """(k, line_no) of lines in a frequent cluster whose letters alone reach the frequency."""

        def run(known):
            def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    src, key = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (2, 3))
                    yield b.select([0, 1]).filter(pa.array(_in(known.value, mix64(key + mix64(src)))))

            return keep

        exact = self.frequent_clusters().join(self.nodes.filter("enough").select("src", "line_key"), ["src", "line_key"], "left_semi")
        return self._over(self.lines.select("k", "line_no", "src", "line_key"), exact, run, f"k {dict(self.rows.dtypes)['k']}, line_no int").distinct()

    def cleaned(self) -> DataFrame:
        """(k, text, n_removed): every row without the lines of frequent clusters."""

        def run(known):
            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    texts, srcs = b.column(2).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    for s, e in sj.steps(texts):
                        part = texts[s:e]
                        x = Lines(part, bands=False)
                        gone = np.flatnonzero((x.n > 0) & _in(known.value, mix64(x.key + mix64(srcs[s:e])[x.doc])))
                        lines: dict[int, set] = {}
                        for d, i in zip(x.doc[gone].tolist(), x.line_no[gone].tolist(), strict=True):
                            lines.setdefault(d, set()).add(i)
                        for d, drop in lines.items():
                            part[d] = "\n".join(t for i, t in enumerate(part[d].split("\n"), 1) if i not in drop)
                        count = np.bincount(x.doc[gone], minlength=e - s).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(part, pa.string()), pa.array(count)], ["k", "text", "n_removed"])

            return cut

        return self._over(self.rows, self.frequent_clusters(), run, f"k {dict(self.rows.dtypes)['k']}, text string, n_removed int")


def _slots(keys: pa.Table) -> np.ndarray:
    """Sorted hashes of (src, line_key)."""
    src, key = (keys.column(c).to_numpy().view(np.uint64) for c in ("src", "line_key"))
    return np.sort(mix64(key + mix64(src)))


def _in(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def manual_name(metadata: str = "metadata") -> Column:
    """``pdf_name``, or the file name in ``source_file``."""
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(F.trim(c))
    return F.coalesce(blank(F.col(f"{metadata}.pdf_name")), blank(F.regexp_extract(F.col(f"{metadata}.source_file"), r"([^/\\]+)[/\\]*$", 1)))
