"""Ranking: exact vectors, BM25, rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.kernels import counted, terms
from docloom.session import materialise

#: Bytes of query vectors sent to the executors at once; more are searched in further blocks.
QUERY_BYTES = 16_000_000
#: Pairs of a row and a query whose scores a task holds at once.
SCORES = 4_000_000
#: Most terms of questions by which postings are picked in the scan (16 MB); with more, all are written.
MOST_TERMS = 2_000_000


def dense_topk(vectors: DataFrame, queries: DataFrame, vec_key: str, query_key: str, vector: str, k: int, metric: str = "l2") -> DataFrame:
    """query_key, vec_key, score, rank: exact search; squared L2 (low is near) or cosine (high is near), ties by key.

    A stated query set runs against all rows in blocks of bounded bytes: each
    task multiplies its batches with the block's matrix and keeps k rows a
    query, by score and key, after every batch, so what it holds does not grow
    with its number of batches.  Products only pick what is near enough to be
    measured; scores come from the differences themselves.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes) | {"q": dict(queries.dtypes)[query_key]}
    asked = materialise(queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("q is not null and v is not null"), "query-vectors")
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = -(-n * max(1, dim or 1) * 8 // QUERY_BYTES) or 1
    rows = vectors.select(F.col(vec_key).alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")
    out: DataFrame | None = None
    for at in range(blocks):
        part = (asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == at) if blocks > 1 else asked).toArrow()
        matrix = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if part.num_rows else np.empty((0, 1))
        sent = spark.sparkContext.broadcast((part.column("q").combine_chunks(), matrix))
        near = rows.mapInArrow(nearest(sent, k, metric), f"q {kinds['q']}, id {kinds[vec_key]}, s double")
        out = near if out is None else out.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("s", 9), "id"))
    best = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("q").alias(query_key), F.col("id").alias(vec_key if vec_key != query_key else f"hit_{vec_key}"), F.round(F.col("s") if metric == "l2" else -F.col("s"), 6).alias("score"), "rank")


def nearest(sent, k: int, metric: str) -> Callable:
    """For mapInArrow over (id, v): the k nearest rows of the task for each query of the broadcast (ids, matrix), as (q, id, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        if not len(ids):
            return
        square = (m * m).sum(axis=1)
        kept: tuple | None = None
        edge = np.full(len(ids), np.inf)
        for whole in batches:
            step = max(1, SCORES // len(ids))
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                own = (x * x).sum(axis=1)
                s = m @ x.T
                if metric == "l2":
                    s = square[:, None] + own[None, :] - 2 * s
                    slack = 1e-9 * (1 + square[:, None] + own[None, :])
                else:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = -s / (np.sqrt(square)[:, None] * np.sqrt(own)[None, :])
                    slack = 1e-9
                if b.num_rows > k:
                    edge = np.minimum(edge, np.partition(s, k - 1, axis=1)[:, k - 1])
                qi, xi = np.nonzero(~(s > edge[:, None] + slack))
                if not len(qi):
                    continue
                exact = s[qi, xi] if metric != "l2" else np.concatenate([((m[qi[i : i + 20_000]] - x[xi[i : i + 20_000]]) ** 2).sum(axis=1) for i in range(0, len(qi), 20_000)])
                new = (qi, exact, b.column(0).take(pa.array(xi)))
                kept = best_of(k, *([np.concatenate([kept[0], new[0]]), np.concatenate([kept[1], new[1]]), pa.concat_arrays([kept[2], new[2]])] if kept else new))
                count = np.bincount(kept[0], minlength=len(ids))
                worst = np.full(len(ids), -np.inf)
                np.maximum.at(worst, kept[0], kept[1])
                edge = np.where(count >= k, np.minimum(edge, worst), edge)
        if kept:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept[0])), kept[2], pa.array(kept[1])], ["q", "id", "s"])

    return run


def best_of(k: int, q: np.ndarray, s: np.ndarray, found: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of (query, score, id) the k lowest of each query, ties by id."""
    place = np.empty(len(q), np.int64)
    place[pa.compute.sort_indices(found).to_numpy()] = np.arange(len(q))
    order = np.lexsort((place, np.round(s, 9), q))
    q = q[order]
    at = np.arange(len(q)) - np.searchsorted(q, q)
    order = order[at < k]
    return q[at < k], s[order], found.take(pa.array(order))


def _postings(known) -> Callable:
    """For mapInArrow over (d, text): known terms of each text, and per task the document count of each term and the sizes.

    Rows of three kinds in one table: (d, len, terms, tfs) of texts that hold a
    known term, (term, df) with no d, and (n, len) of the task with neither.
    """
    names = ["d", "len", "terms", "tfs", "term", "df", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size, kind = [], 0, 0, None
        none = lambda m, t=pa.int64(): pa.nulls(m, t)
        many = pa.list_(pa.int64())

        def count(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[at], np.add.reduceat(n, at)

        def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            m = len(h)
            return pa.RecordBatch.from_arrays([none(m, kind), none(m), none(m, many), none(m, many), pa.array(h.view(np.int64)), pa.array(n), none(m)], names)

        for b in batches:
            kind = b.column(0).type
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                row, h, n = terms(part.column(1).to_pylist())
                docs, size = docs + part.num_rows, size + int(n.sum())
                row, h, tf = counted(row, h)
                held.append((h, np.ones(len(h), np.int64)))
                if sum(len(x) for x, _ in held) > 2_000_000:
                    held = [count(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > 1_000_000:
                        yield rows(*held[0])
                        held = []
                if known.value is not None:
                    ok = _member(known.value, h)
                    row, h, tf = row[ok], h[ok], tf[ok]
                at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
                if m := len(at):
                    edge = pa.array(np.append(at, len(row)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (h.view(np.int64), tf)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at])), pa.array(n[row[at]]), *lists, none(m), none(m), none(m)], names)
        if sum(len(x) for x, _ in held):
            yield rows(*count(*(np.concatenate(x) for x in zip(*held, strict=True))))
        if docs:
            yield pa.RecordBatch.from_arrays([none(1, kind), pa.array([size], pa.int64()), none(1, many), none(1, many), none(1), none(1), pa.array([docs], pa.int64())], names)

    return run


def _scored(sent, k: int, k1: float, b: float, mean: float) -> Callable:
    """For mapInArrow over (d, len, terms, tfs): the k best texts of the task for each question of the broadcast (ids, terms, edges, question, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, edge, question, weight = sent.value
        n, kept = len(ids), None
        if not n or not len(known):
            return
        for whole in batches:
            step = max(1, SCORES // n)
            for part in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                size = part.column(1).to_numpy().astype(np.float64)
                row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column(2)).to_numpy())
                h, tf = (part.column(i).flatten().to_numpy() for i in (2, 3))
                at = np.minimum(np.searchsorted(known, h.view(np.uint64)), len(known) - 1)
                ok = known[at] == h.view(np.uint64)
                row, at, tf = row[ok], at[ok], tf[ok].astype(np.float64)
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / mean))
                # each posting once for every question that has its term
                many = edge[at + 1] - edge[at]
                of = np.repeat(np.arange(len(at)), many)
                j = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(edge[at], many)
                cell = row[of] * n + question[j]
                score = np.round(np.bincount(cell, gain[of] * weight[j], minlength=part.num_rows * n), 6)
                found = np.flatnonzero(np.bincount(cell, minlength=part.num_rows * n))
                if not len(found):
                    continue
                q, d = found % n, found // n
                if part.num_rows > k:  # below the k-th best of these rows nothing counts
                    table = np.full((n, part.num_rows), -np.inf)
                    table[q, d] = score[found]
                    least = np.partition(table, part.num_rows - k, axis=1)[:, part.num_rows - k]
                    near = score[found] >= least[q]
                    q, d, found = q[near], d[near], found[near]
                new = (q, -score[found], part.column(0).take(pa.array(d)))
                kept = best_of(k, *([np.concatenate([kept[0], new[0]]), np.concatenate([kept[1], new[1]]), pa.concat_arrays([kept[2], new[2]])] if kept else new))
        if kept:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept[0])), kept[2], pa.array(-kept[1])], ["q", "d", "score"])

    return run


def _member(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _query_terms(queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """(q, term, times); an id that repeats has the terms of each of its rows."""
    rows = queries.select(F.col(query_key).alias("q"), F.col(query).alias("t")).filter("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h, n = counted(*terms(b.column(1).to_pylist())[:2])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(n)], ["q", "term", "times"])

    return rows.mapInArrow(run, f"q {dict(rows.dtypes)['q']}, term long, times long")


class LexicalIndex:
    """What BM25 needs of a corpus for some sets of questions, from one scan: each text is cut into terms once.

    ``sets`` are (queries, query_key, query) that will be asked.  Their terms
    pick the postings that leave the scan, a row per text; document
    frequencies and lengths come from the whole corpus, added up in each task
    before they move.  A ranking reads the postings without a shuffle: each
    task scores its texts for a block of questions and hands on k of each.
    """

    def __init__(self, docs: DataFrame, doc_key: str, text: str, sets: list[tuple[DataFrame, str, str]]):
        self.spark = docs.sparkSession
        rows = docs.filter(F.col(text).isNotNull() & F.col(doc_key).isNotNull()).select(F.col(doc_key).alias("d"), F.col(text).alias("t"))
        self.doc_key, self.kind = doc_key, dict(rows.dtypes)["d"]
        self.asked = [materialise(_query_terms(*s), "query-terms") for s in sets]
        #: the terms of a set that fits one block are read once
        self.whole = [x.limit(QUERY_BYTES // 32 + 1).toArrow() for x in self.asked]
        self.whole = [x if x.num_rows <= QUERY_BYTES // 32 else None for x in self.whole]
        every = [(w if w is not None else x.select("term").distinct().limit(MOST_TERMS + 1).toArrow()).column("term").to_numpy().view(np.uint64) for w, x in zip(self.whole, self.asked, strict=True)]
        wanted = np.unique(np.concatenate(every))
        known = self.spark.sparkContext.broadcast(wanted if len(wanted) <= MOST_TERMS else None)
        table = materialise(rows.mapInArrow(_postings(known), f"d {self.kind}, len long, terms array<long>, tfs array<long>, term long, df long, n long"), "postings")
        self.postings = table.filter("terms is not null").select("d", "len", "terms", "tfs")
        sums = table.filter("terms is null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("len").alias("len"))
        self.df = materialise(sums, "document-frequencies")
        # terms of one frequency have one idf; the row of the sizes has none
        by = self.df.groupBy("df").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("len").alias("len")).toArrow().to_pydict()
        size = [(n, w) for f, n, w in zip(by["df"], by["n"], by["len"], strict=True) if f is None]
        self.n_docs, self.mean_len = (size[0][0], size[0][1] / size[0][0] or 1.0) if size else (0, 1.0)
        f, c = (np.array([x for x, y in zip(by[k], by["df"], strict=True) if y is not None], np.float64) for k in ("df", "c"))
        self.mean_idf = float((self._idf(f) * c).sum() / c.sum()) if len(f) else 0.0
        self.known = self._weights(wanted) if len(wanted) <= MOST_TERMS else None

    def _idf(self, df: np.ndarray) -> np.ndarray:
        return np.log(self.n_docs - df + 0.5) - np.log(df + 0.5)

    def _weights(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms among ``wanted`` that the corpus has, sorted, and their document frequencies."""
        table = self.spark.createDataFrame(pa.table({"term": pa.array(np.unique(wanted).view(np.int64))}))
        found = self.df.select("term", "df").join(table, "term").toArrow()
        term = found.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        return term[order], found.column("df").to_numpy()[order].astype(np.float64)

    def topk(self, number: int, query_key: str, k: int, k1: float, b: float, epsilon: float) -> DataFrame:
        """The ranking for the questions of set ``number``."""
        asked, whole = self.asked[number], self.whole[number]
        blocks = 1 if whole is not None else -(-asked.count() * 32 // QUERY_BYTES)
        schema, out = f"q {dict(asked.dtypes)['q']}, d {self.kind}, score double", None
        for at in range(blocks):
            part = whole if whole is not None else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == at).toArrow()
            term, times = part.column("term").to_numpy().view(np.uint64), part.column("times").to_numpy()
            have, df = self.known or self._weights(term)
            ok = np.flatnonzero(_member(have, term))
            idf = self._idf(df[np.searchsorted(have, term[ok])])
            weight = np.where(idf < 0, epsilon * self.mean_idf, idf) * times[ok]
            ids = part.column("q").combine_chunks().dictionary_encode()
            order = np.argsort(term[ok], kind="stable")
            known, first = np.unique(term[ok][order], return_index=True)
            question = ids.indices.to_numpy()[ok][order].astype(np.int64)
            sent = self.spark.sparkContext.broadcast((ids.dictionary, known, np.append(first, len(order)), question, weight[order]))
            near = self.postings.mapInArrow(_scored(sent, k, k1, b, self.mean_len), schema)
            out = near if out is None else out.unionByName(near)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "d"))
        return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), F.col("d").alias(self.doc_key), "score", "rank")


def bm25_lists(docs: DataFrame, sets: list[tuple[DataFrame, str, str, int]], doc_key: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> list[DataFrame]:
    """A ranking for each of ``sets`` (queries, query_key, query, k), as ``bm25_topk``, from one scan of the corpus."""
    index = LexicalIndex(docs, doc_key, text, [s[:3] for s in sets])
    return [index.topk(i, s[1], s[3], k1, b, epsilon) for i, s in enumerate(sets)]


def bm25_topk(docs: DataFrame, queries: DataFrame, doc_key: str, text: str, query_key: str, query: str, k: int = 50, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_key, doc_key, score, rank: Okapi BM25 over white-space tokens, case kept; ties by key.

    A term in more than half of the corpus gets ``epsilon`` times the mean idf.
    """
    return bm25_lists(docs, [(queries, query_key, query, k)], doc_key, text, k1, b, epsilon)[0]


def fuse(lists: list[DataFrame], query: str, key: Column | str, payload: list[str], constant: int = 60, k: int = 20) -> DataFrame:
    """query, payload, score, rank: reciprocal rank fusion.

    Rows meet under ``key``.  In each list the last row of a key gives its
    rank; of all, the last gives the payload, and the first its place among
    equal scores.  A missing list adds nothing.
    """
    every = None
    for i, rows in enumerate(lists):
        part = rows.select(query, (F.col(key) if isinstance(key, str) else key).alias("_key"), F.lit(i).alias("_list"), F.col("rank").alias("_rank"), *payload)
        every = part if every is None else every.unionByName(part)
    worst = [F.max(F.when(F.col("_list") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(lists))]
    met = every.groupBy(query, "_key").agg(*worst, F.max(F.struct("_list", "_rank", *payload)).alias("_last"), F.min(F.struct("_list", "_rank")).alias("_first"))
    score = sum((F.coalesce(F.lit(1.0) / (constant + F.col(f"_r{i}")), F.lit(0.0)) for i in range(len(lists))), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), "_first"))
    scored = met.withColumn("score", F.round(score, 9)).withColumn("rank", rank).filter(F.col("rank") <= k)
    return scored.select(query, *[F.col(f"_last.{c}").alias(c) for c in payload], "score", "rank")


def collision_key(text: Column, source: Column | None = None, page: Column | None = None) -> Column:
    """Source, page and the first 64 characters."""
    null = F.lit(None).cast("string")
    return F.concat_ws("\x1f", F.coalesce(null if source is None else source, F.lit("")), F.coalesce((null if page is None else page.cast("string")), F.lit("")), F.substring(text, 1, 64))


def overlap_score(query: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the query's distinct words that the text holds."""
    q, t = F.array_distinct(tx.words(F.lower(query))), F.array_distinct(tx.words(F.lower(text)))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def rerank(rows: DataFrame, query_key: str, score: Column, k: int = 4) -> DataFrame:
    """The best k by a scorer; equal scores keep their former rank."""
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("rerank_score").desc(), "fused_rank"))
    return rows.withColumnRenamed("rank", "fused_rank").withColumn("rerank_score", F.round(score, 6)).withColumn("rank", rank).filter(F.col("rank") <= k)
