import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import kernels as kn
from docloom.operators import context as cx
from docloom.operators import models as md
from docloom.operators import retrieval as rt


def test_dense_topk_with_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (120, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in (0, 50)], "q int, v array<double>")
    got = rt.dense_topk(df, q, "id", "q", "v", 7).collect()
    for i in (0, 50):
        want = sorted(range(len(v)), key=lambda j: (((v[j] - v[i]) ** 2).sum(), j))[:7]
        assert [r.id for r in sorted((r for r in got if r.q == i), key=lambda r: r.rank)] == want
    assert rt.dense_topk(df, q.limit(0), "id", "q", "v", 7).count() == 0
    assert rt.dense_topk(df.limit(0), q, "id", "q", "v", 7).count() == 0


def test_query_blocks_make_no_difference(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.random(3).tolist()) for i in range(30)], "id int, v array<double>")
    q = df.withColumnRenamed("id", "q")
    whole = sorted(map(tuple, rt.dense_topk(df, q, "id", "q", "v", 3).collect()))
    monkeypatch.setattr(rt, "QUERY_BYTES", 200)
    assert sorted(map(tuple, rt.dense_topk(df, q, "id", "q", "v", 3).collect())) == whole


def test_bm25_against_the_formula(spark):
    docs = {1: "a b c a", 2: "b c", 3: "A a d e f g", 4: "c c c", 5: "", 6: "b d"}
    queries = {1: "a c c", 2: "zzz", 3: "b"}
    n = len(docs)
    words = {k: v.split() for k, v in docs.items()}
    mean = sum(map(len, words.values())) / n
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: eps if x < 0 else x for t, x in idf.items()}
    want = {}
    for q, text in queries.items():
        for d, w in words.items():
            tf = Counter(w)
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in text.split() if t in tf)
            if any(t in tf for t in text.split()):
                want[q, d] = round(s, 6)
    d = spark.createDataFrame(list(docs.items()), "d int, t string")
    q = spark.createDataFrame(list(queries.items()), "q int, t string")
    got = {(r.q, r.d): r.score for r in rt.bm25_topk(d, q, "d", "t", "q", "t", k=50).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_fusion_against_a_fold(spark):
    rng = random.Random(5)
    for trial in range(4):
        lists = [[f"{rng.choice('abcd') * 64}{rng.randint(0, 3)}" for _ in range(8)] for _ in range(2)]
        rank, docs, order = [{}, {}], {}, []
        for i, rows in enumerate(lists):
            for r, text in enumerate(rows, 1):
                key = text[:64]
                rank[i][key] = r
                if key not in docs:
                    order.append(key)
                docs[key] = text
        want = sorted(order, key=lambda k: -round(sum(1 / (60 + r[k]) for r in rank if k in r), 9))
        frames = [spark.createDataFrame([(1, t, r) for r, t in enumerate(x, 1)], "q int, text string, rank int") for x in lists]
        got = rt.fuse(frames, "q", rt.collision_key(F.col("text")), ["text"]).orderBy("rank").collect()
        assert [r.text for r in got] == [docs[k] for k in want], trial


def test_packing_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(q, r, rng.choice(["  ", "", "x" * 230 + "tail", "x" * 230 + "other", "y" * rng.randint(1, 300), " z" * rng.randint(1, 80)]), f"c{q}.{r}") for q in range(30) for r in range(1, 13)]
    want = {}
    for q in range(30):
        seen, used, held = set(), [], 0
        for _, _, text, chunk in (x for x in rows if x[0] == q):
            if not text.strip() or text[:200] in seen:
                continue
            seen.add(text[:200])
            if used and held + len(text) > 500:
                break
            used.append(chunk)
            held += len(text.strip())
        want[q] = used
    df = spark.createDataFrame(rows, "q int, rank int, text string, chunk string")
    got = {}
    for r in cx.used_chunks(df, "q", "text", max_chars=500).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append(r.chunk)
    assert got == {q: u for q, u in want.items() if u}


def test_stand_ins(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    v = [r.v for r in df.select(md.embed(F.col("t"), md.hashing_embedder).alias("v")).collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[1])

    def flaky():
        calls = []

        def model(texts):
            calls.append(1)
            if len(calls) < 2:
                raise RuntimeError("busy")
            return [t.upper() for t in texts]

        return model

    assert [r.x for r in df.limit(1).select(md.complete(F.col("t"), flaky).alias("x")).collect()] == ["A B"]
    failing = lambda: lambda texts: 1 / 0
    assert [r.x for r in df.limit(1).select(md.complete(F.col("t"), failing).alias("x")).collect()] == [None]


def test_a_dense_task_holds_k_rows_a_query(monkeypatch):
    """What a task holds after a batch does not grow with the number of batches, ties included."""

    class Sent:
        value = (pa.array([7, 8]), np.array([[1.0, 0.0], [0.0, 1.0]]))

    held = []
    monkeypatch.setattr(rt, "best_of", lambda *a, of=rt.best_of: held.append(len(of(*a)[0])) or of(*a))
    rng = np.random.default_rng(1)
    x = np.round(rng.random((200, 50, 2)), 1)  # many ties
    batches = (pa.RecordBatch.from_pydict({"id": list(range(i * 50, i * 50 + 50)), "v": x[i].tolist()}) for i in range(200))
    (out,) = rt.nearest(Sent, 5, "l2")(batches)
    assert max(held) <= 10 and len(held) < 200
    flat = x.reshape(-1, 2)
    for q, v in zip((7, 8), Sent.value[1], strict=True):
        want = sorted((round(float(((v - y) ** 2).sum()), 9), i) for i, y in enumerate(flat))[:5]
        assert [(round(r["s"], 9), r["id"]) for r in out.to_pylist() if r["q"] == q] == want


def test_query_blocks_make_no_difference(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.random((60, 4)))], "id int, v array<float>")
    q = v.filter("id % 5 = 0").withColumnRenamed("id", "q")
    whole = sorted(map(tuple, rt.dense_topk(v, q, "id", "q", "v", 3).collect()))
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c") for i in range(50)] + [(99, None), (None, "a1")], "d int, t string")
    asked = spark.createDataFrame([(i, f"a{i} b{i} b{i} zz") for i in range(7)] + [(8, None), (9, "")], "q int, t string")
    lists = sorted(map(tuple, rt.bm25_topk(docs, asked, "d", "t", "q", "t", k=4).collect()))
    monkeypatch.setattr(rt, "QUERY_BYTES", 64)
    assert sorted(map(tuple, rt.dense_topk(v, q, "id", "q", "v", 3).collect())) == whole
    assert sorted(map(tuple, rt.bm25_topk(docs, asked, "d", "t", "q", "t", k=4).collect())) == lists
    monkeypatch.setattr(rt, "MOST_TERMS", 3)
    assert sorted(map(tuple, rt.bm25_topk(docs, asked, "d", "t", "q", "t", k=4).collect())) == lists
    assert rt.bm25_topk(docs.limit(0), asked, "d", "t", "q", "t").collect() == [] and rt.bm25_topk(docs, asked.limit(0), "d", "t", "q", "t").collect() == []


def test_terms_are_white_space_runs(spark):
    texts = ["a b  a\u00a0c\n", None, "", "x" * 700_000 + " a"]
    row, h, n = kn.terms(texts)
    assert row.tolist() == [0, 0, 0, 0, 3, 3] and n.tolist() == [4, 0, 0, 2] and h[0] == h[2] == h[5] and len(set(h.tolist())) == 4
    row, h, n = kn.counted(row, h)
    assert sorted(zip(row.tolist(), n.tolist())) == [(0, 1), (0, 1), (0, 2), (3, 1), (3, 1)]
