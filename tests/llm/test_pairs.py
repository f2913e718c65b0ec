"""Problems 1 and 6 against brute force, and their edges."""

import random
import re

import numpy as np
import pytest

from docloom.llm import near_duplicates as nd
from docloom.llm import setjoin as sj
from docloom.llm import split_overlap as so


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def sets(t, width):
    w = words(t)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jac(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], ["new"], [w[i], "x"], [w[i].upper() + ","]])
    return " ".join(w)


def corpus(seed, n=120, vocabulary=60, length=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            out.append(edited(rng, rng.choice(out), rng.randint(0, 6)) or "x")
        else:
            # a template that every text shares, so that frequent shingles exist
            out.append("all texts begin with this line " + " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, length))))
    return out


@pytest.mark.parametrize(("width", "t", "seed"), [(3, 0.5, 1), (5, 0.8, 2), (1, 0.6, 3), (3, 0.34, 4)])
def test_near_duplicates_lose_no_pair(spark, width, t, seed):
    texts = corpus(seed)
    rows = [(f"k{i:03d}", x) for i, x in enumerate(texts)]
    s = [sets(x, width) for x in texts]
    want = {(rows[i][0], rows[j][0]) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] | s[j] and jac(s[i], s[j]) >= t}
    got = nd.near_duplicate_pairs(spark.createDataFrame(rows, "key string, text string").repartition(5), "key", "text", width, t).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_one_hot_group_of_copies_and_near_copies(spark):
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, base) for i in range(60)] + [(100 + i, edited(rng, base, 2)) for i in range(30)] + [(300 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(80))) for i in range(60)]
    members, links = nd.near_duplicate_classes(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 0.5)
    m = {r.k: r.cls for r in members.collect()}
    assert len({m[i] for i in range(60)}) == 1 and len(m) == 150
    linked = {frozenset((r.ca, r.cb)) for r in links.collect()}
    texts = {m[k]: x for k, x in rows}
    keys = list(texts)
    want = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[i + 1 :] if jac(sets(texts[a], 3), sets(texts[b], 3)) >= 0.5}
    assert linked == want


def test_hot_shingles_cut_into_cells_lose_no_pair(spark):
    texts = corpus(11, 100)
    s = [sets(x, 2) for x in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] | s[j] and jac(s[i], s[j]) >= 0.4}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = nd.near_duplicate_pairs(df, "id", "text", 2, 0.4, cell=5).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    rows = [(i, x, "train" if i % 3 else "val") for i, x in enumerate(texts)]
    w = [set(words(x)) for x in texts]
    want = {(i, j) for i, _, a in rows for j, _, b in rows if a == "train" and b == "val" and jac(w[i], w[j]) >= 0.7}
    found = so.cross_split_pairs(spark.createDataFrame(rows, "id int, q string, split string"), "id", "split", ["q"], cell=5).collect()
    assert {(r.train, r.eval) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("turn", [1, -1])
def test_a_key_with_two_texts_stands_for_both(spark, turn):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(1, one, "train"), (1, two, "train"), (2, one + " more", "test"), (3, two + " more", "test")][::turn]
    df = spark.createDataFrame(rows, "id int, text string, split string").coalesce(1)
    assert {(r.a, r.b) for r in nd.near_duplicate_pairs(df, "id", "text", 3, 0.5).collect()} == {(1, 2), (1, 3)}
    assert {(r.train, r.eval) for r in so.cross_split_pairs(df, "id", "split", ["text"]).collect()} == {(1, 2), (1, 3)}


def test_bloom_without_room_lets_all_through(spark, monkeypatch):
    keys = spark.range(5000)
    assert sj.in_bloom(sj.bloom(keys, "id"), np.arange(5000)).all()
    assert sj.in_bloom(sj.bloom(keys, "id"), np.arange(10**6, 10**6 + 20_000)).mean() < 0.03
    monkeypatch.setattr(sj, "MOST_BLOOM", 1 << 10)
    assert sj.bloom(keys, "id") is None and sj.in_bloom(None, np.arange(9)).all()


def test_near_duplicate_edges(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [("a", None, "x", 1), (None, "one two three", "x", 1), ("b", "", "x", 1), ("c", "!!!", "x", 1), ("d", "one two", "x", 1), ("e", "one two three", "x", 1), ("e", "one two three", "x", 1), ("f", "ONE, two. Three", None, None), ("g", long, "x", 1), ("h", long + " end", "x", 1)]
    df = spark.createDataFrame(rows, "id string, text string, k string, cls int")  # other columns, with the operator's own names
    got = {(r.a, r.b) for r in nd.near_duplicate_pairs(df, "id", "text", 3, 0.5).collect()}
    assert got == {("e", "f"), ("g", "h")}
    assert nd.near_duplicate_pairs(df.limit(0), "id", "text").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_cross_split_pairs(spark, seed):
    rng = random.Random(seed)
    texts = corpus(seed, 80, 40, 20)
    rows = [(i, rng.choice(["query: ", "", "query: query: "]) + texts[i], rng.choice(["passage: ", ""]) + rng.choice(texts), rng.choice(["train", "train", "Val ", "test"]), rng.choice("ab")) for i in range(80)]
    want = set()
    for f, at in (("query", 1), ("pos", 2)):
        s = {r[0]: set(words(re.sub(r"(?i)^\s*(?:(?:query|passage)\s*:\s*)+", "", r[at]))) for r in rows}
        want |= {(a[0], b[0], f) for a in rows for b in rows if a[3] == "train" and b[3] != "train" and jac(s[a[0]], s[b[0]]) >= 0.7}
    df = spark.createDataFrame(rows, "id int, query string, pos string, split string, source string")
    got = so.cross_split_pairs(df, "id", "split", ["query", "pos"]).collect()
    assert {(r.train, r.eval, r.field) for r in got} == want and len(got) == len(want)
    report = {(r.split, r.source, r.field): (r.n_rows, r.n_overlapping) for r in so.cross_split_report(df, "id", "split", "source", ["query", "pos"]).collect()}
    for (split, source, field), (n, hit) in report.items():
        mine = [r for r in rows if r[3].strip().lower() == split and r[4] == source]
        assert n == len(mine) and hit == len({r[0] for r in mine} & {b for _, b, f in want if f == field})


def test_cross_split_edges(spark):
    rows = [(1, None, "p", "train", "s"), (2, "query: ", "p", "val", "s"), (3, "q one", None, None, "s"), (None, "q one", "p", "train", "s"), (4, "q one", "p", "train", "s"), (4, "q one", "p", "train", "s"), (5, "Q ONE", None, "TEST", None)]
    df = spark.createDataFrame(rows, "id int, query string, pos string, split string, f string")
    got = {tuple(r) for r in so.cross_split_pairs(df, "id", "split", ["query", "pos"]).collect()}
    assert got == {(4, 5, "query"), (1, 2, "pos"), (4, 2, "pos")}
    assert so.cross_split_pairs(df.limit(0), "id", "split", ["query", "pos"]).collect() == []


def test_needed_overlap_is_exact():
    for t in (0.5, 0.7, 0.8):
        for a in range(1, 40):
            for b in range(1, 40):
                least = next((o for o in range(0, min(a, b) + 1) if o / (a + b - o) >= t - 1e-12), None)
                need = int(sj.need(a, b, t))
                assert need == least or (least is None and need > min(a, b))
