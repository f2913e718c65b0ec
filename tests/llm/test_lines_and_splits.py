"""Problems 4 and 5 against brute force, and their edges."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from docloom.llm import near_heads as nh
from docloom.llm import repeated_lines as rl
from docloom.llm import splitting as sp


def greedy(text, limit, overlap):
    """Pieces by a walk from cut to cut."""
    most, back = sp.words_for(limit), sp.words_for(overlap) if overlap else 0
    w = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    n = len(w)
    natural = [i == n - 1 or text[w[i][1] - 1] in ".!?" or "\n" in text[w[i][1] : w[i + 1][0]] for i in range(n)]
    ends, start = [], 0
    for i in range(n):
        if natural[i]:
            ends += list(range(start + 1, i + 1)) if i + 1 - start > most else []
            ends.append(i + 1)
            start = i + 1
    out, s, before = [], 0, 0
    while n:
        e = max(x for x in ends if x <= s + most)
        out.append((w[s][0], w[e - 1][1], not natural[e - 1], before - s, s == 0 or natural[s - 1]))
        if e == n:
            return out
        low = max(e - back, min(x for x in ends if x > e) - most, 0)
        near = min([x for x in range(low, e) if x == 0 or natural[x - 1]], default=e)
        s, before = near if near == low or (near < e and 2 * (e - near) >= back) else low, e
    return out


@settings(max_examples=200, deadline=None)
@given(hs.lists(hs.text(alphabet="ab.! \n ", max_size=200), min_size=1, max_size=6), hs.integers(4, 30), hs.integers(0, 12))
def test_cuts_match_a_walk(texts, limit, overlap):
    overlap = min(overlap, limit - 3)
    x = sp.cut(texts, limit, overlap)
    got = defaultdict(list)
    for i, s, e, h, p, n, o, k in zip(x["item"], x["start"], x["end"], x["hard"], x["piece"], x["words"], x["shared"], x["natural"], strict=True):
        assert p == len(got[i]) and 4 * n // 3 <= limit
        got[i].append((s, e, h, o, k))
    for i, t in enumerate(texts):
        assert got[i] == (greedy(t, limit, overlap) if t.split() else []), t


@pytest.mark.parametrize("length", [20, 40, 60, 100])
def test_long_sentences_still_overlap(length):
    text = " ".join("w" * 3 + ("." if i % length == length - 1 else "") for i in range(3000))
    x = sp.cut([text], 512, 50)
    assert (x["shared"][1:] >= 19).all() and (x["shared"][1:] <= 38).all() and not x["hard"].any()
    assert (x["natural"] == [s == 0 or text[s - 2] == "." for s in x["start"]]).all()


def test_overlap_gives_way_to_the_limit():
    text = " ".join("w" + ("." if i % 380 == 379 else "") for i in range(3 * 380))
    x = sp.cut([text], 512, 50)
    assert x["words"].tolist() == [380, 384, 384] and x["shared"].tolist() == [0, 4, 4]
    with pytest.raises(ValueError):
        sp.cut([text], 50, 50)


def test_split_edges(spark):
    words = " ".join(f"w{i}" for i in range(385))
    rows = [("a", None), ("b", ""), ("c", "word " * 384), ("d", words), ("e", "One sentence here. " * 200), (None, "x. " * 400), ("f", "word\n" * 50_000)]
    df = spark.createDataFrame(rows, "key string, text string").withColumn("piece", F.lit(1))
    out = sp.split_oversized(df, ["key"], F.col("text")).collect()
    hard = defaultdict(bool)
    for r in out:
        hard[r.key] |= r.hard
        assert r.n_tokens <= 512 and r.piece_text == dict((k, t) for k, t in rows)[r.key][r.piece_start : r.piece_end]
    assert hard == {"d": True, "e": False, None: False, "f": False}
    assert sp.split_oversized(df.limit(0), ["key"], F.col("text")).collect() == []


def test_section_lines_come_in_order(spark):
    df = spark.createDataFrame([(1, [(2, "b"), (1, "a"), (3, None)]), (2, []), (3, None)], "id int, l array<struct<line_no:int,text:string>>")
    assert [r.t for r in df.select(sp.lines_text(F.col("l")).alias("t"), "id").orderBy("id").collect()] == ["a\nb", "", None]


def _key(line):
    return "".join(c for c in line.lower() if c.isalpha())


def brute(rows, least, share):
    size, df, places = defaultdict(int), defaultdict(set), defaultdict(list)
    for k, text, source in rows:
        size[source] += 1
        for n, line in enumerate((text or "").split("\n"), 1):
            if _key(line):
                df[source, _key(line)].add(k)
                places[source, _key(line)].append((k, n))
    return {p for s, keys in df.items() if len(keys) >= least and len(keys) >= share * size[s[0]] for p in places[s]}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines_match_counting(spark, seed):
    rng = random.Random(seed)
    furniture = ["© 20{} All rights reserved.", "Page {} of the guide", "ab", "Was this section helpful?"]
    rows = []
    for i in range(160):
        lines = [rng.choice([rng.choice(furniture).format(rng.randint(1, 99)), rng.choice(furniture).upper().format(1), " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('ijklmn')}x" for _ in range(6)), "123", ""]) for _ in range(rng.randint(0, 7))]
        rows.append((f"c{i}", "\n".join(lines), rng.choice(["m1", "m1", "m1", "m2", "m3"])))
    df = spark.createDataFrame(rows, "id string, text string, m string").repartition(6)
    x = rl.RepeatedLines(df, F.col("id"), F.col("text"), F.col("m"), least=5, share=0.1)
    assert {(r.k, r.line_no) for r in x.found().collect()} == brute(rows, 5, 0.1)


def test_near_equal_lines_are_removed(spark):
    rows = [(f"c{i}", f"text number {i} about {'abcdefghijkl'[i % 12] * 7}\nContact the {name} desk for help with this manual and its parts\nend", "m") for i, name in enumerate(["Kelnor"] * 9 + ["Kelnar"] * 9)]
    x = rl.RepeatedLines(spark.createDataFrame(rows, "id string, text string, m string"), F.col("id"), F.col("text"), F.col("m"), least=15, share=0.1)
    cleaned = {r.k: r.text for r in x.cleaned().collect()}
    assert all("desk" not in t and t.startswith("text number") for t in cleaned.values()) and len(cleaned) == 18
    assert {n for _, n in {(r.k, r.line_no) for r in x.found().collect()}} == {3}  # no single spelling is frequent enough


def test_clusters_recall_against_brute_force(spark):
    """Edited copies of some lines, none frequent by its letters: those that brute force clusters are found in at least 95 of 100."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    bases = [" ".join(word() for _ in range(rng.randint(8, 14))) for _ in range(12)]
    rows = []
    for i in range(400):
        lines = [" ".join(word() for _ in range(8)) for _ in range(2)]
        for base in rng.sample(bases, 4):
            w = base.split()
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = word()
            lines.append(" ".join(w))
        rows.append((f"c{i}", "\n".join(lines), "m"))
    every = [(k, n, _key(x)) for k, t, _ in rows for n, x in enumerate(t.split("\n"), 1)]
    masks = sorted({m for _, _, m in every})
    grams = {m: {m[i : i + 5] for i in range(len(m) - 4)} for m in masks}
    docs = defaultdict(set)
    for k, _, m in every:
        docs[m].add(k)
    near = {b: [m for m in masks if len(grams[m] & grams[b]) >= 0.8 * len(grams[m] | grams[b])] for b in {_key(x) for x in bases} if b in grams}
    gone = {m for members in near.values() if len(set().union(*(docs[m] for m in members))) >= 40 for m in members}
    want = {(k, n) for k, n, m in every if m in gone}
    x = rl.RepeatedLines(spark.createDataFrame(rows, "id string, text string, m string").repartition(4), F.col("id"), F.col("text"), F.col("m"), least=40, share=0.1)
    removed = {r.k: r.text.split("\n") for r in x.cleaned().collect()}
    got = {(k, n) for k, t, _ in rows for n, line in enumerate(t.split("\n"), 1) if line not in removed[k]}
    assert len(want) > 500 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_a_line_meets_a_head_that_is_not_the_commonest_of_its_buckets(spark, monkeypatch):
    """All lines in one bucket, under a commoner one that is near to none: variants of one line still come together."""

    class OneBucket(rl.Lines):
        def __init__(self, texts, bands=True):
            super().__init__(texts, bands)
            if bands:
                self.keys[:, 1:] = 1

    monkeypatch.setattr(rl, "Lines", OneBucket)
    words = "contact the service desk for help with this manual and all of its parts before you call".split()
    variants = [" ".join([*words[:i], w, *words[i:]]) for i, w in enumerate(["or", "an", "it", "we"])]
    rows = [(f"c{i}", "\n".join(["A commoner line of another kind stands here"] * (i < 30) + [variants[i % 4]] + [f"body {'abcdefghijklmnopqrst'[i % 20] * 9} {'abcdefghijklmnopqrst'[i // 20] * 9}"]), "m") for i in range(40)]
    x = rl.RepeatedLines(spark.createDataFrame(rows, "id string, text string, m string").repartition(3), F.col("id"), F.col("text"), F.col("m"), least=25, share=0.1)
    assert {r.k: r.n_removed for r in x.cleaned().collect()} == {f"c{i}": 1 + (i < 30) for i in range(40)}


@pytest.mark.parametrize("seed", [1, 2])
def test_heads_of_lines_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    sets = {}
    for g in (1, 2):
        for _ in range(25):
            base = [word() for _ in range(rng.randint(3, 40))]
            for _ in range(6):
                w = list(base)
                for _ in range(rng.randint(0, 2)):
                    w[rng.randrange(len(w))] = word()
                sets[g, "".join(w)] = rng.randint(1, 30)
    sets[1, "abc"] = 5  # too short for a run
    grams = {m: {m[i : i + 5] for i in range(len(m) - 4)} for _, m in sets}
    around = {(g, m): [o for h, o in sets if h == g and (o == m or 10 * len(grams[m] & grams[o]) >= 8 * len(grams[m] | grams[o]) > 0)] for g, m in sets}
    want = {k: max(around[k], key=lambda o: (sets[k[0], o], o)) for k in sets}
    rows = spark.createDataFrame([(g, m, n) for (g, m), n in sets.items()], "grp long, id string, n long")
    heads, clusters = nh.near_heads(rows.mapInArrow(rl._gram_lists(), "grp long, id string, n long, set array<long>"), 0.8, rl.gram_sets)
    assert {(r.grp, r.id): r.head for r in heads.collect()} == want
    assert sorted((r.grp, r.id, r.head) for r in clusters.collect()) == sorted({(k[0], m, h) for k, h in want.items() for m in around[k[0], h]})


def test_names_and_dates_are_masked():
    x = rl.Lines(["Ask Kelnor about it on 3 March 2024\nAsk Tarvel about it on 12 May 2023\nGetting Started With Routing\nASK KELNOR about it"])
    assert x.mask(0) == x.mask(1) == "askʘaboutitonʘ" and (x.keys[0, 1:] == x.keys[1, 1:]).all() and x.key[0] != x.key[1]
    assert x.mask(2) == "gettingstartedwithrouting" and x.mask(3) == "askkelnoraboutit"


def test_letters_alike_in_other_cases_count_together(spark):
    df = spark.createDataFrame([(f"c{i}", "see the page of Kelnor here" if i % 2 else "See The Page Of KELNOR Here", "m") for i in range(6)], "id string, text string, m string")
    x = rl.RepeatedLines(df, F.col("id"), F.col("text"), F.col("m"))
    assert {r.k for r in x.found().collect()} == {f"c{i}" for i in range(6)}


def test_keys_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(rl, "AT_ONCE", 2)
    df = spark.createDataFrame([(f"{m}{i}", f"Line of {'abc'[i % 3]} here\nrow " + "abcdefghijklmnopqr"[i] * 9, m) for m in "mnop" for i in range(18)], "id string, text string, m string")
    x = rl.RepeatedLines(df, F.col("id"), F.col("text"), F.col("m"))
    assert {r.k: r.n_removed for r in x.cleaned().collect()} == {f"{m}{i}": 1 for m in "mnop" for i in range(18)}
    assert {(r.k, r.line_no) for r in x.found().collect()} == {(f"{m}{i}", 1) for m in "mnop" for i in range(18)}


def test_repeated_line_edges(spark):
    rows = [("a", None, "m"), ("b", "", "m"), (None, "x y\nz", "m"), ("c", "line here\nline here", None), ("d", "42\n--", "m")] + [(f"e{i}", "Same line\n" * 2 + "z" * 100_000, "m") for i in range(6)]
    df = spark.createDataFrame(rows, "id string, text string, m string").withColumn("src", F.lit(1)).withColumn("bands", F.lit("x"))
    x = rl.RepeatedLines(df, F.col("id"), F.col("text"), F.col("m"))
    assert {(r.k, r.line_no) for r in x.found().collect()} == {(f"e{i}", n) for i in range(6) for n in (1, 2, 3)}
    assert {r.k: r.n_removed for r in x.cleaned().collect()} == {"a": 0, "b": 0, "d": 0} | {f"e{i}": 3 for i in range(6)}
    empty = rl.RepeatedLines(df.limit(0), F.col("id"), F.col("text"), F.col("m"))
    assert empty.found().collect() == [] and empty.cleaned().collect() == []


def test_manual_name(spark):
    df = spark.createDataFrame([("p.pdf", "x/y.pdf"), (" ", "x/y.pdf"), (None, "z.pdf"), (None, None)], "pdf_name string, source_file string").select(F.struct("*").alias("metadata"))
    assert [r.x for r in df.select(rl.manual_name().alias("x")).collect()] == ["p.pdf", "y.pdf", "z.pdf", None]
