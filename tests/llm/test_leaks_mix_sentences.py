"""Problems 7, 8 and 9: brute force, held shares, planted boundaries, and edges."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from docloom.llm import contamination as cn
from docloom.llm import mixing as mx
from docloom.llm import sentences as se
from docloom.llm.tokens import Words


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@settings(max_examples=80, deadline=None)
@given(hs.lists(hs.one_of(hs.none(), hs.text(alphabet="aZé9_ -\n日ß", max_size=60)), min_size=1, max_size=8))
def test_words(texts):
    x = Words(texts)
    got = [[] for _ in texts]
    for d, s, e in zip(x.doc, x.start, x.end, strict=True):
        got[d].append(texts[d][s:e].lower())
    assert got == [words(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.integers(1, 5), min_size=1, max_size=120), hs.lists(hs.integers(1, 5), min_size=1, max_size=4))
def test_index_counts_and_locates(seq, phrase):
    text = np.array([*seq, 0])
    index = cn.FMIndex(text, 6)
    lo, hi = index.ranges(np.array([9, *phrase]), np.array([1]), len(phrase))
    want = [i for i in range(len(seq) - len(phrase) + 1) if seq[i : i + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_leaks_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(cn, "SHARD_WORDS", shard)
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randint(2, 25)))) for i in range(25)]
    docs = []
    for i in range(150):
        w = [f"{rng.choice('vz')}{rng.randrange(30)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1].split()
            s = rng.randrange(len(x))
            w[len(w) // 2 : len(w) // 2] = x[s : s + rng.randint(1, 20)]
        docs.append((i, ",  ".join(w).upper()))
    docs += [(1000 + i, items[3][1]) for i in range(60)]
    width = 6
    grams = {i: {tuple(words(t)[k : k + width]) for k in range(len(words(t)) - width + 1)} for i, t in items}
    want = {(d, i) for d, t in docs for i, g in grams.items() if g & {tuple(words(t)[k : k + width]) for k in range(len(words(t)) - width + 1)}}
    df, held = spark.createDataFrame(docs, "d long, t string"), spark.createDataFrame(items, "i long, t string")
    out = cn.leaks(df, "d", "t", held, "i", "t", width).collect()
    assert {(r.k, r.item) for r in out} == want
    texts, item_words = dict(docs), {i: " ".join(words(t)) for i, t in items}
    for r in out:
        span = words(texts[r.k][r.span_start : r.span_end])
        assert len(span) >= width and (len(span) > width * 2 or " ".join(span) in item_words[r.item] or len(span) > width)
    spans = {}
    for r in cn.removal_spans(cn.leaks(df, "d", "t", held, "i", "t", width)).collect():
        spans.setdefault(r.k, []).append((r.span_start, r.span_end))
    covered = {}
    for r in out:
        covered.setdefault(r.k, set()).update(range(r.span_start, r.span_end))
    assert {k: set().union(*(range(*s) for s in v)) for k, v in spans.items()} == covered


def test_item_blocks_make_no_difference(spark):
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(20)], "i long, t string")
    docs = spark.createDataFrame([(i, f"x a{i} b{i} c{i} d{i} y") for i in range(20)], "d long, t string")
    assert sorted((r.k, r.item) for r in cn.leaks(docs, "d", "t", items, "i", "t", 3, block_chars=60).collect()) == [(i, i) for i in range(20)]


def test_several_blocks_search_one_index(monkeypatch):
    class Here:
        def __init__(self, value):
            self.value, self.sent = value, None

        unpersist_here = cn._Block.unpersist_here

    built = []
    monkeypatch.setattr(cn, "FMIndex", lambda *a, make=cn.FMIndex: built.append(1) or make(*a))
    texts = [f"a{i} b{i} c{i}" for i in range(30)]
    blocks = [cn.Phrases(texts[i : i + 10], pa.array(range(i, i + 10)), 3, 8) for i in (0, 10, 20)]
    known = np.unique(np.concatenate([b.words for b in blocks]))
    rows = pa.RecordBatch.from_pydict({"k": list(range(30)), "t": [f"x {t} y" for t in texts]})
    out = [r for b in cn._search([Here(b) for b in blocks], Here(known), 3, 8)(iter([rows])) for r in b.to_pylist()]
    assert sorted((r["k"], r["item"]) for r in out) == [(i, i) for i in range(30)] and len(built) == 1
    every = [r for b in cn._search([Here(b) for b in blocks], Here(None), 3, 8)(iter([rows])) for r in b.to_pylist()]  # no word left out
    assert sorted(map(str, every)) == sorted(map(str, out))


def test_symbols_that_meet_by_chance_report_nothing():
    """With two symbols in all, nearly every run of words looks like a phrase; whole hashes decide."""

    class Here:
        def __init__(self, value):
            self.value = value

    p = cn.Phrases(["one two three four"], pa.array([1]), 3, 1)
    rows = pa.RecordBatch.from_pydict({"k": [1, 2], "t": ["four three two one four one two three", "one four two three one one"]})
    out = [r for b in cn._search([Here(p)], Here(p.words), 3, 1)(iter([rows])) for r in b.to_pylist()]
    assert [(r["k"], r["item"]) for r in out] == [(1, 1)]


def test_long_items_in_pieces_keep_every_phrase(spark, monkeypatch):
    monkeypatch.setattr(cn, "PIECE_CHARS", 50)
    rng = random.Random(3)
    w = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(w[i : i + 5])) for i in range(296)], "d long, t string")
    items = spark.createDataFrame([(1, "  ".join(w)), (2, "x " * 100 + "y")], "i long, t string")
    assert {r.k for r in cn.leaks(docs, "d", "t", items, "i", "t", 5, block_chars=400).collect()} == set(range(296))


def test_a_foreign_stretch_parts_two_passages(spark):
    foreign = " ".join(f"x{i}" for i in range(500))
    text = f"y a b c {foreign} d e f a b c y"
    docs = spark.createDataFrame([(1, text)], "k long, t string")
    items = spark.createDataFrame([(7, "a b c d e f")], "item long, t string")
    found = cn.leaks(docs, "k", "t", items, "item", "t", 3)
    assert sorted(text[r.span_start : r.span_end] for r in found.collect()) == ["a b c", "d e f a b c"]
    assert sorted(text[r.span_start : r.span_end] for r in cn.removal_spans(found).collect()) == ["a b c", "d e f a b c"]


def test_leak_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b c"), (3, "a b c"), (3, "a b c"), (4, "a b\nc " * 30_000)], "k long, t string")
    items = spark.createDataFrame([(7, "A, b c"), (8, None), (9, "a b"), (10, "a b c")], "item long, t string")
    got = {(r.k, r.item) for r in cn.leaks(docs, "k", "t", items, "item", "t", 3).collect()}
    assert got == {(3, 7), (3, 10), (4, 7), (4, 10)}
    assert cn.leaks(docs.limit(0), "k", "t", items, "item", "t", 3).collect() == []
    assert cn.leaks(docs, "k", "t", items.limit(0), "item", "t", 3).collect() == []


def test_mix_reaches_shares(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randint(5, 40)), s) for i, s in enumerate(["big"] * 600 + ["Small "] * 60 + ["other"] * 200 + [None] * 5)]
    df = spark.createDataFrame(docs, "id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.2, 4), ("none", 0.1, 3), ("Other", 0.4, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    plan = mx.rates(df, targets)
    got = {r.source: r for r in plan.collect()}
    assert got["small"].max_repeats == 4 and got["none"].rate == 0.0 and got["big"].rate < 1
    short = {r.source for r in mx.falling_short(plan).collect()}
    assert "none" in short and "big" not in short
    mix = mx.emit(df, plan, "id").collect()
    copies = {}
    for r in mix:
        copies[r.id] = max(copies.get(r.id, 0), r.copy)
    for i, _, s in docs:
        key = (s or "").strip().lower()
        rate = got[key].rate if key in got else 0
        assert int(rate) <= copies.get(i, 0) <= min(int(rate) + 1, 4)
    assert sorted(map(tuple, mx.emit(df.repartition(7), plan, "id").collect())) == sorted(map(tuple, mix))
    report = {r.source: r for r in mx.report(df, plan, "id").collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4
    whole = sum(r.reachable for r in got.values())
    assert abs(report["big"].actual_share - got["big"].reachable / whole) < 0.05


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", "a")], "id long, text string, source string").withColumn("rate", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    targets = spark.createDataFrame([("a", None, None), ("A ", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    plan = mx.rates(df, targets)
    assert {r.source: (r.target_share, r.max_repeats) for r in plan.collect()} == {"a": (0.5, 2), "b": (0.5, 1)}
    assert mx.emit(df, plan, "id").count() >= 0
    assert {r.source for r in mx.falling_short(mx.rates(df.limit(0), targets)).collect()} == set()
    assert mx.rates(df, targets.limit(0)).collect() == []


def test_mix_counts_stray_separators(spark):
    df = spark.createDataFrame([(1, "one two", "tessaly-forum"), (2, "one two", " Tessaly_Forum"), (3, "one two", "tessaly forum"), (4, "one two", "big")], "id long, text string, source string")
    targets = spark.createDataFrame([("tessaly-forum", 0.75, 1), ("big", 0.25, 1)], "source string, target_share double, max_repeats int")
    plan = mx.rates(df, targets)
    assert {r.source: r.n_docs for r in plan.collect()} == {"tessaly-forum": 3, "big": 1}
    assert mx.falling_short(plan).collect() == []
    assert {r.id for r in mx.emit(df, plan, "id").collect()} == {1, 2, 3, 4}
    assert {r.source: (r.n_docs_used, r.actual_share) for r in mx.report(df, plan, "id").collect()} == {"tessaly-forum": (3, 0.75), "big": (1, 0.25)}


SENTENCES = [
    ("Port 1 is down. It costs 2.5 units.", ["Port 1 is down.", "It costs 2.5 units."]),
    ("See Fig. 6 and Sec. 4.4 for it. Inc. names like Norvane Inc. renamed it.", ["See Fig. 6 and Sec. 4.4 for it.", "Inc. names like Norvane Inc. renamed it."]),
    ("Fans, cables, etc. Open it. Timers, etc. and more.", ["Fans, cables, etc.", "Open it.", "Timers, etc. and more."]),
    ('The banner reads "Access logged. Call the desk." and closes. Then wait.', ['The banner reads "Access logged. Call the desk." and closes.', "Then wait."]),
    ('The console prints "Link down." Since then it waits.', ['The console prints "Link down."', "Since then it waits."]),
    ("Wait ... then check it. show version lists 3.", ["Wait ... then check it.", "show version lists 3."]),
    ("It is drained.At the border it stays.", ["It is drained.", "At the border it stays."]),
    ("Der Umbau beginnt am 3. März. Ca. 3 Geräte, d. h. alle, stehen z. B. hier.", ["Der Umbau beginnt am 3. März.", "Ca. 3 Geräte, d. h. alle, stehen z. B. hier."]),
    ("Die Konsole zeigt „Fertig. Bitte warten.“ an. Ende.", ["Die Konsole zeigt „Fertig. Bitte warten.“ an.", "Ende."]),
    ("La console affiche « Terminé. » La file rejette, p. ex. 10.1.0.0/25.", ["La console affiche « Terminé. »", "La file rejette, p. ex. 10.1.0.0/25."]),
    ("¡Cuidado! El puerto aún lleva la VLAN 6. ¿Quién es?", ["¡Cuidado!", "El puerto aún lleva la VLAN 6.", "¿Quién es?"]),
    ("控制台显示“链路断开。请联系A。”之后关闭。请稍候……然后检查。值为10.3。", ["控制台显示“链路断开。请联系A。”之后关闭。", "请稍候……然后检查。", "值为10.3。"]),
    ("画面に「切れました。連絡してください。」と表示されます。値は7です。", ["画面に「切れました。連絡してください。」と表示されます。", "値は7です。"]),
    ("มาน लिखता है। मान 81.5 रह गया।", ["มาน लिखता है।", "मान 81.5 रह गया।"]),
    ("ค่าลดลงจาก 15.4 เหลือ 86.2 ในช่วงกลางคืน พอร์ตอื่น ๆ ของ x-1 ยังใช้ VLAN 3 ตามเดิม", ["ค่าลดลงจาก 15.4 เหลือ 86.2 ในช่วงกลางคืน", "พอร์ตอื่น ๆ ของ x-1 ยังใช้ VLAN 3 ตามเดิม"]),
    ("من يدير 10.1؟ انخفضت القيمة. يمر المسار.", ["من يدير 10.1؟", "انخفضت القيمة.", "يمر المسار."]),
    ("Heading here\n\nA line that\r\nwraps on. Next one\nends.\n \n• One. Two.\n• Three\n1) Four. Five\nr1(config)# ip x. Y\nAfter it.", ["Heading here", "A line that\r\nwraps on.", "Next one\nends.", "• One. Two.", "• Three", "1) Four. Five", "r1(config)# ip x. Y", "After it."]),
    ("", []), (" \n\t ", []), ("...", ["..."]), ("a", ["a"]), ('"', ['"']), ("x.\n\n\n\ny", ["x.", "y"]),
]


@pytest.mark.parametrize(("text", "parts"), SENTENCES)
def test_units(text, parts):
    _, start, end = se.units([text])
    assert [text[s:e] for s, e in zip(start, end, strict=True)] == parts


def test_chunks_and_batches_make_no_difference(monkeypatch):
    texts = [t for t, _ in SENTENCES] * 3
    whole = [x.tolist() for x in se.units(texts)]
    monkeypatch.setattr(se, "CHUNK", 7)
    assert [x.tolist() for x in se.units(texts)] == whole
    one = [(i, s, e) for i, t in enumerate(texts) for _, s, e in zip(*(x.tolist() for x in se.units([t])), strict=True)]
    assert one == list(zip(*whole, strict=True))


def test_transducer_run_equals_a_walk():
    follow, mark, fresh = se.transducer()
    cls = np.random.default_rng(0).integers(0, 21, 5000).astype(np.uint8)
    state, want = fresh, []
    for x in cls:
        want.append(bool(mark[x, state]))
        state = follow[x, state]
    assert se.run_transducer(cls).tolist() == want


@settings(max_examples=100, deadline=None)
@given(hs.lists(hs.one_of(hs.none(), hs.text(alphabet='aB1. \n"“”„«»。！？…ก•-#)(', max_size=80)), min_size=1, max_size=5))
def test_units_cover_all_but_space(texts):
    row, start, end = se.units(texts)
    for i, t in enumerate(texts):
        mine = [(s, e) for r, s, e in zip(row, start, end, strict=True) if r == i]
        assert all(s < e for s, e in mine) and all(a[1] <= b[0] for a, b in zip(mine, mine[1:], strict=False))
        left = "".join(c for k, c in enumerate(t or "") if not any(s <= k < e for s, e in mine))
        assert not left.strip()
        assert all(t[s:e] == t[s:e].strip() for s, e in mine)


def test_sentence_edges(spark):
    long = "A sentence of words. " * 50_000
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a."), (3, "Ab. Cd."), (3, "Ab. Cd."), (4, long)], "id long, text string").withColumn("k", F.lit("x"))
    got = se.sentence_units(df, "id", "text")
    assert {r.k: r.n for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()} == {3: 4, 4: 50_000}
    assert se.sentence_units(df.limit(0), "id", "text").collect() == []


def _plain_abbreviations(t):
    """(place, class) of the full stops that end an abbreviation, by a walk over the text."""
    never, number, end = set(se.NEVER), set(se.BEFORE_NUMBER), set(se.MAY_END)
    for m in re.finditer(r"\.(?=\W|\Z)", t):
        i = m.start()
        tail = re.compile(r"(?:(?<!\w)(?:[^\W\d_]\.)+)?[^\W\d_]+$|\d+$").search(t, max(0, i - 24), i)
        if not tail:
            continue
        w, s = tail.group(), tail.start()
        before = t[s - 1] if s else ""
        if before == "_" or before.isalnum() or (before == "." and not (w[0].isupper() and w[1:2].islower() and s > 1 and t[s - 2].isalnum())):
            continue
        low = w.lower()
        if w[0].isdigit():
            if len(w) <= 2 and re.match(rf"\s+(?:{'|'.join(se.MONTHS)})\b", t[i + 1 :]):
                yield i, se.PLAIN
        elif low in never or (len(w) == 1 and before not in ("'", "’")) or (low in number and re.match(r"\s*\d", t[i + 1 :])) or (low in ("ex", "ej") and re.search(r"(?i)(?<!\w)p\.\s?$", t[:s])):
            yield i, se.PLAIN
        elif low in end or "." in w:
            yield i, se.WEAK


_PIECES = ["z.B", "z.", "B.", "e.g.", "No.", "Nr.", "5", "12", "3.", "1.", "end", "\n", " ", "  ", "März", "März2", "Mai", "p. ex.", "p.ej.", "etc.", "Inc.", "Dr.", "x", "Foo", "_a.", "a_b.", ".", "..", "!", "'s.", "’s.", "ก", "漢字", "fig. 3", "i.d.R.", "U.S.", "a.b.c.d.e.f.g.h.i.j.k.l.m.n.", "x" * 30 + "."]


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.lists(hs.sampled_from(_PIECES), max_size=12).map("".join), min_size=1, max_size=4))
def test_abbreviations_match_a_walk(texts):
    cps, offsets = se.layout(texts)
    cls = se._classes()[0][cps]
    before = cls.copy()
    se.mark_abbreviations(cls, cps, offsets)
    got = {(int(i), int(cls[i])) for i in np.flatnonzero(cls != before)}
    assert got == {(int(base) + i, k) for t, base in zip(texts, offsets[:-1], strict=True) for i, k in _plain_abbreviations(t)}


def test_markers_and_prompts():
    texts = ["Intro:\n1. one\n2. two\nwrapped\n3) no item", "Text goes on\n1) here.", "a)\nnext line\n- dot\n* star\n## Head\nsw(config)# vlan 7\nx> y", "- ", "B.", "Lead:\nB."]
    got = [(texts[r][s:e], r) for r, s, e in zip(*se.units(texts), strict=True)]
    assert [t for t, r in got if r == 0] == ["Intro:", "1. one", "2. two", "wrapped\n3) no item"]
    assert [t for t, r in got if r == 1] == ["Text goes on\n1) here."]
    assert [t for t, r in got if r == 2] == ["a)\nnext line", "- dot", "* star", "## Head", "sw(config)# vlan 7", "x> y"]
    assert [t for t, r in got if r > 2] == ["-", "B.", "Lead:\nB."]
