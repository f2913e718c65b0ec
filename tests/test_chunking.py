import random

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from docloom.operators import chunking as ck
from docloom.operators import dedup as dd


def test_window_starts_match_a_loop(spark):
    def loop(n, m, o):
        out, i = [], 0
        while n > 0:
            out.append(i)
            if i + m >= n:
                break
            i += max(1, m - o)
        return out

    cases = [(n, m, o) for n in range(0, 40, 3) for m in range(1, 14, 2) for o in range(0, m)]
    df = spark.createDataFrame(cases, "n int, m int, o int")
    got = df.select("n", "m", "o", ck.window_starts(F.col("n"), F.col("m"), F.col("o")).alias("s")).collect()
    assert all(r.s == loop(r.n, r.m, r.o) for r in got)


@settings(max_examples=60, deadline=None)
@given(hs.text(alphabet="ab .\n!é", max_size=400), hs.integers(5, 60), hs.integers(0, 4))
def test_recursive_split_keeps_words_and_size(text, size, overlap):
    parts = ck.split_recursive(text, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    assert set("".join(text.split())) >= set("".join("".join(parts).split()))
    if overlap == 0:
        assert "".join("".join(parts).split()).replace(".", "") == "".join(text.split()).replace(".", "")


def test_recursive_split_prefers_coarse_separators():
    assert ck.split_recursive("aaaa aaaa\n\nbbbb bbbb", 12, 0) == ["aaaa aaaa", "bbbb bbbb"]
    assert ck.split_recursive("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert ck.split_recursive("", 4, 1) == [] and ck.split_recursive("x", 4, 1) == ["x"]


def test_flat_blocks():
    text = "\n\n".join(f"paragraph {i}" for i in range(45))
    blocks = ck.flat_blocks(text)
    assert [b[0] for b in blocks] == ["0", "1", "2", "3", "4"] or len(blocks) >= 3
    assert blocks[0][1].startswith("paragraph 0\nparagraph 1") and blocks[0][1].count("\n") == 19
    # nine paragraphs of 12 or 13 characters reach the overlap of 100
    assert blocks[1][1].startswith("paragraph 12")
    long = ck.flat_blocks("x" * 2500)
    assert [b[0] for b in long] == ["0.0", "0.1", "0.2"] and len(long[2][1]) == 500


def test_hierarchical_chunks_edges(spark):
    rows = [(1, "m", "s", "word " * 2000), (2, "m", "s", "too short"), (3, "m", "s", "Additional References " * 20), (4, "m", "s", None), (5, "m", "s", "  "), (6, "m", "s", "word " * 2000), (7, "m", "t", " ".join(f"w{i}" for i in range(20)))]
    out = ck.hierarchical_chunks(spark.createDataFrame(rows, "id int, d string, s string, b string"), "d", "s", ["id"], "b").collect()
    assert {r.id for r in out} <= {1, 7} and any(r.id == 7 for r in out)
    assert all(r.text.startswith("m > ") for r in out)
    # windows of one text differ at their ends only, so equal ones are kept once
    assert len({r.sha1 for r in out}) == len(out)


def test_numbering_follows_file_and_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i) for i in range(50)]
    out = ck.numbered(spark.createDataFrame(rows, "f string, i int"), "f", ["i"]).collect()
    want = {r: f"chunk{n:06d}" for n, r in enumerate(sorted(rows))}
    assert {(r.f, r.i): r.id for r in out} == want


def test_first_wins(spark):
    rows = [(1, "A b", "x"), (2, "a  B", "y"), (3, "A b", "z"), (4, None, "n"), (5, None, "m")]
    df = spark.createDataFrame(rows, "i int, t string, other string")
    assert sorted(r.i for r in dd.exact_dedup(df, "t", ["i"]).collect()) == [1, 2, 4]
    got = sorted((r.i, r.other) for r in dd.normalised_dedup(df, "t", ["i"]).collect())
    assert got == [(1, "x"), (4, "n")]
