import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx

CASES = ["", "  ", "a b c", " x y ", "a\r\nb", "ﬁle  one\t\ttwo\n\n\n\nend", "....... \nkeep this line", "日本 語", "👍 ok", None]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_words_and_tokens(spark):
    assert column(spark, CASES, tx.n_words)[:-1] == [len(t.split()) for t in CASES[:-1]]
    assert column(spark, CASES, tx.approx_tokens)[:-1] == [len(t.split()) * 4 // 3 for t in CASES[:-1]]


def test_strip(spark):
    assert column(spark, CASES, tx.strip_u)[:-1] == [t.strip() for t in CASES[:-1]]


def test_clean_text(spark):
    def spec(t):
        t = unicodedata.normalize("NFKC", t)
        t = re.sub(r"[ \t]{2,}", " ", t)
        t = re.sub(r"\n{3,}", "\n\n", t)
        return re.sub(r"(?m)^[\.\-\s]{5,}$", "", t).strip()

    values = [c for c in CASES if c is not None] + ["x ................\n- - - - - -\nIntro", "a\n\n\nb  c"]
    assert column(spark, values, tx.clean_text) == [spec(v) for v in values]
    assert column(spark, [None], tx.clean_text) == [None]


@pytest.mark.parametrize(
    ("text", "noise"),
    [("", True), ("one two", True), ("Some title . . . 12", True), ("12", True), ("All rights reserved by us all", True), ("© 2024 a b c", True), ("a plain sentence here", False), ("all rights reserved by us", False)],
)
def test_noise(spark, text, noise):
    assert column(spark, [text], tx.is_noise) == [noise]


def test_boilerplate_is_a_substring_in_any_case(spark):
    assert column(spark, ["see ADDITIONAL references now", "plain"], tx.is_boilerplate) == [True, False]


def test_headers(spark):
    df = spark.createDataFrame([("m", " s "), (None, "s"), ("", " "), ("m", None)], "a string, b string")
    assert [r.h for r in df.select(tx.semantic_header(F.col("a"), F.col("b")).alias("h")).collect()] == ["m > s >", "s >", " >", "m >"]
    assert [r.h for r in df.select(tx.breadcrumb(F.col("a"), F.col("b")).alias("h")).collect()] == ["m > s\n", "s\n", "", "m\n"]


def test_budget_and_overlap(spark):
    df = spark.createDataFrame([(0,), (12,), (400,)], "h int")
    assert [r.x for r in df.select(tx.body_budget(F.lit(512), F.col("h")).alias("x")).collect()] == [512, 500, 200]
    df = spark.createDataFrame([(100, 100), (130, 100), (131, 100), (200, 100), (201, 100)], "n int, b int")
    assert [r.x for r in df.select(tx.adaptive_overlap(F.col("n"), F.col("b")).alias("x")).collect()] == [0, 0, 25, 25, 50]


def test_slug_and_prefixes(spark):
    assert column(spark, ["a-b:1.", "__x__", "é"], tx.slug) == ["a_b_1", "x", ""]
    assert column(spark, ["x", "query: x", "passage: x"], tx.passage_text) == ["passage: x", "query: x", "passage: x"]


def test_fingerprint_ignores_case_and_spacing(spark):
    rng = random.Random(1)
    a = column(spark, ["A  b\nC", " a b c ", "abc"], tx.fingerprint)
    assert a[0] == a[1] != a[2]
    assert rng
