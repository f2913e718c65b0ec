import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import batch as bt
from docloom.operators import checkpoints as cp
from docloom.operators import judging as jd
from docloom.operators import stats as sx
from docloom.operators import triplets as tp
from docloom.plans import catalogue


def test_outliers_and_consensus(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(60):
        scores = [round(rng.choice([5.0, rng.uniform(0, 10)]), 3) for _ in range(rng.randint(1, 9))]
        rows += [(q, j, s, s, s, s, s, s) for j, s in enumerate(scores)]
        if len(scores) < 2:
            want[q] = (scores, 0.5)
            continue
        mean, sd = statistics.mean(scores), statistics.stdev(scores)
        keep = [s for s in scores if sd == 0 or abs(s - mean) <= (2.0 if len(scores) >= 5 else 2.5) * sd]
        want[q] = (keep, 1.0 if sd == 0 else min(1.0, max(0.0, 1 - sd / (mean + 0.1))))
    df = spark.createDataFrame(rows, "q int, j int, accuracy double, relevance double, correctness double, hallucination double, completeness double, overall double")
    for r in jd.consensus(df, "q").collect():
        keep, strength = want[r.q]
        assert r.judges_used == len(keep) and r.strength == pytest.approx(strength) and r.overall == pytest.approx(statistics.mean(keep))


def test_risk_edges(spark):
    df = spark.createDataFrame([(8.0,), (7.99,), (6.0,), (4.0,), (3.9,)], "s double")
    assert [r.x for r in df.select(jd.risk(F.col("s")).alias("x")).collect()] == ["Low", "Medium", "Medium", "High", "Critical"]


def test_issues_count_ties_by_first_said(spark):
    rng = random.Random(4)
    rows = [(q, j, [rng.choice("abcdefg") for _ in range(rng.randint(0, 4))]) for q in range(40) for j in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "q int, j int, issues array<string>")
    got = {}
    for r in jd.critical_issues(df, "q", "j", "issues").orderBy("q", "place").collect():
        got.setdefault(r.q, []).append(r.issue)
    for q in range(40):
        mine = [x for x in rows if x[0] == q]
        counts = Counter(i for _, _, issues in mine for i in issues)
        assert got.get(q, []) == [i for i, n in counts.most_common(5) if n > len(mine) * 0.3]


def test_until_enough(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (1, 4, True), (2, 1, False)], "q int, o int, ok boolean")
    assert sorted((r.q, r.o) for r in jd.until_enough(df, "q", "o", "ok", 2).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_token_stats_take_values_at_indices(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(1, 9)) for g in "ab" for _ in range(rng.randint(1, 30))] + [("c", 5)]
    got = {r.g: r for r in sx.token_stats(spark.createDataFrame(rows, "g string, v int"), "g", F.col("v")).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        n = len(v)
        assert (got[g].lowest, got[g].p25, got[g].p50, got[g].p75, got[g].highest) == (v[0], v[n // 4], v[n // 2], v[3 * n // 4], v[-1])
        assert got[g]["mean"] == pytest.approx(sum(v) / n)


def test_topic_split_sizes(spark):
    rows = [(f"{t}-{i}", t) for t, n in (("a", 1), ("b", 10), ("c", 20), ("d", 30)) for i in range(n)] + [("x", None)]
    out = tp.topic_split(spark.createDataFrame(rows, "k string, topic string"), "topic", "k")
    got = {r.topic: r.n for r in out.groupBy("topic").agg(F.count_if("is_val").alias("n")).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 2, None: 1} and out.count() == len(rows)


def test_gap_is_a_mean_of_means(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 1.0, 0.0), (1, 0.0, 0.0)], "b int, p double, n double")
    r = tp.similarity_gap(df, "b", "p", "n").collect()[0]
    assert r.gap == 0.5 and r.batches == 2
    assert tp.accuracy(df, "p", "n").collect()[0].accuracy == pytest.approx(2 / 3)
    assert tp.accuracy(df.limit(0), "p", "n").collect()[0].accuracy == 0.0


@pytest.mark.parametrize(
    ("rows", "best"),
    [
        ([("a", "best", 0.5), ("b", "best", 0.7), ("c", "step", 0.9)], "b"),
        ([("a", "step", 0.5), ("c", "step", 0.9), ("b", "step", 0.9)], "b"),
        ([("b", None, None), ("a", None, None)], "a"),
        ([("a", "best", None), ("b", "step", 0.1)], "b"),
    ],
)
def test_best_checkpoint(spark, rows, best):
    assert cp.best_checkpoint(spark.createDataFrame(rows, "p string, k string, s double"), "p", "k", "s").collect()[0].p == best


def test_pending(spark):
    a = spark.createDataFrame([(1, "x"), (2, " "), (3, None), (4, "y")], "k int, answer string")
    assert sorted(r.k for r in bt.pending_answers(a, "answer").collect()) == [2, 3]
    assert [r.k for r in bt.pending_judgements(a, spark.createDataFrame([(4,)], "k int"), ["k"], "answer").collect()] == [1]
    with pytest.raises(ValueError, match="question"):
        bt.require_columns(a, "question")


def test_pivot_of_every_judge_and_metric(spark, tmp_path):
    judges = ["quorra-8b", "tarn-14b", "sallow-1b"]
    spark.createDataFrame([(j,) for j in judges], "model string").write.parquet(str(tmp_path / "judge_models.parquet"))
    spelled = [(1, "Quorra-8B "), (1, "quorra-8b:latest"), (1, "TARN-14B"), (2, "sallow_1b"), (3, "unknown-1b"), (4, "tarn-14b")]
    rows = [(q, m, q != 4, *[float(10 * i + k) for k in range(len(jd.METRICS))]) for i, (q, m) in enumerate(spelled)]
    spark.createDataFrame(rows, "question_id long, model string, parsing_success boolean, " + ", ".join(f"{m} double" for m in jd.METRICS)).write.parquet(str(tmp_path / "judge_results.parquet"))
    got = {r.question_id: r.asDict() for r in catalogue.queries()["score_pivot"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and len(got[1]) == 1 + len(judges) * len(jd.METRICS)
    for k, m in enumerate(jd.METRICS):
        assert (got[1][f"quorra_8b_{m}"], got[1][f"tarn_14b_{m}"], got[2][f"sallow_1b_{m}"]) == (5.0 + k, 20.0 + k, 30.0 + k)
        assert got[1][f"sallow_1b_{m}"] is None and got[3][f"quorra_8b_{m}"] is None
