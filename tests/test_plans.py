import json

import pytest
from pyspark.sql import functions as F

from docloom import cli
from docloom.functions import jsonx
from docloom.operators import models as md
from docloom.plans import evaluation, rag
from docloom.sources import readers


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([("a", "ospf area zero on the core"), ("b", "vlan seven on the access port"), ("c", "bgp neighbour of the edge"), ("d", None)], "chunk_id string, text string")
    questions = spark.createDataFrame([(1, "which vlan is on the access port"), (2, "zzz")], "question_id int, question string")
    return chunks, questions


@pytest.mark.parametrize("method", ["lexical", "dense", "hybrid", "flat"])
def test_ask(spark, corpus, method):
    got = {r.question_id: r for r in rag.ask(*corpus, rag.Retrieval(method=method, k=2)).collect()}
    assert set(got) == {1, 2} and got[1].used_chunks[0].chunk_id == "b" and got[1].retrieval_config.method == method
    assert got[1].config.startswith("```ios\nenable") and got[1]["count"] == len(got[1].used_chunks)
    if method == "lexical":
        assert got[2]["count"] == 0 and got[2].context_used == ""
    with pytest.raises(ValueError, match="unknown"):
        rag.retrieve(*corpus, rag.Retrieval(method="x"))


def test_judging_resumes_and_reports(spark):
    answers = spark.createDataFrame([(1, "q", "vlan 7"), (2, "q", " "), (3, "q", "ip x")], "eval_id int, question string, answer string")
    broken = lambda: lambda prompts: ["no json"] * len(prompts)
    judged = evaluation.judge(answers, {"good": md.rule_judge, "bad": broken})
    rows = {(r.eval_id, r.model): r.ok for r in judged.collect()}
    assert rows == {(1, "good"): True, (3, "good"): True, (1, "bad"): False, (3, "bad"): False}
    report = {r.eval_id: r for r in evaluation.report(judged).collect()}
    assert report[1].judges_ok == 1 and report[1].judges_failed == 1 and report[1].strength == 0.5
    only_bad = {r.eval_id: r for r in evaluation.report(evaluation.judge(answers, {"bad": broken})).collect()}
    assert only_bad[1].risk == "Unknown" and only_bad[1].overall is None
    left = evaluation.judge(answers, {"good": md.rule_judge}, scored=spark.createDataFrame([(1, "good")], "eval_id int, model string"))
    assert [r.eval_id for r in left.collect()] == [3]
    assert "eval_good_overall" in evaluation.wide(judged, ["good", "bad"]).columns


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = " ".join(f"word{i}" for i in range(40))
    (tmp_path / "in/m.json").write_text(json.dumps({"pdf_name": "m", "content": [{"chapter": "c", "sections": [{"title": "s", "content": body}]}]}))
    cli.main(["chunk", str(tmp_path / "in"), str(tmp_path / "chunks")])
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.count() == 1 and chunks.collect()[0].text.startswith("m > s >")
    (tmp_path / "q.csv").write_text("question\nwhere is word3\n")
    chunks.withColumnRenamed("sha1", "chunk_id").write.parquet(str(tmp_path / "index"))
    cli.main(["ask", str(tmp_path / "index"), str(tmp_path / "q.csv"), str(tmp_path / "answers"), "--method", "lexical"])
    answers = spark.read.parquet(str(tmp_path / "answers"))
    assert answers.count() == 1
    answers.withColumnRenamed("question_id", "eval_id").write.parquet(str(tmp_path / "pairs"))
    cli.main(["evaluate", str(tmp_path / "pairs"), str(tmp_path / "report")])
    assert spark.read.parquet(str(tmp_path / "report")).count() == 1
    cli.main(["index", str(tmp_path / "index"), str(tmp_path / "vectors")])
    cli.main(["ask", str(tmp_path / "vectors"), str(tmp_path / "q.csv"), str(tmp_path / "flat"), "--method", "flat", "--max-chars", "50"])
    assert len(spark.read.parquet(str(tmp_path / "flat")).collect()[0].context_used) == 50
    cli.main(["ask", str(tmp_path / "vectors"), str(tmp_path / "q.csv"), str(tmp_path / "none"), "--method", "none"])
    assert spark.read.parquet(str(tmp_path / "none")).collect()[0].context_used == ""
    (tmp_path / "scored.csv").write_text('question,answer,eval_stand_in_overall\n"q, one","a ""b""\nc",\nq2,a2,7.5\nq3, ,\n')
    cli.main(["score", str(tmp_path / "scored.csv"), str(tmp_path / "out"), "--answer", "answer"])
    rows = readers.questions(spark, str(tmp_path / "out")).collect()
    assert [r.question for r in rows] == ["q, one", "q2", "q3"] and rows[0].answer == 'a "b"\nc' and rows[0].eval_stand_in_judges_ok == "1"
    assert rows[1].eval_stand_in_overall == "7.5" and rows[1].eval_stand_in_accuracy is None and rows[2].eval_stand_in_overall is None


def test_lines_command(spark, tmp_path):
    spark.createDataFrame([("m", 1, " ".join(f"w{i}" for i in range(40)))], "pdf_name string, page_num int, text string").write.parquet(str(tmp_path / "pages"))
    cli.main(["lines", str(tmp_path / "pages"), str(tmp_path / "out"), "--strategy", "fixed"])
    assert [r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["m_chunk000001"]


def test_judges_stop_when_enough_have_answered(spark, tmp_path):
    """No judge is called about an answer that has enough successes; the calls themselves are counted."""
    log = str(tmp_path / "calls")

    def counting(name, ok):
        def make():
            def judge(prompts):
                with open(f"{log}-{name}", "a") as f:
                    f.write("x" * len(prompts))
                good = md.rule_judge()(prompts)
                return [g if ok(p) else "no json" for p, g in zip(prompts, good, strict=True)]

            return judge

        return make

    answers = spark.createDataFrame([(i, "q", f"vlan {i}") for i in range(6)], "eval_id int, question string, answer string").coalesce(1)
    odd = lambda p: "vlan 1" in p or "vlan 3" in p or "vlan 5" in p
    judged = evaluation.judge(answers, {"a": counting("a", odd), "b": counting("b", lambda p: True), "c": counting("c", lambda p: True)}, enough=1)
    assert judged.count() == 9 and {r.model for r in judged.collect()} == {"a", "b"}
    assert [len(open(f"{log}-{n}").read()) for n in "ab"] == [6, 3]
    again = evaluation.judge(answers, {"b": md.rule_judge}, scored=judged.filter("model = 'a'"), enough=1)
    assert sorted(r.eval_id for r in again.collect()) == [0, 2, 4]


def test_batches_keep_the_flag_of_a_readable_response(spark):
    answers = spark.createDataFrame([(i, "q", f"vlan {i}") for i in range(5)], "eval_id int, question string, answer string").coalesce(1)
    one = {c: 5 for c in jsonx.CRITERIA}
    half = lambda: lambda prompts: [json.dumps([one | {"potential_issues": ["mtu"]}, {"accuracy": 99}]) if "Judge 2" in p else "[]" for p in prompts]
    got = [(r.eval_id, r.ok, r.accuracy, r.issues) for r in evaluation.judge(answers, {"h": half}, batch=2).orderBy("eval_id").collect()]
    assert got == [(0, True, 5.0, ["mtu"]), (1, True, 0.0, []), (2, True, 5.0, ["mtu"]), (3, True, 0.0, []), (4, False, 0.0, [])]
    assert jsonx.batch_items('x [{"a": 1}] y', 1) == ([{"a": 1}], True) and jsonx.batch_items(None, 2) == ([None, None], False)
    assert jsonx.batch_items(f"{json.dumps(one)} and {json.dumps(one)}", 2) == ([one, one], True)


def test_outputs_that_do_not_match_the_prompts_are_failures(spark):
    short = lambda: lambda prompts: prompts[:-1]
    rows = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    assert [r.x for r in rows.select(md.complete(F.col("t"), short).alias("x")).collect()] == [None, None]


def test_tokenizer_plug_in(spark):
    count = lambda: lambda texts: [len(t.split("-")) for t in texts]
    rows = spark.createDataFrame([("a-b-c",), (None,)], "t string")
    assert [r.x for r in rows.select(md.count_tokens(F.col("t"), count).alias("x")).collect()] == [3, 1]
