import pytest
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.operators import answers as an


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).collect()[0].x


def lines(config):
    assert config.startswith("```ios\n") and config.endswith("\n```")
    return config.split("\n")[1:-1]


def test_repeats_are_dropped_or_kept(spark):
    text = "ios\ninterface Gi0/1\n no shutdown\nexit\ninterface Gi0/2\n no shutdown\nexit\n```\nnotes ip 1"
    assert lines(one(spark, text, an.sanitise)) == ["enable", "configure terminal", "interface Gi0/1", "no shutdown", "exit", "interface Gi0/2", "end"]
    plain = lines(one(spark, f"Sure:\n```ios\n{text[4:].split('```')[0]}```\nbye", lambda c: an.sanitise(c, "plain")))
    assert plain == ["enable", "configure terminal", "interface Gi0/1", "no shutdown", "interface Gi0/2", "no shutdown", "end"]


@pytest.mark.parametrize("text", ["", "hello there", "! only a comment", " "])
def test_nothing_usable_is_still_framed(spark, text):
    assert lines(one(spark, text, an.sanitise)) == ["enable", "configure terminal", "end"]


def test_comments_and_case(spark):
    got = lines(one(spark, "ENABLE\nconf t\nhostname r1 ! name\nvlan 10 # ten\nEND", an.sanitise))
    assert got == ["ENABLE", "configure terminal", "conf t", "hostname r1", "vlan 10", "END"]


def test_extraction_stops_at_the_first_exit(spark):
    text = "Here you go\n```bash\nenable\nrouter ospf 1\nexit\nrouter bgp 2\nend\n```"
    assert one(spark, text, an.extract_config) == "enable\nrouter ospf 1\nexit"
    assert one(spark, "a description of it", an.extract_config) == "a description of it"  # 'ip' is inside
    assert one(spark, None, an.extract_config) == "" and one(spark, "nothing", an.extract_config) == ""


@pytest.mark.parametrize(
    ("text", "method", "accuracy"),
    [
        ('{"accuracy": 8, "relevance": 7, "correctness": 6, "hallucination": 5, "completeness": 4}', "whole", 8.0),
        ('```json\n{"accuracy": 8, "relevance": 7, "correctness": 6, "hallucination": 5, "completeness": 4}\n```', "whole", 8.0),
        ('ok {"accuracy": 8, "relevance": 7, "correctness": 6, "hallucination": 5, "completeness": 4} thanks', "inner", 8.0),
        ('{"accuracy": 8, "relevance": 7,', "scores", 8.0),
        ('{"accuracy": 11, "relevance": 7, "correctness": 6, "hallucination": 5, "completeness": 4}', "scores", 11.0),
        ('{"accuracy": "8", "relevance": 7, "correctness": 6, "hallucination": 5, "completeness": 4}', "scores", 0.0),
        ("no idea", "none", 0.0),
        ("", "none", 0.0),
        ('<think>{"accuracy": 1}</think>{"accuracy": 8, "relevance": 7, "correctness": 6, "hallucination": 5, "completeness": 4}', "whole", 8.0),
    ],
)
def test_judge_json(spark, text, method, accuracy):
    p = one(spark, text, jsonx.parse_judge)
    assert (p.method, p.scores.accuracy, p.ok) == (method, accuracy, method != "none")


def test_thinking(spark):
    text = "a<THINK>x</THINK>b<thinking>y\nz</thinking> c <think>open"
    assert one(spark, text, jsonx.strip_thinking) == "ab c"


def test_batched_judgements(spark):
    good = '{"accuracy": 1, "relevance": 2, "correctness": 3, "hallucination": 4, "completeness": 5}'
    df = spark.createDataFrame([(f"[{good}, {good}]", 2), (f"text {good} and {good}", 2), ("junk", 2), (f"[{good}]", 2)], "t string, n int")
    got = [[x.valid for x in r.p] for r in df.select(jsonx.parse_judge_batch("t", "n").alias("p")).collect()]
    assert got == [[True, True], [True, True], [False, False], [False, False]]
