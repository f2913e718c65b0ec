"""Problems 2 and 3: planted cases, recovery of a known model, and edges."""

import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import answer_defects as ad
from docloom.llm import consensus as cs

AT = datetime(2024, 1, 1)


@pytest.mark.parametrize("text", [None, "", " \n", " ", "​", "N/A", "null", "...", "-", '""', "# ", "```\n```", "```cli\n\n```", "<answer></answer>", "Answer:"])
def test_empty(text):
    assert ad.is_empty(text)


def test_not_empty():
    assert not ad.is_empty("VLAN 7.") and not ad.is_empty("no shutdown")


@pytest.mark.parametrize(
    "answer",
    [
        "HOW DO I SET VLAN 7 ON GI0/1?", "Question: How do I set VLAN 7 on Gi0/1?", '"How  do I set VLAN 7 on Gi0/1"', "How do I set VLAN 7 Gi0/1?",
        "how do i set vlan 7 on gi01", "Q: How do I set VLAN 7 on Gi0/1?\nA: How do I set VLAN 7 on Gi0/1?",
    ],
)
def test_copy(answer):
    q = "How do I set VLAN 7 on Gi0/1?"
    assert ad.copies([q, None, ""], [answer, answer, answer]).tolist() == [True, False, False]
    assert not ad.copies([q], [answer + " Use the vlan command and then check the port again with show."]).any()
    assert not ad.copies([q], ["VLAN 7."]).any() and not ad.copies([q], [""]).any()


@pytest.mark.parametrize(
    ("answer", "broken"),
    [
        ("Use 10.1.1.1.", False), ("vlan 7\nend", False), ("Do this:\n```\nvlan 7\nend\n```", False), ("```\nvlan 7\nend\n```\nDone here.", False),
        ("Do this:", True), ("```\nvlan 7", True), ("vlan 7\nname x\nip address 10.1.", True), ("The port is", True), ("1. One.\n2.", True), ("Hosts behind 10.16.", True), ("The mask is 255.255.252.", True), ("It fell to 40.3.", False), ("Bind it to Gi0/10.", False), ("A list,", True), ("他说完成。", False),
    ],
)
def test_truncated(answer, broken):
    assert ad.is_truncated(answer) == broken


def _leading(text, owner=None):
    top, lead = ad._leading(ad.Spoken([text]).votes(owner))
    return ad.LANGUAGES[top[0]] if lead[0] > 0 else None


def test_language():
    assert _leading("Why does the port go down?") == "en" and _leading("Der Nachbar ist nicht mit dem Port verbunden.") == "de"
    assert _leading("画面に表示されます。") == "ja" and _leading("打开端口。") == "zh" and _leading("¿Cómo pongo la VLAN en el puerto?") == "es"
    assert _leading("```\nvlan 7\nend\n```") is None and _leading("IS-IS AS 65000.") is None and _leading(None) is None
    assert _leading("WHY DOES THE PORT OF THE SWITCH GO DOWN") == "en"


def test_languages_are_learned(spark):
    """Words that are no function words speak for the language whose questions and answers hold them."""
    rng = random.Random(2)
    words = {k: [f"{k}{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(30)] for k in ("en", "de")}
    ask = {"en": "How does the port of {} work with the line", "de": "Wie ist der Port von {} mit der Leitung verbunden"}
    rows = []
    for i in range(400):
        k, other = rng.choice([("en", "de"), ("de", "en")])
        defect = i % 20 == 0
        rows.append((i, ask[k].format(f"x{i}"), " ".join(rng.choice(words[other if defect else k]) for _ in range(12)) + ".", AT, defect))
    df = spark.createDataFrame(rows, "eval_id long, question string, answer string, at timestamp, d boolean").repartition(3)
    got = {r.k for r in ad.defects(df, "eval_id", "question", "answer", "at").collect() if r.defect == "language"}
    assert got == {r[0] for r in rows if r[4]}


def test_rewordings_of_one_prompt_are_no_evidence(spark):
    rows = [(i, f"Please tell me how to place the second link behind the old router of the northern site {'now' if i else 'today'}?", "A reply that has no value at all.", AT) for i in range(2)]
    rows += [(10 + i, q, "This is nothing that we can say.", AT) for i, q in enumerate(["Why does the port go down?", "How do I set the clock?"])]
    df = spark.createDataFrame(rows, "eval_id long, question string, answer string, at timestamp")
    assert {r.k: r.defect for r in ad.defects(df, "eval_id", "question", "answer", "at").collect()} == {10: "refusal", 11: "refusal"}


def test_clusters_of_openings_recall(spark):
    """Of the masks that brute force finds near a commoner one, at least 95 of 100 meet a head they are near to."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    bases, masks = [[word() for _ in range(12)] for _ in range(40)], {}
    for b in bases:
        masks[" ".join(b)] = 1000
        for _ in range(12):
            w = list(b)
            w[rng.randrange(12)] = word()
            masks[" ".join(w)] = rng.randint(1, 5)
    got = {r["mask"]: r["head"] for r in ad.opening_clusters(spark.createDataFrame(list(masks.items()), "mask string, n long")).collect()}
    near = lambda a, b: len(set(a.split()) & set(b.split())) >= 0.8 * len(set(a.split()) | set(b.split()))
    want = [m for m in masks if masks[m] < 1000 and any(near(m, " ".join(b)) for b in bases)]
    assert set(got) == set(masks) and len(want) > 400
    assert sum(got[m] != m and near(m, got[m]) for m in want) >= 0.95 * len(want)


def test_heads_of_openings_match_brute_force(spark):
    """Each mask meets the commonest of all masks it is near to, also where commoner ones that it is not near to share its words; clusters hold every near mask."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    masks = {}
    for _ in range(60):
        base = rng.sample(vocabulary, rng.randint(1, 12))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            masks[" ".join(dict.fromkeys(w))] = rng.randint(1, 40)
    near = lambda a, b: 10 * len(set(a.split()) & set(b.split())) >= 8 * len(set(a.split()) | set(b.split()))
    around = {m: [o for o in masks if near(m, o)] for m in masks}
    want = {m: max(around[m], key=lambda o: (masks[o], o)) for m in masks}
    heads, clusters = ad.opening_links(spark.createDataFrame(list(masks.items()), "mask string, n long"))
    assert {r["mask"]: r["head"] for r in heads.collect()} == want and sum(m != h for m, h in want.items()) > 50
    assert sorted((r["mask"], r["head"]) for r in clusters.collect()) == sorted((m, h) for h in set(want.values()) for m in around[h])


def test_a_rare_opening_near_a_refusal_is_one(spark):
    """A mask near a template is judged by all prompts of that template, also where the template itself goes with a commoner one."""
    words = "we will not write any of these commands for you here today".split()
    c, b, a = (" ".join([*start, *words, *end]) + "." for start, end in (([], []), (["please"], []), (["please"], ["or", "then"])))
    asked = ["Why does the port go down?", "How do I set the clock?", "Which release fits?", "Where is the log kept?", "When was it changed last?"]
    rows = [(i, asked[i], c, AT) for i in range(3)] + [(10 + i, asked[3 + i], b, AT) for i in range(2)] + [(20, "Who may log in?", a, AT)]
    df = spark.createDataFrame(rows, "eval_id long, question string, answer string, at timestamp")
    assert {r.k: r.defect for r in ad.defects(df, "eval_id", "question", "answer", "at").collect()} == {r[0]: "refusal" for r in rows}


def test_refusals_are_templates_over_prompts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        q = rng.choice(["How do I set VLAN {} on the port of core-abc-{}?", "Why does line {} flap at edge-xy-{} when it rains?", "Which release brings gw-{} to level {} without an outage?"]).format(i, i)
        a = rng.choice([f"Set it to {i} seconds on the port Gi0/{i}.", "I must decline to write commands for Kelnor.", "Thank you for the question about core-abc-07. I must decline to write commands for Tarvel.", f"Sorry for the mix-up: the next hop is 10.0.0.{i}."])
        rows.append((i, q, a, AT))
    rows += [(100, "How do I set VLAN 1 on x?", "", AT), (101, "How?", "A single odd reply without any values.", AT), (None, "q", "a", AT), (102, None, None, None)]
    rows += [(103, "How do I do it?", "N/A", AT), (103, "How do I do it?", "Set VLAN 7.", datetime(2024, 2, 1))]  # delivered again, later and better
    df = spark.createDataFrame(rows, "eval_id long, question string, answer string, at timestamp")
    got = {r.k: r.defect for r in ad.defects(df, "eval_id", "question", "answer", "at").collect()}
    want = {i: "refusal" for i, _, a, _ in rows[:60] if "decline" in a} | {100: "empty", 102: "empty"}
    assert got == want
    assert ad.defects(df.limit(0), "eval_id", "question", "answer", "at").collect() == []


def test_a_mask_without_a_near_head_heads_itself(spark, monkeypatch):
    def one_band(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([1] * b.num_rows, pa.int64())], ["mask", "n", "band"])

    monkeypatch.setattr(ad, "_bands", lambda: one_band)
    masks = spark.createDataFrame([("Set the port to # on H.", 90), ("Set the port to # on H", 5), ("That is nothing we answer here.", 8)], "mask string, n long")
    got = {r["mask"]: r["head"] for r in ad.opening_clusters(masks).collect()}
    assert got == {"Set the port to # on H.": "Set the port to # on H.", "Set the port to # on H": "Set the port to # on H.", "That is nothing we answer here.": "That is nothing we answer here."}


def test_model_recovers_reliabilities(spark):
    rng = np.random.default_rng(3)
    skill = {"good-a": 0.95, "good-b": 0.9, "fair": 0.75, "poor": 0.4, "contrary": 0.1}
    truth, rows = {}, []
    for e in range(1500):
        truth[e] = int(rng.integers(0, 3))
        for m, p in skill.items():
            if rng.random() < 0.8:
                label = truth[e] if rng.random() < p else int((truth[e] + rng.integers(1, 3)) % 3)
                rows.append((e, m, label))
    c = cs.Consensus(spark.createDataFrame(rows, "eval_id long, model string, label int"))
    got = {r.eval_id: r.label for r in c.posterior().collect()}
    right = sum(got[e] == t for e, t in truth.items() if e in got) / len(got)
    assert right > 0.93
    majority = {}
    for e, _, label in rows:
        majority.setdefault(e, []).append(label)
    assert right > sum(max(sorted(set(v)), key=v.count) == truth[e] for e, v in majority.items()) / len(majority)
    for r in c.reliability().collect():
        assert r.low - 0.03 <= skill[r.model] <= r.high + 0.03
    # with more judges than travel as arrays, the same from a table
    votes = spark.createDataFrame(rows[:600], "eval_id long, model string, label int")
    a, b = cs.Consensus(votes), cs.Consensus(votes, most_judges=2)
    assert type(a) is not type(b) and a.rounds == b.rounds
    key = lambda x: [tuple(r) for r in sorted(x.collect())]
    for one, other in zip(key(a.posterior()), key(b.posterior()), strict=True):
        assert one[:2] == other[:2] and one[2] == pytest.approx(other[2], abs=1e-9) and one[3] == other[3]
    for one, other in zip(key(a.reliability()), key(b.reliability()), strict=True):
        assert one[0] == other[0] and one[1:] == pytest.approx(other[1:], abs=1e-9)


def test_votes_are_cleaned(spark):
    cols = "result_id long, eval_id long, model string, accuracy double, relevance double, correctness double, hallucination double, completeness double, overall_score double, parsing_success boolean, judged_at timestamp"
    rows = [
        (1, 1, "A-1b", 5.0, 5.0, 8.0, 5.0, 5.0, 5.0, True, AT), (2, 1, " a-1B:latest", 5.0, 5.0, 8.0, 5.0, 5.0, 5.0, True, AT),
        (3, 1, "b", 50.0, 5.0, 9.0, 60.0, 5.0, 5.0, True, AT), (4, 1, "unknown", 5.0, 5.0, 8.0, 5.0, 5.0, 5.0, True, AT),
        (5, 2, "b", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, AT), (6, 3, "b", 5.0, None, None, 5.0, 5.0, 5.0, True, AT),
        (7, 4, "b", None, None, float("nan"), None, None, None, True, None), (8, None, "b", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, AT),
        (9, 5, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, True, AT),
    ]
    df = spark.createDataFrame(rows, cols)
    models = spark.createDataFrame([("a-1b",), ("b",), (None,)], "model string")
    got = {(r.eval_id, r.model): r.label for r in cs.valid_votes(df, models).collect()}
    assert got == {(1, "a-1b"): 2, (1, "b"): 0}
    c = cs.Consensus(cs.valid_votes(df, models))
    assert c.posterior().count() == 1
    empty = cs.Consensus(cs.valid_votes(df.limit(0), models))
    assert empty.posterior().collect() == [] and empty.reliability().collect() == []


def test_krippendorff(spark):
    rows = [(1, "a", 0), (1, "b", 0), (2, "a", 1), (2, "b", 1), (3, "a", 0), (3, "b", 1), (4, "a", 2)]
    df = spark.createDataFrame(rows, "eval_id long, model string, label int")
    r = cs.krippendorff(df).collect()[0]
    # three paired items, one of which disagrees: coincidences 3 of 0 and 3 of 1
    assert r.n_items == 3 and r.alpha == pytest.approx(1 - (2 / 6) / (18 / 30))
    parts = {r.eval_id: r.agreement for r in cs.agreement_parts(df).collect()}
    assert parts == {1: 1.0, 2: 1.0, 3: 0.0, 4: None}


def test_digamma():
    x = np.array([0.1, 0.5, 1.0, 3.7, 50.0])
    want = [-10.4237549404, -1.9635100260, -0.5772156649, 1.1671535394, 3.9019896734]
    assert np.allclose(cs.digamma(x), want, atol=1e-7)


def test_digamma_as_a_column(spark):
    x = [0.1, 0.5, 1.0, 3.7, 50.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(cs.psi(F.col("x")).alias("y")).collect()
    assert np.allclose([r.y for r in got], cs.digamma(np.array(x)), atol=1e-10)
