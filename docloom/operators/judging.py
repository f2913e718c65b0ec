"""Judgements to scores, reliable judges and a verdict per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

# Shares of the criteria in a judge's overall score, and in production readiness.
WEIGHTS = {"accuracy": 0.20, "relevance": 0.20, "correctness": 0.30, "hallucination": 0.20, "completeness": 0.10}
READINESS = {"accuracy": 0.20, "correctness": 0.30, "completeness": 0.20, "hallucination": 0.20, "relevance": 0.10}
#: What a judgement measures.
METRICS = (*WEIGHTS, "overall_score", "confidence", "response_time")
RISKS = ((8.0, "Low"), (6.0, "Medium"), (4.0, "High"))


def weighted(shares: dict[str, float] = WEIGHTS, prefix: str = "") -> Column:
    out = None
    for name, share in shares.items():
        part = F.coalesce(F.col(prefix + name), F.lit(0.0)) * share
        out = part if out is None else out + part
    return out


def risk(score: Column) -> Column:
    out = F.lit("Critical")
    for least, name in reversed(RISKS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def with_reliability(rows: DataFrame, key: str, score: str = "overall") -> DataFrame:
    """Adds reliable and strength.

    With at least two judges, those within 2 (of five and more) or 2.5 sample
    deviations of the mean are reliable; the strength is one minus deviation
    over mean, between 0 and 1, and one half for a single judge.  The moments
    come from a group-by, so a question with many judges needs no window.
    """
    m = rows.groupBy(F.col(key).alias("_k")).agg(F.count(score).alias("_n"), F.avg(score).alias("_mean"), F.stddev_samp(score).alias("_sd"))
    j = rows.join(m, F.col(key) == F.col("_k"))
    limit = F.when(F.col("_n") >= 5, 2.0).otherwise(2.5) * F.col("_sd")
    alike = (F.col("_n") < 2) | (F.col("_sd") == 0)
    strength = F.when(F.col("_n") < 2, 0.5).when(F.col("_sd") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("_sd") / (F.col("_mean") + 0.1))))
    return j.withColumn("reliable", alike | (F.abs(F.col(score) - F.col("_mean")) <= limit)).withColumn("strength", strength).drop("_k", "_n", "_mean", "_sd")


def consensus(rows: DataFrame, key: str, score: str = "overall") -> DataFrame:
    """Per question: means over the reliable judges, readiness, risk, confidence, strength and counts."""
    marked = with_reliability(rows, key, score)
    ok = F.col("reliable")
    means = marked.groupBy(key).agg(*[F.avg(F.when(ok, F.col(c))).alias(c) for c in WEIGHTS], F.avg(F.when(ok, F.col(score))).alias("overall"), F.first("strength").alias("strength"), F.count_if(ok).alias("judges_used"), F.count("*").alias("judges"))
    ready = means.withColumn("readiness", weighted(READINESS))
    return ready.withColumn("risk", risk(F.col("readiness"))).withColumn("deployment_confidence", F.least(F.lit(100.0), F.col("readiness") * 10))


def critical_issues(rows: DataFrame, key: str, judge: str, issues: str, most: int = 5, share: float = 0.3) -> DataFrame:
    """key, issue, n, place: of the five commonest issues (the first said wins ties) those of more than ``share`` of the judges."""
    judges = rows.groupBy(key).agg(F.count("*").alias("judges"))
    said = rows.select(key, judge, F.posexplode(issues).alias("pos", "issue"))
    counts = said.groupBy(key, "issue").agg(F.count("*").alias("n"), F.min(F.struct(judge, "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first", "issue"))
    return counts.withColumn("place", place).filter(F.col("place") <= most).join(judges, key).filter(F.col("n") > share * F.col("judges")).select(key, "issue", "n", "place")


def until_enough(rows: DataFrame, key: str, order: str, ok: str, target: int) -> DataFrame:
    """Judges in order until ``target`` have succeeded: the rows that would have been asked."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_done", F.coalesce(F.sum(F.col(ok).cast("int")).over(w), F.lit(0))).filter(F.col("_done") < target).drop("_done")


def judge_key(name: Column) -> Column:
    """A judge name without case, space, separators and a tag after a colon, for matching spellings."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r":.*$", ""), r"[^a-z0-9]+", "")


def score_columns(rows: DataFrame, key: list[str], model: str, metrics: list[str], models: list[str]) -> DataFrame:
    """Long scores to one column per model and metric."""
    return rows.withColumn("_slug", tx.slug(F.col(model))).groupBy(*key).pivot("_slug", models).agg(*[F.avg(m).alias(m) for m in metrics])


def progress(rows: DataFrame, model: str, score: str) -> DataFrame:
    """Per model: rows scored, rows open, mean."""
    return rows.groupBy(model).agg(F.count(score).alias("scored"), F.count_if(F.col(score).isNull()).alias("open"), F.avg(score).alias("mean"))


#: Columns that one judge gives a row of a table, after ``eval_<judge>_``.
WIDE = (*WEIGHTS, "overall", "production_readiness", "risk", "deployment_confidence", "consensus_strength", "judges_ok", "judges_failed")


def wide_scores(rows: DataFrame, key: str) -> DataFrame:
    """key, model and the columns of WIDE: each judgement (ok, the criteria, overall) as a consensus of one; zeros and Unknown where it failed."""
    ok, ready = F.coalesce("ok", F.lit(False)), weighted(READINESS)
    score = lambda c, digits=3: F.when(ok, F.round(c, digits)).otherwise(0.0)
    columns = {c: score(F.col(c)) for c in (*WEIGHTS, "overall")} | {"production_readiness": score(ready), "risk": F.when(ok, risk(ready)).otherwise("Unknown"), "deployment_confidence": score(F.least(F.lit(100.0), ready * 10), 1)}
    columns |= {"consensus_strength": F.lit(0.5), "judges_ok": ok.cast("int"), "judges_failed": (~ok).cast("int")}
    return rows.select(key, "model", *[columns[c].alias(c) for c in WIDE])


def batch_prompt(pairs: list[tuple[str, str]]) -> str:
    """What a judge is asked about several pairs at once: the pairs, the criteria, and the array to return."""
    shares = "".join(f"\n- {k} ({v * 100:.0f}% of the score), 0 to 10" for k, v in WEIGHTS.items())
    keys = ", ".join(f'"{k}": <0-10>, "{k}_justification": "<text>"' for k in WEIGHTS)
    body = "".join(f"\n--- PAIR {i} ---\nQuestion: {q}\n\nConfiguration: {a}" for i, (q, a) in enumerate(pairs, 1))
    return f'Judge {len(pairs)} pairs.{body}\n--- END ---\n\nCriteria:{shares}\n\nReply with one JSON array only, an object for each pair in order:\n[{{"pair_index": 1, {keys}, "overall_reasoning": "<text>", "detected_commands": [], "potential_issues": [], "missing_elements": [], "confidence": <0-100>}}]'


def prompt_tail() -> str:
    """What follows the pair: the criteria with their shares, and the JSON to return."""
    shares = "".join(f"\n- {k} ({v * 100:.0f}% of the score), 0 to 10" for k, v in WEIGHTS.items())
    keys = ", ".join(f'"{k}": <0-10>, "{k}_justification": "<text>"' for k in WEIGHTS)
    return f"\n\nCriteria:{shares}\n\nReply with this JSON only:\n{{{keys}, \"overall_reasoning\": \"<text>\", \"detected_commands\": [], \"potential_issues\": [], \"missing_elements\": [], \"confidence\": <0-100>}}"


def judge_prompt(question: Column, answer: Column) -> Column:
    """What a judge is asked: the pair, then the tail."""
    return F.concat(F.lit("Question: "), question, F.lit("\n\nConfiguration: "), answer, F.lit(prompt_tail()))
