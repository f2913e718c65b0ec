"""Answers to consensus scores: judges asked, responses parsed, outliers left out."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import jsonx
from docloom.functions import text as tx
from docloom.operators import batch as bt
from docloom.operators import judging as jd
from docloom.operators import models as md
from docloom.session import materialise

Judges = dict[str, Callable[[], md.Judge]]


def judge(answers: DataFrame, models: Judges, scored: DataFrame | None = None, enough: int | None = None, batch: int = 1) -> DataFrame:
    """eval_id, model, ok, five scores, confidence, issues, overall: every answer by the models in their order.

    ``answers`` (eval_id, question, answer); blank ones are not judged.  Pairs
    of (eval_id, model) in ``scored`` are skipped, so a run resumes where it
    stopped.  With ``enough`` a model is asked only about answers that fewer
    models have judged with success so far, ``scored`` (with ok) included, so
    no call is made that nobody needs.  With ``batch`` above one a call covers
    so many pairs.  Each model's results are written once: a call is never
    repeated by a later step of the plan.
    """
    out: DataFrame | None = None
    for name, make in models.items():
        rows = answers.withColumn("model", F.lit(name))
        todo = bt.pending_judgements(rows, rows.limit(0) if scored is None else scored, ["eval_id", "model"], "answer")
        if enough is not None:
            before = [x.filter("ok").select("eval_id", "model") for x in (out, scored) if x is not None and "ok" in x.columns]
            if before:
                done = (before[0] if len(before) == 1 else before[0].unionByName(before[1])).distinct().groupBy("eval_id").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
                todo = todo.join(done, "eval_id", "left_anti")
        parsed = materialise(_single(todo, make) if batch == 1 else _batched(todo, make, batch), "judged")
        out = parsed if out is None else out.unionByName(parsed)
    return out.withColumn("overall", jd.weighted())


def _single(todo: DataFrame, make: Callable[[], md.Judge]) -> DataFrame:
    p = F.col("p")
    said = todo.withColumn("response", md.complete(jd.judge_prompt(F.col("question"), F.col("answer")), make))
    return said.withColumn("p", jsonx.parse_judge(F.coalesce("response", F.lit("")))).select("eval_id", "model", p["ok"].alias("ok"), *[p["scores"][c].alias(c) for c in jsonx.CRITERIA], p["confidence"].alias("confidence"), p["issues"].alias("issues"))


def _batched(todo: DataFrame, make: Callable[[], md.Judge], size: int, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """One call for ``size`` pairs of a task; a call that fails or can not be read gives failed judgements for its pairs."""
    rows = todo.select("eval_id", "model", "question", "answer")
    kind = dict(rows.dtypes)["eval_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            out = []
            for i in range(0, len(p), size):
                own = p.iloc[i : i + size]
                prompt, said = jd.batch_prompt(list(zip(own["question"].fillna(""), own["answer"].fillna(""), strict=True))), None
                for attempt in range(retries):
                    try:
                        (said,) = model([prompt])
                        break
                    except Exception:  # noqa: BLE001
                        time.sleep(pause * (attempt + 1))
                items, ok = jsonx.batch_items(said, len(own))
                for key, name, d in zip(own["eval_id"], own["model"], items, strict=True):
                    good = d if jsonx.valid_item(d) else {}
                    out.append((key, name, ok, *[float(good.get(c, 0)) for c in jsonx.CRITERIA], float(good.get("confidence", 50 if ok else 0)), [str(x) for x in good.get("potential_issues") or []]))
            yield pd.DataFrame(out, columns=["eval_id", "model", "ok", *jsonx.CRITERIA, "confidence", "issues"])

    return rows.mapInPandas(run, f"eval_id {kind}, model string, ok boolean, {', '.join(f'{c} double' for c in jsonx.CRITERIA)}, confidence double, issues array<string>")


def report(judged: DataFrame) -> DataFrame:
    """One row per answer: consensus over the judges that succeeded, with judges_ok and judges_failed and the critical issues.

    Where no judge succeeded the scores are null, the risk is Unknown and the
    strength is one half.
    """
    counts = judged.groupBy("eval_id").agg(F.count_if("ok").alias("judges_ok"), F.count_if(~F.col("ok")).alias("judges_failed"))
    good = judged.filter("ok")
    verdict = jd.consensus(good, "eval_id").drop("judges", "judges_used")
    issues = jd.critical_issues(good, "eval_id", "model", "issues").groupBy("eval_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "issue"))), lambda x: x["issue"]).alias("critical_issues"))
    rows = counts.join(verdict, "eval_id", "left").join(issues, "eval_id", "left")
    return rows.withColumns({"risk": F.coalesce("risk", F.lit("Unknown")), "strength": F.coalesce("strength", F.lit(0.5)), "critical_issues": F.coalesce("critical_issues", F.array().cast("array<string>"))})


def slug(model: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]", "_", model).strip("_")


def wide(judged: DataFrame, models: list[str]) -> DataFrame:
    """eval_id and twelve columns for each model, as ``eval_<model>_<metric>``."""
    by = jd.wide_scores(judged, "eval_id").groupBy("eval_id").pivot("model", models).agg(*[F.first(c).alias(c) for c in jd.WIDE])
    return by.select("eval_id", *[F.col(f"`{m}_{c}`").alias(f"eval_{slug(m)}_{c}") for m in models for c in jd.WIDE])


def evaluate_table(rows: DataFrame, answer: str, models: Judges, question: str = "question", batch: int = 1) -> DataFrame:
    """The table, its columns as they are, with twelve columns of scores for each model.

    Rows without a question or an answer have none.  Rows whose
    ``eval_<model>_overall`` is filled already keep their scores and are not
    judged again, for each model by itself.
    """
    bt.require_columns(rows, question, answer)
    kept = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "evaluated-rows")
    out = kept
    for name, make in models.items():
        columns = [f"eval_{slug(name)}_{c}" for c in jd.WIDE]
        had = [c for c in columns if c in rows.columns]
        mine = kept.select(F.col("_row").alias("eval_id"), tx.strip_u(F.col(question)).alias("question"), tx.strip_u(F.col(answer)).alias("answer"), F.col(columns[5]).alias("had") if columns[5] in had else F.lit(None).alias("had"))
        todo = mine.filter("had is null and question is not null and answer is not null and question <> '' and answer <> ''").select("eval_id", "question", "answer")
        new = wide(judge(todo, {name: make}, batch=batch), [name]).select(F.col("eval_id").alias("_row"), *[F.col(c).alias(f"_{c}") for c in columns])
        met = out.join(new, "_row", "left")
        out = met.withColumns({c: F.coalesce(F.col(c).cast("string"), F.col(f"_{c}").cast("string")) if c in had else F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
    return out.orderBy("_row").drop("_row")
