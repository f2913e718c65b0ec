"""Judge responses: reasoning blocks out, JSON recovered step by step."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRITERIA = ("accuracy", "relevance", "correctness", "hallucination", "completeness")
SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in CRITERIA])
_RESPONSE = ", ".join([f"{c} double" for c in CRITERIA] + [f"{c}_justification string" for c in CRITERIA] + ["overall_reasoning string", "detected_commands array<string>", "potential_issues array<string>", "missing_elements array<string>", "confidence double"])


def strip_thinking(c: Column) -> Column:
    """Without closed reasoning blocks, and without an unclosed one to the end."""
    out = c
    for tag in ("think", "thinking"):
        out = F.regexp_replace(out, rf"(?is)<{tag}>.*?</{tag}>", "")
    for tag in ("think", "thinking"):
        out = F.regexp_replace(out, rf"(?is)<{tag}>.*\z", "")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def thinking(c: Column) -> Column:
    """What the closed reasoning blocks said."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<think(?:ing)?>(.*?)</think(?:ing)?>"), 1), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), "\n\n")


def unfence(c: Column) -> Column:
    s = F.regexp_replace(c, r"\A\s*(?:```json|```)?\s*", "")
    return F.regexp_replace(s, r"\s*(?:```)?\s*\z", "")


def valid_scores(d: Column) -> Column:
    """All five there and within 0 to 10; NaN is above every number."""
    ok = d.isNotNull()
    for c in CRITERIA:
        ok = ok & d[c].isNotNull() & (d[c] >= 0) & (d[c] <= 10)
    return F.coalesce(ok, F.lit(False))


def _strict(c: Column) -> Column:
    """Parsed only where the text is one object: the parser itself would let trailing text pass."""
    return F.from_json(F.when(c.rlike(r"(?s)\A\s*\{.*\}\s*\z"), c), _RESPONSE)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def parse_judge(c: Column) -> Column:
    """struct(scores, confidence, issues, method, ok): the whole text, else its outermost braces, else score by score."""
    none = F.array().cast("array<string>")

    def made(method: str, scores: dict[str, Column], confidence: Column, issues: Column, ok: bool) -> Column:
        return F.struct(F.struct(*[scores[k].alias(k) for k in CRITERIA]).alias("scores"), confidence.cast("double").alias("confidence"), issues.alias("issues"), F.lit(method).alias("method"), F.lit(ok).alias("ok"))

    def from_object(method: str, d: Column) -> Column:
        return made(method, {k: d[k] for k in CRITERIA}, d["confidence"], F.coalesce(d["potential_issues"], none), True)

    def by_score(body: Column) -> Column:
        found = F.struct(*[F.coalesce(F.nullif(F.regexp_extract(body, rf'"{k}"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1), F.lit("")).cast("double"), F.lit(0.0)).alias(k) for k in CRITERIA])
        zero = made("none", dict.fromkeys(CRITERIA, F.lit(0.0)), F.lit(0.0), F.array(F.lit("Evaluation failed")), False)
        return let(found, lambda x: F.when(F.greatest(*[x[k] for k in CRITERIA]) > 0, made("scores", {k: x[k] for k in CRITERIA}, F.lit(50.0), none, True)).otherwise(zero))

    def inner(body: Column) -> Column:
        return let(_strict(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))), lambda d: F.when(valid_scores(d), from_object("inner", d)).otherwise(by_score(body)))

    def whole(body: Column) -> Column:
        return let(_strict(unfence(body)), lambda d: F.when(valid_scores(d), from_object("whole", d)).otherwise(inner(body)))

    return let(strip_thinking(c), whole)


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def valid_item(d: object) -> bool:
    return isinstance(d, dict) and all(isinstance(d.get(k), (int, float)) and not isinstance(d.get(k), bool) and 0 <= d[k] <= 10 for k in CRITERIA)


def batch_items(text: str | None, expected: int) -> tuple[list, bool]:
    """The items of a response for several pairs, and whether it could be read.

    The whole text is read as an array, else its outermost brackets; where that
    gives no array of the expected length, the valid objects are taken one by
    one.  If they too are not as many as expected, nothing is taken.
    """
    body = re.sub(r"\A\s*```(?:json)?|```\s*\Z", "", text or "").strip()
    array = _loads(body)
    if not isinstance(array, list):
        array = _loads((re.search(r"\[.*\]", body, re.S) or [""])[0])
    if isinstance(array, list) and len(array) == expected:
        return array, True
    objects = [d for d in map(_loads, re.findall(r"\{(?:[^{}]|\{[^{}]*\})*\}", body)) if valid_item(d)]
    return (objects, True) if len(objects) == expected else ([None] * expected, False)


_BATCH = T.ArrayType(T.StructType([T.StructField("pair_index", T.IntegerType()), T.StructField("scores", SCORES), T.StructField("valid", T.BooleanType()), T.StructField("ok", T.BooleanType())]))


@F.pandas_udf(_BATCH)
def parse_judge_batch(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Several judgements in one response; strict JSON, so in Python.

    ``ok`` says that the response could be read; an invalid item of a readable
    response keeps it and has zeros, which ``valid`` tells apart.
    """
    zero = dict.fromkeys(CRITERIA, 0.0)
    for texts, expected in parts:
        out = []
        for t, n in zip(texts, expected, strict=True):
            found, ok = batch_items(t, int(n))
            out.append([{"pair_index": i, "scores": {k: float(d[k]) for k in CRITERIA} if valid_item(d) else zero, "valid": valid_item(d), "ok": ok} for i, d in enumerate(found)])
        yield pd.Series(out)
