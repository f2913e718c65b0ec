"""Boundaries to models.  Each has an interface and a deterministic stand-in.

The stand-ins make pipelines run and testable without a model.  Their output
says nothing about the quality that a real model would have.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.jsonx import CRITERIA


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class CrossScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Judge(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def hashing_embedder(dim: int = 64) -> Embedder:
    """Stand-in: signed counts of words, placed by the first half of their MD5."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def extractive_generator(lines: int = 10) -> Generator:
    """Stand-in: the first lines of the prompt's context that look like commands."""

    def generate(prompts: list[str]) -> list[str]:
        return ["\n".join([x for x in p.split("\n") if ("#" in x or "(config" in x)][:lines]) + "\n```" for p in prompts]

    return generate


def rule_judge(silent: int = 0) -> Judge:
    """Stand-in: scores by the length of the prompt, as the JSON that a judge returns; no JSON where ``silent`` divides the length."""

    def judge(prompts: list[str]) -> list[str]:
        said = [json.dumps({c: float((len(p) + i) % 11) for i, c in enumerate(CRITERIA)} | {"potential_issues": [], "confidence": 50}) for p in prompts]
        return ["I can not tell." if silent and len(p) % silent == 0 else x for p, x in zip(prompts, said, strict=True)]

    return judge


def batch_rule_judge() -> Judge:
    """Stand-in: one array for a prompt of several pairs, each scored by the length of its part."""

    def judge(prompts: list[str]) -> list[str]:
        parts = [re.split(r"\n--- PAIR \d+ ---\n", p)[1:] for p in prompts]
        return [json.dumps([{c: float((len(x.split("\n--- END ---")[0]) + i) % 11) for i, c in enumerate(CRITERIA)} | {"pair_index": n} for n, x in enumerate(own, 1)]) for own in parts]

    return judge


def embed(text: Column, make: Callable[[], Embedder], batch: int = 32) -> Column:
    """Unit vectors of a text column.  ``make`` builds the model once per task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            texts = s.fillna("").tolist()
            v = np.concatenate([model(texts[i : i + batch]) for i in range(0, len(texts), batch)]) if texts else np.zeros((0, 1))
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(n == 0, 1, n)).astype(np.float32)), index=s.index)

    return run(text)


def complete(text: Column, make: Callable[[], Generator | Judge], batch: int = 32, retries: int = 3, pause: float = 0.0, per_minute: float | None = None) -> Column:
    """Model output for a prompt column; failures are retried, then null.

    ``per_minute`` limits the calls of one task; divide a service's limit by
    the number of tasks that run at once.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, last = make(), 0.0
        for s in parts:
            out: list[str | None] = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), batch):
                for attempt in range(retries):
                    if per_minute:
                        time.sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                        last = time.monotonic()
                    try:
                        said = list(model(texts[i : i + batch]))
                        if len(said) != len(texts[i : i + batch]):  # else every later answer would be another's
                            raise ValueError(f"{len(said)} outputs for {len(texts[i : i + batch])} prompts")
                        out += said
                        break
                    except Exception:  # noqa: BLE001
                        time.sleep(pause * (attempt + 1))
                else:
                    out += [None] * len(texts[i : i + batch])
            yield pd.Series(out, index=s.index, dtype=object)

    return run(text)


def count_tokens(text: Column, make: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Tokens of a text column by a tokenizer that is plugged in: ``make`` builds, once per task, what turns texts into counts."""

    @F.pandas_udf("int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for s in parts:
            yield pd.Series(count(s.fillna("").tolist()), index=s.index, dtype="int32")

    return run(text)


def cross_score(query: Column, text: Column, make: Callable[[], CrossScorer]) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in parts:
            pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
            yield pd.Series(model(pairs), index=q.index, dtype=float)

    return run(query, text)


def generate_answers(questions: DataFrame, prompt: Column, make: Callable[[], Generator], method: str) -> DataFrame:
    """One answer per question as a long table: columns of questions, method, answer."""
    return questions.withColumn("method", F.lit(method)).withColumn("answer", complete(prompt, make))
