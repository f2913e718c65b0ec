"""Resumable batches: which rows are still to be generated or judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx


def pending_answers(df: DataFrame, answer: str) -> DataFrame:
    """Rows without an answer: null or blank."""
    return df.filter(tx.strip_u(F.coalesce(F.col(answer), F.lit(""))) == "")


def pending_judgements(answers: DataFrame, scores: DataFrame, key: list[str], answer: str) -> DataFrame:
    """Answered rows that have no score under the key."""
    return answers.filter(tx.strip_u(F.coalesce(F.col(answer), F.lit(""))) != "").join(scores.select(*key).distinct(), key, "left_anti")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df
