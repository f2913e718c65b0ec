"""Choosing one of equal rows, and rank-aware unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with one key, the first by ``order``.

    An aggregation with partial sums: each task sends one row per key, so a
    key that stands in a third of all rows does not meet in one task.
    """
    cols = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*order, *[F.to_json(F.struct(c)).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes if c in cols]))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(first.alias("_first")).select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])


def exact_dedup(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    return first_wins(df.withColumn("_h", tx.sha1_text(F.col(text))), ["_h"], order).drop("_h")


def normalised_dedup(df: DataFrame, text: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Equal up to case and spacing; ``within`` limits it to rows of one file."""
    return first_wins(df.withColumn("_h", tx.fingerprint(F.col(text))), [*(within or []), "_h"], order).drop("_h")
