"""Choosing a model checkpoint from metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_checkpoint(df: DataFrame, path: str, kind: str, score: str) -> DataFrame:
    """One row.  A checkpoint of kind 'best' with the highest score; else the highest score of the others; else the first without one.

    Equal scores: the first path.
    """
    tier = F.when((F.col(kind) == "best") & F.col(score).isNotNull(), 2).when(F.col(score).isNotNull() & (F.col(score) > -1), 1).otherwise(0)
    rows = df.filter(F.col(path).isNotNull()).withColumn("_tier", tier).withColumn("_s", F.when(F.col("_tier") > 0, F.col(score)).otherwise(0.0))
    top = rows.agg(F.max(F.struct("_tier", "_s")).alias("top"))
    return rows.join(F.broadcast(top)).filter((F.col("_tier") == F.col("top._tier")) & (F.col("_s") == F.col("top._s"))).agg(F.min_by(F.struct(path, kind, score), path).alias("b")).select("b.*")
