"""Ranked chunks to a context within a budget, with the record of what was used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

SEPARATOR = "\n\n---\n\n"
#: A budget that no context exceeds.
UNBOUNDED = 1 << 60


def used_chunks(ranked: DataFrame, query: str, text: str, rank: str = "rank", max_chars: int = 4000, prefix: int = 200) -> DataFrame:
    """The ranked rows that enter the context, with ``place`` from 1; ``rank`` keeps the original place.

    Of rows with one beginning the first stays.  Rows are taken in order until
    one would exceed the budget; the first is always taken.
    """
    rows = ranked.filter(F.col(text).isNotNull()).withColumn("_t", tx.strip_u(F.col(text)))
    first = F.row_number().over(Window.partitionBy(query, F.substring(text, 1, prefix)).orderBy(rank))
    w = Window.partitionBy(query).orderBy(rank)
    rows = rows.withColumn("_dup", first).filter((F.col("_dup") == 1) & (F.col("_t") != "")).withColumn("place", F.row_number().over(w))
    held = F.coalesce(F.sum(F.length("_t")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = ((F.col("place") > 1) & (held + F.length(text) > max_chars)).cast("int")
    rows = rows.withColumn("_over", over).withColumn("_stop", F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.filter("_stop = 0").drop("_dup", "_over", "_stop")


def pack(ranked: DataFrame, query: str, text: str, rank: str = "rank", max_chars: int = 4000, prefix: int = 200) -> DataFrame:
    """query, context, n_used: one context per query."""
    used = used_chunks(ranked, query, text, rank, max_chars, prefix)
    return used.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_t"))), lambda x: x["_t"]), SEPARATOR).alias("context"), F.count("*").alias("n_used"))


def provenance(ranked: DataFrame, query: str, text: str, chunk: str, score: str, score_kind: str, rank: str = "rank", max_chars: int = 4000, prefix: int = 200) -> DataFrame:
    """One record per used chunk: its original rank, place, score with its kind, sizes and hash."""
    used = used_chunks(ranked, query, text, rank, max_chars, prefix)
    return used.select(query, F.col(rank).alias("rank"), "place", F.col(chunk).alias("chunk_id"), F.col(score).alias("score"), F.lit(score_kind).alias("score_kind"), F.length("_t").alias("n_chars"), tx.sha1_text(F.col("_t")).alias("sha1"))
