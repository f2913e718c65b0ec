"""Figures over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx


def token_stats(df: DataFrame, group: str, tokens: Column) -> DataFrame:
    """group, n, lowest, p25, p50, p75, highest, mean: index quantiles, no value between two rows.

    Values are counted first, so the running count covers distinct values of a
    group, not its rows.
    """
    counts = df.select(F.col(group).alias("g"), tokens.alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("hi", F.sum("c").over(w)).join(counts.groupBy(F.col("g").alias("_g")).agg(F.sum("c").alias("n")), F.col("g").eqNullSafe(F.col("_g")))
    at = lambda q: F.min(F.when(F.col("hi") > F.floor(F.col("n") * q), F.col("v")))
    return run.groupBy("g", "n").agg(F.min("v").alias("lowest"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max("v").alias("highest"), (F.sum(F.col("v") * F.col("c")) / F.first("n")).alias("mean")).withColumnRenamed("g", group)


def structure_counts(df: DataFrame, group: str, chapter: Column, section: Column) -> DataFrame:
    """Distinct chapters and (chapter, section) pairs; a missing one counts as one value."""
    return df.groupBy(group).agg(F.count_distinct(F.struct(chapter)).alias("chapters"), F.count_distinct(F.struct(chapter, section)).alias("sections"), F.count("*").alias("chunks"))


def block_types(df: DataFrame, kind: Column, oversized: Column) -> DataFrame:
    return df.groupBy(kind.alias("block_type")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(oversized, F.lit(False))).alias("n_oversized"))


def chunking_totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens, tokens in headers, mean header and its share."""
    t = chunks.agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.sum("header_tokens").alias("header_tokens"))
    whole = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(1))
    return t.select("chunks", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("header_tokens", F.lit(0)).alias("header_tokens"), (F.coalesce("header_tokens", F.lit(0)) / F.greatest("chunks", F.lit(1))).alias("mean_header"), (F.coalesce("header_tokens", F.lit(0)) * 100 / whole).alias("header_percent"))


def context_totals(chapters: DataFrame, document: str, chapter: str, intro: str, key: str, max_tokens: int = 300) -> DataFrame:
    """One row: contexts, those made shorter than document, chapter and introduction in full, the tokens that saves, and those cut to the limit."""
    label, first = tx.context_label(F.col(document), F.col(chapter), F.col(intro)), tx.strip_u(F.concat_ws("\n", F.concat(F.lit("Document: "), F.col(key)), F.coalesce(chapter, F.lit(""))))
    full = F.when(F.coalesce(intro, F.lit("")) == "", first).otherwise(F.concat(first, F.lit("\n"), F.col(intro)))
    saved = tx.token_count4(full) - tx.token_count4(label)
    cut = tx.bounded_context(label, max_tokens) != label
    return chapters.select(saved.alias("saved"), cut.alias("cut")).agg(F.count("*").alias("contexts"), F.count_if(F.col("saved") > 0).alias("contexts_optimized"), F.coalesce(F.sum(F.when(F.col("saved") > 0, F.col("saved"))), F.lit(0)).alias("tokens_saved"), F.count_if("cut").alias("contexts_cut"))


def overlap_totals(bodies: DataFrame, tokens: str, budget: str, overlap: int = 50) -> DataFrame:
    """One row: bodies over their budget, and those of them whose windows overlap less than asked."""
    long = F.col(tokens) > F.col(budget)
    less = tx.adaptive_overlap(F.col(tokens), F.col(budget), overlap) < overlap
    return bodies.agg(F.count_if(long).alias("split"), F.count_if(long & less).alias("overlaps_reduced"))
