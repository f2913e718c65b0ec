"""Training triplets: quality filter, split by topic, and their two measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality(score: Column, label: Column, least: int = 2) -> Column:
    """Missing scores count as 3 and missing labels as 1."""
    return (F.coalesce(score, F.lit(3)) >= least) & (F.coalesce(label, F.lit(1)) == 1)


def topic_split(df: DataFrame, topic: str, key: str, ratio: float = 1 - 0.9, seed: int = 42) -> DataFrame:
    """Adds is_val: in each topic the first max(1, floor(n * ratio)) rows by seeded hash, ties by key.

    Hash prefixes are counted per topic first.  Whole prefixes fall on either
    side of the cut; only the rows of the prefix that holds the cut are
    ranked, so a topic with a third of all rows is never sorted in one task.
    """
    rows = df.withColumn("_h", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy(F.col(topic).alias("_t"), F.col("_b").alias("_p")).agg(F.count("*").alias("_n"))
    run = Window.partitionBy("_t").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sized = counts.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).withColumn("_n_val", F.greatest(F.lit(1), F.floor(F.sum("_n").over(Window.partitionBy("_t")) * ratio)))
    cut = sized.filter((F.col("_before") < F.col("_n_val")) & (F.col("_before") + F.col("_n") >= F.col("_n_val"))).select("_t", "_p", (F.col("_n_val") - F.col("_before")).alias("_take"))
    marked = rows.join(cut, F.col(topic).eqNullSafe(F.col("_t")))
    clear = marked.filter(F.col("_b") != F.col("_p")).withColumn("is_val", F.col("_b") < F.col("_p"))
    rank = F.row_number().over(Window.partitionBy(topic, "_b").orderBy("_h", key))
    close = marked.filter(F.col("_b") == F.col("_p")).withColumn("is_val", rank <= F.col("_take"))
    return clear.unionByName(close).drop("_h", "_b", "_t", "_p", "_take")


def accuracy(df: DataFrame, pos: str, neg: str) -> DataFrame:
    """The share of triplets whose positive is strictly nearer; 0 without rows."""
    return df.agg(F.coalesce(F.avg((F.col(pos) > F.col(neg)).cast("double")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def similarity_gap(df: DataFrame, batch: str, pos: str, neg: str, loss: str | None = None) -> DataFrame:
    """Mean of the batches' means: a short last batch weighs as much as a full one.  With a loss per row also the mean loss."""
    means = df.groupBy(batch).agg(F.avg(pos).alias("p"), F.avg(neg).alias("n"), *([F.avg(loss).alias("l")] if loss else []))
    return means.agg(F.avg("p").alias("pos"), F.avg("n").alias("neg"), F.avg(F.col("p") - F.col("n")).alias("gap"), F.count("*").alias("batches"), *([F.avg("l").alias("loss")] if loss else []))


def contrastive_loss(pos: Column, neg: Column, temperature: float = 0.05) -> Column:
    """The loss of one triplet: minus the logarithm of the positive's share between positive and negative."""
    return F.log1p(F.exp((neg - pos) / temperature))
