"""Building, saving, loading and asking a vector index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import models as md
from docloom.operators import retrieval as rt
from docloom.sources import readers, sinks


def build(chunks: DataFrame, embedder: Callable[[], md.Embedder] = md.hashing_embedder, batch: int = 32) -> DataFrame:
    """The chunks (chunk_id, text and whatever else they have) with ``embedding``, unit vectors of their texts as passages; blank texts are left out."""
    rows = chunks.filter(F.col("chunk_id").isNotNull() & (tx.strip_u(F.coalesce("text", F.lit(""))) != ""))
    return rows.withColumn("embedding", md.embed(tx.passage_text(F.col("text")), embedder, batch))


def save(index: DataFrame, path: str) -> None:
    sinks.write_index(index, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return readers.vector_index(spark, path)


def search(index: DataFrame, questions: DataFrame, k: int = 4, embedder: Callable[[], md.Embedder] = md.hashing_embedder, metric: str = "l2") -> DataFrame:
    """question_id, chunk_id, score, rank: the k nearest chunks of each question (question_id, question)."""
    asked = questions.select("question_id", md.embed(tx.query_text(F.col("question")), embedder).alias("embedding"))
    return rt.dense_topk(index.select("chunk_id", "embedding"), asked, "chunk_id", "question_id", "embedding", k, metric)
