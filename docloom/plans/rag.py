"""Questions to answers with provenance, for a whole table of questions in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import answers as an
from docloom.operators import context as cx
from docloom.operators import models as md
from docloom.operators import retrieval as rt


@dataclass(frozen=True)
class Retrieval:
    """How chunks are found: dense, lexical, hybrid (both fused and reranked), flat (dense, the context cut at its last character) or none."""

    method: str = "hybrid"
    k: int = 4
    k_dense: int = 30
    k_lexical: int = 50
    k_fused: int = 20
    max_chars: int = 4000
    prefix: int = 200


def retrieve(chunks: DataFrame, questions: DataFrame, how: Retrieval = Retrieval(), embedder: Callable[[], md.Embedder] = md.hashing_embedder) -> DataFrame:
    """question_id, chunk_id, text, score, score_kind, rank.  chunks (chunk_id, text, embedding if dense), questions (question_id, question)."""
    if how.method not in ("dense", "lexical", "hybrid", "flat"):
        raise ValueError(f"unknown retrieval method: {how.method}")
    texts = chunks.select("chunk_id", "text")
    lists = []
    if how.method != "lexical":
        vectors = chunks.select("chunk_id", F.col("embedding") if "embedding" in chunks.columns else md.embed(tx.passage_text(F.col("text")), embedder).alias("embedding"))
        wanted = questions.select("question_id", md.embed(tx.query_text(F.col("question")), embedder).alias("embedding"))
        lists.append(rt.dense_topk(vectors, wanted, "chunk_id", "question_id", "embedding", how.k_dense if how.method == "hybrid" else how.k))
    if how.method not in ("dense", "flat"):
        lists.append(rt.bm25_topk(texts, questions, "chunk_id", "text", "question_id", "question", k=how.k_lexical if how.method == "hybrid" else how.k))
    if how.method != "hybrid":
        kind = "relevance" if how.method == "lexical" else "distance"
        return lists[0].join(texts, "chunk_id").withColumn("score_kind", F.lit(kind)).select("question_id", "chunk_id", "text", "score", "score_kind", "rank")
    fused = rt.fuse([x.join(texts, "chunk_id") for x in lists], "question_id", rt.collision_key(F.col("text")), ["chunk_id", "text"], k=how.k_fused).join(questions.select("question_id", "question"), "question_id")
    best = rt.rerank(fused, "question_id", rt.overlap_score(F.col("question"), F.col("text")), how.k)
    return best.select("question_id", "chunk_id", "text", F.col("rerank_score").alias("score"), F.lit("relevance").alias("score_kind"), "rank")


def ask(chunks: DataFrame, questions: DataFrame, how: Retrieval = Retrieval(), generator: Callable[[], md.Generator] = md.extractive_generator, variant: str = "dedup", embedder: Callable[[], md.Embedder] = md.hashing_embedder) -> DataFrame:
    """question_id, question, answer, config, context_used, used_chunks, count, retrieval_config: one row per question.

    A question without any chunk is asked without context, and so is every
    question with the method none.  The method flat takes all k chunks and cuts
    the joined text to ``max_chars``; the others take whole chunks that fit.
    """
    none = questions.select("question_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("text"), F.lit(0.0).alias("score"), F.lit("none").alias("score_kind"), F.lit(0).alias("rank")).limit(0)
    found = none if how.method == "none" else retrieve(chunks, questions, how, embedder)
    used = cx.used_chunks(found, "question_id", "text", max_chars=cx.UNBOUNDED if how.method == "flat" else how.max_chars, prefix=how.prefix)
    record = F.struct("place", "rank", "chunk_id", "score", "score_kind", F.col("_t").alias("chunk_text"))
    packed = used.groupBy("question_id").agg(F.array_sort(F.collect_list(record)).alias("used_chunks"))
    context = F.array_join(F.transform("used_chunks", lambda x: x["chunk_text"]), cx.SEPARATOR)
    rows = questions.select("question_id", "question").join(packed, "question_id", "left").withColumn("context_used", F.coalesce(F.substring(context, 1, how.max_chars) if how.method == "flat" else context, F.lit("")))
    prompt = F.when(F.col("context_used") == "", an.bare_prompt(F.col("question"))).otherwise(an.prompt(F.col("context_used"), F.col("question")))
    answered = md.generate_answers(rows, prompt, generator, how.method)
    config = F.struct(*[F.lit(v).alias(k) for k, v in asdict(how).items()])
    return answered.select("question_id", "question", "method", "answer", an.sanitise(F.col("answer"), variant).alias("config"), "context_used", "used_chunks", F.coalesce(F.size("used_chunks"), F.lit(0)).alias("count"), config.alias("retrieval_config"))
