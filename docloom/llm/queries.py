"""The pN_ queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import answer_defects as ad
from docloom.llm import consensus as cs
from docloom.llm import contamination as cn
from docloom.llm import mixing as mx
from docloom.llm import near_duplicates as nd
from docloom.llm import oracles
from docloom.llm import repeated_lines as rl
from docloom.llm import sentences as se
from docloom.llm import split_overlap as so
from docloom.llm import splitting as sp
from docloom.session import materialise


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = nd.near_duplicate_pairs(_read(spark, sf, "chunks"), "chunk_id", "text", width=3, threshold=0.5)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per chunk with its class of equal sets and the class's links; copies are not expanded.  The same words and threshold as p1_found."""
    members, links = nd.near_duplicate_classes(_read(spark, sf, "chunks"), "chunk_id", "text", width=3, threshold=0.5)
    ends = links.select(F.explode(F.array("ca", "cb")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    return members.join(ends, "cls", "left").select(F.col("k").alias("chunk_id"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return ad.defects(_read(spark, sf, "evaluations"), "eval_id", "question", "answer", "ingested_at").select(F.col("k").alias("eval_id"), "defect")


def _votes(spark: SparkSession, sf: str, score: str = "correctness") -> DataFrame:
    return cs.valid_votes(_read(spark, sf, "judge_results"), _read(spark, sf, "judge_models"), score)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(b) for b in cs.BANDS]), F.col("label") + 1)
    return cs.Consensus(_votes(spark, sf)).posterior().select("eval_id", label.alias("verdict"))


SCORES = ("correctness", "hallucination", "overall_score")


def _each_score(spark: SparkSession, sf: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    votes = materialise(cs.votes_of(_read(spark, sf, "judge_results"), _read(spark, sf, "judge_models"), list(SCORES)), "votes-of-scores")
    each = [of(votes.filter(F.col("score") == s).drop("score")).withColumn("score", F.lit(s)) for s in SCORES]
    return each[0].unionByName(each[1]).unionByName(each[2])


def p3_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return _each_score(spark, sf, lambda votes: cs.Consensus(votes).reliability())


def p3_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _each_score(spark, sf, cs.agreement_parts).select("eval_id", "score", F.col("n").cast("bigint").alias("n_votes"), F.round("agreement", 6).alias("agreement"))


def p3_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return _each_score(spark, sf, cs.krippendorff).select("score", F.col("n_items").cast("bigint").alias("n_items"), F.col("n_votes").cast("bigint").alias("n_votes"), F.round("alpha", 6).alias("alpha"))


def _oversized(spark: SparkSession, sf: str, with_text: bool) -> DataFrame:
    chunks = _read(spark, sf, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text")
    sections = _read(spark, sf, "sections").select(F.lit("section").alias("item_kind"), F.col("section_id").cast("string").alias("item_key"), sp.lines_text(F.col("font_lines")).alias("text"))
    keys = ["item_kind", "item_key"]
    return sp.split_oversized(chunks, keys, F.col("text"), with_text=with_text).unionByName(sp.split_oversized(sections, keys, F.col("text"), with_text=with_text))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _oversized(spark, sf, False).groupBy("item_kind", "item_key").agg(F.when(F.max("hard"), "hard").otherwise("natural").alias("cut"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _oversized(spark, sf, True)


def _furniture(spark: SparkSession, sf: str) -> rl.RepeatedLines:
    return rl.RepeatedLines(_read(spark, sf, "chunks"), F.col("chunk_id"), F.col("text"), rl.manual_name(), least=5, share=0.1)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _furniture(spark, sf).found().select(F.col("k").alias("chunk_id"), "line_no")


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _furniture(spark, sf).cleaned().select(F.col("k").alias("chunk_id"), "text", "n_removed")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = so.cross_split_pairs(_read(spark, sf, "triplets"), "triplet_id", "split", ["query", "pos"], width=1, threshold=0.7)
    return pairs.select(F.least("train", "eval").alias("triplet_id_a"), F.greatest("train", "eval").alias("triplet_id_b"), "field")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return so.cross_split_report(_read(spark, sf, "triplets"), "triplet_id", "split", "source", ["query", "pos"], width=1, threshold=0.7)


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return cn.leaks(_read(spark, sf, "documents"), "doc_id", "text", _read(spark, sf, "heldout_items"), "item_id", "text", width=12)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("k").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return cn.removal_spans(_leaks(spark, sf)).withColumnRenamed("k", "doc_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "heldout_items").select("item_id", "suite")
    hits = _leaks(spark, sf).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("k").alias("n_docs"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def _mix(spark: SparkSession, sf: str) -> DataFrame:
    return mx.rates(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mx.falling_short(_mix(spark, sf))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mx.emit(_read(spark, sf, "documents"), _mix(spark, sf), "doc_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mx.report(_read(spark, sf, "documents"), _mix(spark, sf), "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return se.sentence_units(_read(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("k", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
