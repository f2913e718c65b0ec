"""The registered queries of the core.  Each reads whole tables; ``oracles`` holds the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import jsonx, vector
from docloom.functions import text as tx
from docloom.operators import answers as an
from docloom.operators import batch as bt
from docloom.operators import checkpoints as cp
from docloom.operators import chunking as ck
from docloom.operators import context as cx
from docloom.operators import dedup as dd
from docloom.operators import judging as jd
from docloom.operators import models as md
from docloom.operators import retrieval as rt
from docloom.operators import stats as sx
from docloom.operators import structure as st
from docloom.operators import triplets as tp
from docloom.plans import evaluation, index, oracles, rag
from docloom.session import spread
from docloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in REGISTRY}


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """A table; with columns, only those, spread over all cores for work that is heavy per row."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return spread(df.select(*columns)) if columns else df


# -- text ----------------------------------------------------------------------


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "chunks", "chunk_id", "text").select("chunk_id", tx.clean_text(F.col("text")).alias("text"))


@query
def clean_text_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "chunks", "chunk_id", "text").select("chunk_id", tx.clean_text_ascii(F.col("text")).alias("text"))


@query
def approx_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "chunks").select("chunk_id", tx.approx_tokens(F.col("text")).cast("bigint").alias("n_tokens"))


@query
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = sx.token_stats(read(spark, sf, "chunks").withColumn("strategy", F.col("metadata.strategy")), "strategy", tx.approx_tokens(F.col("text")))
    return out.select("strategy", *[F.col(c).cast("bigint").alias(c) for c in ("n", "lowest", "p25", "p50", "p75", "highest")], F.round("mean", 6).alias("mean"))


@query
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "chunks", "chunk_id", "text").select("chunk_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(tx.is_noise(F.col("line"))).groupBy("chunk_id").agg(F.count("*").alias("n_noise"), F.min("pos").cast("bigint").alias("first_noise"))


@query
def boilerplate_filter(spark: SparkSession, sf: str) -> DataFrame:
    phrases = (*tx.BOILERPLATE_PHRASES, "All rights reserved", "Before you begin")
    return read(spark, sf, "chunks").filter(tx.is_boilerplate(F.col("text"), phrases)).select("chunk_id")


@query
def semantic_headers(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    return read(spark, sf, "chunks").select("chunk_id", tx.semantic_header(m["pdf_name"], m["section"]).alias("header"), tx.breadcrumb(m["chapter"], m["section"]).alias("breadcrumb"))


@query
def body_budgets(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    rows = read(spark, sf, "chunks").select("chunk_id", tx.token_count4(tx.semantic_header(m["pdf_name"], m["section"])).alias("header_tokens"), F.ceil(F.length("text") / 4).cast("int").alias("n"))
    rows = rows.withColumn("budget", tx.body_budget(F.lit(512), F.col("header_tokens")))
    return rows.select("chunk_id", F.col("header_tokens").cast("bigint").alias("header_tokens"), F.col("budget").cast("bigint").alias("budget"), tx.adaptive_overlap(F.col("n"), F.col("budget")).cast("bigint").alias("overlap"))


@query
def context_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    label = tx.context_label(F.coalesce(m["pdf_name"], F.lit("")), m["chapter"], m["section"])
    return read(spark, sf, "chunks").select("chunk_id", label.alias("label"), tx.token_count4(label).cast("bigint").alias("tokens"))


@query
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.sha1_text(F.col("text")).alias("sha1"), tx.fingerprint(F.col("text")).alias("fingerprint"))


@query
def prefix_guard(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "triplets").select("triplet_id", tx.query_text(F.col("query")).alias("query"), tx.passage_text(F.col("pos")).alias("pos"))


@query
def model_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "judge_results").select(F.col("model"), tx.slug(F.col("model")).alias("slug"), tx.safe_id(F.col("model")).alias("safe")).distinct()


# -- chunking --------------------------------------------------------------------


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "source", "lang", "text").select("doc_id", "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("section"), F.col("lang"), "text")


@query
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sections(spark, sf).filter("text is not null").withColumn("text", tx.collapse(F.col("text")))
    out = ck.token_windows(rows, ["doc_id"], "text", F.lit(100), F.lit(20))
    return out.select("doc_id", F.col("part").cast("bigint").alias("part"), F.col("parts_total").cast("bigint").alias("parts_total"), F.sha1("window").alias("window_sha1"))


def _chunks(spark: SparkSession, sf: str, section: str = "section") -> DataFrame:
    return ck.hierarchical_chunks(_sections(spark, sf), "source", section, ["doc_id"], "text")


@query
def hier_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", F.col("part").cast("bigint").alias("part"), F.col("parts_total").cast("bigint").alias("parts_total"), F.col("token_count").cast("bigint").alias("token_count"), F.col("word_count").cast("bigint").alias("word_count"), "sha1")


@query
def hier_chunks_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """Sections named by language: equal texts under one header meet in the deduplication."""
    return _chunks(spark, sf, "lang").select("doc_id", F.col("part").cast("bigint").alias("part"), "sha1")


@query
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ck.numbered(_chunks(spark, sf, "lang").select("document", "doc_id", "part"), "document", ["doc_id", "part"]).select("doc_id", F.col("part").cast("bigint").alias("part"), "id")


@query
def chunking_totals(spark: SparkSession, sf: str) -> DataFrame:
    out = sx.chunking_totals(_chunks(spark, sf))
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in ("chunks", "tokens", "header_tokens")], F.round("mean_header", 6).alias("mean_header"), F.round("header_percent", 6).alias("header_percent"))


@query
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = ck.paragraph_chunks(read(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text", min_tokens=20, max_tokens=60, ascii_only=True)
    return out.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.sha1("text").alias("sha1"))


@query
def recursive_split(spark: SparkSession, sf: str) -> DataFrame:
    return ck.recursive_chunks(read(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text")


@query
def semantic_split(spark: SparkSession, sf: str) -> DataFrame:
    return ck.recursive_chunks(read(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text", sentences=True)


@query
def flat_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ck.flat_chunks(read(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text")


@query
def sha1_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dd.exact_dedup(read(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query
def normalised_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dd.normalised_dedup(read(spark, sf, "documents").filter("text is not null").select("doc_id", "source", "text"), "text", ["doc_id"], within=["source"]).select("doc_id")


@query
def flat_json_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "chunks").select(F.col("metadata.source_file").alias("source_file"), F.col("metadata.chunk_index").alias("ord"), "chunk_id", "text")
    out = sinks.grouped_texts(rows, "source_file", "ord", ["ord", "chunk_id"], "text", size=500)
    return out.select("source_file", F.col("part").cast("bigint").alias("part"), F.size("texts").cast("bigint").alias("n"), F.sha1(F.array_join("texts", "\x1e")).alias("sha1"))


@query
def structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "chunks").select(F.col("metadata.source_file").alias("source_file"), "metadata")
    return sx.structure_counts(rows, "source_file", F.col("metadata.chapter"), F.col("metadata.section"))


@query
def block_types(spark: SparkSession, sf: str) -> DataFrame:
    return sx.block_types(read(spark, sf, "chunks"), F.col("metadata.block_type"), F.col("metadata.oversized"))


# -- structure -------------------------------------------------------------------


def _font_name(flag: Column) -> Column:
    return F.when(flag == "R", "Courier-New").when(flag == "A", "Univers-CondensedBold").otherwise("Times-Bold")


@query
def font_line_roles(spark: SparkSession, sf: str) -> DataFrame:
    words = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _font_name(F.col("l_returnflag")).alias("font"), F.col("l_quantity").alias("size"))
    return st.line_roles(words, ["l_orderkey"], "l_linenumber", "font", "size")


@query
def words_to_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as words of a page: quantity is the distance from the top, the line number the place."""
    words = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc"), F.col("l_orderkey").cast("int").alias("page_num"), F.lit(60.0).alias("page_height"), F.concat(F.col("l_linestatus"), F.col("l_partkey").cast("string")).alias("text"), _font_name(F.col("l_returnflag")).alias("fontname"), (F.col("l_tax") * 200).alias("size"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 2).alias("bottom"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("x0"))
    return st.lines_from_words(words, "doc").select("doc", F.col("page_num").cast("bigint").alias("page_num"), F.col("line_no.y").alias("y"), "text")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "text").withColumn("page_num", F.lit(1))


@query
def chunk_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Every strategy by name, with its chunks' count and tokens."""
    lines = _font_lines(spark, sf)
    out = None
    for name in ck.STRATEGIES:
        made = ck.chunk(lines, name, "section_id") if name in ("section", "block_preserve") else ck.chunk(_pages(spark, sf), name, "doc_id")
        part = made.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def sections_from_headings(spark: SparkSession, sf: str) -> DataFrame:
    out = st.section_texts(_event_lines(spark, sf), "user_id")
    return out.select("user_id", F.col("sec_id").cast("bigint").alias("sec_id"), "chapter", "section", F.col("page_num").cast("bigint").alias("page_num"), F.col("n_lines").cast("bigint").alias("n_lines"), F.sha1("text").alias("sha1"))


def _event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as font lines: errors are headings, clicks commands, purchases steps, sign-ups labels, views prose."""
    role = F.when(F.col("event_type") == "error", "heading").when(F.col("event_type") == "click", "cli").when(F.col("event_type") == "purchase", "step").when(F.col("event_type") == "signup", "label").otherwise("prose")
    name = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.concat(F.lit("Chapter "), F.col("event_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    return read(spark, sf, "events").select("user_id", F.struct(F.col("ts").alias("a"), F.col("event_id").alias("b")).alias("line_no"), role.alias("role"), name.alias("text"), (F.col("event_id") % 7).cast("int").alias("page_num"))


@query
def span_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return st.with_kinds(_event_lines(spark, sf), "user_id").groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query
def span_islands(spark: SparkSession, sf: str) -> DataFrame:
    out = st.span_islands(_event_lines(spark, sf), "user_id")
    return out.select("user_id", F.col("sec_id").cast("bigint").alias("sec_id"), F.col("island").cast("bigint").alias("island"), "kind", F.col("n_lines").cast("bigint").alias("n_lines"))


def _font_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The font lines of the manuals' sections."""
    return st.font_lines(read(spark, sf, "sections", "section_id", "font_lines"))


@query
def manual_sections(spark: SparkSession, sf: str) -> DataFrame:
    out = st.section_texts(_font_lines(spark, sf), "section_id")
    return out.select("section_id", F.col("sec_id").cast("bigint").alias("sec_id"), "chapter", "section", F.col("page_num").cast("bigint").alias("page_num"), F.col("n_lines").cast("bigint").alias("n_lines"), F.sha1("text").alias("sha1"))


@query
def manual_spans(spark: SparkSession, sf: str) -> DataFrame:
    out = st.span_islands(_font_lines(spark, sf), "section_id")
    return out.select("section_id", F.col("sec_id").cast("bigint").alias("sec_id"), F.col("island").cast("bigint").alias("island"), "kind", F.col("n_lines").cast("bigint").alias("n_lines"))


@query
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ck.section_chunks(_font_lines(spark, sf), "section_id")


@query
def block_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ck.block_chunks(_font_lines(spark, sf), "section_id")


@query
def command_blocks(spark: SparkSession, sf: str) -> DataFrame:
    out = st.command_blocks(read(spark, sf, "evaluations").select("eval_id", "ingested_at", "answer"), ["eval_id", "ingested_at"], "answer")
    return out.groupBy("eval_id").agg(F.max(F.col("block_no") + 1).cast("bigint").alias("n_blocks"))


# -- retrieval -------------------------------------------------------------------


def _dense(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    v = read(spark, sf, "embeddings")
    return rt.dense_topk(v, v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", 30, metric)


@query
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, "l2").select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def dense_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf, "cosine").select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "questions").filter("question_id % 50 = 0")


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return rt.bm25_topk(read(spark, sf, "chunks", "chunk_id", "text"), _asked(spark, sf), "chunk_id", "text", "question_id", "question", k=50)


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).select("question_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _lists(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Two rankings of the same chunks, from one scan: BM25 for the question's topic and its text, and for the question."""
    asked = _asked(spark, sf)
    broad = asked.select("question_id", F.concat_ws(" ", "topic", F.lower("question")).alias("question"))
    return rt.bm25_lists(read(spark, sf, "chunks", "chunk_id", "text"), [(broad, "question_id", "question", 30), (asked, "question_id", "question", 50)], "chunk_id", "text")


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "chunks").select("chunk_id", "text", F.col("metadata.source_file").alias("source_file"), F.col("metadata.page_num").alias("page_num"))
    lists = [r.join(texts, "chunk_id") for r in _lists(spark, sf)]
    key = rt.collision_key(F.col("text"), F.col("source_file"), F.col("page_num"))
    return rt.fuse(lists, "question_id", key, ["chunk_id", "text"])


@query
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return rt.fuse(_lists(spark, sf), "question_id", "chunk_id", ["chunk_id"]).select("question_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def rrf_fusion_prefix_key(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("question_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bm25(spark, sf).join(read(spark, sf, "chunks").select("chunk_id", "text"), "chunk_id").join(_asked(spark, sf).select("question_id", "question"), "question_id")
    return rt.rerank(rows, "question_id", rt.overlap_score(F.col("question"), F.col("text"))).select("question_id", "chunk_id", "rerank_score", F.col("rank").cast("bigint").alias("rank"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf).join(read(spark, sf, "chunks").select("chunk_id", "text"), "chunk_id")


@query
def context_pack_4000(spark: SparkSession, sf: str) -> DataFrame:
    return cx.pack(_ranked(spark, sf), "question_id", "text", max_chars=4000).select("question_id", F.sha1("context").alias("sha1"), F.length("context").cast("bigint").alias("n_chars"), "n_used")


@query
def context_pack_8000(spark: SparkSession, sf: str) -> DataFrame:
    return cx.pack(_ranked(spark, sf), "question_id", "text", max_chars=8000).select("question_id", F.sha1("context").alias("sha1"), F.length("context").cast("bigint").alias("n_chars"), "n_used")


@query
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    out = cx.provenance(_ranked(spark, sf), "question_id", "text", "chunk_id", "score", "relevance")
    return out.select("question_id", F.col("rank").cast("bigint").alias("rank"), F.col("place").cast("bigint").alias("place"), "chunk_id", "score", "score_kind", F.col("n_chars").cast("bigint").alias("n_chars"), "sha1")


@query
def rag_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to headed chunks, BM25 and a packed context for every question of the search set."""
    chunks = _chunks(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("part").cast("string")).alias("chunk_id"), "text")
    ranked = rt.bm25_topk(chunks, _asked(spark, sf), "chunk_id", "text", "question_id", "question", k=4).join(chunks, "chunk_id")
    return cx.pack(ranked, "question_id", "text").select("question_id", F.sha1("context").alias("sha1"), F.length("context").cast("bigint").alias("n_chars"), "n_used")


@query
def hybrid_rag(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and lexical lists fused, reranked, packed, answered and cleaned; models are stand-ins."""
    chunks = read(spark, sf, "chunks").select("chunk_id", "text", F.col("metadata.source_file").alias("source_file"), F.col("metadata.page_num").alias("page_num"))
    asked = _asked(spark, sf).select("question_id", "question")
    vectors = chunks.select("chunk_id", md.embed(tx.passage_text(F.col("text")), md.hashing_embedder).alias("v"))
    wanted = asked.select("question_id", md.embed(tx.query_text(F.col("question")), md.hashing_embedder).alias("v"))
    dense = rt.dense_topk(vectors, wanted, "chunk_id", "question_id", "v", 30).join(chunks, "chunk_id")
    lexical = _bm25(spark, sf).join(chunks, "chunk_id")
    fused = rt.fuse([dense, lexical], "question_id", rt.collision_key(F.col("text"), F.col("source_file"), F.col("page_num")), ["chunk_id", "text"]).join(asked, "question_id")
    best = rt.rerank(fused, "question_id", rt.overlap_score(F.col("question"), F.col("text")))
    packed = cx.pack(best, "question_id", "text").join(asked, "question_id")
    answered = md.generate_answers(packed, an.prompt(F.col("context"), F.col("question")), md.extractive_generator, "hybrid")
    return answered.select("question_id", "n_used", "method", an.sanitise(F.col("answer")).alias("answer"))


@query
def rag_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with the chunks used, for each way of retrieval."""
    chunks, asked = read(spark, sf, "chunks", "chunk_id", "text"), _asked(spark, sf)
    out = None
    for method in ("lexical", "dense", "hybrid"):
        part = rag.ask(chunks, asked, rag.Retrieval(method=method)).select("question_id", "method", "count", "config", F.to_json(F.struct("used_chunks", "retrieval_config")).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


# -- answers ---------------------------------------------------------------------


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "evaluations", "eval_id", "answer").filter("answer is not null").distinct()


@query
def sanitise_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("eval_id", an.sanitise(F.col("answer"), "dedup").alias("config")).distinct()


@query
def sanitise_plain(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("eval_id", an.sanitise(F.col("answer"), "plain").alias("config")).distinct()


@query
def extract_config(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("eval_id", an.extract_config(F.col("answer")).alias("config")).distinct()


@query
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "questions").select("question_id", F.length(an.bare_prompt(F.col("question"))).cast("bigint").alias("n_bare"), F.sha1(an.prompt(F.col("topic"), F.col("question"))).alias("sha1"))


@query
def pending_answers(spark: SparkSession, sf: str) -> DataFrame:
    return bt.pending_answers(read(spark, sf, "evaluations"), "answer").select("eval_id").distinct()


@query
def pending_judgements(spark: SparkSession, sf: str) -> DataFrame:
    return bt.pending_judgements(read(spark, sf, "evaluations"), read(spark, sf, "judge_results").filter("parsing_success"), ["eval_id"], "answer").select("eval_id").distinct()


# -- judging ---------------------------------------------------------------------


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Judge responses with the flaws that real ones have, by the row's number."""
    cols = [F.concat(F.lit(f'"{c}": '), F.format_string("%.1f", F.coalesce(F.col(c), F.lit(0.0)))) for c in jsonx.CRITERIA]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *cols), F.lit(', "confidence": 80, "potential_issues": ["mtu", "acl"]}'))
    n = F.col("result_id") % 7
    text = (
        F.when(n == 0, body)
        .when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("<think>maybe\n10</think> Scores: "), body, F.lit(" as asked.")))
        .when(n == 3, F.concat(F.lit("Result: "), F.substr(body, F.lit(2))))
        .when(n == 4, F.lit("no idea"))
        .when(n == 5, F.concat(body, F.lit("<thinking>never closed")))
        .otherwise(F.replace(body, F.lit('"accuracy": '), F.lit('"accuracy": "x", "was": ')))
    )
    return read(spark, sf, "judge_results", "result_id", *jsonx.CRITERIA).select("result_id", text.alias("response"))


@query
def strip_thinking(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).select("result_id", jsonx.strip_thinking(F.col("response")).alias("response"), jsonx.thinking(F.col("response")).alias("thought"))


@query
def judge_json(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    return _responses(spark, sf).withColumn("p", jsonx.parse_judge(F.col("response"))).select("result_id", p["method"].alias("method"), p["ok"].alias("ok"), p["scores"]["accuracy"].alias("accuracy"), p["scores"]["correctness"].alias("correctness"), p["confidence"].alias("confidence"))


@query
def judge_json_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Five judgements a response: a bare array, a fenced one, one inside prose, and one short of an object; every seventh item has no accuracy."""
    cols = [F.concat(F.lit(f'"{c}": '), F.format_string("%.1f", F.coalesce(F.col(c), F.lit(0.0)))) for c in jsonx.CRITERIA]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *cols), F.lit("}"))
    item = F.when(F.col("result_id") % 7 == 0, F.replace(body, F.lit('"accuracy": '), F.lit('"was": '))).otherwise(body)
    rows = read(spark, sf, "judge_results", "result_id", *jsonx.CRITERIA).select("result_id", item.alias("item"), F.floor(F.col("result_id") / 5).alias("batch"))
    made = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("result_id", "item"))).alias("x"))
    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x["item"]), ", "), F.lit("]"))
    n = F.col("batch") % 4
    text = F.when(n == 0, listed(F.col("x"))).when(n == 1, F.concat(F.lit("```json\n"), listed(F.col("x")), F.lit("\n```"))).when(n == 2, F.concat(F.lit("Scores: "), listed(F.col("x")), F.lit(" as asked."))).otherwise(listed(F.slice("x", 2, 100)))
    found = made.select("x", F.explode(F.arrays_zip("x", jsonx.parse_judge_batch(text, F.size("x")).alias("p"))).alias("z"))
    return found.select("z.x.result_id", "z.p.ok", "z.p.valid", "z.p.scores.accuracy", "z.p.scores.completeness")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as judges of one answer: up to seven, so outliers occur."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 5).alias("accuracy"), (F.col("l_discount") * 100).alias("relevance"), (F.col("l_tax") * 100).alias("correctness"), (F.col("l_quantity") / 5).alias("hallucination"), (F.col("l_discount") * 100).alias("completeness"))
    return li.withColumn("overall", F.round(jd.weighted(), 6))


@query
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "judge_results").filter("parsing_success").select("result_id", F.round(jd.weighted(), 6).alias("overall"), F.round(jd.weighted(jd.READINESS), 6).alias("readiness"))


@query
def outlier_filter(spark: SparkSession, sf: str) -> DataFrame:
    return jd.with_reliability(_judged(spark, sf), "l_orderkey").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "reliable", F.round("strength", 5).alias("strength"))


@query
def consensus_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = jd.consensus(_judged(spark, sf), "l_orderkey")
    return out.select("l_orderkey", *[F.round(c, 5).alias(c) for c in ("accuracy", "correctness", "overall", "strength")], F.col("judges_used").cast("bigint").alias("judges_used"), F.col("judges").cast("bigint").alias("judges"))


@query
def risk_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = jd.consensus(_judged(spark, sf), "l_orderkey").withColumn("readiness", F.round("readiness", 5))
    return out.select("l_orderkey", "readiness", jd.risk(F.col("readiness")).alias("risk"), F.round(F.least(F.lit(100.0), F.col("readiness") * 10), 4).alias("deployment_confidence"))


@query
def critical_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.concat(F.lit("flag "), F.col("l_returnflag")), F.concat(F.lit("status "), F.col("l_linestatus")), F.concat(F.lit("tax "), F.col("l_tax").cast("string"))).alias("issues"))
    out = jd.critical_issues(rows, "l_orderkey", "l_linenumber", "issues")
    return out.select("l_orderkey", "issue", F.col("n").cast("bigint").alias("n"), F.col("place").cast("bigint").alias("place"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """The judgements that succeeded, a row each, with their overall score."""
    rows = read(spark, sf, "judge_results").filter("parsing_success and eval_id is not null")
    return rows.select("eval_id", "result_id", *jsonx.CRITERIA).withColumn("overall", F.round(jd.weighted(), 6))


@query
def judge_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return jd.with_reliability(_scores(spark, sf), "eval_id").select("eval_id", "result_id", "reliable", F.round("strength", 5).alias("strength"))


@query
def judge_consensus(spark: SparkSession, sf: str) -> DataFrame:
    out = jd.consensus(_scores(spark, sf), "eval_id")
    return out.select("eval_id", *[F.round(c, 5).alias(c) for c in ("accuracy", "correctness", "overall", "strength", "readiness")], "risk", F.col("judges_used").cast("bigint").alias("judges_used"), F.col("judges").cast("bigint").alias("judges"))


@query
def judge_issues(spark: SparkSession, sf: str) -> DataFrame:
    """What more than three in a hundred of a question's calls failed with."""
    rows = read(spark, sf, "judge_results").filter("question_id is not null").select("question_id", "result_id", F.when(F.col("error_message").isNull(), F.array().cast("array<string>")).otherwise(F.array("error_message")).alias("issues"))
    out = jd.critical_issues(rows, "question_id", "result_id", "issues", share=0.03)
    return out.select("question_id", "issue", F.col("n").cast("bigint").alias("n"), F.col("place").cast("bigint").alias("place"))


@query
def judges_until_enough(spark: SparkSession, sf: str) -> DataFrame:
    return jd.until_enough(read(spark, sf, "judge_results").filter("eval_id is not null").withColumn("good", F.coalesce("parsing_success", F.lit(False))), "eval_id", "result_id", "good", 3).select("eval_id", "result_id")


@query
def score_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A column for every judge of ``judge_models``, in any spelling, and every metric: ``<judge>_<metric>``."""
    results, models = read(spark, sf, "judge_results"), read(spark, sf, "judge_models")
    names = models.filter("model is not null").select(F.col("model").alias("judge"), jd.judge_key(F.col("model")).alias("judge_key")).dropDuplicates(["judge_key"])
    slugs = sorted(r.s for r in names.select(tx.slug(F.col("judge")).alias("s")).collect())
    # a left join: questions that only unknown judges answered keep their row
    rows = results.filter("parsing_success").withColumn("judge_key", jd.judge_key(F.col("model"))).join(F.broadcast(names), "judge_key", "left")
    out = jd.score_columns(rows, ["question_id"], "judge", list(jd.METRICS), slugs)
    return out.select("question_id", *[F.round(f"{s}_{m}", 5).alias(f"{s}_{m}") for s in slugs for m in jd.METRICS])


@query
def judge_progress(spark: SparkSession, sf: str) -> DataFrame:
    return jd.progress(read(spark, sf, "judge_results").withColumn("model", F.lower(F.trim("model"))), "model", "correctness").select("model", "scored", "open", F.round("mean", 5).alias("mean"))


@query
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).join(read(spark, sf, "evaluations").select("eval_id", "question").distinct(), "eval_id").select("eval_id", F.length(jd.judge_prompt(F.col("question"), F.col("answer"))).cast("bigint").alias("n_chars")).distinct()


@query
def judge_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Every answer judged by two stand-ins, with the consensus."""
    answers = read(spark, sf, "evaluations").groupBy("eval_id").agg(F.max_by(F.struct("question", "answer"), "ingested_at").alias("r")).select("eval_id", "r.question", "r.answer")
    return evaluation.report(evaluation.judge(answers, {"one": md.rule_judge, "two": md.rule_judge})).select("eval_id", "judges_ok", "judges_failed", F.round("overall", 5).alias("overall"), "risk", F.round("strength", 5).alias("strength"))


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    """Each evaluation as it was delivered last."""
    return read(spark, sf, "evaluations").groupBy("eval_id").agg(F.max_by(F.struct("question", "answer"), "ingested_at").alias("r")).select("eval_id", "r.question", "r.answer")


@query
def judges_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Three judges in order, each asked only about answers that none before could judge."""
    judges = {"first": partial(md.rule_judge, 3), "second": partial(md.rule_judge, 2), "third": md.rule_judge}
    return evaluation.judge(_latest(spark, sf), judges, enough=1).select("eval_id", "model", "ok", F.round("overall", 5).alias("overall"))


@query
def judge_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Eight pairs a call."""
    return evaluation.judge(_latest(spark, sf), {"batched": md.batch_rule_judge}, batch=8).select("eval_id", "ok", "accuracy", "completeness", "confidence", F.round("overall", 5).alias("overall"))


@query
def evaluation_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluations as a table with columns of scores; every fourth has been scored before and keeps its score."""
    rows = _latest(spark, sf).withColumn("eval_rule_judge_overall", F.when(F.col("eval_id") % 4 == 0, F.lit(5.25)))
    out = evaluation.evaluate_table(rows, "answer", {"rule judge": partial(md.rule_judge, 5)})
    return out.select("eval_id", F.col("eval_rule_judge_overall").cast("double").alias("overall"), *[F.col(f"eval_rule_judge_{c}").cast("string" if c == "risk" else "double").alias(c) for c in jd.WIDE if c != "overall"])


@query
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """A vector index built over the chunks and asked the search set; the encoder is a stand-in."""
    built = index.build(read(spark, sf, "chunks", "chunk_id", "text"))
    return index.search(built, _asked(spark, sf).select("question_id", "question"), 10).select("question_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def context_totals(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    rows = read(spark, sf, "chunks").select(F.coalesce(m["pdf_name"], F.lit("")).alias("document"), m["chapter"].alias("chapter"), F.col("text").alias("intro"), m["source_file"].alias("key"))
    return sx.context_totals(rows, "document", "chapter", "intro", "key")


@query
def overlap_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").filter("text is not null").select(F.ceil(F.length("text") / 4).cast("int").alias("n"), F.lit(300).alias("budget"))
    return sx.overlap_totals(rows, "n", "budget")


# -- triplets and checkpoints ------------------------------------------------------


@query
def triplet_filter(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "triplets").filter(tp.quality(F.col("_meta.eval_score"), F.col("_meta.eval_detail.A"))).select("triplet_id")


@query
def topic_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "triplets").select("triplet_id", F.col("_meta.topic").alias("topic"))
    return tp.topic_split(rows, "topic", "triplet_id").select("triplet_id", "is_val")


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "triplets").filter("query is not null and pos is not null and neg is not null")
    return t.select("triplet_id", F.round(rt.overlap_score(F.col("query"), F.col("pos")), 9).alias("sp"), F.round(rt.overlap_score(F.col("query"), F.col("neg")), 9).alias("sn"), F.floor(F.col("triplet_id") / 64).alias("batch"))


@query
def triplet_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return tp.accuracy(_sides(spark, sf), "sp", "sn").select(F.round("accuracy", 6).alias("accuracy"), "n")


@query
def validation_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sides(spark, sf).withColumn("loss", tp.contrastive_loss(F.col("sp"), F.col("sn")))
    return tp.similarity_gap(rows, "batch", "sp", "sn", "loss").select(*[F.round(c, 6).alias(c) for c in ("pos", "neg", "gap", "loss")], "batches")


@query
def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_nationkey") % 3
    rows = read(spark, sf, "supplier").select(F.col("s_name").alias("path"), F.when(n == 0, "best").when(n == 1, "step").otherwise("final").alias("kind"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("score"))
    return cp.best_checkpoint(rows, "path", "kind", "score")


@query
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.round(vector.norm(vector.normalise(F.col("embedding"))), 6).alias("norm"), F.round(vector.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"))


@query
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: tumbling event-time windows, the batch form of the stream operator."""
    return read(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
