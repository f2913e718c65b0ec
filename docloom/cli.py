"""Command line: ``python -m docloom.cli chunk|lines|index|ask|evaluate|score|models ...`` over files or tables in parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking as ck
from docloom.operators import models as md
from docloom.plans import evaluation, index, rag
from docloom.sources import readers, sinks

#: Judges by name; a deployment adds its own.
JUDGES = {"stand-in": md.rule_judge}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("chunk", help="nested JSON manuals to headed chunks")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--max-tokens", type=int, default=512)
    c.add_argument("--overlap", type=int, default=50)
    c.add_argument("--min-words", type=int, default=15)
    n = sub.add_parser("lines", help="decoded pages or font lines (parquet) to chunks by a strategy")
    n.add_argument("input")
    n.add_argument("output")
    n.add_argument("--strategy", choices=ck.STRATEGIES, default="block_preserve")
    n.add_argument("--doc", default="pdf_name")
    n.add_argument("--chunk-tokens", type=int, default=256)
    n.add_argument("--overlap-tokens", type=int, default=32)
    n.add_argument("--min-tokens", type=int, default=20)
    n.add_argument("--max-tokens", type=int, default=512)
    n.add_argument("--oversized", choices=("keep", "warn", "drop"), default="keep")
    n.add_argument("--no-dedup", action="store_true")
    i = sub.add_parser("index", help="chunks to a vector index")
    i.add_argument("chunks")
    i.add_argument("output")
    a = sub.add_parser("ask", help="a CSV of questions over chunks or an index")
    a.add_argument("chunks")
    a.add_argument("questions")
    a.add_argument("output")
    a.add_argument("--method", choices=("dense", "lexical", "hybrid", "flat", "none"), default="hybrid")
    a.add_argument("--k", type=int, default=4)
    a.add_argument("--max-chars", type=int, default=4000)
    a.add_argument("--variant", choices=("dedup", "plain"), default="dedup")
    e = sub.add_parser("evaluate", help="judge answers (parquet) and report the consensus")
    e.add_argument("answers")
    e.add_argument("output")
    e.add_argument("--judges", nargs="+", default=["stand-in"], choices=sorted(JUDGES))
    e.add_argument("--enough", type=int)
    s = sub.add_parser("score", help="judge a CSV: its columns and twelve for each judge; scored rows are left as they are")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--answer", required=True)
    s.add_argument("--question", default="question")
    s.add_argument("--judges", nargs="+", default=["stand-in"], choices=sorted(JUDGES))
    sub.add_parser("models", help="the judges that are known")
    return p


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    if o.command == "models":
        print("\n".join(sorted(JUDGES)))
        return
    spark = SparkSession.builder.getOrCreate()
    if o.command == "chunk":
        sections = readers.nested_documents(spark, o.input)
        ck.hierarchical_chunks(sections, "document", "section", ["source_file", "chapter_no", "section_no"], "body", o.max_tokens, o.overlap, o.min_words).write.mode("overwrite").parquet(o.output)
    elif o.command == "lines":
        sizes = {"max_tokens": o.max_tokens, "min_tokens": o.min_tokens} if o.strategy == "paragraph" else {"chunk_tokens": o.chunk_tokens, "overlap_tokens": o.overlap_tokens, "min_tokens": o.min_tokens}
        sizes |= {"max_tokens": o.max_tokens} if o.strategy in ("section", "block_preserve") else {}
        sizes |= {"oversized": o.oversized} if o.strategy == "block_preserve" else {}
        ck.chunk(spark.read.parquet(o.input), o.strategy, o.doc, dedup=not o.no_dedup, **sizes).write.mode("overwrite").parquet(o.output)
    elif o.command == "index":
        index.save(index.build(spark.read.parquet(o.chunks)), o.output)
    elif o.command == "ask":
        questions = readers.questions(spark, o.questions).select(F.xxhash64("question").alias("question_id"), "question").distinct()
        how = rag.Retrieval(method=o.method, k=o.k, max_chars=o.max_chars)
        rag.ask(spark.read.parquet(o.chunks), questions, how, variant=o.variant).write.mode("overwrite").parquet(o.output)
    elif o.command == "evaluate":
        judged = evaluation.judge(spark.read.parquet(o.answers), {j: JUDGES[j] for j in o.judges}, enough=o.enough)
        evaluation.report(judged).write.mode("overwrite").parquet(o.output)
    else:
        rows = readers.questions(spark, o.input, o.question)
        sinks.write_csv(evaluation.evaluate_table(rows, o.answer, {j: JUDGES[j] for j in o.judges}, o.question), o.output)


if __name__ == "__main__":
    main()
