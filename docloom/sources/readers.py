"""Sources.  Every reader states its schema; none infers one by a pass over the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.batch import require_columns

TRIPLET = "query string, pos string, neg string, _meta struct<topic:string,eval_score:int,eval_detail:struct<A:int>>"
CHUNK = "id string, chunk_id string, text string, metadata struct<source_file:string,pdf_name:string,chapter:string,section:string,page_num:int,token_count:int,word_count:int,strategy:string,chunk_index:int,block_type:string,oversized:boolean,sha1:string,chunk_id:string>, source_file string, pdf_name string, chapter string, section string, token_count int"
CHECKPOINT = "checkpoint_type string, metrics struct<triplet_accuracy:double,val_sim_gap:double>"


def nested_documents(spark: SparkSession, path: str) -> DataFrame:
    """Manuals as JSON objects with one array of chapters under a free key.

    document, source_file, chapter_no, section_no, chapter, section, intro,
    body: one row per section, in file order.  Files that are no JSON give none.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_name").alias("source_file"), F.col("value"))
    maps = files.withColumn("m", F.from_json("value", "map<string,string>"))
    first = lambda c, *names: F.coalesce(*[tx.blank_to_null(c[n]) for n in names])
    stem = F.regexp_replace("source_file", r"\.json$", "")
    document = F.coalesce(*[tx.blank_to_null(F.try_element_at("m", F.lit(n))) for n in ("pdf_name", "document_name", "source")], stem)
    sections = "array<struct<title:string,section:string,content:string,text:string,body:string>>"
    chapters = f"array<struct<chapter:string,title:string,intro:string,introduction:string,sections:{sections}>>"
    entries = maps.filter("m is not null").select("source_file", document.alias("document"), F.explode("m").alias("key", "json")).filter(F.col("json").rlike(r"\A\s*\["))
    parsed = entries.select("source_file", "document", "key", F.posexplode(F.from_json("json", chapters)).alias("chapter_no", "c"))
    rows = parsed.select("source_file", "document", "chapter_no", first(F.col("c"), "chapter", "title").alias("chapter"), first(F.col("c"), "intro", "introduction").alias("intro"), F.posexplode("c.sections").alias("section_no", "s"))
    return rows.select("source_file", "document", "chapter_no", "section_no", "chapter", first(F.col("s"), "title", "section").alias("section"), "intro", first(F.col("s"), "content", "text", "body").alias("body"))


def chunk_documents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of chunks of either layout as one table: chunk_id, text and the metadata lifted from where it stands."""
    raw = spark.read.schema(CHUNK).option("multiLine", True).json(path)
    lifted = [F.coalesce(f"metadata.{c}", c).alias(c) for c in ("source_file", "pdf_name", "chapter", "section", "token_count")]
    return raw.select(F.coalesce("metadata.chunk_id", "id", "chunk_id").alias("chunk_id"), "text", *lifted, "metadata.page_num", "metadata.strategy", "metadata.chunk_index", "metadata.block_type", "metadata.oversized")


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """Line JSON; blank and broken lines are left out."""
    return spark.read.schema(TRIPLET).option("mode", "DROPMALFORMED").json(path)


def questions(spark: SparkSession, path: str, column: str = "question") -> DataFrame:
    """A CSV of questions, quoted fields over several lines allowed; the column must be there."""
    return require_columns(spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path), column)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """path, checkpoint_type, score of every ``metadata.json`` below the folder."""
    raw = spark.read.schema(CHECKPOINT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), r"/metadata\.json$", "").alias("path"), "checkpoint_type", F.col("metrics.triplet_accuracy").alias("score"))


def binary_documents(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Files of a folder, recursively, by path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "length", "content")


def decoded_words(files: DataFrame, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words with font and place from binary documents, through a decoder that is plugged in.

    ``decode`` gives dicts with page_num, page_height, text, fontname, size,
    top, bottom and x0.  Words in the header and footer bands are left out.
    """
    schema = "path string, page_num int, page_height double, text string, fontname string, size double, top double, bottom double, x0 double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [{"path": path} | w for path, content in zip(p["path"], p["content"], strict=True) for w in decode(bytes(content))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    from docloom.operators.structure import in_page_body

    return files.select("path", "content").mapInPandas(run, schema).filter(in_page_body(F.col("top"), F.col("bottom"), F.col("page_height")))


def page_texts(blocks: DataFrame, keys: list[str], header: float = 0.10, footer: float = 0.10) -> DataFrame:
    """Text of each page from positioned blocks inside the bands, in order; blank pages are left out."""
    inside = blocks.filter((F.col("y0") > F.col("page_height") * header) & (F.col("y1") < F.col("page_height") * (1 - footer)))
    pages = inside.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return pages.filter(tx.strip_u(F.col("text")) != "")


def plain_pages(words: DataFrame, keys: list[str], header: float = 0.08, footer: float = 0.08) -> DataFrame:
    """keys, text: plain text of each page from positioned words, without the header and footer bands; blank pages are left out.  Fonts play no part."""
    from docloom.operators.structure import in_page_body, y_bucket

    inside = words.filter(in_page_body(F.col("top"), F.col("bottom"), F.col("page_height"), header, footer)).withColumn("_y", y_bucket(F.col("top")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    lines = inside.groupBy(*keys, "_y").agg(line.alias("line"))
    pages = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_y", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.filter(tx.strip_u(F.col("text")) != "")


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
