"""Documents to chunks: token windows, paragraphs, recursive splits, flat blocks, preserved blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docloom.functions import text as tx
from docloom.operators import structure as st
from docloom.operators.dedup import first_wins
from docloom.session import materialise, once

#: Separators of the recursive splitter, coarse to fine, without and with sentence marks.
PLAIN_SEPARATORS, SENTENCE_SEPARATORS = ("\n\n", "\n", ". ", " ", ""), ("\n\n", "\n", ". ", "! ", "? ", " ", "")


def window_starts(n: Column, size: Column, overlap: Column) -> Column:
    """Starts (from 0) of windows over n tokens: the last is the first to reach the end."""
    stride = F.greatest(F.lit(1), size - overlap)
    more = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), more), lambda i: (i * stride).cast("int")))


def token_windows(df: DataFrame, keys: list[str], body: str, size: Column, overlap: Column) -> DataFrame:
    """keys, part (from 0), parts_total, window: windows of four-character tokens.

    A token is four characters, so a window is one substring: nothing is built per token.
    """
    n = F.ceil(F.length(body) / 4).cast("int")
    starts = window_starts(n, F.col("_size"), F.col("_overlap"))
    rows = once(once(df, _size=size, _overlap=overlap), _starts=starts)
    return rows.select(*keys, F.size("_starts").alias("parts_total"), F.col(body).alias("_body"), "_size", F.posexplode("_starts").alias("part", "_start")).select(*keys, "part", "parts_total", F.col("_body").substr(F.col("_start") * 4 + 1, F.col("_size") * 4).alias("window"))


def hierarchical_chunks(df: DataFrame, document: str, section: str, order: list[str], body: str, max_tokens: int = 512, overlap: int = 50, min_words: int = 15, adaptive: bool = True) -> DataFrame:
    """Headed chunks of every section: normalised, without boilerplate, windowed, long enough, each text once.

    Of equal texts the first by ``order`` and part stays; the choice is one
    aggregation by hash, not a global sort.
    """
    rows = df.filter(F.col(body).isNotNull() & (tx.strip_u(F.col(body)) != "") & ~tx.is_boilerplate(F.col(body)))
    rows = rows.select(*dict.fromkeys(order), F.col(document).alias("document"), F.col(section).alias("section"), F.col(body).alias("_raw"))
    rows = once(rows, body=tx.collapse(F.col("_raw")), header=tx.semantic_header(F.col("document"), F.col("section"))).drop("_raw").withColumn("header_tokens", tx.token_count4(F.col("header")))
    rows = rows.withColumn("budget", tx.body_budget(F.lit(max_tokens), F.col("header_tokens"))).withColumn("n_tokens", F.ceil(F.length("body") / 4).cast("int"))
    step = tx.adaptive_overlap(F.col("n_tokens"), F.col("budget"), overlap) if adaptive else F.lit(overlap)
    keys = [*dict.fromkeys(order), "document", "section", "header", "header_tokens"]
    parts = token_windows(rows, keys, "body", F.col("budget"), step)
    texts = once(parts, text=F.concat("header", "window")).drop("header", "window")
    chunks = once(texts, word_count=tx.n_words(F.col("text"))).filter(F.col("word_count") >= min_words).withColumn("sha1", tx.sha1_text(F.col("text")))
    kept = first_wins(chunks, ["sha1"], [*dict.fromkeys(order), "part"])
    return kept.select(*dict.fromkeys(order), "document", "section", "part", "parts_total", "header_tokens", tx.token_count4(F.col("text")).alias("token_count"), "word_count", "sha1", "text")


def numbered(df: DataFrame, file: str, order: list[str], name: str = "id") -> DataFrame:
    """Ids ``chunk000000`` ... in order of file and position.

    Rows are range-partitioned by file and position and sorted within their
    partition; the partitions' counts become offsets.  A file with a third of
    all rows spreads over many partitions, and only one number per partition
    passes through a single task.
    """
    return _ranked(df, file, order).withColumn(name, F.format_string("chunk%06d", F.col("_rank"))).drop("_rank")


def _ranked(df: DataFrame, file: str, order: list[str]) -> DataFrame:
    """Adds _rank, the row's place from 0 in order of file and position."""
    ordered = df.repartitionByRange(file, *order).sortWithinPartitions(file, *order)
    at = F.monotonically_increasing_id()
    placed = materialise(ordered.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").withColumn("_rank", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")


def paragraph_chunks(df: DataFrame, keys: list[str], text: str, separator: str = "\n\n", min_tokens: int = 20, max_tokens: int = 512, ascii_only: bool = False) -> DataFrame:
    """keys, chunk_index, text: paragraphs that are no noise; long ones are cut to three words for four tokens of the limit."""
    clean = tx.clean_text_ascii if ascii_only else tx.clean_text
    rows = df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, separator)).alias("chunk_index", "raw"))
    rows = once(rows, p=clean(F.col("raw"))).drop("raw").filter(~tx.is_noise(F.col("p")) & (tx.approx_tokens(F.col("p")) >= min_tokens))
    cut = F.array_join(F.slice(tx.words(F.col("p")), 1, max_tokens * 3 // 4), " ")
    return rows.select(*keys, "chunk_index", F.when(tx.approx_tokens(F.col("p")) > max_tokens, cut).otherwise(F.col("p")).alias("text"))


def _merge(parts: list[str], joint: str, size: int, overlap: int) -> list[str]:
    """Neighbouring parts joined up to the size; a new piece starts with the last parts that fit the overlap."""
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        if held and length + len(joint) + len(part) > size:
            out.append(joint.join(held))
            while held and (length > overlap or length + len(joint) + len(part) > size):
                length -= len(held.pop(0)) + (len(joint) if held else 0)
        length += len(part) + (len(joint) if held else 0)
        held.append(part)
    return [x for x in (s.strip() for s in [*out, joint.join(held)]) if x]


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = PLAIN_SEPARATORS, keep: bool = False) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; finer ones cut what is still too long."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep == "":
        step = max(1, size - overlap)
        cuts = range(0, max(1, len(text) - overlap), step)
        return [x for x in (text[i : i + size].strip() for i in cuts) if x]
    pieces = text.split(sep)
    if keep:
        pieces = [pieces[0], *(sep + p for p in pieces[1:])]
    joint = "" if keep else sep
    out: list[str] = []
    short: list[str] = []
    for p in (p for p in pieces if p):
        if len(p) <= size:
            short.append(p)
            continue
        out += _merge(short, joint, size, overlap) if short else []
        short = []
        out += split_recursive(p, size, overlap, finer, keep) if finer else [p]
    return out + (_merge(short, joint, size, overlap) if short else [])


def recursive_chunks(df: DataFrame, keys: list[str], text: str, chunk_tokens: int = 256, overlap_tokens: int = 32, min_tokens: int = 20, sentences: bool = False) -> DataFrame:
    """keys, chunk_index, text: recursive splits of four characters a token; short pieces are left out.

    The split depends on what earlier cuts left, so it runs per text in Arrow batches.
    """
    size, overlap = chunk_tokens * 4, overlap_tokens * 4
    separators = SENTENCE_SEPARATORS if sentences else PLAIN_SEPARATORS

    @F.pandas_udf(ArrayType(StringType()))
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: split_recursive(t, size, overlap, separators, sentences), na_action="ignore")

    rows = df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(split(F.col(text))).alias("chunk_index", "text"))
    return rows.filter(tx.approx_tokens(F.col("text")) >= min_tokens)


def flat_blocks(text: str, paragraphs: int = 20, most: int = 1000, overlap: int = 100) -> list[tuple[str, str]]:
    """(id, text) of blocks of paragraphs.  The next block goes back over the fewest last paragraphs that reach the overlap."""
    items = [" ".join(p.strip().splitlines()) for p in text.split("\n\n") if p.strip()]
    out, start, number = [], 0, 0
    while start < len(items):
        block = items[start : start + paragraphs]
        joined = "\n".join(block).strip()
        pieces = [joined[i : i + most] for i in range(0, len(joined), most)]
        out += [(str(number), joined)] if len(joined) <= most else [(f"{number}.{j}", p) for j, p in enumerate(pieces)]
        back = 0
        if len(joined) > overlap:
            total = 0
            for k, item in enumerate(reversed(block), 1):
                total += len(item) + 1
                if total >= overlap:
                    back = k
                    break
        start += max(1, paragraphs - back) if len(joined) > overlap else paragraphs
        number += 1
    return out


def flat_chunks(df: DataFrame, keys: list[str], text: str, paragraphs: int = 20, most: int = 1000, overlap: int = 100) -> DataFrame:
    """keys, chunk_id, text.  Where a block starts depends on the blocks before it, so each text is one call in an Arrow batch."""

    @F.pandas_udf("array<struct<chunk_id:string,text:string>>")
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: [{"chunk_id": i, "text": x} for i, x in flat_blocks(t, paragraphs, most, overlap)], na_action="ignore")

    return df.filter(F.col(text).isNotNull()).select(*keys, F.explode(split(F.col(text))).alias("c")).select(*keys, "c.chunk_id", "c.text")


def _split_prose(rows: DataFrame, keys: list[str], chunk_tokens: int, overlap_tokens: int, min_tokens: int, max_tokens: int) -> DataFrame:
    """keys, piece, text: texts over the chunk size are split; noise and short pieces are left out, long ones cut."""
    size, overlap = chunk_tokens * 4, overlap_tokens * 4

    @F.pandas_udf(ArrayType(StringType()))
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: split_recursive(t, size, overlap), na_action="ignore")

    large = tx.approx_tokens(F.col("text")) > chunk_tokens
    pieces = F.when(large, split(F.when(large, F.col("text")))).otherwise(F.array("text"))
    rows = rows.select(*keys, F.posexplode(pieces).alias("piece", "text")).filter(~tx.is_noise(F.col("text")) & (tx.approx_tokens(F.col("text")) >= min_tokens))
    cut = F.array_join(F.slice(tx.words(F.col("text")), 1, max_tokens * 3 // 4), " ")
    return rows.withColumn("text", F.when(tx.approx_tokens(F.col("text")) > max_tokens, cut).otherwise(F.col("text")))


def section_chunks(lines: DataFrame, doc: str, chunk_tokens: int = 256, overlap_tokens: int = 32, min_tokens: int = 20, max_tokens: int = 512) -> DataFrame:
    """doc, sec_id, chunk_index, chapter, section, page_num, token_count, text: sections of font lines, split where too long, under their breadcrumb."""
    whole = once(st.section_texts(lines, doc).withColumnRenamed("text", "_raw"), text=tx.clean_text(F.col("_raw"))).drop("_raw").filter(~tx.is_noise(F.col("text")))
    parts = _split_prose(whole, [doc, "sec_id", "chapter", "section", "page_num"], chunk_tokens, overlap_tokens, min_tokens, max_tokens)
    headed = parts.withColumn("text", F.concat(tx.breadcrumb(F.col("chapter"), F.col("section")), F.col("text")))
    return headed.select(doc, "sec_id", F.col("piece").alias("chunk_index"), "chapter", "section", "page_num", tx.approx_tokens(F.col("text")).alias("token_count"), "text")


def block_chunks(lines: DataFrame, doc: str, chunk_tokens: int = 256, overlap_tokens: int = 32, min_tokens: int = 20, max_tokens: int = 512, oversized: str = "keep") -> DataFrame:
    """Blocks of commands and step tables stay whole; prose is split.

    ``oversized`` blocks are kept, kept for a warning (``oversized_blocks``
    lists them for whoever writes the chunks) or dropped.
    """
    if oversized not in ("keep", "warn", "drop"):
        raise ValueError(f"oversized must be keep, warn or drop, not {oversized}")
    spans = once(st.span_islands(lines, doc).withColumnRenamed("text", "_raw"), text=tx.clean_text(F.col("_raw"))).drop("_raw").filter(~tx.is_noise(F.col("text")))
    atomic = spans.filter(F.col("kind").isin(*st.ATOMIC) & (tx.approx_tokens(F.col("text")) >= min_tokens)).withColumn("oversized", tx.approx_tokens(F.col("text")) > max_tokens)
    if oversized == "drop":
        atomic = atomic.filter(~F.col("oversized"))
    keys = [doc, "sec_id", "island", "kind", "chapter", "section", "page_num"]
    prose = _split_prose(spans.filter(~F.col("kind").isin(*st.ATOMIC)), keys, chunk_tokens, overlap_tokens, min_tokens, max_tokens).withColumn("oversized", F.lit(False))
    every = atomic.withColumn("piece", F.lit(0)).select(*keys, "piece", "text", "oversized").unionByName(prose)
    order = Window.partitionBy(doc, "sec_id").orderBy("island", "piece")
    headed = every.withColumn("text", F.concat(tx.breadcrumb(F.col("chapter"), F.col("section")), F.col("text")))
    return headed.withColumn("chunk_index", F.row_number().over(order) - 1).select(doc, "sec_id", "chunk_index", F.col("kind").alias("block_type"), "oversized", "page_num", tx.approx_tokens(F.col("text")).alias("token_count"), "text")


def oversized_blocks(chunks: DataFrame, doc: str) -> DataFrame:
    """The blocks that stayed whole over the limit, with a line of warning for each."""
    said = F.format_string("oversized %s of %d tokens in %s, section %d: kept whole", F.col("block_type"), F.col("token_count"), F.col(doc).cast("string"), F.col("sec_id"))
    return chunks.filter("oversized").select(doc, "sec_id", "chunk_index", "block_type", "token_count", said.alias("warning"))


#: Strategies by name: the first three read page texts, the others font lines.
STRATEGIES = ("paragraph", "fixed", "semantic", "section", "block_preserve")


def chunk(df: DataFrame, strategy: str, doc: str, text: str = "text", dedup: bool = True, **options: int | str) -> DataFrame:
    """chunk_id, doc, chunk_index, strategy, token_count, text under one of the strategies.

    ``df`` holds page texts (doc, page_num, text) for the plain strategies and
    font lines for the others.  With ``dedup`` equal texts, up to case and
    spacing, stay once per document, then once in all.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    if strategy == "paragraph":
        rows = paragraph_chunks(df, [doc, "page_num"], text, **options).withColumn("_order", F.struct("page_num", "chunk_index"))
    elif strategy in ("fixed", "semantic"):
        rows = recursive_chunks(df, [doc, "page_num"], text, sentences=strategy == "semantic", **options).withColumn("_order", F.struct("page_num", "chunk_index"))
    else:
        made = section_chunks(df, doc, **options) if strategy == "section" else block_chunks(df, doc, **options)
        rows = made.withColumn("_order", F.struct("sec_id", "chunk_index"))
    rows = rows.select(doc, F.col("chunk_index"), F.lit(strategy).alias("strategy"), tx.approx_tokens(F.col("text")).alias("token_count"), "_order", "text")
    if dedup:
        rows = first_wins(rows.withColumn("_h", tx.fingerprint(F.col("text"))), ["_h"], [doc, "_order"]).drop("_h")
    # numbered within the document by the place in the whole, so that no document is sorted in one task
    ranked = _ranked(rows, doc, ["_order"])
    first = ranked.groupBy(F.col(doc).alias("_doc")).agg(F.min("_rank").alias("_first"))
    number = F.col("_rank") - F.col("_first") + 1
    return ranked.join(first, F.col(doc).eqNullSafe(F.col("_doc"))).withColumn("chunk_id", F.concat(tx.safe_id(F.col(doc).cast("string")), F.format_string("_chunk%06d", number))).drop("_order", "_rank", "_first", "_doc")
