"""Font lines to roles, sections and spans.  Order is a column (``line_no``), never the place in a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.session import materialise

ROLES = ("cli", "heading", "label", "step", "prose", "skip")
ATOMIC = ("cli_code", "step_table")


def y_bucket(top: Column) -> Column:
    """Words whose tops round to one even number stand on one line."""
    return F.bround(top / 2) * 2


def in_page_body(top: Column, bottom: Column, height: Column, header: float = 0.08, footer: float = 0.08) -> Column:
    return (top >= height * header) & (bottom <= height * (1 - footer))


def line_roles(words: DataFrame, keys: list[str], pos: str, font: str, size: str) -> DataFrame:
    """keys, role: by the words' fonts.  The commonest font decides (the first of equals), with the upper median size."""
    fonts = words.groupBy(*keys, font).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    main = fonts.groupBy(*keys).agg(F.max_by(F.lower(font), F.struct("n", -F.col("first"), F.lower(font))).alias("main"), F.every(F.lower(font).contains("courier")).alias("mono"))
    sizes = words.groupBy(*keys).agg(F.array_sort(F.collect_list(size)).alias("s")).select(*keys, F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("size"))
    f = F.col("main")
    structural = f.contains("univers") & f.contains("condensed") & f.contains("bold")
    step = f.contains("times-bold") | f.contains("timesnewromanps-boldmt")
    role = F.when(F.col("mono"), "cli").when(structural & (F.col("size") <= 9), "skip").when(structural & (F.col("size") >= 17), "heading").when(structural, "label").when(step, "step").otherwise("prose")
    return main.join(sizes, keys).select(*keys, role.alias("role"))


def lines_from_words(words: DataFrame, doc: str, header: float = 0.08, footer: float = 0.08) -> DataFrame:
    """doc, page_num, line_no, text, role, x0: the lines of each page, top to bottom, from words with font and place.

    Words in the header and footer bands are left out, as are lines of the
    running-header role and blank ones.  line_no is (page, top), so it orders
    the lines of a document without a window over it.
    """
    inside = words.filter(in_page_body(F.col("top"), F.col("bottom"), F.col("page_height"), header, footer)).withColumn("_y", y_bucket(F.col("top")))
    keys = [doc, "page_num", "_y"]
    roles = line_roles(inside, keys, "x0", "fontname", "size")
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    texts = inside.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"))
    rows = texts.join(roles, keys).filter((F.col("role") != "skip") & (tx.strip_u(F.col("text")) != ""))
    return rows.select(doc, "page_num", F.struct("page_num", F.col("_y").alias("y")).alias("line_no"), tx.strip_u(F.col("text")).alias("text"), "role", "x0")


def font_lines(sections: DataFrame, key: str = "section_id", lines: str = "font_lines") -> DataFrame:
    """One row per line of an array of lines."""
    return sections.select(key, F.explode(lines).alias("l")).select(key, "l.line_no", "l.text", "l.role", "l.page_num", "l.x0")


#: Lines above which a document is cut into stretches.
LONG = 100_000


def in_order(lines: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    """The lines with ``_part``, the number of the stretch they are in, and (_doc) of the documents of several stretches, if there are any.

    A document over ``LONG`` lines spreads over stretches, ranges of its lines
    short enough for a window; what a stretch needs from those before it is
    carried over (``_carried``).  Every other document is one stretch, number 0.
    """
    long = lines.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("n")).filter(F.col("n") > LONG).select("_doc")
    if not long.take(1):
        return lines.withColumn("_part", F.lit(0)), None
    long = materialise(long, "long-documents")
    met = _same({doc: "_doc"})
    cut = lines.join(long, met, "left_semi").repartitionByRange(doc, "line_no").withColumn("_part", F.spark_partition_id() + 1)
    return lines.join(long, met, "left_anti").withColumn("_part", F.lit(0)).unionByName(materialise(cut, "stretches")), long


def _same(keys: dict[str, str]) -> Column:
    met = None
    for k, v in keys.items():
        one = F.col(k).eqNullSafe(F.col(v))
        met = one if met is None else met & one
    return met


def _carried(rows: DataFrame, spanning: DataFrame | None, keys: list[str], sums: dict[str, Column], last: dict[str, Column]) -> DataFrame:
    """The rows with, for each of ``sums``, its total in the stretches before, and for each of ``last`` its latest value there that is not null.

    Only what goes on from one stretch to the next has something to carry: one
    row a stretch, which is broadcast.
    """
    if spanning is None:
        return rows.withColumns({c: F.lit(0).cast("long") for c in sums} | {c: F.when(F.lit(False), v) for c, v in last.items()})
    at = {c: F.max_by(v, F.when(v.isNotNull(), F.col("line_no"))).alias(c) for c, v in last.items()}
    long = rows.join(spanning, _same({keys[0]: "_doc"}), "left_semi")
    own = long.groupBy(*keys, "_part").agg(*[F.sum(v).alias(c) for c, v in sums.items()], *at.values())
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_k_{k}" for k in [*keys, "_part"]}
    carry = own.select(*[F.col(k).alias(v) for k, v in names.items()], F.count("*").over(before).alias("_earlier"), *[F.sum(c).over(before).alias(c) for c in sums], *[F.last(c, ignorenulls=True).over(before).alias(c) for c in last]).filter("_earlier > 0")
    met = rows.join(F.broadcast(carry.drop("_earlier")), _same(names), "left").drop(*names.values())
    return met.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums}) if sums else met


def with_sections(lines: DataFrame, doc: str) -> DataFrame:
    """Each line with the section it falls in: sec_id, chapter, section, section_page (and _part, see ``in_order``)."""
    return _outlined(lines, doc)[0]


def _outlined(lines: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    ordered, spanning = in_order(lines, doc)
    head = F.coalesce(F.col("role") == "heading", F.lit(False))
    is_chapter = F.coalesce(head & F.col("text").rlike(r"(?i)\bchapter\b"), F.lit(False))
    last_head = F.when(head, F.struct("text", "page_num", is_chapter.alias("chapter")))
    title = F.when(is_chapter, F.col("text"))
    rows = _carried(ordered, spanning, [doc], {"_n": head.cast("int")}, {"_title": title, "_head": last_head})
    w = Window.partitionBy("_part", doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"sec_id": F.col("_n") + F.sum(head.cast("int")).over(w), "chapter": F.coalesce(F.last(title, ignorenulls=True).over(w), F.col("_title"), F.lit("Preamble")), "_h": F.coalesce(F.last(last_head, ignorenulls=True).over(w), F.col("_head"))})
    rows = rows.withColumn("section", F.when(F.col("_h").isNull() | F.col("_h.chapter"), "Overview").otherwise(F.col("_h.text"))).withColumn("section_page", F.coalesce("_h.page_num", F.lit(1)))
    return rows.drop("_h", "_n", "_title", "_head"), spanning


def section_texts(lines: DataFrame, doc: str) -> DataFrame:
    """doc, sec_id, chapter, section, page_num, n_lines, text: sections that hold a line besides their heading."""
    rows = with_sections(lines, doc).filter((F.col("role") != "heading") & F.col("text").isNotNull())
    return rows.groupBy(doc, "sec_id").agg(F.first("chapter").alias("chapter"), F.first("section").alias("section"), F.first("section_page").alias("page_num"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


def with_kinds(lines: DataFrame, doc: str) -> DataFrame:
    """Each line with its span kind: commands after a step or label belong to a step table."""
    return _kinded(lines, doc)[0]


def _kinded(lines: DataFrame, doc: str) -> tuple[DataFrame, DataFrame | None]:
    sections, spanning = _outlined(lines, doc)
    rows = sections.filter("role <> 'heading'")
    other = F.when(F.col("role") != "cli", F.col("role"))
    rows = _carried(rows, spanning, [doc], {}, {"_other": F.when(other.isNotNull(), F.struct("sec_id", other.alias("role")))})
    w = Window.partitionBy("_part", doc, "sec_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.coalesce(F.last(other, ignorenulls=True).over(w), F.when(F.col("_other.sec_id") == F.col("sec_id"), F.col("_other.role")))
    kind = F.when(F.col("role") == "cli", F.when(before.isin("step", "label"), "step_table").otherwise("cli_code")).when(F.col("role").isin("step", "label"), "step_table").otherwise("prose")
    return rows.withColumn("kind", kind).drop("_other"), spanning


def span_islands(lines: DataFrame, doc: str) -> DataFrame:
    """doc, sec_id, island, kind, n_lines, text, page_num: neighbours of one kind, without blank edges; blank spans vanish."""
    w = Window.partitionBy("_part", doc, "sec_id").orderBy("line_no")
    kinds, spanning = _kinded(lines, doc)
    rows = _carried(kinds, spanning, [doc], {}, {"_last": F.struct("sec_id", "kind")})
    before = F.coalesce(F.lag("kind").over(w), F.when(F.col("_last.sec_id") == F.col("sec_id"), F.col("_last.kind")))
    rows = rows.withColumn("_new", F.coalesce((F.col("kind") != before).cast("int"), F.lit(0))).drop("_last")
    rows = _carried(rows, spanning, [doc, "sec_id"], {"_sum": F.col("_new")}, {})
    rows = rows.withColumn("island", F.col("_sum") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    spans = rows.groupBy(doc, "sec_id", "island").agg(F.first("kind").alias("kind"), F.count("*").alias("n_lines"), F.first("chapter").alias("chapter"), F.first("section").alias("section"), F.first("section_page").alias("page_num"), whole.alias("text"))
    trimmed = F.regexp_replace("text", rf"\A(?:{tx.WS}*\n)+|(?:\n{tx.WS}*)+\z", "")
    return spans.withColumn("text", trimmed).filter(tx.strip_u(F.col("text")) != "")


def command_blocks(df: DataFrame, keys: list[str], text: str, opening: str = r"(?i)^\s*(?:interface|router|ip access-list|line)\b") -> DataFrame:
    """keys, block_no, block: the text cut before every line that opens a block."""
    lines = df.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = (F.col("line").rlike(opening) & (F.col("n") > 0)).cast("int")
    rows = lines.withColumn("block_no", F.sum(opened).over(w))
    return rows.groupBy(*keys, "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("block"))
