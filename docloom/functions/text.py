"""Column expressions over text.  White space is Unicode white space throughout."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One white-space character, spelled so that Java and RE2 read the same set.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Line ends other than the line feed.
LINE_ENDS = r"\r\n|[\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# Phrases that mark a whole section as boilerplate, anywhere and in any case.
BOILERPLATE_PHRASES = (
    "Finding Feature Information", "Additional References", "Related Documentation",
    "Document Conventions", "Technical Assistance", "Support Information",
    "Documentation Updates", "Obtaining Documentation", "Bug Search Tool",
)

# Beginnings that mark a fragment as noise, in this case.
NOISE_PREFIXES = (
    "Americas Headquarters", "Cisco Systems, Inc.",
    "THE SPECIFICATIONS", "THE SOFTWARE LICENSE",
    "NOTWITHSTANDING ANY OTHER", "IN NO EVENT SHALL CISCO",
    "© 20", "All rights reserved",
)


def strip_u(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_u(c), F.lit(""))


def words(c: Column) -> Column:
    """The pieces between white space; none for a blank text."""
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def approx_tokens(c: Column) -> Column:
    """Four tokens for three words, rounded down."""
    return F.floor(n_words(c) * 4 / 3).cast("int")


def collapse(c: Column) -> Column:
    """Runs of spaces and tabs to one space, three or more line feeds to two, no white space around."""
    return strip_u(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _clean(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return strip_u(F.regexp_replace(c, rf"(?md)^(?:[.\-]|{WS}){{5,}}$", ""))


def clean_text_ascii(c: Column) -> Column:
    """Spacing and leader lines cleaned, letters as they are."""
    return _clean(c)


def clean_text(c: Column) -> Column:
    """Compatibility forms replaced (Python only sees texts with a letter beyond ASCII), then cleaned."""
    return _clean(F.when(c.rlike(r"[^\x{00}-\x{7F}]"), _nfkc(F.when(c.rlike(r"[^\x{00}-\x{7F}]"), c))).otherwise(c))


def is_boilerplate(c: Column, phrases: tuple[str, ...] = BOILERPLATE_PHRASES) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for p in phrases:
        found = found | low.contains(p.lower())
    return found


def is_noise(c: Column, prefixes: tuple[str, ...] = NOISE_PREFIXES) -> Column:
    """Blank, under three words, a table-of-contents entry, a number, or one of the beginnings."""
    s = strip_u(c)
    out = (n_words(s) < 3) | s.rlike(rf"(?:\.|{WS}){{3,}}[0-9]+{WS}*\z") | s.rlike(r"\A[0-9]+\z")
    for p in prefixes:
        out = out | s.startswith(p)
    return out


def sha1_text(c: Column) -> Column:
    return F.sha1(F.encode(c, "UTF-8"))


def fingerprint(c: Column) -> Column:
    """Hash of the text in lower case with single spaces."""
    return F.sha2(F.encode(F.regexp_replace(strip_u(F.lower(c)), f"{WS}+", " "), "UTF-8"), 256)


def slug(c: Column) -> Column:
    """A model name as part of a column name."""
    return F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"), r"\A_+|_+\z", "")


def safe_id(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "_")


def semantic_header(document: Column, section: Column) -> Column:
    """``document > section >`` without blank parts."""
    return F.concat(F.concat_ws(" > ", blank_to_null(document), blank_to_null(section)), F.lit(" >"))


def breadcrumb(chapter: Column, section: Column) -> Column:
    """``chapter > section`` and a line feed; nothing where both are blank."""
    joined = F.concat_ws(" > ", blank_to_null(chapter), blank_to_null(section))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(joined, F.lit("\n")))


def token_count4(c: Column) -> Column:
    """Tokens of the four-character tokenizer: the length over four, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def body_budget(max_tokens: Column, header_tokens: Column) -> Column:
    """What the header leaves of a chunk, but 200 at least."""
    return F.when(header_tokens.isNull() | (header_tokens <= 0), max_tokens).otherwise(F.greatest(F.lit(200), max_tokens - header_tokens))


def adaptive_overlap(n_tokens: Column, budget: Column, overlap: int = 50) -> Column:
    """Overlap of the windows of a body by how far it exceeds the budget."""
    ratio = n_tokens / budget
    return F.when(ratio <= 1.3, 0).when(ratio <= 2.0, min(100, overlap // 2)).otherwise(overlap).cast("int")


def query_text(c: Column) -> Column:
    return F.concat(F.lit("query: "), c)


def passage_text(c: Column) -> Column:
    """With the passage prefix, unless a prefix is there."""
    return F.when(c.startswith("query: ") | c.startswith("passage: "), c).otherwise(F.concat(F.lit("passage: "), c))


def context_label(document: Column, chapter: Column, intro: Column) -> Column:
    """Short description of where a chunk stands: document, chapter and a short introduction."""
    title, lead = strip_u(chapter), strip_u(intro)
    part = F.split(title, " ", 4)
    numbered = F.concat(F.lit("\n"), F.concat_ws(" ", F.slice(part, 1, 2)), F.lit(": "), F.coalesce(F.try_element_at(part, F.lit(3)), F.lit("")))
    plain = F.concat(F.lit("\nChapter: "), F.substring(title, 1, 100), F.when(F.length(title) > 100, F.lit("...")).otherwise(F.lit("")))
    named = F.when(blank_to_null(chapter).isNull(), F.lit("")).when(F.upper(title).startswith("CHAPTER") | F.upper(title).startswith("CHAPITRE"), numbered).otherwise(plain)
    return F.concat(F.lit("PDF: "), document, named, F.when((F.length(lead) > 0) & (F.length(lead) <= 150), F.concat(F.lit("\n"), lead)).otherwise(F.lit("")))


def bounded_context(label: Column, max_tokens: int = 300) -> Column:
    """The label, or as much of it as the limit of four-character tokens holds, without space at its end and with three dots."""
    over = F.ceil((F.length(label) + 2) / 4) > max_tokens
    return F.when(over, F.concat(F.regexp_replace(F.substring(label, 1, 4 * max_tokens), rf"{WS}+\z", ""), F.lit("..."))).otherwise(label)
