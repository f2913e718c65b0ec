"""Problem 2: question and answer pairs whose answer is no usable reply.

Refusals are not found by a list of phrases.  The first sentences of every
answer that hold no value are masked (names of hosts, models and places) and
equal masks are counted; each distinct mask goes to the commonest of all masks
that share 0.8 of its words (exactly, by the prefix filter), and a cluster is
such a mask with every mask near to it.  A cluster that recurs over unrelated
prompts while its answers hold nothing technical is a template that evades the
question: a refusal; so are the masks whose commonest near mask it is.  Templates of real
answers recur as well, but with addresses, ports and values in the answer.
Prompts are unrelated if those of a cluster share, on average, less than 0.8 of
their words; rewordings of one prompt are therefore no evidence.

Languages are learned from the table itself: questions whose function words
agree give a language to their own words and those of their answers, and the
words are counted by language in a table of fixed size.  A word speaks for a
language where it is four times as frequent as in any other; words that the
data do not show often enough speak only if they are function words.  Words of
commands and names stand in all languages alike and speak for none.

The other kinds are read off each pair: empty wrapping and placeholders, the
question given back (by runs of four letters or digits, so that changed case,
punctuation, spacing, labels and repeats do not matter), and text that breaks
off.  One pair gets one kind, in the order empty, copy, refusal, language,
truncated.

Defined results: a null or blank answer is empty; a null question has no words,
so neither copy nor language applies; of several deliveries of one id the one
ingested last counts (on a tie, the greater kind); rows with a null id are left
out; an empty table gives no row; only the first ``OPENING`` sentences of an
answer can be its refusal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import near_heads as nh
from docloom.llm import setjoin as sj
from docloom.llm.tokens import Words, _mixed_lower, _tables, distinct, layout, mix64, powers
from docloom.session import materialise

KINDS = ("empty", "copy", "refusal", "language", "truncated")
#: Words that stand for no answer when nothing else is left.
PLACEHOLDERS = frozenset("na none null nil nan tbd todo undefined empty blank answer response reply output result antwort réponse reponse respuesta nichts rien nada keine aucune ninguna".split())
#: Common function words of each language, the seed of the learned profiles; words that several share are left out.
FUNCTION_WORDS = {
    "en": "the of and to is are with for on from by at this that it be so when which does how what why where you your into until while unless then these as not do has have after before if its an",
    "de": "der die das und ist sind mit für auf von zu im den dem ein eine einen einer wie warum welche welcher wer wenn nicht nach über unter sich bei aus diese dieser sie ich wird vom zum zur durch damit oder ohne auch",
    "fr": "le les des du et est sont avec pour sur par au aux une dans que qui ce cette ces vers depuis comment pourquoi quelles quel lorsque je vous ne pas il elle nous leur avant après sans",
    "es": "el los las del y es son con para por al una un en que como cómo qué cuando esta este estos hacia desde cada sin se su lo antes después si está cuáles quién hasta",
}
_SCRIPTS = (
    ("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("th", 0x0E00, 0x0E7F), ("hi", 0x0900, 0x097F), ("ar", 0x0600, 0x06FF),
    ("ru", 0x0400, 0x04FF), ("ko", 0xAC00, 0xD7AF), ("el", 0x0370, 0x03FF), ("he", 0x0590, 0x05FF),
)
LANGUAGES = (*FUNCTION_WORDS, *(s[0] for s in _SCRIPTS))
#: Sentences that count as an opening; slots of the learned table; least count of a word in it, and how much more frequent it must be.
OPENING, SLOTS, LEAST, MORE = 3, 1 << 18, 10, 4.0

_FENCE = re.compile(r"```[^\n`]*")
_TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
_WORD = re.compile(r"[^\W_]+")
_HOST = re.compile(r"\b[A-Za-z]+(?:-[A-Za-z]+)*-\d+\b|\b[A-Z][A-Za-z]*v\d\b")
_MODEL = re.compile(r"\b[A-Z][a-z]+ \d{3,5}\b")
_IDENTIFIER = re.compile(r"\b\w*[A-Z]\w*_\w+\b")
_DIGIT = re.compile(r"\d")
_NAME = re.compile(r"(?<!^)\b[A-Z][a-z]+\b")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")
_WRAP = re.compile(r"^(?:\s|[>#*`\"'_~-]|\u200b|\ufeff)+")
_LABEL = re.compile(r"^\w+\*\*\s*")
_PARTIAL_ADDRESS = re.compile(r"(?<!\S)(?:(?:\d{1,3}\.){3}|(?:10|172|192|255|0)\.\d{1,3}\.)$")
_BARE_MARKER = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s*$")
_LISTED = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s")
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff]")
_ENDS, _CLOSERS = frozenset(".!?。！？।؟…"), "\"'”’»«“)]】』」*_`"


def visible(text: str | None) -> str:
    if not text:
        return ""
    return text.strip() if text.isascii() or not _INVISIBLE.search(text) else _INVISIBLE.sub("", text).strip()


def finished(line: str) -> bool:
    return line.rstrip(_CLOSERS)[-1:] in _ENDS if line else False


def is_empty(text: str | None) -> bool:
    rest = _TAG.sub(" ", _FENCE.sub(" ", visible(text)))
    words = _WORD.findall(rest.lower())
    return not words or (len(words) <= 2 and "".join(words) in PLACEHOLDERS)


def run_sets(texts: list[str | None], size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the runs of ``size`` letters or digits of each text, everything else dropped; a shorter text is one run."""
    cps, offsets = layout(texts)
    at = np.flatnonzero(_tables()[0][cps])
    row = np.searchsorted(offsets, at, "right") - 1
    value = np.concatenate([_mixed_lower()[cps[at]], np.zeros(size - 1, np.uint64)])
    last = np.bincount(row, minlength=len(texts)).cumsum()
    place = np.minimum(np.arange(len(at))[:, None] + np.arange(size), len(value) - 1)
    inside = place < last[row][:, None]
    whole = inside[:, -1] | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    gram = (value[place] * powers(size)[None, :] * inside).sum(axis=1, dtype=np.uint64)
    return distinct(row[whole], mix64(gram[whole]))


def copies(questions: list[str | None], answers: list[str], kept: float = 0.7, label: int = 9) -> np.ndarray:
    """Which answers give the question back and nothing else.

    They hold ``kept`` of the question's runs of letters and digits, and the
    runs of their own are as few as a small change or a short label makes.
    """
    out = np.zeros(len(answers), bool)
    at = [i for i, (q, a) in enumerate(zip(questions, answers, strict=True)) if q and a and len(a) <= 2.5 * len(q) + 40]
    if at:
        common, q, a = sj.overlap([questions[i] for i in at], [answers[i] for i in at], run_sets)
        out[at] = (common > 0) & (common >= kept * q) & (a - common <= np.maximum((1 - kept) * q, np.minimum(label, q / 2)))
    return out


def is_block(lines: list[str]) -> bool:
    """Lines that are commands rather than sentences or a list."""
    return len(lines) > 2 and sum(finished(x) or x[-1] == ":" for x in lines) < 0.5 * len(lines) and not any(_LISTED.match(x) for x in lines)


def prose(text: str) -> str:
    """The text outside fences and command blocks: lines that hold a sentence or introduce one."""
    lines = [x.rstrip() for x in "\n".join(text.split("```")[::2]).split("\n") if x.strip()]
    return "\n".join([x for x in lines if finished(x) or x[-1] == ":"] if is_block(lines) else lines)


def is_truncated(answer: str) -> bool:
    text = visible(answer)
    fences = text.count("```")
    if fences % 2:
        return True
    if fences:
        for block in text.split("```")[1::2]:
            body = [x for x in block.split("\n")[1:] if x.strip()]
            if body and body[-1].strip() != "end" and not finished(body[-1].rstrip()):
                return True
    last = text.rsplit("\n", 1)[-1].strip()
    if last in ("end", "```") or text.endswith("```"):
        return False
    if not fences and text.count("\n") > 1 and is_block([x.rstrip() for x in text.split("\n") if x.strip()]):
        return True
    if not finished(text):
        return True
    return text[-1] in ".)-*•" and bool(_BARE_MARKER.match(last) or _PARTIAL_ADDRESS.search(last))


def technical(text: str) -> bool:
    """Holds a value, an address, a port or an identifier besides host, model and protocol names."""
    if _IDENTIFIER.search(text):
        return True
    if not _DIGIT.search(text):
        return False
    return bool(_DIGIT.search(_MODEL.sub(" ", _HOST.sub(" ", text))))


def openings(text: str) -> list[str]:
    """The masked first sentences, without those that hold something technical."""
    body = _FENCE.sub("\n", text, count=2) if "```" in text else text
    body = _LABEL.sub("", _WRAP.sub("", body.strip()))
    out = []
    for s in _SENTENCE.split(body, OPENING + 3)[: OPENING + 3]:
        s = s.strip()
        if s:
            if _DIGIT.search(s):
                s = _HOST.sub("H", _MODEL.sub("M", s))
            out.append(None if _DIGIT.search(s) or _IDENTIFIER.search(s) else _NAME.sub("N", s))
        if len(out) == OPENING:
            break
    return [s for s in out if s]


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words of one language only, and that language's number."""
    owner = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split() if sum(w in v.split() for v in FUNCTION_WORDS.values()) == 1}
    h = Words(list(owner)).hash
    order = np.argsort(h)
    return h[order], np.array(list(owner.values()))[order]


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    """For each code point, the number of the language its script speaks for, or 255."""
    out = np.full(0x110000, 255, np.uint8)
    for i, (_, low, high) in enumerate(_SCRIPTS, len(FUNCTION_WORDS)):
        out[low : high + 1] = i
    return out


class Spoken:
    """The words of each text that may speak for a language: ``row``, ``hash``; and ``scripts`` (row × language) votes by script."""

    def __init__(self, texts: list[str | None]):
        w = Words(texts)
        cps, offsets = layout(texts)
        small = np.cumsum(np.concatenate([[0], _tables()[1][cps] == cps]))
        big = np.cumsum(np.concatenate([[0], _tables()[1][cps] != cps]))
        digit = np.cumsum(np.concatenate([[0], _tables()[0][cps] & ~_tables()[2][cps]]))
        start, end = w.start + offsets[w.doc], w.end + offsets[w.doc]
        n_big = big[end] - big[start]
        capital = (n_big == end - start) & (end - start > 1)  # abbreviations speak for no language, unless all is written so
        plain = np.bincount(w.doc[~capital & (n_big < end - start)], minlength=len(texts))
        loud = (plain == 0) & (w.counts > 5)
        ok = (digit[end] == digit[start]) & (~capital | loud[w.doc]) & (small[end] + n_big > small[start])
        self.row, self.hash, self.n = w.doc[ok], w.hash[ok], len(texts)
        kind = _script_of()[cps]
        at = np.flatnonzero(kind < 255)
        self.scripts = np.zeros((len(texts), len(LANGUAGES)), np.int64)
        if len(at):
            np.add.at(self.scripts, (np.searchsorted(offsets, at, "right") - 1, kind[at]), 1)
            ja, zh = LANGUAGES.index("ja"), LANGUAGES.index("zh")
            kana = self.scripts[:, ja] > 0.1 * (self.scripts[:, ja] + self.scripts[:, zh])
            self.scripts[kana, ja] += self.scripts[kana, zh]
            self.scripts[kana, zh] = 0
            self.scripts = -(-self.scripts // 3)  # a word of a script is some letters

    def votes(self, owner: np.ndarray | None = None) -> np.ndarray:
        """row × language: words that speak for each; by the learned table where it knows the word, else by function words."""
        h, of = _seeds()
        i = np.minimum(np.searchsorted(h, self.hash), len(h) - 1)
        speaks = np.where(h[i] == self.hash, of[i], 255)
        if owner is not None:
            learned = owner[(self.hash % np.uint64(SLOTS)).astype(np.int64)]
            speaks = np.where(learned == UNKNOWN, speaks, learned)
        out = self.scripts.copy()
        ok = speaks < 254
        np.add.at(out, (self.row[ok], speaks[ok]), 1)
        return out


UNKNOWN = 254


def _leading(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with most votes of each row, and how far it leads."""
    if not len(votes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = votes.argmax(axis=1)
    most = votes.max(axis=1)
    rest = votes.copy()
    rest[np.arange(len(votes)), top] = -1
    return top, most - rest.max(axis=1)


def learn_languages(rows: DataFrame) -> np.ndarray:
    """For each slot, the language (of FUNCTION_WORDS) its words speak for, 255 for none, UNKNOWN where the data show too few.

    ``rows`` (q, a).  Every row counts; each task sends its counts once, and
    SLOTS × languages numbers reach the driver.
    """
    n = len(FUNCTION_WORDS)
    block = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * n, np.int64)
        for b in batches:
            qs, ans = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s, e in sj.steps(ans):
                q, a = Spoken(qs[s:e]), Spoken(ans[s:e])
                top, lead = _leading(q.votes())
                for x in (q, a):
                    ok = (lead[x.row] > 0) & (top[x.row] < n)
                    total += np.bincount((x.hash[ok] % np.uint64(SLOTS)).astype(np.int64) * n + top[x.row[ok]], minlength=len(total))
        parts = [(i // block, total[i : i + block]) for i in range(0, len(total), block)]
        parts = [(i, x) for i, x in parts if x.any()]
        if parts:
            at = [np.flatnonzero(x) for _, x in parts]
            yield pa.RecordBatch.from_pydict({"block": pa.array([i for i, _ in parts], pa.int32()), "at": pa.array([x.astype(np.uint16).tobytes() for x in at], pa.binary()), "n": pa.array([x[i].tobytes() for i, (_, x) in zip(at, parts, strict=True)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for at, x in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(x, np.int64)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(SLOTS * n, np.int64)
    for r in rows.select("q", "a").mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInArrow(add, "block int, n binary").collect():
        total[r.block * block : (r.block + 1) * block] = np.frombuffer(r.n, np.int64)
    total = total.reshape(SLOTS, n)
    rate = total / np.maximum(total.sum(axis=0), 1)
    order = np.sort(rate, axis=1)
    owner = np.where(order[:, -1] >= MORE * order[:, -2], rate.argmax(axis=1), 255).astype(np.uint8)
    owner[total.sum(axis=1) < LEAST] = UNKNOWN
    return owner


def _features(owner):
    """For mapInArrow over (k, at, q, a, prompt): kind, whether the answer holds nothing technical, masks of its opening."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qs, raw = b.column(2).to_pylist(), b.column(3).to_pylist()
            for s, e in sj.steps(raw):
                q, texts = qs[s:e], [visible(a) for a in raw[s:e]]
                asked, sure = _leading(Spoken(q).votes(owner.value))
                given, margin = _leading(Spoken(texts).votes(owner.value))
                other = (sure > 0) & (margin > 0) & (asked != given)
                # commands hold words of a language as well: those that differ are read again without them
                at = np.flatnonzero(other)
                if len(at):
                    given, margin = _leading(Spoken([prose(texts[i]) for i in at]).votes(owner.value))
                    other[at] = (margin > 0) & (asked[at] != given)
                copied = copies(q, texts)
                kind, bare, masks = [], [], []
                for i, text in enumerate(texts):
                    k = None
                    if len(text) < 80 and is_empty(text):
                        k = "empty"
                    elif copied[i]:
                        k = "copy"
                    elif other[i]:
                        k = "language"
                    elif is_truncated(text):
                        k = "truncated"
                    kind.append(k)
                    open_ = [] if k in ("empty", "copy") else openings(text)
                    masks.append(open_)
                    bare.append(bool(open_) and not text.endswith(":") and not technical(text))
                cols = [b.column(i).slice(s, e - s) for i in (0, 1, 4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kind, pa.string()), pa.array(bare, pa.bool_()), pa.array(masks, pa.list_(pa.string()))], ["k", "at", "prompt", "kind", "bare", "masks"])

    return run


#: What sets of words are compared by: the members of their prefixes.
_bands = nh.prefixes


def opening_links(openings_: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(heads, clusters), both (mask, head): every distinct mask of (mask, n) with the commonest of all masks to which its words are similar, itself included; and each head with every mask similar to it."""
    masks = openings_.groupBy("mask").agg(F.sum("n").alias("n"))
    words = F.array_distinct(F.split(F.lower("mask"), r"[^\p{L}\p{N}#@]+"))
    sets = masks.select(F.lit(0).cast("long").alias("grp"), F.col("mask").alias("id"), "n", F.transform(words, lambda w: F.xxhash64(w)).alias("set"))
    heads, clusters = nh.near_heads(sets, threshold)
    return heads.select(F.col("id").alias("mask"), "head"), clusters.select(F.col("id").alias("mask"), "head")


def opening_clusters(openings_: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(mask, head): every distinct mask of (mask, n) with the commonest of all masks to which its words are similar; itself where there is no commoner one."""
    return opening_links(openings_, threshold)[0]


def _unrelated(found: DataFrame, prompts: DataFrame, alike: float) -> DataFrame:
    """(head): the heads of ``found`` (head, prompt) whose prompts share, on average over all pairs, less than ``alike`` of their words.

    A word that c of n prompts hold is common to c (c - 1) of their n (n - 1) pairs, so no pair is formed.
    """
    words = found.join(prompts, "prompt").select("head", F.explode(F.array_distinct(F.split("q", r"[^\p{L}\p{N}]+"))).alias("word")).groupBy("head", "word").agg(F.count("*").alias("c"))
    sums = words.groupBy("head").agg(F.sum("c").alias("size"), F.sum(F.col("c") * (F.col("c") - 1)).alias("common"))
    n = found.groupBy("head").agg(F.count("*").alias("n"))
    mean, shared = F.col("size") / F.col("n"), F.col("common") / (F.col("n") * (F.col("n") - 1))
    return n.join(sums, "head").filter((F.col("n") > 1) & (shared < alike * (2 * mean - shared))).select("head")


def defects(df: DataFrame, key: str, question: str, answer: str, at: str, prompts: int = 2, purity: float = 0.9, alike: float = 0.8) -> DataFrame:
    """(k, defect): the defective pairs.  A refusal cluster spans ``prompts`` unrelated prompts and is free of technical content in ``purity`` of its answers."""
    plain = F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(question), F.lit(""))), r"\s+", " "))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("at"), F.col(question).alias("q"), F.col(answer).alias("a"), F.xxhash64(plain).alias("prompt"))
    kinds = dict(rows.dtypes)
    owner = df.sparkSession.sparkContext.broadcast(learn_languages(rows))
    # several deliveries of one row are one row
    read = materialise(rows.mapInArrow(_features(owner), f"k {kinds['k']}, at {kinds['at']}, prompt long, kind string, bare boolean, masks array<string>"), "answer-features")
    # a mask or a prompt with a third of all rows becomes one row per pair before it meets a join
    opening = materialise(read.select("prompt", "bare", F.explode("masks").alias("mask")).groupBy("mask", "prompt").agg(F.count("*").alias("n"), F.count_if("bare").alias("bare")), "openings")
    heads, clusters = opening_links(opening.filter("bare > 0"))
    met = opening.join(materialise(clusters, "opening-clusters"), "mask")
    stats = met.groupBy("head").agg(F.count_distinct(F.when(F.col("bare") > 0, F.col("prompt"))).alias("prompts"), (F.sum("bare") / F.sum("n")).alias("pure"))
    recurring = materialise(stats.filter((F.col("prompts") >= prompts) & (F.col("pure") >= purity)).select("head"), "recurring-openings")
    asked = rows.select("prompt", F.lower("q").alias("q")).filter("q is not null").groupBy("prompt").agg(F.min("q").alias("q"))
    apart = _unrelated(met.filter("bare > 0").join(recurring, "head").select("head", "prompt").distinct(), asked, alike)
    templates = heads.join(apart, "head").select("mask")
    bare = read.filter("bare").select("k", "at", F.explode("masks").alias("mask"))
    refusing = bare.join(templates, "mask", "left_semi").select(F.col("k").alias("rk"), F.col("at").alias("rat")).distinct().withColumn("refusing", F.lit(True))
    labelled = read.select("k", "at", "kind", "bare").join(refusing, (F.col("k") == F.col("rk")) & F.col("at").eqNullSafe(F.col("rat")), "left").select("k", "at", F.when(F.col("refusing") & F.col("bare"), "refusal").otherwise(F.col("kind")).alias("defect"))
    latest = labelled.groupBy("k").agg(F.max_by("defect", F.struct(F.coalesce(F.col("at"), F.lit("0001-01-01").cast(kinds["at"])), F.coalesce("defect", F.lit("")))).alias("defect"))
    return latest.filter("defect is not null")
