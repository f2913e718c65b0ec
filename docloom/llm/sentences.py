"""Problem 9: sentence units of every document, across languages and scripts.

The boundary rules are compiled into one finite transducer.  Its letters are
classes of characters (terminators, closers, quotes, spaces, ...), its states
remember an open quotation and what stands between the last terminator and
here, and it marks each character that begins a unit.

The class of a character comes from its code point and a bounded context: the
24 characters before a full stop and the word after it (abbreviations, by a
table of hashes), the head of its line (list items, commands), and whether the
quotation marks of its block pair.  Each is an array pass over all texts at
once, with running maxima and counts in place of loops, so it is as parallel as
the transducer and no Python code runs per character, line or text.

Texts are run through it in chunks.  A chunk of ``CHUNK`` characters is first
read as a function from states to states, all chunks and all states at once;
the functions are composed by a parallel prefix scan, which gives the state
that each chunk begins in, and a second pass marks the starts.  A text of any
length is thus cut in as many steps as a chunk is long.

Defined results: null, empty and blank texts have no unit; rows with a null
key are left out; rows that repeat a key have the units of each of their texts
once; offsets count code points from 0, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import setjoin as sj
from docloom.llm.tokens import _tables, layout, run_hash

#: Characters in a chunk.
CHUNK = 512

# Abbreviations that never end a sentence, that do not before a number, and that may end one before a capital.
NEVER = "approx ca z.b d.h u.a o.ä i.d.r e.g i.e vs rel cf bzw ggf inkl evtl vgl bsp dr mr mrs prof ing ej aprox núm pág págs sra mme env resp rev dept fa hr fr str".split()
BEFORE_NUMBER = "no nos nr fig figs sec secs p pp s art abs abb abt tab eq ref ver vol ch chap ed kap st max min n bd cap sect réf rel tel".split()
MAY_END = "etc inc ltd co corp usw jr sr bros gmbh al".split()
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()

PLAIN, SPACE, BREAK, UPPER, LOWER, DIGIT, STRONG, WEAK, WIDE, CLOSER, STRAIGHT, LOW_OPEN, HIGH_LEFT, HIGH_RIGHT, ANGLE_OPEN, ANGLE_CLOSE, CORNER_OPEN, CORNER_CLOSE, GLUED, GAP, OPENER = range(21)

_FIXED = (
    {ord(c): STRONG for c in ".!?।॥؟۔"}
    | {ord(c): WIDE for c in "。！？｡"}
    | {ord(c): CLOSER for c in ")]}’'）］】》"}
    | {ord("…"): WEAK, ord('"'): STRAIGHT, ord("„"): LOW_OPEN, ord("“"): HIGH_LEFT, ord("”"): HIGH_RIGHT, ord("«"): ANGLE_OPEN, ord("»"): ANGLE_CLOSE}
    | {ord(c): CORNER_OPEN for c in "「『"}
    | {ord(c): CORNER_CLOSE for c in "」』"}
    | {ord(c): OPENER for c in "¿¡([{（【《"}
)


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point, and which are Thai or another script that spaces its sentences."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        if s.isspace():
            kind[c] = SPACE
        elif s.isdigit():
            kind[c] = DIGIT
        elif s.islower():
            kind[c] = LOWER
        elif s.isalpha():
            kind[c] = UPPER
    for c, k in _FIXED.items():
        kind[c] = k
    spaced = np.zeros(0x110000, bool)
    for low, high in ((0x0E01, 0x0E3A), (0x0E40, 0x0E45), (0x0E47, 0x0E4E), (0x0E81, 0x0EC5), (0x0EC8, 0x0ECD), (0x1780, 0x17D3), (0x1000, 0x109F)):
        spaced[low : high + 1] = True
    return kind, spaced


# Pending: NONE; after a terminator or weak one, or a quotation that ended with one, without and with space;
# after a terminator that needs no space; at a fresh start; after a terminator inside a quotation.
NONE, TERM, SOFT, QUOTED, TERM_SP, SOFT_SP, QUOTED_SP, NOW, FRESH, INNER = range(10)
QUOTES = {STRAIGHT: 1, LOW_OPEN: 2, HIGH_LEFT: 3, ANGLE_OPEN: 4, CORNER_OPEN: 5}
CLOSES = {1: {STRAIGHT}, 2: {HIGH_LEFT, HIGH_RIGHT}, 3: {HIGH_RIGHT}, 4: {ANGLE_CLOSE}, 5: {CORNER_CLOSE}}


def _step(quote: int, pending: int, x: int) -> tuple[int, int, bool]:
    """One move of the transducer: the next state, and whether x begins a unit."""
    if x == BREAK:
        return 0, FRESH, False
    if x == GAP:
        return (0, FRESH, False) if quote == 0 else (quote, pending, False)
    if x == SPACE:
        return quote, {TERM: TERM_SP, SOFT: SOFT_SP, QUOTED: QUOTED_SP}.get(pending, pending), False
    if quote:
        if x in CLOSES[quote]:
            return 0, (QUOTED if pending == INNER and quote != 5 else NONE), pending == FRESH
        if x in (STRONG, WEAK, WIDE, GLUED):
            return quote, INNER, pending == FRESH
        return quote, (INNER if pending == INNER and x == CLOSER else NONE), pending == FRESH
    closing = x in (CLOSER, HIGH_RIGHT, ANGLE_CLOSE, CORNER_CLOSE)
    mark = x in (STRONG, WEAK, WIDE, GLUED)
    start = (
        pending == FRESH
        or (pending == TERM_SP and not (mark or closing))
        or (pending in (SOFT_SP, QUOTED_SP) and (x in (UPPER, OPENER) or x in QUOTES))
        or (pending == NOW and not (mark or closing))
    )
    if x in QUOTES:
        return QUOTES[x], NONE, start
    if mark:
        if x == WIDE or x == GLUED:
            return 0, NOW, start
        if x == WEAK or (pending in (SOFT, SOFT_SP) and not start):
            return 0, SOFT, start
        return 0, TERM, start
    if closing and not start and pending in (TERM, SOFT, QUOTED, NOW, TERM_SP):
        return 0, TERM if pending == TERM_SP else pending, start
    return 0, NONE, start


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray, int]:
    """(next state, mark) by class and state, and the fresh state, over the states that can be reached."""
    states, todo, moves = {(0, FRESH): 0}, [(0, FRESH)], {}
    while todo:
        s = todo.pop()
        for x in range(21):
            quote, pending, start = _step(*s, x)
            if (quote, pending) not in states:
                states[quote, pending] = len(states)
                todo.append((quote, pending))
            moves[x, states[s]] = states[quote, pending], start
    follow, mark = np.zeros((21, len(states)), np.uint8), np.zeros((21, len(states)), bool)
    for (x, s), (to, start) in moves.items():
        follow[x, s], mark[x, s] = to, start
    return follow, mark, 0


#: How far an abbreviation may reach back from its full stop.
BACK = 24
_BULLETS = "-*•‣–·◦▪"
#: What the line before a numbered one ends with where that one, inside a paragraph, is a list item.
_LEADS_IN = ":："


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, ...]:
    """Tables by code point: word (letter, digit or underscore), letter, decimal digit, white space; and the lower case of each."""
    alnum, lower, _ = _tables()
    decimal, space = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for c in range(0x20000):
        decimal[c], space[c] = chr(c).isdecimal(), chr(c).isspace()
    word = alnum.copy()
    word[ord("_")] = True
    return word, alnum & ~decimal, decimal, space, lower


def _hashes(words: Iterable[str]) -> np.ndarray:
    words = list(words)
    cps, offsets = layout(words)
    return np.sort(run_hash(cps, offsets[:-1], offsets[1:] - 1))


@lru_cache(maxsize=1)
def _known() -> dict[str, np.ndarray]:
    return {"never": _hashes(NEVER), "number": _hashes(BEFORE_NUMBER), "end": _hashes(MAY_END), "example": _hashes(["ex", "ej"]), "month": _hashes(MONTHS)}


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _before(flag: np.ndarray) -> np.ndarray:
    """For each place the last place up to it where the flag is set, or -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag), dtype=np.int32), np.int32(-1)))


def _after(flag: np.ndarray) -> np.ndarray:
    """For each place the first place from it on where the flag is set, or the length."""
    n = len(flag)
    return np.minimum.accumulate(np.where(flag, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]


def mark_abbreviations(cls: np.ndarray, cps: np.ndarray, offsets: np.ndarray) -> None:
    """Full stops that end an abbreviation become PLAIN, or WEAK where they may also end a sentence."""
    word, letter, decimal, space, lower = (t[cps] for t in _kinds())
    n, known = len(cps), _known()
    dot = np.flatnonzero(cps[:-1] == 46)
    dot = dot[(dot > 0) & ~word[np.minimum(dot + 1, n - 1)]]
    dot = dot[letter[dot - 1] | decimal[dot - 1]]
    if not len(dot):
        return
    by_letter = letter[dot - 1]
    at = lambda a, i: a[np.maximum(i, 0)]
    start = np.where(by_letter, _before(~letter)[dot - 1], _before(~decimal)[dot - 1]).astype(np.int64) + 1
    text = offsets[np.searchsorted(offsets, dot, "right") - 1]
    start = np.maximum(start, dot - BACK)
    # single letters with full stops before the word belong to it
    first, cur, go = start.copy(), start.copy(), by_letter.copy()
    for _ in range(BACK // 2):
        cur = cur - 2
        go &= (cur >= np.maximum(text, dot - BACK)) & (at(cps, cur + 1) == 46) & at(letter, cur)
        if not go.any():
            break
        begins = go & ((cur == text) | ~at(word, cur - 1))
        first = np.where(begins, cur, first)
    dotted, start = first < start, first
    head = start == text
    before = np.where(head, 0, at(cps, start - 1))
    ok = head | ~at(word, start - 1)
    # the end of a dotted name is none, but the first word of a sentence may follow a full stop without space
    capital = (lower[start] != cps[start]) & (dot - start > 1) & (at(cls, np.minimum(start + 1, n - 1)) == LOWER)
    ok &= (before != 46) | (capital & (start - 1 > text) & at(_tables()[0][cps], start - 2))
    dot, start, text, before, dotted, by_letter = (x[ok] for x in (dot, start, text, before, dotted, by_letter))
    if not len(dot):
        return
    h, size = run_hash(cps, start, dot), dot - start
    end = offsets[np.searchsorted(offsets, dot, "right")] - 1
    solid = _after(~space)[np.minimum(dot + 1, n - 1)].astype(np.int64)
    inside = solid < end
    solid = np.where(inside, solid, 0)
    number = inside & decimal[solid]
    month = np.zeros(len(dot), bool)
    day = np.flatnonzero(~by_letter & (size <= 2) & inside & (solid > dot + 1) & letter[solid])
    if len(day):
        m = solid[day]
        stop = _after(~letter)[m].astype(np.int64)
        month[day] = _in(known["month"], run_hash(cps, m, stop)) & ~word[np.minimum(stop, n - 1)] & (lower[m] != cps[m]) & (cls[np.minimum(m + 1, n - 1)] == LOWER)
    k = np.where(at(space, start - 1), start - 1, start)
    page = (k - 2 >= text) & (at(cps, k - 1) == 46) & (at(lower, k - 2) == ord("p")) & ((k - 2 == text) | ~at(word, k - 3))
    plain = _in(known["never"], h) | ((size == 1) & ~np.isin(before, [ord("'"), ord("’")])) | (_in(known["number"], h) & number) | (_in(known["example"], h) & page)
    weak = by_letter & ~plain & (_in(known["end"], h) | dotted)
    cls[dot[np.where(by_letter, plain, month)]] = PLAIN
    cls[dot[weak]] = WEAK


def mark_lines(cls: np.ndarray, cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """List items, headings with signs and command lines become units: BREAK on either side; returns the places inside them.

    A numbered line inside a paragraph is one only after a line that leads in
    or that is one itself.
    """
    word, _, decimal, space, _ = (t[cps] for t in _kinds())
    n = len(cps)
    feed = np.flatnonzero(cps == 10)
    start = np.concatenate([[0], feed[:-1] + 1])
    f = _after(~space | (cps == 10))[start].astype(np.int64)
    filled = f < feed
    one = np.minimum(f + 1, n - 1)
    ascii_letter = ((cps[f] | 32) >= 97) & ((cps[f] | 32) <= 122) & (cps[f] < 128)
    bullet = np.isin(cps[f], list(map(ord, _BULLETS))) & space[one]
    digits = _after(~decimal)[f].astype(np.int64)
    stop = np.where(decimal[f] & (digits - f <= 3), digits, np.where(ascii_letter, f + 1, 0))
    number = (stop > 0) & np.isin(cps[stop], [46, 41]) & space[np.minimum(stop + 1, n - 1)]
    marks = _after(cps != 35)[f].astype(np.int64)
    mark = (cps[f] == 35) & (marks - f <= 6) & space[np.minimum(marks, n - 1)]
    # a device prompt: a name, perhaps a mode in brackets, and its sign
    dash = cps == 45
    name = np.minimum(_after(~(word | dash | (cps == 46)))[f], n - 1).astype(np.int64)
    mode = np.minimum(_after(~(word | dash))[np.minimum(name + 1, n - 1)], n - 1).astype(np.int64)
    sign = np.where((cps[name] == 40) & (mode > name + 1) & (cps[mode] == 41), np.minimum(mode + 1, n - 1), name)
    text_end = offsets[np.searchsorted(offsets, start, "right")] - 1
    prompt = ascii_letter & np.isin(cps[sign], [35, 62]) & (sign + 1 < text_end)
    ends = np.where(bullet, one, np.where(number, np.minimum(stop + 1, n - 1), np.minimum(marks, n - 1)))
    found = filled & (prompt | (bullet | number | mark) & (ends < text_end))
    only_number = number & ~(bullet | mark | prompt)
    # a marker alone on its line takes the next line of its text, which then is no line of its own
    alone = found & ~prompt & (ends == feed)
    order = np.arange(len(start))
    row = order - 1 - np.concatenate([[-1], _before(~alone)[:-1]])
    held = (row % 2 == 1) & (row > 0)
    found &= ~held
    alone &= ~held
    # what stands before the line, up to the paragraph's or the text's beginning
    begins = np.isin(start, offsets[:-1])
    last = _before(~space)
    lead = np.where(begins, -1, last[np.maximum(start - 1, 0)])
    text = offsets[np.searchsorted(offsets, start, "right") - 1]
    free = begins | (cls[np.maximum(start - 1, 0)] == BREAK) | (lead < text) | np.isin(cps[np.maximum(lead, 0)], list(map(ord, _LEADS_IN)))
    sure = found & (~only_number | free)
    taken = found & (_before(sure) > _before((~found & ~held) | begins & ~sure))
    s, e = start[taken], feed[np.minimum(order + alone, len(feed) - 1)][taken]
    cls[s[s > text[taken]] - 1] = BREAK
    cls[e] = BREAK
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, s, 1)
    np.add.at(inside, e, -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


def classify(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, solid, offsets) of all texts, one BREAK after each."""
    kind, spaced = _classes()
    cps, offsets = layout(texts)
    cls = kind[cps]
    solid = cls != SPACE
    nl = np.flatnonzero(cps == 10)
    # a line feed separates where only space lies between it and the next or the last one
    if len(nl):
        filled = np.concatenate([[0], np.cumsum(solid)])
        blank = filled[nl[1:]] == filled[nl[:-1] + 1]
        cls[nl[1:][blank]] = BREAK
        cls[nl[:-1][blank]] = BREAK
    cls[offsets[1:] - 1] = BREAK
    mark_abbreviations(cls, cps, offsets)
    inside = mark_lines(cls, cps, offsets)
    # a full stop that a capitalised word follows without space
    n = len(cps)
    dot = np.flatnonzero((cps[: n - 2] == 46) & (cls[: n - 2] == STRONG)) if n > 2 else np.empty(0, np.int64)
    dot = dot[dot > 0]
    glued = dot[(cls[dot + 1] == UPPER) & (cls[dot + 2] == LOWER) & ((cls[dot - 1] == LOWER) | (cls[dot - 1] == DIGIT))]
    cls[glued] = GLUED
    # several dots
    run = (cps[1:] == 46) & (cps[:-1] == 46)
    cls[1:][run & (cls[1:] == STRONG)] = WEAK
    cls[:-1][run & (cls[:-1] == STRONG)] = WEAK
    # a space between letters of a script that has no other mark
    gap = np.flatnonzero(~solid & (cls == SPACE))
    if len(gap):
        first = gap[np.concatenate([[True], gap[1:] != gap[:-1] + 1])]
        last = gap[np.concatenate([gap[1:] != gap[:-1] + 1, [True]])]
        inner = (first > 0) & (last < n - 1)
        first, last = first[inner], last[inner]
        between = spaced[cps[first - 1]] & spaced[cps[last + 1]]
        cls[first[between]] = GAP
    if len(inside):
        cls[inside] = np.where(solid[inside], PLAIN, SPACE)
    # quotations that do not pair within their block quote nothing
    block = np.cumsum(cls == BREAK)
    for opens, closes in ((STRAIGHT, None), (ANGLE_OPEN, ANGLE_CLOSE), (CORNER_OPEN, CORNER_CLOSE)):
        a = np.flatnonzero(cls == opens)
        b = a[:0] if closes is None else np.flatnonzero(cls == closes)
        if len(a) + len(b):
            both = np.concatenate([block[a], block[b]])
            size = np.bincount(both) % 2 if closes is None else np.abs(np.bincount(block[a], minlength=int(both.max()) + 1) - np.bincount(block[b], minlength=int(both.max()) + 1))
            at = np.concatenate([a, b])
            cls[at[size[both] > 0]] = CLOSER
    curly = np.flatnonzero(np.isin(cls, [LOW_OPEN, HIGH_LEFT, HIGH_RIGHT]))
    if len(curly):
        count = np.bincount(block[curly]) % 2
        cls[curly[count[block[curly]] > 0]] = CLOSER
    return cls, solid, offsets


def run_transducer(cls: np.ndarray) -> np.ndarray:
    """Marks of the characters that begin a unit, by composition of the chunks' functions."""
    follow, mark, fresh = transducer()
    n_states = follow.shape[1]
    n = -(-len(cls) // CHUNK)
    grid = np.full(n * CHUNK, BREAK, np.uint8)
    grid[: len(cls)] = cls
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    flat, marks = follow.ravel(), mark.ravel()
    # each chunk as a function: the state it leaves in, for every state it may be entered in;
    # a break leads every state to the same one, so a chunk with a break is a constant
    broken = (grid == BREAK).any(axis=0)
    out = np.empty((n, n_states), np.int32)
    whole = np.ascontiguousarray(grid[:, ~broken])
    function = np.tile(np.arange(n_states, dtype=np.int32), (whole.shape[1], 1))
    for row in whole:
        function = flat[row.astype(np.int32)[:, None] * n_states + function]
    out[~broken] = function
    constant = np.zeros(int(broken.sum()), np.int32)
    for row in np.ascontiguousarray(grid[:, broken]):
        constant = flat[row.astype(np.int32) * n_states + constant]
    out[broken] = constant[:, None]
    # parallel prefix: after round r a function covers the 2**r chunks up to its own
    reach = 1
    out = out.astype(np.int64)
    while reach < n:
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].copy(), axis=1)
        reach *= 2
    state = np.concatenate([[fresh], out[:-1, fresh]]).astype(np.int32)
    starts = np.zeros((CHUNK, n), bool)
    for k, row in enumerate(grid):
        at = row.astype(np.int32) * n_states + state
        starts[k] = marks[at]
        state = flat[at].astype(np.int32)
    return starts.T.ravel()[: len(cls)]


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every unit of all texts."""
    cls, solid, offsets = classify(texts)
    if not len(cls):
        return (np.empty(0, np.int64),) * 3
    start = np.flatnonzero(run_transducer(cls) & solid)
    row = np.searchsorted(offsets, start, "right") - 1
    # the last character that is no space before the next unit or the text's end
    stop = np.minimum(np.append(start[1:], len(cls)), offsets[row + 1] - 1)
    last = np.maximum.accumulate(np.where(solid, np.arange(len(cls)), -1))
    return row, start - offsets[row], last[stop - 1] + 1 - offsets[row]


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, sent_start, sent_end) for every unit of every row."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in sj.steps(texts):
                row, start, end = units(texts[s:e])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["k", "sent_start", "sent_end"])

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, sent_start int, sent_end int")
