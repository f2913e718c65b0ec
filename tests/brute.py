"""Plain walks over the smallest tables for queries that have no SQL."""

import json
import re
import unicodedata

import pyarrow.parquet as pq

from docloom.functions.text import NOISE_PREFIXES
from docloom.operators import chunking as ck

SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def table(sf, name, *columns):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def tokens(t):
    return len(t.split()) * 4 // 3


def clean(t):
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", unicodedata.normalize("NFKC", t)))
    lines = ["" if len(x) >= 5 and re.fullmatch(rf"(?:[.\-]|{SPACE})+", x) else x for x in t.split("\n")]
    return "\n".join(lines).strip()


def noise(t):
    s = t.strip()
    return len(s.split()) < 3 or bool(re.search(rf"(?:\.|{SPACE}){{3,}}[0-9]+\s*\Z", s)) or bool(re.fullmatch(r"[0-9]+", s)) or s.startswith(NOISE_PREFIXES)


def crumb(chapter, section):
    parts = [x.strip() for x in (chapter, section) if x and x.strip()]
    return " > ".join(parts) + "\n" if parts else ""


def prose(text):
    """(piece, text) of a text that may be split."""
    pieces = ck.split_recursive(text, 1024, 128) if tokens(text) > 256 else [text]
    for i, p in enumerate(pieces):
        if not noise(p) and tokens(p) >= 20:
            yield i, " ".join(p.split()[:384]) if tokens(p) > 512 else p


def walk(lines):
    """(sec, chapter, section, page, texts, spans) of a document's lines; spans are [kind, texts]."""
    out, sec, chapter, section, page = [], 0, "Preamble", "Overview", 1
    now = [sec, chapter, section, page, [], []]
    state = "prose"
    for x in sorted(lines, key=lambda x: x["line_no"]):
        if x["role"] == "heading":
            out.append(now)
            if re.search(r"\bchapter\b", x["text"] or "", re.IGNORECASE):
                chapter, section = x["text"], "Overview"
            else:
                section = x["text"]
            sec, page, state = sec + 1, x["page_num"], "prose"
            now = [sec, chapter, section, page, [], []]
            continue
        if x["text"] is not None:
            now[4].append(x["text"])
        state = ("step_table" if state == "step_table" else "cli_code") if x["role"] == "cli" else "step_table" if x["role"] in ("step", "label") else "prose"
        if not now[5] or now[5][-1][0] != state:
            now[5].append([state, []])
        now[5][-1][1].append(x["text"] or "")
    return [*out, now]


def section_chunks(sf):
    for r in table(sf, "sections", "section_id", "font_lines"):
        for sec, chapter, section, page, texts, _ in walk(r["font_lines"] or []):
            text = clean("\n".join(texts)) if texts else ""
            if texts and not noise(text):
                for i, p in prose(text):
                    t = crumb(chapter, section) + p
                    yield {"section_id": r["section_id"], "sec_id": sec, "chunk_index": i, "chapter": chapter, "section": section, "page_num": page, "token_count": tokens(t), "text": t}


def block_chunks(sf):
    for r in table(sf, "sections", "section_id", "font_lines"):
        for sec, chapter, section, page, _, spans in walk(r["font_lines"] or []):
            number = 0
            for kind, texts in spans:
                text = clean("\n".join(texts))
                if not "".join(texts).strip() or noise(text):
                    continue
                atomic = kind != "prose"
                for p in ([text] if atomic and tokens(text) >= 20 else []) if atomic else [p for _, p in prose(text)]:
                    t = crumb(chapter, section) + p
                    yield {"section_id": r["section_id"], "sec_id": sec, "chunk_index": number, "block_type": kind, "oversized": atomic and tokens(text) > 512, "page_num": page, "token_count": tokens(t), "text": t}
                    number += 1


def clean_text(sf):
    for r in table(sf, "chunks", "chunk_id", "text"):
        yield r | {"text": None if r["text"] is None else clean(r["text"])}


def _split(sf, separators, keep):
    for r in table(sf, "documents", "doc_id", "text"):
        for i, p in enumerate(ck.split_recursive(r["text"], 1024, 128, separators, keep) if r["text"] else []):
            if tokens(p) >= 20:
                yield {"doc_id": r["doc_id"], "chunk_index": i, "text": p}


def recursive_split(sf):
    return _split(sf, ck.PLAIN_SEPARATORS, False)


def semantic_split(sf):
    return _split(sf, ck.SENTENCE_SEPARATORS, True)


def flat_chunks(sf):
    for r in table(sf, "documents", "doc_id", "text"):
        for i, t in ck.flat_blocks(r["text"]) if r["text"] else []:
            yield {"doc_id": r["doc_id"], "chunk_id": i, "text": t}


def _paragraphs(sf):
    for r in table(sf, "documents", "doc_id", "text"):
        for p in map(clean, (r["text"] or "").split("\n\n")):
            if not noise(p) and tokens(p) >= 20:
                yield {"text": " ".join(p.split()[:384]) if tokens(p) > 512 else p}


def chunk_strategies(sf):
    """Texts that are equal up to case and spacing count once."""
    made = {"paragraph": _paragraphs, "fixed": recursive_split, "semantic": semantic_split, "section": section_chunks, "block_preserve": block_chunks}
    for name, f in made.items():
        sizes = {" ".join(x["text"].lower().split()): tokens(x["text"]) for x in f(sf)}
        yield {"strategy": name, "n": len(sizes), "tokens": sum(sizes.values())}


EXPECTED = {f.__name__: f for f in (clean_text, recursive_split, semantic_split, flat_chunks, section_chunks, block_chunks, chunk_strategies)}


def asked(sf):
    return {r["question_id"]: r["question"] for r in table(sf, "questions", "question_id", "question") if r["question_id"] % 50 == 0}


def framed(config):
    body = config.split("\n")
    return body[0] == "```ios" and body[1].lower() == "enable" and body[2].lower() == "configure terminal" and body[-2].lower() == "end" and body[-1] == "```"


def hybrid_rag(rows, sf):
    """One framed answer for each question of the search set, from one to four chunks."""
    return {r["question_id"] for r in rows} == set(asked(sf)) and len(rows) == len(asked(sf)) and all(framed(r["answer"]) and 1 <= r["n_used"] <= 4 for r in rows)


def rag_payloads(rows, sf):
    """Each way once for each question; what a payload says was used are chunks of the table, by rank, within the budget."""
    texts = {r["chunk_id"]: (r["text"] or "").strip() for r in table(sf, "chunks", "chunk_id", "text")}
    if len(rows) != 3 * len(asked(sf)) or len({(r["question_id"], r["method"]) for r in rows}) != len(rows):
        return False
    for r in rows:
        used = json.loads(r["payload"])["used_chunks"]
        if len(used) != r["count"] or not framed(r["config"]) or [u["place"] for u in used] != list(range(1, len(used) + 1)):
            return False
        if any(texts[u["chunk_id"]] != u["chunk_text"] for u in used) or [u["rank"] for u in used] != sorted(u["rank"] for u in used):
            return False
        if sum(len(u["chunk_text"]) for u in used[:-1]) > 4000:
            return False
    return True


HOLDS = {f.__name__: f for f in (hybrid_rag, rag_payloads)}
