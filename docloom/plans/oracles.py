"""SQL of the registered queries, for an engine that shares nothing with Spark."""

from __future__ import annotations

from docloom.functions.text import BOILERPLATE_PHRASES, NOISE_PREFIXES, WS
from docloom.operators import answers as an
from docloom.operators import judging as jd
from docloom.operators.judging import READINESS, WEIGHTS

CRITERIA = tuple(WEIGHTS)
INSTRUCTIONS = an.INSTRUCTIONS

NWS = WS.replace("[", "[^", 1)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(NWS + '+')}))"


def tokens(x: str) -> str:
    return f"({n_words(x)} * 4 // 3)"


def collapse(x: str) -> str:
    return strip(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def clean(x: str) -> str:
    spaced = f"regexp_replace(regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(f"regexp_replace({spaced}, {q(rf'(?m)^(?:[.\-]|{WS}){{5,}}$')}, '', 'g')")


def noise(x: str) -> str:
    s = strip(x)
    begins = " OR ".join(f"starts_with({s}, {q(p)})" for p in NOISE_PREFIXES)
    return f"({n_words(s)} < 3 OR regexp_matches({s}, {q(rf'(?:\.|{WS}){{3,}}[0-9]+{WS}*\z')}) OR regexp_matches({s}, '\\A[0-9]+\\z') OR {begins})"


def contains_any(x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def header(document: str, section: str) -> str:
    return f"(concat_ws(' > ', nullif({strip(document)}, ''), nullif({strip(section)}, '')) || ' >')"


def weighted(shares: dict[str, float]) -> str:
    return " + ".join(f"coalesce({k}, 0) * {v}" for k, v in shares.items())


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g')"


def bm25(docs: str, key: str, asked: str, k: int, name: str) -> str:
    """CTEs that end in ``name``(question_id, key, score, rank)."""
    return f"""
{name}_d AS (SELECT {key} AS d, regexp_extract_all(text, {q(NWS + "+")}) AS w FROM ({docs}) WHERE text IS NOT NULL),
{name}_size AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM {name}_d),
{name}_terms AS (SELECT question_id AS q, term, count(*) AS times FROM (SELECT question_id, unnest(regexp_extract_all(question, {q(NWS + "+")})) AS term FROM ({asked})) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM {name}_d) GROUP BY term),
{name}_idf AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf FROM {name}_df, {name}_size),
{name}_mean AS (SELECT avg(idf) AS mean_idf FROM {name}_idf),
{name}_tf AS (SELECT d, term, len, count(*) AS tf FROM (SELECT d, len(w) AS len, unnest(w) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_terms) GROUP BY ALL),
{name}_s AS (SELECT t.q, f.d, round(sum(CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean_len)) * times), 6) AS score
  FROM {name}_tf f JOIN {name}_idf USING (term) JOIN {name}_terms t USING (term), {name}_size, {name}_mean GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT q AS question_id, d AS {key}, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM {name}_s) WHERE rank <= {k})"""


ASKED = "SELECT question_id, question FROM questions WHERE question_id % 50 = 0"
TOPICAL = "SELECT question_id, concat_ws(' ', topic, lower(question)) AS question FROM questions WHERE question_id % 50 = 0"
CHUNK_TEXTS = "SELECT chunk_id, text FROM chunks"


def hier(section: str) -> str:
    """CTEs that end in ``kept``: headed chunks, each text once."""
    return f"""
s0 AS (SELECT doc_id, source AS document, {section} AS section, {collapse("text")} AS body FROM documents
  WHERE text IS NOT NULL AND {strip("text")} <> '' AND NOT {contains_any("lower(text)", tuple(p.lower() for p in BOILERPLATE_PHRASES))}),
s1 AS (SELECT *, {header("document", "section")} AS header, ceil(length(body) / 4.0)::INT AS n FROM s0),
s2 AS (SELECT *, greatest(1, length(header) // 4) AS header_tokens, greatest(200, 512 - greatest(1, length(header) // 4)) AS budget FROM s1),
s3 AS (SELECT *, budget - (CASE WHEN n / budget <= 1.3 THEN 0 WHEN n / budget <= 2.0 THEN 25 ELSE 50 END) AS stride FROM s2),
s4 AS (SELECT *, CASE WHEN n <= 0 THEN 0 ELSE 1 + greatest(0, ceil((n - budget) / stride))::INT END AS parts_total FROM s3),
s5 AS (SELECT *, unnest(range(parts_total)) AS part FROM s4),
s6 AS (SELECT doc_id, document, section, part, parts_total, header_tokens, header || substr(body, part * stride * 4 + 1, budget * 4) AS text FROM s5),
s7 AS (SELECT *, sha1(text) AS sha1 FROM s6 WHERE {n_words("text")} >= 15),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY doc_id, part) AS rn FROM s7) WHERE rn = 1)"""


def pack(ranked: str, most: int) -> str:
    """CTEs over ``ranked`` that end in ``used``."""
    return f"""
u0 AS (SELECT *, {strip("text")} AS t, row_number() OVER (PARTITION BY question_id, substr(text, 1, 200) ORDER BY rank) AS dup FROM {ranked} WHERE text IS NOT NULL),
u1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place FROM u0 WHERE dup = 1 AND t <> ''),
u2 AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM u1),
u3 AS (SELECT *, max(CASE WHEN place > 1 AND held + length(text) > {most} THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY rank) AS stop FROM u2),
used AS (SELECT * FROM u3 WHERE stop = 0)"""


PACKED = "SELECT question_id, sha1(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS sha1, length(string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS n_chars, count(*) AS n_used FROM used GROUP BY question_id"
RANKED = f"WITH {bm25(CHUNK_TEXTS, 'chunk_id', ASKED, 50, 'lex')}, ranked AS (SELECT lex.*, text FROM lex JOIN chunks USING (chunk_id))"



def outlined(source: str, doc: str, order: str) -> str:
    """Tables sec, kinded and islands over a table ``lines`` (doc, order, page, role, text)."""
    by, sec = f"PARTITION BY {doc} ORDER BY {order}", f"PARTITION BY {doc}, sec_id ORDER BY {order}"
    return f"""
lines AS ({source}),
marked AS (SELECT *, role = 'heading' AND regexp_matches(coalesce(text, ''), '(?i)\\bchapter\\b') AS opens FROM lines),
sec AS (SELECT *, sum(CASE WHEN role = 'heading' THEN 1 ELSE 0 END) OVER w AS sec_id, coalesce(last_value(CASE WHEN opens THEN text END IGNORE NULLS) OVER w, 'Preamble') AS chapter,
  last_value(CASE WHEN role = 'heading' THEN struct_pack(t := text, p := page, c := opens) END IGNORE NULLS) OVER w AS head FROM marked WINDOW w AS ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kinds AS (SELECT *, last_value(CASE WHEN role <> 'cli' THEN role END IGNORE NULLS) OVER ({sec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM sec WHERE role <> 'heading'),
kinded AS (SELECT *, CASE WHEN role = 'cli' THEN CASE WHEN before IN ('step', 'label') THEN 'step_table' ELSE 'cli_code' END WHEN role IN ('step', 'label') THEN 'step_table' ELSE 'prose' END AS kind FROM kinds),
turns AS (SELECT *, coalesce((kind <> lag(kind) OVER ({sec}))::INT, 0) AS new FROM kinded),
islands AS (SELECT *, sum(new) OVER ({sec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM turns)"""


def sections_of(doc: str, order: str) -> str:
    return f"SELECT {doc}, sec_id::BIGINT AS sec_id, first(chapter) AS chapter, first(CASE WHEN head IS NULL OR head.c THEN 'Overview' ELSE head.t END) AS section, first(coalesce(head.p, 1))::BIGINT AS page_num, count(*) AS n_lines, sha1(string_agg(text, chr(10) ORDER BY {order})) AS sha1 FROM sec WHERE role <> 'heading' AND text IS NOT NULL GROUP BY {doc}, sec_id"


def spans_of(doc: str) -> str:
    return f"SELECT {doc}, sec_id::BIGINT AS sec_id, island::BIGINT AS island, first(kind) AS kind, count(*) AS n_lines FROM islands GROUP BY {doc}, sec_id, island HAVING bool_or({strip("coalesce(text, '')")} <> '')"


EVENT_LINES = outlined("""SELECT user_id, ts, event_id, event_id % 7 AS page, CASE event_type WHEN 'error' THEN 'heading' WHEN 'click' THEN 'cli' WHEN 'purchase' THEN 'step' WHEN 'signup' THEN 'label' ELSE 'prose' END AS role,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Chapter ' || event_id ELSE event_type || ' ' || event_id END AS text FROM events""", "user_id", "ts, event_id")
FONT_LINES = outlined("SELECT section_id, l.line_no AS line_no, l.page_num AS page, l.role AS role, l.text AS text FROM (SELECT section_id, unnest(font_lines) AS l FROM sections)", "section_id", "line_no")


def judged(source: str, key: str) -> str:
    """Tables marked and consensus over a table of judgements (key, the criteria)."""
    return f"""
judged AS (SELECT *, round({weighted(WEIGHTS)}, 6) AS overall FROM ({source})),
moments AS (SELECT {key}, count(overall) AS n, avg(overall) AS mean, stddev_samp(overall) AS sd FROM judged GROUP BY {key}),
marked AS (SELECT judged.*, (n < 2 OR sd = 0 OR abs(overall - mean) <= (CASE WHEN n >= 5 THEN 2.0 ELSE 2.5 END) * sd) AS reliable,
  CASE WHEN n < 2 THEN 0.5 WHEN sd = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - sd / (mean + 0.1))) END AS strength FROM judged JOIN moments USING ({key})),
consensus AS (SELECT {key}, {", ".join(f"avg({c}) FILTER (WHERE reliable) AS {c}" for c in WEIGHTS)}, avg(overall) FILTER (WHERE reliable) AS overall, first(strength) AS strength, count(*) FILTER (WHERE reliable) AS judges_used, count(*) AS judges FROM marked GROUP BY {key})"""


JUDGED = judged("SELECT l_orderkey, l_linenumber, l_quantity / 5 AS accuracy, l_discount * 100 AS relevance, l_tax * 100 AS correctness, l_quantity / 5 AS hallucination, l_discount * 100 AS completeness FROM lineitem", "l_orderkey")
SCORED = judged(f"SELECT eval_id, result_id, {', '.join(CRITERIA)} FROM judge_results WHERE parsing_success AND eval_id IS NOT NULL", "eval_id")

RESPONSES = f"""
bodies AS (SELECT result_id, '{{' || {" || ', ' || ".join(f"'" + f'"{c}": ' + f"' || printf('%.1f', coalesce({c}, 0.0))" for c in ("accuracy", "relevance", "correctness", "hallucination", "completeness"))} || ', "confidence": 80, "potential_issues": ["mtu", "acl"]}}' AS body FROM judge_results),
responses AS (SELECT result_id, CASE result_id % 7 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN '<think>maybe' || chr(10) || '10</think> Scores: ' || body || ' as asked.'
  WHEN 3 THEN 'Result: ' || substr(body, 2, 10000) WHEN 4 THEN 'no idea' WHEN 5 THEN body || '<thinking>never closed' ELSE replace(body, '"accuracy": ', '"accuracy": "x", "was": ') END AS response FROM bodies)"""

THOUGHTLESS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<think>.*\z', '', 'g'), '(?is)<thinking>.*\z', '', 'g'), '\A\s+|\s+\z', '', 'g')"


def lines_of(x: str) -> str:
    """A list of stripped lines that are not blank."""
    ends = r"\r\n|[\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
    return f"list_filter(list_transform(string_split(regexp_replace({x}, {q(ends)}, chr(10), 'g'), chr(10)), lambda y: {strip('y')}), lambda y: y <> '')"


def sanitised(raw: str, pattern: str, once: bool) -> str:
    bare = strip(r"regexp_replace(y, '\s[!#].*$', '')")
    kept = f"list_filter(list_transform({lines_of(raw)}, lambda y: {bare}), lambda y: regexp_matches(y, {q(pattern)}))"
    dedup = "list_filter(kept, lambda y, i: list_position(list_transform(kept, lambda z: lower(z)), lower(y)) = i)" if once else "kept"
    return f"""
WITH a AS (SELECT DISTINCT eval_id, answer FROM evaluations WHERE answer IS NOT NULL),
k AS (SELECT eval_id, {kept} AS kept FROM a),
k0 AS (SELECT eval_id, {dedup} AS x FROM k),
k1 AS (SELECT eval_id, CASE WHEN len(x) > 0 AND lower(x[1]) = 'enable' THEN x ELSE list_prepend('enable', x) END AS x FROM k0),
k2 AS (SELECT eval_id, CASE WHEN len(x) > 1 AND lower(x[2]) = 'configure terminal' THEN x ELSE list_concat([x[1], 'configure terminal'], x[2:]) END AS x FROM k1),
k3 AS (SELECT eval_id, CASE WHEN lower(x[-1]) = 'end' THEN x ELSE list_append(x, 'end') END AS x FROM k2)
SELECT DISTINCT eval_id, '```ios' || chr(10) || array_to_string(x, chr(10)) || chr(10) || '```' AS config FROM k3"""


def share(text: str) -> str:
    """Share of the query's distinct lower-case words in a text."""
    w = lambda x: f"list_distinct(regexp_extract_all(lower({x}), {q(NWS + '+')}))"
    return f"CASE WHEN len({w('query')}) = 0 THEN 0.0 ELSE len(list_intersect({w('query')}, {w(text)})) / len({w('query')}) END"


def judge_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), ':.*$', ''), '[^a-z0-9]+', '', 'g')"


METRICS = (*CRITERIA, "overall_score", "confidence", "response_time")
LATEST = f"latest AS (SELECT eval_id, r.question AS question, r.answer AS answer FROM (SELECT eval_id, arg_max(struct_pack(question := question, answer := answer), ingested_at) AS r FROM evaluations GROUP BY eval_id)), answered AS (SELECT * FROM latest WHERE {strip('coalesce(answer, chr(32))')} <> '')"


def prompt_length(question: str, answer: str) -> str:
    """Of what a judge is asked about one pair."""
    return f"(length({question}) + length({answer}) + {len('Question: ') + len(chr(10) * 2 + 'Configuration: ') + len(jd.prompt_tail())})"


def rule_scores(size: str) -> str:
    """The criteria as the stand-in gives them, and what follows from them."""
    scores = ", ".join(f"(({size} + {i}) % 11)::DOUBLE AS {c}" for i, c in enumerate(CRITERIA))
    return scores


def risk_of(x: str) -> str:
    return f"CASE WHEN {x} >= 8 THEN 'Low' WHEN {x} >= 6 THEN 'Medium' WHEN {x} >= 4 THEN 'High' ELSE 'Critical' END"


def encoded(name: str, source: str, key: str, text: str) -> str:
    """Tables of the stand-in's unit vectors: <name>_u (key, d, x) and <name>_s (key, squared length)."""
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), {q(NWS + '+')})) AS t FROM {source}),
{name}_h AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM {name}_w),
{name}_d AS (SELECT {key}, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM {name}_h GROUP BY ALL),
{name}_u AS (SELECT {key}, d, (x / sqrt(sum(x * x) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM {name}_d),
{name}_s AS (SELECT {key}, sum(x * x) AS s FROM {name}_u GROUP BY {key})"""


SQL: dict[str, str] = {
    "clean_text_ascii": f"SELECT chunk_id, {clean('text')} AS text FROM chunks",
    "approx_tokens": f"SELECT chunk_id, {tokens('text')} AS n_tokens FROM chunks",
    "token_stats": f"""
WITH t AS (SELECT metadata.strategy AS strategy, {tokens("text")} AS v FROM chunks WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM t)
SELECT strategy, n, min(v) AS lowest, max(v) FILTER (WHERE i = n // 4) AS p25, max(v) FILTER (WHERE i = n // 2) AS p50, max(v) FILTER (WHERE i = (3 * n) // 4) AS p75, max(v) AS highest, round(avg(v), 6) AS mean FROM r GROUP BY strategy, n""",
    "noise_filter": f"""
WITH l AS (SELECT chunk_id, string_split(text, chr(10)) AS x FROM chunks), u AS (SELECT chunk_id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM l)
SELECT chunk_id, count(*) AS n_noise, min(pos) AS first_noise FROM u WHERE {noise("line")} GROUP BY chunk_id""",
    "boilerplate_filter": f"SELECT chunk_id FROM chunks WHERE {contains_any('lower(text)', tuple(p.lower() for p in (*BOILERPLATE_PHRASES, 'All rights reserved', 'Before you begin')))}",
    "semantic_headers": f"""
SELECT chunk_id, {header("metadata.pdf_name", "metadata.section")} AS header, CASE WHEN crumb = '' THEN '' ELSE crumb || chr(10) END AS breadcrumb
FROM (SELECT *, concat_ws(' > ', nullif({strip("metadata.chapter")}, ''), nullif({strip("metadata.section")}, '')) AS crumb FROM chunks)""",
    "body_budgets": f"""
WITH h AS (SELECT chunk_id, greatest(1, length({header("metadata.pdf_name", "metadata.section")}) // 4) AS header_tokens, ceil(length(text) / 4.0)::BIGINT AS n FROM chunks), b AS (SELECT *, greatest(200, 512 - header_tokens) AS budget FROM h)
SELECT chunk_id, header_tokens, budget, CASE WHEN n / budget <= 1.3 THEN 0 WHEN n / budget <= 2.0 THEN 25 ELSE 50 END AS overlap FROM b""",
    "context_labels": f"""
WITH t AS (SELECT chunk_id, coalesce(metadata.pdf_name, '') AS d, {strip("metadata.chapter")} AS title, {strip("metadata.section")} AS lead FROM chunks),
l AS (SELECT chunk_id, 'PDF: ' || d || CASE WHEN title IS NULL OR title = '' THEN '' WHEN starts_with(upper(title), 'CHAPTER') OR starts_with(upper(title), 'CHAPITRE') THEN chr(10) || array_to_string(string_split(title, ' ')[1:2], ' ') || ': ' || coalesce(string_split(title, ' ')[3], '')
  ELSE chr(10) || 'Chapter: ' || substr(title, 1, 100) || CASE WHEN length(title) > 100 THEN '...' ELSE '' END END || CASE WHEN length(lead) > 0 AND length(lead) <= 150 THEN chr(10) || lead ELSE '' END AS label FROM t)
SELECT chunk_id, label, greatest(1, length(label) // 4) AS tokens FROM l""",
    "fingerprints": f"SELECT doc_id, sha1(text) AS sha1, sha256(regexp_replace({strip('lower(text)')}, {q(WS + '+')}, ' ', 'g')) AS fingerprint FROM documents",
    "prefix_guard": "SELECT triplet_id, 'query: ' || query AS query, CASE WHEN starts_with(pos, 'query: ') OR starts_with(pos, 'passage: ') THEN pos ELSE 'passage: ' || pos END AS pos FROM triplets",
    "model_slugs": f"SELECT DISTINCT model, {slug('model')} AS slug, regexp_replace(lower(model), '[^a-z0-9]', '_', 'g') AS safe FROM judge_results",
    "token_windows": f"""
WITH b AS (SELECT doc_id, {collapse("text")} AS body FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, CASE WHEN length(body) = 0 THEN 0 ELSE 1 + greatest(0, ceil((ceil(length(body) / 4.0) - 100) / 80.0))::BIGINT END AS parts_total FROM b),
p AS (SELECT *, unnest(range(parts_total)) AS part FROM n)
SELECT doc_id, part, parts_total, sha1(substr(body, part * 320 + 1, 400)) AS window_sha1 FROM p""",
    "hier_chunks": f"WITH {hier("'doc_' || doc_id")} SELECT doc_id, part::BIGINT AS part, parts_total::BIGINT AS parts_total, greatest(1, length(text) // 4) AS token_count, {n_words('text')} AS word_count, sha1 FROM kept",
    "hier_chunks_by_lang": f"WITH {hier('lang')} SELECT doc_id, part::BIGINT AS part, sha1 FROM kept",
    "chunk_ids": f"WITH {hier('lang')} SELECT doc_id, part::BIGINT AS part, printf('chunk%06d', row_number() OVER (ORDER BY document NULLS FIRST, doc_id, part) - 1) AS id FROM kept",
    "chunking_totals": f"WITH {hier("'doc_' || doc_id")} SELECT count(*) AS chunks, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, sum(header_tokens)::BIGINT AS header_tokens, round(sum(header_tokens) / count(*), 6) AS mean_header, round(sum(header_tokens) * 100 / sum(greatest(1, length(text) // 4)), 6) AS header_percent FROM kept",
    "paragraph_chunks": f"""
WITH r AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(x) AS raw, unnest(range(len(x))) AS chunk_index FROM r),
p AS (SELECT doc_id, chunk_index, {clean("raw")} AS p FROM u)
SELECT doc_id, chunk_index, sha1(CASE WHEN {tokens("p")} > 60 THEN array_to_string(regexp_extract_all(p, {q(NWS + "+")})[1:45], ' ') ELSE p END) AS sha1 FROM p WHERE NOT {noise("p")} AND {tokens("p")} >= 20""",
    "sha1_dedup": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY sha1(text)",
    "normalised_dedup": f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY source, sha256(regexp_replace({strip('lower(text)')}, {q(WS + '+')}, ' ', 'g'))",
    "flat_json_group": "SELECT metadata.source_file AS source_file, coalesce(metadata.chunk_index, 0) // 500 AS part, count(*) AS n, sha1(string_agg(text, chr(30) ORDER BY metadata.chunk_index NULLS FIRST, chunk_id)) AS sha1 FROM chunks GROUP BY 1, 2",
    "structure_counts": "SELECT metadata.source_file AS source_file, count(DISTINCT coalesce('v' || metadata.chapter, 'n')) AS chapters, count(DISTINCT coalesce('v' || metadata.chapter, 'n') || chr(31) || coalesce('v' || metadata.section, 'n')) AS sections, count(*) AS chunks FROM chunks GROUP BY 1",
    "block_types": "SELECT metadata.block_type AS block_type, count(*) AS n, count(*) FILTER (WHERE metadata.oversized) AS n_oversized FROM chunks GROUP BY 1",
    "font_line_roles": """
WITH w AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'courier-new' WHEN 'A' THEN 'univers-condensedbold' ELSE 'times-bold' END AS font, l_quantity AS size FROM lineitem),
f AS (SELECT l_orderkey, font, count(*) AS n, min(l_linenumber) AS first FROM w GROUP BY ALL),
m AS (SELECT l_orderkey, font AS main FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, font DESC) AS rn FROM f) WHERE rn = 1),
c AS (SELECT l_orderkey, bool_and(font = 'courier-new') AS mono, list_sort(list(size)) AS s FROM w GROUP BY 1)
SELECT l_orderkey, CASE WHEN mono THEN 'cli' WHEN main = 'univers-condensedbold' THEN CASE WHEN s[len(s) // 2 + 1] <= 9 THEN 'skip' WHEN s[len(s) // 2 + 1] >= 17 THEN 'heading' ELSE 'label' END WHEN main = 'times-bold' THEN 'step' ELSE 'prose' END AS role FROM m JOIN c USING (l_orderkey)""",
    "words_to_lines": """
WITH w AS (SELECT l_orderkey % 1000 AS doc, l_orderkey AS page_num, l_linestatus || l_partkey AS text, CASE l_returnflag WHEN 'R' THEN 'courier-new' WHEN 'A' THEN 'univers-condensedbold' ELSE 'times-bold' END AS font, l_tax * 200 AS size, l_quantity AS top, l_partkey * 10 + l_linenumber AS x0 FROM lineitem WHERE l_quantity >= 60.0 * 0.08 AND l_quantity + 2 <= 60.0 * (1 - 0.08)),
b AS (SELECT *, round_even(top / 2, 0) * 2 AS y FROM w),
f AS (SELECT doc, page_num, y, font, count(*) AS n, min(x0) AS first FROM b GROUP BY ALL),
m AS (SELECT doc, page_num, y, font AS main FROM (SELECT *, row_number() OVER (PARTITION BY doc, page_num, y ORDER BY n DESC, first, font DESC) AS rn FROM f) WHERE rn = 1),
l AS (SELECT doc, page_num, y, string_agg(text, ' ' ORDER BY x0, text) AS text, list_sort(list(size)) AS s FROM b GROUP BY ALL)
SELECT doc, page_num, y, text FROM l JOIN m USING (doc, page_num, y) WHERE NOT (main = 'univers-condensedbold' AND s[len(s) // 2 + 1] <= 9)""",
    "sections_from_headings": f"WITH {EVENT_LINES} {sections_of('user_id', 'ts, event_id')}",
    "span_kinds": f"WITH {EVENT_LINES} SELECT user_id, kind, count(*) AS n FROM kinded GROUP BY ALL",
    "span_islands": f"WITH {EVENT_LINES} {spans_of('user_id')}",
    "manual_sections": f"WITH {FONT_LINES} {sections_of('section_id', 'line_no')}",
    "manual_spans": f"WITH {FONT_LINES} {spans_of('section_id')}",
    "judge_outliers": f"WITH {SCORED} SELECT eval_id, result_id, reliable, round(strength, 5) AS strength FROM marked",
    "judge_consensus": f"WITH {SCORED}, r AS (SELECT *, {weighted(READINESS)} AS ready FROM consensus) SELECT eval_id, {', '.join(f'round({c}, 5) AS {c}' for c in ('accuracy', 'correctness', 'overall', 'strength'))}, round(ready, 5) AS readiness, {risk_of('ready')} AS risk, judges_used, judges FROM r",
    "judge_issues": """
WITH j AS (SELECT question_id, count(*) AS judges FROM judge_results WHERE question_id IS NOT NULL GROUP BY 1), c AS (SELECT question_id, error_message AS issue, count(*) AS n, min(result_id) AS first FROM judge_results WHERE question_id IS NOT NULL AND error_message IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first, issue) AS place FROM c)
SELECT question_id, issue, n, place FROM p JOIN j USING (question_id) WHERE place <= 5 AND n > 0.03 * judges""",
    "command_blocks": r"""
WITH l AS (SELECT DISTINCT eval_id, ingested_at, string_split(answer, chr(10)) AS x FROM evaluations WHERE answer IS NOT NULL), u AS (SELECT eval_id, ingested_at, unnest(x) AS line, unnest(range(len(x))) AS n FROM l)
SELECT eval_id, max(c) AS n_blocks FROM (SELECT eval_id, 1 + count(*) FILTER (WHERE n > 0 AND regexp_matches(line, '(?i)^\s*(?:interface|router|ip access-list|line)\b')) AS c FROM u GROUP BY eval_id, ingested_at) GROUP BY eval_id""",
    "dense_topk": """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9), vec_id) AS rank FROM d) WHERE rank <= 30""",
    "dense_topk_cosine": """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-s, 9), vec_id) AS rank FROM d) WHERE rank <= 30""",
    "bm25_topk": f"WITH {bm25(CHUNK_TEXTS, 'chunk_id', ASKED, 50, 'lex')} SELECT question_id, chunk_id, score, rank FROM lex",
    "rrf_fusion": f"""
WITH {bm25(CHUNK_TEXTS, "chunk_id", TOPICAL, 30, "top")}, {bm25(CHUNK_TEXTS, "chunk_id", ASKED, 50, "lex")},
e AS (SELECT question_id, chunk_id, 0 AS list, rank FROM top UNION ALL SELECT question_id, chunk_id, 1, rank FROM lex),
m AS (SELECT question_id, chunk_id, max(rank) FILTER (WHERE list = 0) AS r0, max(rank) FILTER (WHERE list = 1) AS r1, min(list * 100000 + rank) AS f FROM e GROUP BY ALL),
s AS (SELECT *, round(coalesce(1.0 / (60 + r0), 0) + coalesce(1.0 / (60 + r1), 0), 9) AS score FROM m)
SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, f) AS rank FROM s) WHERE rank <= 20""",
    "rerank_overlap": f"""
WITH {bm25(CHUNK_TEXTS, "chunk_id", ASKED, 50, "lex")}, j AS (SELECT lex.question_id, chunk_id, rank AS fused, question AS query, text FROM lex JOIN chunks USING (chunk_id) JOIN questions USING (question_id)),
s AS (SELECT *, round({share("text")}, 6) AS rerank_score FROM j)
SELECT question_id, chunk_id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, fused) AS rank FROM s) WHERE rank <= 4""",
    "context_pack_4000": f"{RANKED}, {pack('ranked', 4000)} {PACKED}",
    "context_pack_8000": f"{RANKED}, {pack('ranked', 8000)} {PACKED}",
    "provenance": f"{RANKED}, {pack('ranked', 4000)} SELECT question_id, rank, place, chunk_id, score, 'relevance' AS score_kind, length(t) AS n_chars, sha1(t) AS sha1 FROM used",
    "rag_contexts": f"WITH {hier("'doc_' || doc_id")}, {bm25("SELECT doc_id || '.' || part AS chunk_id, text FROM kept", 'chunk_id', ASKED, 4, 'lex')}, ranked AS (SELECT lex.*, text FROM lex JOIN (SELECT doc_id || '.' || part AS chunk_id, text FROM kept) USING (chunk_id)), {pack('ranked', 4000)} {PACKED}",
    "sanitise_dedup": sanitised(r"regexp_replace(regexp_replace(answer, '(?i)\A[ \t]*ios[\w ]*[ \t]*(?:\n|\z)', ''), '(?s)```.*\z', '')", an.command_pattern(True), True),
    "sanitise_plain": sanitised(r"(CASE WHEN regexp_matches(answer, '(?s)```(?:[a-zA-Z]+)?\n(.*?)```') THEN regexp_extract(answer, '(?s)```(?:[a-zA-Z]+)?\n(.*?)```', 1) ELSE answer END)", an.command_pattern(False), False),
    "extract_config": f"""
WITH a AS (SELECT DISTINCT eval_id, answer FROM evaluations WHERE answer IS NOT NULL),
l AS (SELECT eval_id, list_filter({lines_of("replace(answer, '```', '')")}, lambda y: NOT {contains_any("lower(y)", an.FOREIGN)}) AS x FROM a),
s AS (SELECT eval_id, x, list_position(list_transform(x, lambda y: {contains_any("lower(y)", an.STARTS + an.OPENERS)}), true) AS b FROM l),
r AS (SELECT eval_id, CASE WHEN b > 0 THEN x[b:] ELSE []::VARCHAR[] END AS x FROM s),
e AS (SELECT eval_id, x, list_position(list_transform(x, lambda y: lower(y) IN ('end', 'exit')), true) AS e FROM r)
SELECT DISTINCT eval_id, array_to_string(CASE WHEN e > 0 THEN x[1:e] ELSE x END, chr(10)) AS config FROM e""",
    "pending_answers": f"SELECT DISTINCT eval_id FROM evaluations WHERE {strip("coalesce(answer, '')")} = ''",
    "pending_judgements": f"SELECT DISTINCT eval_id FROM evaluations WHERE {strip("coalesce(answer, '')")} <> '' AND NOT EXISTS (SELECT 1 FROM judge_results j WHERE j.eval_id = evaluations.eval_id AND parsing_success)",
    "strip_thinking": rf"WITH {RESPONSES} SELECT result_id, {THOUGHTLESS} AS response, array_to_string(list_transform(regexp_extract_all(response, '(?is)<think(?:ing)?>(.*?)</think(?:ing)?>', 1), lambda y: regexp_replace(y, '\A\s+|\s+\z', '', 'g')), chr(10) || chr(10)) AS thought FROM responses",
    "weighted_score": f"SELECT result_id, round({weighted(WEIGHTS)}, 6) AS overall, round({weighted(READINESS)}, 6) AS readiness FROM judge_results WHERE parsing_success",
    "outlier_filter": f"WITH {JUDGED} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, reliable, round(strength, 5) AS strength FROM marked",
    "consensus_scores": f"WITH {JUDGED} SELECT l_orderkey, {', '.join(f'round({c}, 5) AS {c}' for c in ('accuracy', 'correctness', 'overall', 'strength'))}, judges_used, judges FROM consensus",
    "risk_levels": f"WITH {JUDGED}, r AS (SELECT l_orderkey, round({weighted(READINESS)}, 5) AS readiness FROM consensus) SELECT l_orderkey, readiness, CASE WHEN readiness >= 8 THEN 'Low' WHEN readiness >= 6 THEN 'Medium' WHEN readiness >= 4 THEN 'High' ELSE 'Critical' END AS risk, round(least(100.0, readiness * 10), 4) AS deployment_confidence FROM r",
    "critical_issues": """
WITH j AS (SELECT l_orderkey, count(*) AS judges FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey, l_linenumber, unnest(['flag ' || l_returnflag, 'status ' || l_linestatus, 'tax ' || l_tax]) AS issue, unnest([0, 1, 2]) AS pos FROM lineitem),
c AS (SELECT l_orderkey, issue, count(*) AS n, min(l_linenumber * 10 + pos) AS first FROM i GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first, issue) AS place FROM c)
SELECT l_orderkey, issue, n, place FROM p JOIN j USING (l_orderkey) WHERE place <= 5 AND n > 0.3 * judges""",
    "judges_until_enough": "SELECT eval_id, result_id FROM (SELECT eval_id, result_id, coalesce(sum(coalesce(parsing_success, false)::INT) OVER (PARTITION BY eval_id ORDER BY result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM judge_results WHERE eval_id IS NOT NULL) WHERE done < 3",
    "score_pivot": f"""
WITH m AS (SELECT min({slug("model")}) AS slug, {judge_key("model")} AS k FROM judge_models WHERE model IS NOT NULL GROUP BY k),
r AS (SELECT question_id, slug, {", ".join(METRICS)} FROM judge_results LEFT JOIN m ON {judge_key("judge_results.model")} = k WHERE parsing_success)
SELECT q.question_id, p.* EXCLUDE (question_id) FROM (SELECT DISTINCT question_id FROM r) q LEFT JOIN (PIVOT (SELECT * FROM r WHERE slug IS NOT NULL) ON slug USING {", ".join(f"round(avg({c}), 5) AS {c}" for c in METRICS)} GROUP BY question_id) p ON q.question_id IS NOT DISTINCT FROM p.question_id""",
    "judge_progress": "SELECT lower(trim(model)) AS model, count(correctness) AS scored, count(*) FILTER (WHERE correctness IS NULL) AS open, round(avg(correctness), 5) AS mean FROM judge_results GROUP BY 1",
    "triplet_filter": "SELECT triplet_id FROM triplets WHERE coalesce(_meta.eval_score, 3) >= 2 AND coalesce(_meta.eval_detail.A, 1) = 1",
    "topic_split": """
WITH t AS (SELECT triplet_id, _meta.topic AS topic FROM triplets), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY sha1('42:' || triplet_id), triplet_id) AS rank, count(*) OVER (PARTITION BY topic) AS n FROM t)
SELECT triplet_id, rank <= greatest(1, floor(n * 0.09999999999999998)) AS is_val FROM r""",
    "triplet_accuracy": f"WITH s AS (SELECT round({share('pos')}, 9) AS sp, round({share('neg')}, 9) AS sn FROM triplets WHERE query IS NOT NULL AND pos IS NOT NULL AND neg IS NOT NULL) SELECT round(avg((sp > sn)::INT), 6) AS accuracy, count(*) AS n FROM s",
    "validation_gap": f"WITH s AS (SELECT triplet_id // 64 AS batch, round({share('pos')}, 9) AS sp, round({share('neg')}, 9) AS sn FROM triplets WHERE query IS NOT NULL AND pos IS NOT NULL AND neg IS NOT NULL), b AS (SELECT batch, avg(sp) AS p, avg(sn) AS n, avg(ln(1 + exp((sn - sp) / 0.05))) AS l FROM s GROUP BY batch) SELECT round(avg(p), 6) AS pos, round(avg(n), 6) AS neg, round(avg(p - n), 6) AS gap, round(avg(l), 6) AS loss, count(*) AS batches FROM b",
    "best_checkpoint": """
WITH r AS (SELECT s_name AS path, CASE s_nationkey % 3 WHEN 0 THEN 'best' WHEN 1 THEN 'step' ELSE 'final' END AS kind, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS score FROM supplier),
t AS (SELECT *, CASE WHEN kind = 'best' AND score IS NOT NULL THEN 2 WHEN score > -1 THEN 1 ELSE 0 END AS tier FROM r)
SELECT path, kind, score FROM t ORDER BY tier DESC, CASE WHEN tier > 0 THEN score ELSE 0 END DESC, path LIMIT 1""",
    "unit_vectors": "SELECT vec_id, 1.0::DOUBLE AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS squared FROM embeddings",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "rrf_fusion_prefix_key": f"""
WITH {bm25(CHUNK_TEXTS, "chunk_id", TOPICAL, 30, "top")}, {bm25(CHUNK_TEXTS, "chunk_id", ASKED, 50, "lex")},
e AS (SELECT question_id, chunk_id, 0 AS list, rank FROM top UNION ALL SELECT question_id, chunk_id, 1, rank FROM lex),
k AS (SELECT e.*, coalesce(metadata.source_file, '') || chr(31) || coalesce(metadata.page_num::VARCHAR, '') || chr(31) || substr(text, 1, 64) AS key FROM e JOIN chunks USING (chunk_id)),
m AS (SELECT question_id, key, max(rank) FILTER (WHERE list = 0) AS r0, max(rank) FILTER (WHERE list = 1) AS r1, min(list * 100000 + rank) AS f, arg_max(chunk_id, list * 100000 + rank) AS chunk_id FROM k GROUP BY ALL),
s AS (SELECT *, round(coalesce(1.0 / (60 + r0), 0) + coalesce(1.0 / (60 + r1), 0), 9) AS score FROM m)
SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, f) AS rank FROM s) WHERE rank <= 20""",
    "judge_json": rf"""
WITH {RESPONSES}, t AS (SELECT result_id, {THOUGHTLESS} AS body FROM responses),
u AS (SELECT result_id, body, regexp_replace(regexp_replace(body, '\A\s*(?:```json|```)?\s*', ''), '\s*(?:```)?\s*\z', '') AS whole, regexp_extract(body, '(?s)\{{.*\}}', 0) AS inner_text FROM t),
j AS (SELECT *, CASE WHEN json_valid(whole) THEN whole::JSON END AS w, CASE WHEN json_valid(inner_text) THEN inner_text::JSON END AS i FROM u),
v AS (SELECT *, {" AND ".join(f"coalesce(json_type(w, '$.{c}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND TRY_CAST(w->>'$.{c}' AS DOUBLE) BETWEEN 0 AND 10, false)" for c in CRITERIA)} AS w_ok,
  {" AND ".join(f"coalesce(json_type(i, '$.{c}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND TRY_CAST(i->>'$.{c}' AS DOUBLE) BETWEEN 0 AND 10, false)" for c in CRITERIA)} AS i_ok,
  {", ".join(rf"coalesce(nullif(regexp_extract(body, '{chr(34)}{c}{chr(34)}\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1), '')::DOUBLE, 0.0) AS x_{c}" for c in CRITERIA)} FROM j),
o AS (SELECT *, CASE WHEN w_ok THEN 'whole' WHEN i_ok THEN 'inner' WHEN greatest({", ".join(f"x_{c}" for c in CRITERIA)}) > 0 THEN 'scores' ELSE 'none' END AS method FROM v)
SELECT result_id, method, method <> 'none' AS ok, {", ".join(f"CASE method WHEN 'whole' THEN TRY_CAST(w->>'$.{c}' AS DOUBLE) WHEN 'inner' THEN TRY_CAST(i->>'$.{c}' AS DOUBLE) WHEN 'scores' THEN x_{c} ELSE 0.0 END AS {c}" for c in ("accuracy", "correctness"))},
  CASE method WHEN 'whole' THEN (w->>'$.confidence')::DOUBLE WHEN 'inner' THEN (i->>'$.confidence')::DOUBLE WHEN 'scores' THEN 50.0 ELSE 0.0 END AS confidence FROM o""",
    "prompts": f"SELECT question_id, length({q(INSTRUCTIONS)} || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || '```') AS n_bare, sha1({q(INSTRUCTIONS)} || chr(10) || chr(10) || 'Context (from docs):' || chr(10) || coalesce(topic, '') || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || '```') AS sha1 FROM questions",
    "judge_prompts": f"WITH a AS (SELECT DISTINCT eval_id, answer FROM evaluations WHERE answer IS NOT NULL), b AS (SELECT DISTINCT eval_id, question FROM evaluations) SELECT DISTINCT eval_id, {prompt_length('question', 'answer')} AS n_chars FROM a JOIN b USING (eval_id)",
    "judge_reports": f"""
WITH {LATEST}, s AS (SELECT eval_id, {rule_scores(f"coalesce({prompt_length('question', 'answer')}, 0)")} FROM answered), t AS (SELECT *, {weighted(WEIGHTS)} AS overall, {weighted(READINESS)} AS ready FROM s)
SELECT eval_id, 2 AS judges_ok, 0 AS judges_failed, round(overall, 5) AS overall, {risk_of("ready")} AS risk, 1.0 AS strength FROM t""",
    "judges_early_stop": f"""
WITH {LATEST}, n AS (SELECT eval_id, coalesce({prompt_length('question', 'answer')}, 0) AS n FROM answered),
a AS (SELECT *, unnest([1, 2, 3]) AS j FROM n), asked AS (SELECT *, CASE j WHEN 1 THEN n % 3 <> 0 WHEN 2 THEN n % 2 <> 0 ELSE true END AS ok FROM a WHERE j = 1 OR (n % 3 = 0 AND (j = 2 OR n % 2 = 0))),
s AS (SELECT eval_id, j, ok, {rule_scores("n")} FROM asked)
SELECT eval_id, CASE j WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'third' END AS model, ok, CASE WHEN ok THEN round({weighted(WEIGHTS)}, 5) ELSE 0.0 END AS overall FROM s""",
    "judge_batches": f"""
WITH {LATEST}, s AS (SELECT eval_id, {rule_scores(f"(length(coalesce(question, '')) + length(answer) + {len('Question: ') + len(chr(10) * 2 + 'Configuration: ')})")} FROM answered)
SELECT eval_id, true AS ok, accuracy, completeness, 50.0 AS confidence, round({weighted(WEIGHTS)}, 5) AS overall FROM s""",
    "evaluation_wide": f"""
WITH {LATEST}, n AS (SELECT eval_id, {strip("question")} AS question, {strip("answer")} AS answer FROM latest),
l AS (SELECT eval_id, CASE WHEN eval_id % 4 <> 0 AND question <> '' AND answer <> '' THEN {prompt_length('question', 'answer')} END AS n FROM n),
s AS (SELECT eval_id, n, n % 5 <> 0 AS good, {rule_scores("n")} FROM l), t AS (SELECT *, {weighted(WEIGHTS)} AS overall, {weighted(READINESS)} AS ready FROM s)
SELECT eval_id, CASE WHEN eval_id % 4 = 0 THEN 5.25 WHEN good THEN round(overall, 3) WHEN n IS NOT NULL THEN 0.0 END AS overall,
  {", ".join(f"CASE WHEN good THEN round({c}, 3) WHEN n IS NOT NULL THEN 0.0 END AS {c}" for c in CRITERIA)}, CASE WHEN good THEN round(ready, 3) WHEN n IS NOT NULL THEN 0.0 END AS production_readiness,
  CASE WHEN good THEN {risk_of("ready")} WHEN n IS NOT NULL THEN 'Unknown' END AS risk, CASE WHEN good THEN round(least(100.0, ready * 10), 1) WHEN n IS NOT NULL THEN 0.0 END AS deployment_confidence,
  CASE WHEN n IS NOT NULL THEN 0.5 END AS consensus_strength, good::INT::DOUBLE AS judges_ok, (NOT good)::INT::DOUBLE AS judges_failed FROM t""",
    "judge_json_batch": f"""
WITH b AS (SELECT result_id, (result_id // 5) % 4 <> 3 AS ok, result_id % 7 <> 0 AS whole, {", ".join(f"round(coalesce({c}, 0), 1) AS {c}" for c in CRITERIA)} FROM judge_results),
v AS (SELECT *, ok AND whole AND {" AND ".join(f"{c} BETWEEN 0 AND 10" for c in CRITERIA)} AS valid FROM b)
SELECT result_id, ok, valid, CASE WHEN valid THEN accuracy ELSE 0.0 END AS accuracy, CASE WHEN valid THEN completeness ELSE 0.0 END AS completeness FROM v""",
    "index_search": f"""
WITH c AS (SELECT chunk_id, CASE WHEN starts_with(text, 'query: ') OR starts_with(text, 'passage: ') THEN text ELSE 'passage: ' || text END AS t FROM chunks WHERE chunk_id IS NOT NULL AND {strip("coalesce(text, '')")} <> ''),
a AS (SELECT question_id, 'query: ' || question AS t FROM questions WHERE question_id % 50 = 0),
{encoded("c", "c", "chunk_id", "t")}, {encoded("a", "a", "question_id", "t")},
p AS (SELECT question_id, chunk_id, sum(a_u.x * c_u.x) AS p FROM a_u JOIN c_u USING (d) GROUP BY ALL),
s AS (SELECT question_id, chunk_id, a_s.s + c_s.s - 2 * coalesce(p, 0) AS s FROM a_s CROSS JOIN c_s LEFT JOIN p USING (question_id, chunk_id)),
r AS (SELECT question_id, chunk_id, round(s, 6) + 0.0 AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 9), chunk_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "context_totals": f"""
WITH t AS (SELECT coalesce(metadata.pdf_name, '') AS d, metadata.chapter AS chapter, {strip("metadata.chapter")} AS title, text, {strip("text")} AS lead, metadata.source_file AS file FROM chunks),
l AS (SELECT *, 'PDF: ' || d || CASE WHEN title IS NULL OR title = '' THEN '' WHEN starts_with(upper(title), 'CHAPTER') OR starts_with(upper(title), 'CHAPITRE') THEN chr(10) || array_to_string(string_split(title, ' ')[1:2], ' ') || ': ' || coalesce(string_split(title, ' ')[3], '')
  ELSE chr(10) || 'Chapter: ' || substr(title, 1, 100) || CASE WHEN length(title) > 100 THEN '...' ELSE '' END END || CASE WHEN length(lead) > 0 AND length(lead) <= 150 THEN chr(10) || lead ELSE '' END AS label,
  {strip("'Document: ' || file || chr(10) || coalesce(chapter, '')")} || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || text END AS whole FROM t),
s AS (SELECT greatest(1, length(whole) // 4) - greatest(1, length(label) // 4) AS saved, ceil((length(label) + 2) / 4.0) > 300 AS cut FROM l)
SELECT count(*) AS contexts, count(*) FILTER (WHERE saved > 0) AS contexts_optimized, coalesce(sum(saved) FILTER (WHERE saved > 0), 0)::BIGINT AS tokens_saved, count(*) FILTER (WHERE cut) AS contexts_cut FROM s""",
    "overlap_totals": "WITH n AS (SELECT ceil(length(text) / 4.0) AS n FROM documents WHERE text IS NOT NULL) SELECT count(*) FILTER (WHERE n > 300) AS split, count(*) FILTER (WHERE n > 300 AND n / 300 <= 2.0) AS overlaps_reduced FROM n",
}
