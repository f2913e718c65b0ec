"""SQL of the pN_ queries that SQL can express over whole tables.

Left out: p1's classes (named by hashes), p2, p3's fitted model, p5's cleaned
texts, p8's mix and report (their sizes are tokens of a byte-pair vocabulary)
and p9; those are tested against brute force on small fixtures.
"""

from __future__ import annotations

SPACE = r"[^\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
GAP = "[" + SPACE[2:-1]
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}]+')"

VOTES = """
v0 AS (SELECT eval_id, regexp_replace(regexp_replace(lower(model), ':.*$', ''), '[^a-z0-9]+', '', 'g') AS name, unnest(['correctness', 'hallucination', 'overall_score']) AS score, unnest([correctness, hallucination, overall_score]) AS x, judged_at, result_id,
  greatest(coalesce(accuracy, 0), coalesce(relevance, 0), coalesce(correctness, 0), coalesce(hallucination, 0), coalesce(completeness, 0), coalesce(overall_score, 0)) > 10 AS wide
  FROM judge_results WHERE parsing_success AND eval_id IS NOT NULL),
v1 AS (SELECT *, CASE WHEN wide THEN x / 10 ELSE x END AS s FROM v0 WHERE x IS NOT NULL),
v2 AS (SELECT eval_id, score, name, arg_max(s, (judged_at, result_id)) AS s FROM v1 WHERE s BETWEEN 0 AND 10 GROUP BY ALL),
votes AS (SELECT eval_id, score, CASE WHEN s < 4 THEN 0 WHEN s < 7 THEN 1 ELSE 2 END AS label FROM v2 WHERE name IN (SELECT regexp_replace(regexp_replace(lower(model), ':.*$', ''), '[^a-z0-9]+', '', 'g') FROM judge_models)),
counts AS (SELECT eval_id, score, label, count(*) AS c FROM votes GROUP BY ALL)"""

MANUAL = r"coalesce(nullif(trim(metadata.pdf_name), ''), nullif(trim(regexp_extract(metadata.source_file, '([^/\\]+)[/\\]*$', 1)), ''))"

BARE = r"regexp_replace({0}, '(?i)^\s*(?:(?:query|passage)\s*:\s*)+', '')"
OVERLAP = f"""
t AS (SELECT triplet_id, lower(trim(split)) AS split, source, unnest(['query', 'pos']) AS field, unnest([{BARE.format("query")}, {BARE.format("pos")}]) AS text FROM triplets WHERE triplet_id IS NOT NULL AND split IS NOT NULL),
w AS (SELECT DISTINCT triplet_id, split = 'train' AS train, field, unnest({WORDS.format("text")}) AS word FROM t), n AS (SELECT triplet_id, field, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT a.triplet_id AS a, b.triplet_id AS b, field, count(*) AS m FROM w a JOIN w b USING (field, word) WHERE a.train AND NOT b.train GROUP BY ALL),
links AS (SELECT m.a, m.b, m.field FROM m JOIN n x ON x.triplet_id = m.a AND x.field = m.field JOIN n y ON y.triplet_id = m.b AND y.field = m.field WHERE 10 * m >= 7 * (x.n + y.n - m))"""

LEAKED = f"""
i AS (SELECT item_id, {WORDS.format("text")} AS w FROM heldout_items), d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dg AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
hits AS (SELECT doc_id, item_id, k FROM dg JOIN ig USING (g))"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH c AS (SELECT chunk_id, {WORDS.format("text")} AS w FROM chunks WHERE chunk_id IS NOT NULL), g AS (SELECT DISTINCT chunk_id, array_to_string(w[k:k + 2], ' ') AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS k FROM c)),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT m.a AS chunk_id_a, m.b AS chunk_id_b FROM m JOIN n x ON x.chunk_id = m.a JOIN n y ON y.chunk_id = m.b WHERE 2 * m >= x.n + y.n - m""",
    "p6_found": f"WITH {OVERLAP} SELECT DISTINCT least(a, b) AS triplet_id_a, greatest(a, b) AS triplet_id_b, field FROM links",
    "p6_report": f"""
WITH {OVERLAP}, hit AS (SELECT DISTINCT b AS triplet_id, field FROM links)
SELECT split, source, field, count(DISTINCT triplet_id) AS n_rows, count(DISTINCT CASE WHEN hit.triplet_id IS NOT NULL THEN t.triplet_id END) AS n_overlapping FROM t LEFT JOIN hit USING (triplet_id, field) WHERE split <> 'train' GROUP BY split, source, field""",
    "p7_report": f"WITH {LEAKED} SELECT item_id, suite, count(DISTINCT doc_id) AS n_docs FROM heldout_items LEFT JOIN hits USING (item_id) GROUP BY item_id, suite",
    "p7_spans": rf"""
WITH {LEAKED}, runs AS (SELECT doc_id, generate_subscripts(r, 1) AS i, unnest(r) AS run FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+') AS r FROM documents WHERE doc_id IN (SELECT doc_id FROM hits))),
placed AS (SELECT doc_id, i, run, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM runs),
words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, e - length(run) AS s, e FROM placed WHERE regexp_matches(run, '^[\p{{L}}\p{{Nd}}]')),
fresh AS (SELECT *, coalesce(k > lag(k) OVER v + 12, true)::INT AS new FROM hits WINDOW v AS (PARTITION BY doc_id, item_id ORDER BY k)),
passages AS (SELECT doc_id, item_id, part, min(k) AS k1, max(k) + 11 AS k2 FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS part FROM fresh) GROUP BY ALL),
spans AS (SELECT DISTINCT p.doc_id, a.s, z.e FROM passages p JOIN words a ON a.doc_id = p.doc_id AND a.k = k1 JOIN words z ON z.doc_id = p.doc_id AND z.k = k2),
cut AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM spans)
SELECT doc_id, min(s)::INT AS span_start, max(e)::INT AS span_end FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e) AS part FROM cut) GROUP BY doc_id, part""",
    "p3_agreement": f"WITH {VOTES} SELECT eval_id, score, sum(c)::BIGINT AS n_votes, round(CASE WHEN sum(c) > 1 THEN sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) END, 6) AS agreement FROM counts GROUP BY ALL",
    "p3_alpha": f"""
WITH {VOTES}, items AS (SELECT eval_id, score, sum(c) AS n, sum(c * c) AS sq FROM counts GROUP BY ALL HAVING sum(c) > 1),
o AS (SELECT score, count(*) AS n_items, sum(n) AS n, sum((n * n - sq) / (n - 1)) AS diff FROM items GROUP BY score),
e AS (SELECT score, sum(c * c) AS sq FROM (SELECT score, label, sum(c) AS c FROM counts JOIN items USING (eval_id, score) GROUP BY ALL) GROUP BY score)
SELECT score, n_items::BIGINT AS n_items, n::BIGINT AS n_votes, round(1.0 - diff / ((n * n - e.sq) / (n - 1)), 6) AS alpha FROM o JOIN e USING (score)""",
    "p4_found": rf"""
WITH items AS (SELECT 'chunk' AS item_kind, chunk_id AS item_key, text FROM chunks UNION ALL
  SELECT 'section', section_id::VARCHAR, array_to_string(list_filter(list_transform(list_sort(font_lines), lambda x: x.text), lambda x: x IS NOT NULL), chr(10)) FROM sections),
large AS (SELECT * FROM items WHERE 4 * len(regexp_extract_all(text, '{SPACE}')) // 3 > 512),
lines AS (SELECT item_kind, item_key, unnest(string_split(text, chr(10))) AS line FROM large),
parts AS (SELECT item_kind, item_key, unnest(string_split_regex(regexp_replace(line, '([.!?]){GAP}', '\1' || chr(10), 'g'), chr(10))) AS part FROM lines)
SELECT item_kind, item_key, CASE WHEN max(4 * len(regexp_extract_all(part, '{SPACE}')) // 3) > 512 THEN 'hard' ELSE 'natural' END AS cut FROM parts GROUP BY ALL""",
    "p4_pieces": rf"""
WITH RECURSIVE items AS (SELECT 'chunk' AS item_kind, chunk_id AS item_key, text FROM chunks UNION ALL
  SELECT 'section', section_id::VARCHAR, array_to_string(list_filter(list_transform(list_sort(font_lines), lambda x: x.text), lambda x: x IS NOT NULL), chr(10)) FROM sections),
large AS (SELECT * FROM items WHERE 4 * len(regexp_extract_all(text, '{SPACE}')) // 3 > 512),
runs AS (SELECT *, generate_subscripts(r, 1) AS i, unnest(r) AS run FROM (SELECT item_kind, item_key, text, regexp_extract_all(text, '{SPACE}|{GAP}+') AS r FROM large)),
placed AS (SELECT *, sum(length(run)) OVER w - length(run) AS s, lead(run) OVER w AS gap FROM runs WINDOW w AS (PARTITION BY item_kind, item_key ORDER BY i)),
words AS (SELECT item_kind, item_key, s, s + length(run) AS e, row_number() OVER v AS b, count(*) OVER (PARTITION BY item_kind, item_key) AS n,
  run[-1] IN ('.', '!', '?') OR coalesce(contains(gap, chr(10)), false) OR lead(run) OVER v IS NULL AS is_end
  FROM placed WHERE NOT regexp_matches(run, '^{GAP}') WINDOW v AS (PARTITION BY item_kind, item_key ORDER BY i)),
stretches AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY item_kind, item_key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM words),
bounds AS (SELECT *, lead(b) OVER (PARTITION BY item_kind, item_key ORDER BY b) AS nb FROM (SELECT *, count(*) OVER (PARTITION BY item_kind, item_key, stretch) AS size FROM stretches) WHERE is_end OR size > 384),
low AS (SELECT item_kind, item_key, b, greatest(b - 38, nb - 384, 0) AS low FROM bounds WHERE b < n),
near AS (SELECT l.item_kind, l.item_key, l.b, l.low, CASE WHEN l.low = 0 THEN 0 ELSE min(x.b) END AS near FROM low l LEFT JOIN words x ON x.item_kind = l.item_kind AND x.item_key = l.item_key AND x.is_end AND x.b >= l.low AND x.b < l.b GROUP BY l.item_kind, l.item_key, l.b, l.low),
starts AS (SELECT item_kind, item_key, b AS before, CASE WHEN near = low OR 2 * (b - near) >= 38 THEN near ELSE low END AS start, coalesce(near = low OR 2 * (b - near) >= 38, low = b) AS aligned FROM near
  UNION ALL SELECT item_kind, item_key, 0, 0, true FROM large),
steps AS (SELECT t.item_kind, t.item_key, t.before, t.start, t.aligned, max(x.b) AS b FROM starts t JOIN bounds x ON x.item_kind = t.item_kind AND x.item_key = t.item_key AND x.b <= t.start + 384 GROUP BY ALL),
walk AS (SELECT *, 0 AS piece FROM steps WHERE before = 0 UNION ALL SELECT t.*, k.piece + 1 FROM walk k JOIN steps t ON t.item_kind = k.item_kind AND t.item_key = k.item_key AND t.before = k.b)
SELECT k.item_kind, k.item_key, k.piece::INT AS piece, a.s::INT AS piece_start, z.e::INT AS piece_end, (4 * (k.b - k.start) // 3)::INT AS n_tokens, NOT z.is_end AS hard,
  CASE WHEN k.piece = 0 THEN 0 ELSE 4 * (k.before - k.start) // 3 END::INT AS overlap_tokens, k.aligned AS start_natural, substr(l.text, a.s::INT + 1, (z.e - a.s)::INT) AS piece_text
FROM walk k JOIN words a ON a.item_kind = k.item_kind AND a.item_key = k.item_key AND a.b = k.start + 1 JOIN words z ON z.item_kind = k.item_kind AND z.item_key = k.item_key AND z.b = k.b JOIN large l ON l.item_kind = k.item_kind AND l.item_key = k.item_key""",
    "p5_found": rf"""
WITH rows AS (SELECT chunk_id, {MANUAL} AS manual, string_split(text, chr(10)) AS x FROM chunks), sizes AS (SELECT manual, count(*) AS n FROM rows GROUP BY manual),
lines AS (SELECT chunk_id, manual, unnest(range(1, len(x) + 1)) AS line_no, lower(regexp_replace(unnest(x), '[^\p{{L}}]+', '', 'g')) AS k FROM rows),
keys AS (SELECT manual, k, count(DISTINCT chunk_id) AS df FROM lines WHERE k <> '' GROUP BY ALL)
SELECT chunk_id, line_no::INT AS line_no FROM lines JOIN keys USING (manual, k) JOIN sizes USING (manual) WHERE df >= 5 AND 10 * df >= n""",
    "p7_found": f"WITH {LEAKED} SELECT DISTINCT doc_id, item_id FROM hits",
    "p8_found": """
WITH d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1), t AS (SELECT sum(length(text)) AS total FROM documents)
SELECT m.source FROM mix_targets m LEFT JOIN d ON d.source = lower(trim(m.source)), t WHERE coalesce(n, 0) * max_repeats < target_share * total""",
}
