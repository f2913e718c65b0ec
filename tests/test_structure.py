import random

from pyspark.sql import functions as F

from docloom.operators import chunking as ck
from docloom.operators import structure as st

SCHEMA = "doc int, line_no int, text string, role string, page_num int, x0 double"


def random_lines(seed, docs=40, n=20):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        for i in range(rng.randint(0, n)):
            role = rng.choice(["cli", "heading", "label", "step", "prose"])
            text = rng.choice(["Chapter 1 x", "Setup", "chapters", ""]) if role == "heading" else rng.choice(["alpha", " ", "", "beta gamma"])
            rows.append((d, i, text, role, rng.randint(1, 9), 0.0))
    return rows


def spec(rows):
    """Sections and spans by a walk over the lines."""
    sections, spans = {}, {}
    docs = {}
    for r in rows:
        docs.setdefault(r[0], []).append(r)
    for d, lines in docs.items():
        chapter, section, page, sec, last, island = "Preamble", "Overview", 1, 0, None, -1
        state = "prose"
        for _, _, text, role, page_num, _ in sorted(lines, key=lambda r: r[1]):
            if role == "heading":
                if "chapter" in text.lower().replace(",", " ").split():
                    chapter, section = text, "Overview"
                else:
                    section = text
                page, sec, last, island, state = page_num, sec + 1, None, -1, "prose"
                continue
            sections.setdefault((d, sec), [chapter, section, page, []])[3].append(text)
            state = ("step_table" if state == "step_table" else "cli_code") if role == "cli" else "step_table" if role in ("step", "label") else "prose"
            if state != last:
                island, last = island + 1, state
            spans.setdefault((d, sec, island), [state, []])[1].append(text)
    out = {}
    for k, (kind, texts) in spans.items():
        while texts and not texts[0].strip():
            texts.pop(0)
        while texts and not texts[-1].strip():
            texts.pop()
        if texts:
            out[k] = (kind, "\n".join(texts))
    return {k: (c, s, p, "\n".join(t)) for k, (c, s, p, t) in sections.items()}, out


def test_sections_and_spans_match_a_walk(spark):
    rows = random_lines(3)
    df = spark.createDataFrame(rows, SCHEMA)
    sections, spans = spec(rows)
    got = {(r.doc, r.sec_id): (r.chapter, r.section, r.page_num, r.text) for r in st.section_texts(df, "doc").collect()}
    assert got == sections
    got = {(r.doc, r.sec_id, r.island): (r.kind, r.text) for r in st.span_islands(df, "doc").collect()}
    assert got == spans


def test_line_roles(spark):
    rows = [
        (1, 1, "Courier", 10.0), (1, 2, "Courier-Bold", 10.0),
        (2, 1, "Univers-CondensedBold", 8.0),
        (3, 1, "Univers-CondensedBold", 18.0), (3, 2, "Times", 18.0),
        (4, 1, "Univers-CondensedBold", 12.0),
        (5, 1, "Times-Bold", 10.0),
        (6, 1, "TimesNewRoman", 10.0), (6, 2, "Courier", 10.0),
        (7, 1, "Times", 9.0), (7, 2, "Univers-CondensedBold", 20.0),
    ]
    df = spark.createDataFrame(rows, "line int, pos int, font string, size double")
    got = {r.line: r.role for r in st.line_roles(df, ["line"], "pos", "font", "size").collect()}
    assert got == {1: "cli", 2: "skip", 3: "heading", 4: "label", 5: "step", 6: "prose", 7: "prose"}


def test_command_blocks_rejoin_to_the_text(spark):
    text = "hostname a\ninterface Gi1\n shutdown\nrouter ospf 1\nline vty 0"
    got = st.command_blocks(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("block_no").collect()
    assert [r.block for r in got] == ["hostname a", "interface Gi1\n shutdown", "router ospf 1", "line vty 0"]


def test_y_bucket_rounds_half_to_even(spark):
    got = spark.createDataFrame([(5.0,), (7.0,), (6.1,)], "t double").select(st.y_bucket(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [4.0, 8.0, 6.0]


def test_block_chunks_keep_commands_whole(spark):
    rows = [(1, 1, "Chapter 1 A", "heading", 1, 0.0)] + [(1, 2 + i, f"command number {i} with some words", "cli", 1, 0.0) for i in range(120)]
    rows += [(1, 200 + i, "A sentence of plain prose that goes on for a while.", "prose", 2, 0.0) for i in range(100)]
    out = ck.block_chunks(spark.createDataFrame(rows, SCHEMA), "doc").orderBy("chunk_index").collect()
    assert out[0].block_type == "cli_code" and out[0].oversized and out[0].text.count("command number") == 120
    assert all(r.block_type == "prose" and r.token_count <= 520 for r in out[1:]) and len(out) > 2
    dropped = ck.block_chunks(spark.createDataFrame(rows, SCHEMA), "doc", oversized="drop").collect()
    assert len(dropped) == len(out) - 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert st.section_texts(empty, "doc").collect() == [] and st.span_islands(empty, "doc").collect() == []


def test_lines_from_words(spark):
    rows = [
        ("d", 1, 100.0, "world", "Times", 10.0, 50.4, 60.0, 9.0), ("d", 1, 100.0, "hello", "Times", 10.0, 50.0, 60.0, 1.0),
        ("d", 1, 100.0, "head", "Times", 10.0, 2.0, 6.0, 1.0), ("d", 1, 100.0, "running", "Univers-CondensedBold", 8.0, 30.0, 36.0, 1.0),
        ("d", 2, 100.0, "Title", "Univers-CondensedBold", 18.0, 20.0, 38.0, 1.0), ("d", 1, 100.0, "ping", "Courier", 9.0, 70.0, 79.0, 1.0),
    ]
    words = spark.createDataFrame(rows, "doc string, page_num int, page_height double, text string, fontname string, size double, top double, bottom double, x0 double")
    got = [(r.page_num, r.text, r.role) for r in st.lines_from_words(words, "doc").orderBy("line_no").collect()]
    assert got == [(1, "hello world", "prose"), (1, "ping", "cli"), (2, "Title", "heading")]
    assert [r.section for r in st.section_texts(st.lines_from_words(words, "doc"), "doc").collect()] == ["Overview"]


def test_strategies(spark):
    import pytest

    page = "A first sentence of words that is long enough to stay in here. " * 3
    pages = spark.createDataFrame([("m", 1, page + "\n\n" + page.upper()), ("m", 2, page)], "doc string, page_num int, text string")
    for name in ("paragraph", "fixed", "semantic"):
        out = ck.chunk(pages, name, "doc").orderBy("chunk_id").collect()
        assert out[0].chunk_id == "m_chunk000001" and out[0].strategy == name
    assert ck.chunk(pages, "paragraph", "doc").count() == 1 and ck.chunk(pages, "paragraph", "doc", dedup=False).count() == 3
    with pytest.raises(ValueError, match="unknown"):
        ck.chunk(pages, "magic", "doc")


def test_one_long_document_over_several_stretches(spark, monkeypatch):
    """Sections, kinds and islands carry over from stretch to stretch."""
    rows = [r for seed in range(3) for r in random_lines(seed, 1, 900)]
    rows = [(d, i, *r[2:]) for d, part in enumerate((rows, random_lines(9, 1, 30))) for i, r in enumerate(part)]
    # long stretches of commands without a heading, so that a section spans stretches
    rows = [(d, i, t, "cli" if 100 < i < 600 and role == "heading" else role, p, x) for d, i, t, role, p, x in rows]
    monkeypatch.setattr(st, "LONG", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        ordered, long = st.in_order(df, "doc")
        assert [r[0] for r in long.collect()] == [0] and ordered.filter("doc = 0").select("_part").distinct().count() > 1
        sections, spans = spec(rows)
        assert {(r.doc, r.sec_id): (r.chapter, r.section, r.page_num, r.text) for r in st.section_texts(df, "doc").collect()} == sections
        assert {(r.doc, r.sec_id, r.island): (r.kind, r.text) for r in st.span_islands(df, "doc").collect()} == spans
        made = ck.chunk(df, "section", "doc", min_tokens=1).collect()
        assert sorted(r.chunk_id for r in made if r.doc == 0) == [f"0_chunk{i:06d}" for i in range(1, sum(r.doc == 0 for r in made) + 1)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
