import json

from pyspark.sql import functions as F

from docloom.sources import readers, sinks
from docloom.streaming import incremental


def test_nested_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pdf_name": "", "document_name": "Manual", "content": [{"chapter": "One", "introduction": "i", "sections": [{"title": "S", "text": "body", "content": ""}, {"section": "T"}]}, {"title": "Two", "sections": []}], "note": "x"}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"main": [{"title": "C", "sections": [{"title": "U", "body": "b"}]}]}))
    got = [(r.document, r.chapter, r.section, r.body) for r in readers.nested_documents(spark, str(tmp_path)).orderBy("source_file", "chapter_no", "section_no").collect()]
    assert got == [("Manual", "One", "S", "body"), ("Manual", "One", "T", None), ("c", "C", "U", "b")]


def test_chunk_documents_lift_metadata(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps([{"id": "1", "text": "x", "pdf_name": "top", "metadata": {"section": "s"}}, {"chunk_id": "2", "text": "y", "metadata": {"pdf_name": "inner", "page_num": 3}}]))
    got = [(r.chunk_id, r.pdf_name, r.section, r.page_num) for r in readers.chunk_documents(spark, str(f)).orderBy("chunk_id").collect()]
    assert got == [("1", "top", "s", None), ("2", "inner", None, 3)]


def test_triplets_skip_broken_lines(spark, tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text('{"query": "q", "pos": "p", "neg": "n", "_meta": {"eval_score": 3}}\n\n{"query": \n{"query": "r"}\n')
    assert sorted(r.query for r in readers.triplets(spark, str(f)).collect()) == ["q", "r"]


def test_questions_and_checkpoints(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,other\n"a, b\nc",1\n')
    assert readers.questions(spark, str(tmp_path / "q.csv")).collect()[0].question == "a, b\nc"
    for name, score in (("one", 0.5), ("two", 0.7)):
        (tmp_path / "cp" / name).mkdir(parents=True)
        (tmp_path / "cp" / name / "metadata.json").write_text(json.dumps({"checkpoint_type": "best", "metrics": {"triplet_accuracy": score}}))
    got = {r.path.rsplit("/", 1)[1]: r.score for r in readers.checkpoints(spark, str(tmp_path / "cp")).collect()}
    assert got == {"one": 0.5, "two": 0.7}


def test_decoder_plug_in_drops_bands(spark, tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"words")

    def decode(content):
        return [{"page_num": 1, "page_height": 100.0, "text": content.decode(), "fontname": "Courier", "size": 10.0, "top": t, "bottom": t + 5, "x0": 1.0} for t in (2.0, 50.0, 95.0)]

    words = readers.decoded_words(readers.binary_documents(spark, str(tmp_path)), decode).collect()
    assert [w.top for w in words] == [50.0]
    blocks = spark.createDataFrame([("d", 1, 1, "head", 2.0, 5.0, 100.0), ("d", 1, 3, "b", 50.0, 60.0, 100.0), ("d", 1, 2, "a", 20.0, 30.0, 100.0)], "doc string, page int, block_no int, text string, y0 double, y1 double, page_height double")
    assert readers.page_texts(blocks, ["doc", "page"]).collect()[0].text == "a\nb"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "ä"), ("g", 1, "c")], "f string, o int, t string")
    assert {(r.f, r.part): r.texts for r in sinks.grouped_texts(df, "f", "o", ["o"], "t").collect()} == {("f", 0): ["ä", "b"], ("g", 0): ["c"]}
    assert {(r.f, r.part): r.texts for r in sinks.grouped_texts(df, "f", "o", ["o"], "t", size=2).collect()} == {("f", 0): ["ä"], ("f", 1): ["b"], ("g", 0): ["c"]}
    sinks.write_chunks(df, str(tmp_path / "chunks"))
    assert "ä" in "".join(p.read_text() for p in (tmp_path / "chunks").glob("*.json"))
    sinks.append_batch(df, str(tmp_path / "batch"))
    sinks.append_batch(df, str(tmp_path / "batch"))
    assert sinks.latest(spark.read.parquet(str(tmp_path / "batch")), ["f", "o"], "t").count() == 3
    sinks.write_index(df, str(tmp_path / "index"))
    assert readers.vector_index(spark, str(tmp_path / "index")).count() == 3
    assert json.loads(sinks.payload_json(df.filter("f = 'g'"), "f", "t").collect()[0].value) == {"f": "g", "t": "c"}


def test_stream_judges_each_answer_once(spark, tmp_path):
    answers, scores, check = (str(tmp_path / n) for n in ("answers", "scores", "check"))
    schema = "q int, answer string"
    spark.createDataFrame([(1, "a"), (2, " "), (3, "c")], schema).write.parquet(answers)
    judge = lambda df: df.withColumn("score", F.length("answer"))
    incremental.judge_stream(spark, answers, schema, scores, check, ["q"], judge).awaitTermination()
    spark.createDataFrame([(3, "c"), (4, "d")], schema).write.mode("append").parquet(answers)
    incremental.judge_stream(spark, answers, schema, scores, check, ["q"], judge).awaitTermination()
    assert sorted(r.q for r in spark.read.parquet(scores).collect()) == [1, 3, 4]
    # a batch that is run again takes the place of what it left
    spark.createDataFrame([(9, "i")], schema).write.mode("append").parquet(answers)
    spark.createDataFrame([(9, "i", 1)], f"{schema}, score int").write.mode("append").parquet(f"{scores}/batch=2")
    incremental.judge_stream(spark, answers, schema, scores, check, ["q"], judge).awaitTermination()
    assert sorted(r.q for r in spark.read.parquet(scores).collect()) == [1, 3, 4, 9]


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as g union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'a'")
    assert sorted(r.n for r in incremental.windowed_counts(df, "ts", "g").collect()) == [1, 2]


def test_chunk_arrays_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f'a "{i}"\nü', "m") for i in range(7)], "chunk_id string, text string, pdf_name string").repartition(3)
    sinks.write_chunk_arrays(rows, str(tmp_path / "a"))
    for f in (tmp_path / "a").glob("*.txt"):
        assert isinstance(json.loads(f.read_text()), list)
    got = readers.chunk_documents(spark, str(tmp_path / "a" / "*.txt")).select("chunk_id", "text", "pdf_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_rows_without_a_place_are_spread(spark):
    rows = spark.createDataFrame([("f", i if i < 5 else None, f"t{i}") for i in range(45)], "file string, place int, t string")
    parts = sinks.grouped_texts(rows, "file", "place", ["place"], "t", size=10).collect()
    assert sorted(x for p in parts for x in p.texts) == sorted(f"t{i}" for i in range(45))
    assert max(len(p.texts) for p in parts) <= 20 and [p.texts for p in parts if p.part == 0] == [[f"t{i}" for i in range(5)]]


def test_plain_pages(spark):
    word = lambda p, top, x, t: ("m", p, 100.0, top, top + 2, x, t)
    words = spark.createDataFrame([word(1, 50.0, 9.0, "b"), word(1, 50.4, 1.0, "a"), word(1, 60.0, 1.0, "c"), word(1, 2.0, 1.0, "head"), word(2, 50.0, 1.0, " ")], "pdf string, page_num int, page_height double, top double, bottom double, x0 double, text string")
    assert [(r.page_num, r.text) for r in readers.plain_pages(words, ["pdf", "page_num"]).collect()] == [(1, "a b\nc")]


def test_stages_are_released(spark):
    from docloom import session

    session.release(spark)
    df = session.materialise(spark.range(5), "released")
    assert df.count() == 5 and session.release(spark) == 1
    assert session.release(spark) == 0
