import json

from papercairn.functions.text import terms
from papercairn.operators import retrieval
from papercairn.sources import files, sinks
from papercairn.streaming import ingest
from pyspark.sql import functions as F


def test_ledgers(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('﻿{"k": "a", "v": 1}\n\n{"k": "b", "v": 2}\n{"k": "a", "v": 3}\n{"k": "c", ')
    good, bad = files.tolerant_lines(spark, str(p), "k string, v int")
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("a", 3), ("b", 2)] and [r["line"] for r in bad.collect()] == ['{"k": "c", ']
    assert files.count_lines(spark, str(p)) == 4
    assert {tuple(r) for r in files.last_entries(good, "k", "v").collect()} == {("a", 3), ("b", 2)}
    failed = spark.createDataFrame([("x" * 900, "ValueError", "m" * 3000)], "item string, error_type string, message string")
    for _ in range(2):
        sinks.record_failures(failed, str(tmp_path / "f"), "parse")
    got = sinks.failures(spark, str(tmp_path / "f")).collect()
    assert len(got) == 2 and len(got[0]["item"]) == 500 and len(got[0]["message"]) == 2000


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.pdf").write_bytes(b"abc")
    (tmp_path / "c.txt").write_bytes(b"abc")
    got = files.manifest(spark, str(tmp_path)).collect()
    assert {r["filename"] for r in got} == {"a.pdf", "b.pdf"} and {r["sha1"] for r in got} == {"a9993e364706816aba3e25717850c26c9cd0d89d"}


def test_documents_round_trip(spark, tmp_path):
    doc = {"paper_id": "p", "source": "grobid", "body_text": [{"path": ["R"], "section_type": "results", "paragraphs": [{"id": "p1", "text": "one"}, {"id": "p2", "text": "two"}]}, {"path": ["E"], "section_type": "other", "paragraphs": []}], "figures": [{"id": "f1", "caption": "c"}], "tables": [], "references": [{"key": "b0", "number": 1, "title": "t"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"paper_id": "q", "source": "x"}))
    rel = files.relations(files.documents(spark, str(tmp_path)))
    assert rel["papers"].count() == 2
    assert [(r["sec_ord"], r["par_ord"], r["text"]) for r in rel["paragraphs"].orderBy("par_ord").collect()] == [(0, 0, "one"), (0, 1, "two")]
    back = {r["paper_id"]: r for r in files.nested(rel).collect()}
    assert [p["text"] for p in back["p"]["body_text"][0]["paragraphs"]] == ["one", "two"] and back["p"]["references"][0]["title"] == "t" and back["q"]["body_text"] is None


JATS = """<article><front><abstract abstract-type="teaser"><p>Short.</p></abstract><abstract><sec><title>Aim</title><p>To see.</p></sec><sec><title>Result</title><p>Seen.</p></sec></abstract></front>
<body><sec><title>Methods</title><p>We did <xref ref-type="bibr" rid="r2">2</xref>, see <xref ref-type="table" rid="t1">Table 1</xref>.<fig id="f1"><label>Fig 1</label><caption><p>A fold.</p></caption></fig></p><sec><title>Design</title><p>More.</p></sec></sec>
<table-wrap id="t1"><label>Table 1</label><caption><p>Areas</p></caption><table><tr><th colspan="2">A</th><th>B</th></tr><tr><td rowspan="2">x</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4|5</td></tr></table></table-wrap></body>
<back><ref-list><ref id="r1"><label>1</label><mixed-citation>First</mixed-citation></ref><ref id="r2"><label>2</label><mixed-citation>Second</mixed-citation></ref></ref-list></back><sub-article><body><p>Reply.</p></body></sub-article></article>"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div><head n="1">Results</head><p>As in <ref type="bibr" target="#b1">[2]</ref>.</p></div><figure type="table" xml:id="tab_0"><head>Table 1</head><figDesc>Areas</figDesc><table><row><cell>a</cell><cell>b</cell></row><row><cell>1</cell></row></table></figure></body>
<back><div><listBibl><biblStruct xml:id="b0"><title>First</title></biblStruct><biblStruct xml:id="b1"><title>Second</title></biblStruct></listBibl></div></back></text></TEI>"""


def test_xml(spark):
    df = spark.createDataFrame([("j", JATS, 1), ("t", TEI, 1), ("bad", "<a>", 1), ("null", None, 1)], "paper_id string, xml string, kind int")
    got = files.from_xml(df).collect()
    of = lambda p, k: [r for r in got if r["paper_id"] == p and r["kind"] == k]
    assert of("j", "abstract")[0]["text"] == "Aim: To see. Result: Seen."
    first, second = of("j", "paragraph")
    assert first["text"] == "We did [2], see Table 1." and first["path"] == ["Methods"] and first["refs_table"] == ["t1"] and first["cited_keys"] == ["r2"]
    assert second["path"] == ["Methods", "Design"]
    assert of("j", "table")[0]["markdown"] == "| A | A | B |\n| --- | --- | --- |\n| x | 1 | 2 |\n| x | 3 | 4\\|5 |" and of("j", "table")[0]["text"] == "Table 1. Areas"
    assert of("j", "figure")[0]["id"] == "f1" and [r["id"] for r in of("j", "reference")] == ["r1", "r2"]
    assert of("t", "paragraph")[0]["text"] == "As in [2]." and of("t", "table")[0]["markdown"] == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert of("bad", "error") and not of("null", "error")
    assert files.from_xml(df.filter("false")).count() == 0


def test_store(spark, tmp_path):
    at = str(tmp_path / "s")
    docs = spark.createDataFrame([("ab1", "p", "t"), ("cd2", "q", "u")], "sha1 string, paper_id string, title string")
    sinks.store_documents(docs, at)
    sinks.store_documents(docs.filter("sha1 = 'ab1'").withColumn("title", F.lit("new")), at)
    assert {(r["sha1"], r["title"]) for r in sinks.stored(spark, at).collect()} == {("ab1", "new"), ("cd2", "u")}
    assert sinks.stored(spark, at, "cd2").first()["paper_id"] == "q"


def test_indexes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "light on the knee"), ("b", "light"), ("c", "")], "id string, text string")
    q = spark.createDataFrame([("q", "light knee")], "qid string, query string")
    sinks.save_index(retrieval.postings(docs, "id", F.col("text")), retrieval.lengths(docs, "id", F.col("text")), str(tmp_path / "i"))
    got = sinks.index_search(sinks.load_index(spark, str(tmp_path / "i")), "id", q, 5).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in retrieval.bm25(docs, "id", F.col("text"), q, 5).collect()]
    v = spark.createDataFrame([("a", [1.0])], "chunk_id string, vector array<float>")
    sinks.save_vectors(v, str(tmp_path / "v"), "hash", 1)
    assert sinks.load_vectors(spark, str(tmp_path / "v"), "hash", 1)[1] == []
    assert sinks.load_vectors(spark, str(tmp_path / "v"), "other", 2)[1] == ["encoder", "dim"]
    assert docs.select(terms(F.col("text"))).count() == 3


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), ("bad", -1)], "k string, v int").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    df.write.parquet(src)
    work = lambda b: b.withColumn("error", F.when(F.col("v") < 0, "negative"))

    def run():
        stream = ingest.once_each(ingest.arrivals(spark, src, df.schema), "k", "at")
        q = ingest.into(stream, str(tmp_path / "out"), str(tmp_path / "state"), work, str(tmp_path / "failed"))
        q.awaitTermination()
        return q

    q = run()
    assert sum(p["rows"] for p in ingest.progress(q)) == 4
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == ["bad"]
    df.filter("k = 'a'").unionByName(spark.createDataFrame([("c", 5)], "k string, v int").withColumn("at", F.to_timestamp(F.lit("2024-01-03")))).write.mode("append").parquet(src)
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_scope_removes_its_tables(spark, tmp_path):
    import os

    from papercairn import tables

    with tables.scope(spark):
        df = tables.kept(spark.range(5).toDF("a"))
        path = tables._SCOPES[-1][0]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
