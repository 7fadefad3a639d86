import pytest
from papercairn.operators import captions, documents
from pyspark.sql import functions as F


def test_captions_by_number(spark):
    t = spark.createDataFrame([("p", "t1", "Table 1. Mean area of the face"), ("p", "t2", "TABLE I. Something else entirely, and longer too"), ("p", "t3", "No number"), ("p", "t3", "No number")], "paper_id string, table_uid string, caption string")
    f = spark.createDataFrame([("p", "f1", "Fig. 1. A fold")], "paper_id string, figure_uid string, caption string")
    c = captions.floats(t, f)
    assert c.count() == 4
    got = {(r["kind"], r["number"]): (r["caption"][:8], r["claims"]) for r in captions.caption_map(c).collect()}
    assert got == {("table", 1): ("TABLE I.", 2), ("figure", 1): ("Fig. 1. ", 1)}
    assert [tuple(r) for r in captions.ambiguous_numbers(c).collect()] == [("p", "table", 1)]
    p = spark.createDataFrame([("p", "x", "so it was. Table 1. Mean area of the face was"), ("p", "y", "nothing"), ("q", "z", "Table 1. Mean area of the face")], "paper_id string, par_uid string, text string")
    assert [tuple(r) for r in captions.leaked_captions(p, c).collect()] == [("p", "t1", "x")]


def test_text_without_what_stands_in_it(spark):
    df = spark.createDataFrame([("It ended. Table 4. Mean area of the face and hands", "Journal of Skin Notes"), ("we saw the Journal of Skin Notes", "Journal of Skin Notes"), ("the fold Journal of Skin Notes reduced it", "Journal of Skin Notes"), (None, None)], "t string, j string")
    rows = df.select(captions.without_caption(F.col("t")).alias("c"), captions.without_journal(F.col("t"), F.col("j")).alias("j")).collect()
    assert (rows[0]["c"]["text"], rows[0]["c"]["caption"]) == ("It ended.", "Table 4. Mean area of the face and hands")
    assert [r["j"] for r in rows] == ["It ended. Table 4. Mean area of the face and hands", "we saw the Journal of Skin Notes", "the fold reduced it", None]
    long = "x" * 130 + ". Keywords: a, b"
    assert df.limit(1).select(captions.abstract_tail(F.lit(long))).first()[0] == "x" * 130 + "."


def test_abstracts(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), ("a b", "a b c d e f"), ("a", None), (None, "b"), (None, None)], "x string, y string")
    v = [tuple(r["v"]) for r in df.select(captions.abstract_verdict(F.col("x"), F.col("y")).alias("v")).collect()]
    assert v == [(1.0, 1.0, True), (1.0, 1 / 3, False), (None, None, None), (None, None, None), (None, None, None)]
    assert [r["v"]["source"] for r in df.select(captions.chosen_abstract(F.col("x"), F.col("y")).alias("v")).collect()] == ["extracted", "api", "extracted_unver", "api", "none"]


def test_terms_and_lines(spark):
    df = spark.createDataFrame([("Segmental vitiligo of the face",)], "t string")
    assert df.select(captions.terms_in(F.col("t"), ["vitiligo", "segmental vitiligo", "face", "hand"])).first()[0] == ["segmental vitiligo", "face"]
    meta = "authors array<string>, title string, journal string, year int, doi string"
    m = spark.createDataFrame([((list("ABCDEFG"), "T", "J", 2001, "10.1/x"),), ((None, " ", None, None, None),)], f"meta struct<{meta.replace(' ', ':').replace(',:', ',')}>")
    assert [r[0] for r in m.select(captions.reference_line(F.col("meta"))).collect()] == ["A, B, C, D, E, F, et al. T. J. 2001. doi:10.1/x", ""]
    assert m.select(captions.human_name(F.col("meta"))).first()[0] == "2001 J T"


def test_numbers_and_paths(spark):
    p = spark.createDataFrame([("p", "1", ["b0", "b1"], ["1", "2"]), ("p", "2", ["b0", "b2"], ["1", "2"]), ("p", "3", ["b0"], ["7"]), ("p", "4", None, None)], "paper_id string, par_uid string, cited_keys array<string>, cited_refs array<string>")
    assert {(r["key"], r["number"]) for r in captions.marker_numbers(p).collect()} == {("b0", 1)}
    h = spark.createDataFrame([("d", 1, "1", "Intro"), ("d", 2, "2.", "Methods"), ("d", 3, "2.1", "Study"), ("d", 4, None, "Loose"), ("d", 5, "2.1.1", "Deep"), ("d", 6, "3", "End")], "doc_id string, ord int, number string, title string")
    got = [r["path"] for r in captions.numbered_paths(h).orderBy("ord").collect()]
    assert got == [["Intro"], ["Methods"], ["Methods", "Study"], ["Methods", "Loose"], ["Methods", "Loose", "Deep"], ["End"]]
    m = spark.createDataFrame([("k", 2, "late", 9), ("k", 1, None, 8)], "doi string, source int, title string, n int")
    assert [tuple(r) for r in captions.merged_metadata(m, "doi", "source").collect()] == [("k", "late", 8)]


def test_tables_that_go_on(spark):
    md = "| a |\n| --- |\n| 1 |\n| 2 |"
    t = spark.createDataFrame([("p", "t1", "Table 2. X", md), ("p", "t2", "Table 2 (continued)", md), ("p", "t3", "Table 3", None)], "paper_id string, table_uid string, caption string, markdown string")
    assert [tuple(r) for r in captions.continued_tables(t).collect()] == [("p", 2, ["t1", "t2"], 4)]
    parts = documents.split_table("Table 1. X", "| h |\n| --- |\n" + "\n".join(f"| row {i} |" for i in range(200)), 100)
    assert all(p.startswith("Table 1. X\n\n| h |\n| --- |\n") and len(p) // 4 <= 100 for p in parts)
    assert sum(p.count("| row ") for p in parts) == 200
    assert documents.split_table("", "", 100) == [] and documents.split_table("C", "", 100) == ["C\n"]
    assert all(len(p) // 4 <= 50 for p in documents.split_table("C" * 300, "| " + "x" * 900 + " |", 50))


def test_reranking_and_filters(spark):
    hits = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.9), ("q", 3, 1.0)], "qid string, rank int, s double")
    assert [r["s"] for r in captions.reranked(hits, F.col("s"), 2).orderBy("rank").collect()] == [0.9, 0.1, 1.0]
    assert captions.filters_from({"section": "methods, Results", "year": "2018-", "journal": "Skin", "kind": None}) == {"section_types": ["methods", "Results"], "years": (2018, None), "journal": "Skin"}
    assert captions.filters_from({"year": "2020"}) == {"years": (2020, 2020)} and captions.filters_from({"year": "-2015"}) == {"years": (None, 2015)}
    for bad in ({"section": "odd"}, {"year": "2018 2025"}, {"year": "x"}, {"other": 1}):
        with pytest.raises(ValueError):
            captions.filters_from(bad)


def test_profile(spark):
    df = spark.createDataFrame([("k", "Â± x"), ("k", "P ¼ .05 and 4Á5"), ("k", "a�"), ("k", None), ("m", "clean – text")], "key string, text string")
    got = {r["key"]: r for r in captions.encoding_profile(df, "key").collect()}
    assert got["k"]["utf8_as_latin"] == 1 and got["k"]["quarter"] == 1 and got["k"]["middle_dot"] == 1 and got["k"]["replaced"] == 1
    assert sum(got["m"][c] for c in captions.SIGNATURES) == 0
