import pytest
from papercairn.functions import python as P
from papercairn.functions import text as X
from papercairn.operators import matching
from pyspark.sql import functions as F


def value(spark, c, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(c(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_text(spark):
    assert value(spark, X.doi_candidates, "see 10.1000/abc and 10.1000/ab\nc.def.ghi more")[:3] == ["10.1000/abc", "10.1000/ab", "10.1000/abc.def.ghi"]
    assert value(spark, X.doi_candidates, "none") == []
    assert P.token_set_ratio("light for the knee", "the knee for light") == 100.0 and P.token_set_ratio("", "x") == 0.0
    assert P.token_set_ratio("light for the knee", "light for the knee of men") == 100.0
    assert P.token_set_ratio("fuzzy was a bear", "wuzzy fuzzy") == pytest.approx(62.5, abs=0.1)
    assert P.ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert P.partial_ratio("this is a test", "well, this is a test!") == 100.0 and 0 < P.partial_ratio("abcd", "xxbcxx") < 100
    assert P.file_title("inbox/2021-03-A12 Light for the knees of men.pdf") == "Light for the knees of men" and P.file_title("Reply.pdf") == ""
    assert value(spark, X.dropcap, "V itiligo is") == "Vitiligo is" and value(spark, X.dropcap, "T he case") == "T he case" and value(spark, X.dropcap, "A number of") == "A number of"
    assert value(spark, X.joined_fragments, "Recommenda-", "tion") == "Recommendation"
    assert value(spark, X.joined_fragments, "HA-", "Based") == "HA-Based" and value(spark, X.joined_fragments, "", "x") == "x"
    assert value(spark, X.is_plausible_title, "A study of light on the knee") is True and value(spark, X.is_plausible_title, "Downloaded from the journal site today") is False
    assert value(spark, lambda c, i: X.asset_label(c, i, "Table"), "Table 2. x", "t1") == "Table 2"
    assert value(spark, lambda c, i: X.asset_label(c, i, "Table"), "x", None) == "Table"
    assert value(spark, X.clean_reply, "<think>a\nb</think>\nHere is the text:\nBody [1]") == "Body [1]"


def test_files(spark):
    p = spark.createDataFrame([("a", "x/One.pdf"), ("b", "two.PDF"), ("c", "none.pdf"), ("d", None)], "paper_id string, source_file string")
    f = spark.createDataFrame([("in/One.pdf",), ("in/b/One.pdf",), ("in/Two.pdf",)], "file string")
    assert {tuple(r) for r in matching.found_files(p, f).collect()} == {("a", "in/One.pdf", "name"), ("b", "in/Two.pdf", "stem")}
    keys = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "doi string")
    assert [r["doi"] for r in matching.to_look_up(keys, spark.createDataFrame([("1", None)], "doi string, pmid string"), "doi").collect()] == ["2"]
    r = spark.createDataFrame([("a", "7", ["5", "7", "6"]), ("b", None, None)], "paper_id string, pmid string, references array<string>")
    assert [tuple(x) for x in matching.listed_items(r).collect()] == [("a", 0, "5"), ("a", 2, "6")]


def test_captions_and_pages(spark):
    items = spark.createDataFrame([("p", "t1", 1, "x"), ("p", "t2", None, "Mean area of the face and the hands"), ("p", "t3", 2, "Other words")], "paper_id string, uid string, number int, caption string")
    printed = spark.createDataFrame([("p", 1, 1, "Table 1. Anything"), ("p", 2, 2, "Table 2. Mean area of the face and the hands"), ("p", 3, 2, "Table 2. Twice")], "paper_id string, pos int, number int, caption string")
    assert {tuple(r) for r in matching.aligned(items, printed).collect()} == {("p", "t1", 1, "number"), ("p", "t2", 2, "text")}
    cells = spark.createDataFrame([("p", "t", i, v) for i, v in enumerate(["3.5", "4.5", "7", "", "9"])], "paper_id string, uid string, ord int, value string")
    pages = spark.createDataFrame([("p", 1, "3.5 and 4.5"), ("p", 2, "3.5 4.5 7 9"), ("p", 3, "9 7 4.5 3.5")], "paper_id string, page int, text string")
    assert [tuple(r) for r in matching.table_pages(cells, pages).collect()] == [("p", "t", 2, 4)]


def test_identity_and_topics(spark):
    p = spark.createDataFrame([("a", ("Light for the knees of men",), "s", "x/Cream on faces, hands, feet.pdf"), ("b", (None,), "s", None), ("c", ("<i>Light</i> for the knees of men",), "s", "Light for the knees of men.pdf")], "paper_id string, meta struct<title:string>, source string, source_file string")
    assert {(r["paper_id"], r["ok"]) for r in matching.identities(p).collect()} == {("a", False), ("b", None), ("c", True)}
    p = p.filter("paper_id < 'c'")
    c = spark.createDataFrame([("a", "t", "mean area of face"), ("a", "u", "no")], "paper_id string, uid string, caption string")
    x = spark.createDataFrame([("a", "q", "The area was mean")], "paper_id string, par_uid string, text string")
    assert [tuple(r) for r in matching.topical_coverage(c, x).collect()] == [("a", "t", 2 / 3)]
    none = spark.createDataFrame([], "paper_id string, table_uid string, figure_uid string")
    assert [tuple(r) for r in matching.unit_counts(p, x, none, none).collect()] == [("s", 2, 1, 0, 0)]
