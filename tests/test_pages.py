import pytest
from papercairn import __main__ as cli
from papercairn.functions import python as P
from papercairn.functions import signs as S
from papercairn.operators import pages, references, retrieval
from pyspark.sql import functions as F

LINES = "doc string, page int, col int, block int, ord int, text string, x0 double, y0 double, x1 double, y1 double"


def test_pages_of_nothing(spark):
    e = spark.createDataFrame([], LINES)
    assert pages.alone(e).count() == pages.paragraph_starts(e, 10.0).count() == pages.reference_zone(e).count() == pages.front_matter(e).count() == 0
    i = spark.createDataFrame([], "doc string, page int, image int, x0 double, y0 double, x1 double, y1 double, uid string")
    assert pages.ornaments(i).count() == pages.next_stop(i, i).count() == pages.barriers(i, i).count() == 0


def test_reference_zone(spark):
    text = ["body text"] * 40 + ["References"] + [f"{i}. Roe AB, et al. Title. J 2019;3:4" for i in range(1, 21)] + ["and the fold goes on"] * 40
    df = spark.createDataFrame([("d", i, t, 1) for i, t in enumerate(text)] + [("short", 0, "References", 1), (None, 0, None, 1)], "doc string, ord int, text string, n12 int")
    got = [tuple(r) for r in pages.reference_zone(df.select("doc", "ord", "text")).collect()]
    assert got == [("d", 40, 59)]


def test_signs(spark):
    df = spark.createDataFrame([("Pp. 1\nAbstract\nThe fold was seen in many and it was long enough to be taken for an abstract of a paper.\nKeywords: skin",), ("Nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(S.printed_abstract(F.col("t"))).collect()]
    assert got[0].startswith("The fold") and "Keywords" not in got[0] and got[1] == ""
    one = df.limit(1).select(*[f(F.lit(None).cast("string")) for f in (S.is_byline, S.is_capitals, S.looks_author, S.is_author_list, S.looks_prose, S.reference_sign, S.foreign_scope)]).first()
    assert not any(one)


def test_references_of_two_papers(spark):
    rows = [("p", i, i >= 4, 8, 7) for i in range(12)] + [("q", i, True, 12, 12) for i in range(12)] + [(None, 0, None, None, None)]
    got = {(r["paper_id"], r["pos"]): (r["number"], r["foreign"]) for r in references.foreign_block(spark.createDataFrame(rows, "paper_id string, pos int, paired boolean, listed int, highest int")).collect()}
    assert got["p", 3] == (None, True) and got["p", 4] == (1, False) and got["p", 11] == (8, False)
    assert got["q", 0] == (1, False) and got[None, 0][1] is False
    bad = spark.createDataFrame([("a", "Light for the knees of adults", "Smith. Light for the knees of adults. J", "10.1/x"), ("b", "Light for the knees of adults", "Jones Q. Wholly unlike things printed here. Z", "10.1/y"), ("c", None, None, None)], "k string, title string, raw string, doi string")
    assert {r["k"]: (r["corrupt"], r["doi"]) for r in references.distrusted(bad).collect()} == {"a": (False, "10.1/x"), "b": (True, None), "c": (False, None)}


def test_search_says_why(spark):
    c = spark.createDataFrame([("a", "fold knee", "text"), ("b", "fold fold face", "text"), ("c", "ﬁbre", "table")], "id string, t string, kind string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "id string, vector array<float>")
    q = spark.createDataFrame([("q", "fold", [1.0, 0.0]), ("n", " ", [1.0, 0.0]), ("l", "fibre", None)], "qid string, query string, vector array<float>")
    text = P.norm_text(F.col("t"))
    got = {(r["qid"], r["id"]): r for r in retrieval.search(c, "id", text, q, 2, vectors=v).collect()}
    assert {k[0] for k in got} == {"q", "l"} and got["l", "c"]["bm25_rank"] == 1 and got["q", "a"]["dense_rank"] == 1
    some = retrieval.search(c, "id", text, q, 5, F.col("kind") == "table", v).collect()
    assert {(r["qid"], r["id"]) for r in some} == {("q", "c"), ("l", "c")}
    order = retrieval.search(c, "id", text, q.filter("qid = 'q'"), 3, vectors=v, scorer=lambda a, b: -F.char_length(b), rerank_k=2).orderBy("rank").collect()
    assert [r["rerank"] is not None for r in order] == [True, True, False] and order[0]["rerank"] >= order[1]["rerank"]
    assert retrieval.search(c, "id", text, q, 0).count() == 0


def test_edits_and_command_line():
    assert P.edited("a\nbcd", "a\nbxd\nnew") == 4 and P.edited(None, "") == 0 and P.edited("abc", None) == 3
    assert cli.main(["no_such_query", "/"]) == 2
    with pytest.raises(SystemExit):
        cli.main([])
