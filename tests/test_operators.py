import datetime
import math

from papercairn.operators import corpus, documents, joins, layout, retrieval, tables
from pyspark.sql import functions as F


def test_bm25_against_formula(spark):
    docs = {"a": "light light knee", "b": "light face", "c": "", "d": None, "e": "face face face hand"}
    df = spark.createDataFrame(list(docs.items()), "id string, text string")
    q = spark.createDataFrame([("q1", "light light face"), ("q2", "of the"), ("q3", "absent")], "qid string, query string")
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval.bm25(df, "id", F.col("text"), q, 5).collect()}
    tokens = {k: (v or "").split() for k, v in docs.items()}
    avg = sum(map(len, tokens.values())) / 5
    want = {}
    for k, t in tokens.items():
        s = 0.0
        for w in ("light", "face"):
            n = sum(w in x for x in tokens.values())
            tf = t.count(w)
            s += tf and math.log(1 + (5 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want["q1", k] = round(s, 6)
    assert got == want


def test_ties_k_and_filters(spark):
    meta = "meta struct<year:int,journal:string,pub_types:array<string>>"
    rows = [(f"c{i}", "p", "methods" if i % 2 else "results", "text", "light knee", (2000 + i, "Skin", ["Review"])) for i in range(9)] + [("n", "p", "methods", "text", "light knee", (None, None, None))]
    df = spark.createDataFrame(rows, f"id string, paper_id string, section_type string, kind string, text string, {meta}")
    q = spark.createDataFrame([("q", "light")], "qid string, query string")
    run = lambda k, where=None: [r["id"] for r in retrieval.search(df, "id", F.col("text"), q, k, where).orderBy("rank").collect()]
    assert run(3) == ["c0", "c1", "c2"]
    assert run(None) == [f"c{i}" for i in range(8)]
    assert run(0) == run(-3) == []
    assert run(2, retrieval.passes(years=(2007, None))) == ["c7", "c8"]
    assert run(9, retrieval.passes(section_types=["METHODS"], journal="sk", pub_types=["review"], years=(None, 2003))) == ["c1", "c3"]
    assert run(9, retrieval.passes(kinds=["figure"])) == []


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "qid string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "qid string, id string, rank int")
    got = [r["id"] for r in retrieval.fuse(a, b, "id").orderBy("rank").collect()]
    assert got == ["y", "x", "z"]


def test_dense(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 2.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("a", [1.0, 0.0])], "id string, v array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "qid string, vector array<float>")
    got = [(r["qid"], r["id"], r["score"]) for r in retrieval.dense(v, "id", "v", q, 5).orderBy("rank").collect()]
    assert got == [("q", "a", 1.0), ("q", "b", 0.707107)]
    assert retrieval.dense(v, "id", "v", q.filter("false"), 5).count() == 0


def test_evaluation(spark):
    hits = spark.createDataFrame([("q", "p1", 1), ("q", "p1", 2), ("q", "p2", 3)], "qid string, paper_id string, rank int")
    golden = spark.createDataFrame([("q", ["p2"]), ("none", []), ("miss", ["p9"])], "qid string, anchors array<string>")
    got = {r["qid"]: (r["n_hits"], r["rank"], r["hit"], r["reciprocal"]) for r in retrieval.evaluate(hits, golden, 8).collect()}
    assert got == {"q": (3, 2, True, 0.5), "none": (0, None, None, None), "miss": (0, None, False, 0.0)}


def test_manifest(spark):
    m = spark.createDataFrame([("b", "10.1/x", "s1"), ("a", "10.1/X ", "s2"), ("c", None, "s3"), ("d", "", "s3"), ("e", None, None), ("e", None, None)], "file string, doi string, sha1 string")
    got = {r["file"]: (r["dup_group"], r["is_primary"]) for r in corpus.duplicate_groups(m).collect()}
    assert got == {"a": ("doi:10.1/x", True), "b": ("doi:10.1/x", False), "c": ("sha1:s3", True), "d": ("sha1:s3", False), "e": ("path:e", True)}


def test_resume_and_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, h string")
    new = spark.createDataFrame([("b", "3"), ("c", None)], "k string, h string")
    assert {tuple(r) for r in corpus.resume(old, new, "k").collect()} == {("a", "1"), ("b", "3"), ("c", None)}
    assert {r["k"] for r in corpus.changed(old, new, "k", "h").collect()} == {"b", "c"}


def test_nearest_rank(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 3, 9, None]], "v int")
    assert [r["value"] for r in corpus.nearest_rank(df, "v", [0.0, 0.5, 1.0]).orderBy("share").collect()] == [1, 2, 9]
    assert corpus.nearest_rank(df.filter("false"), "v", [0.5]).count() == 0


def test_latest(spark):
    t = datetime.datetime(2020, 1, 1)
    df = spark.createDataFrame([("a", 1, t), ("a", 2, t + datetime.timedelta(1)), ("b", 3, None)], "k string, v int, at timestamp")
    assert {(r["k"], r["v"]) for r in corpus.latest(df, "k", "at", "v").collect()} == {("a", 2), ("b", 3)}


PARS = "paper_id string, par_uid string, sec_ord int, par_ord int, id string, path array<string>, section_type string, text string, cited_refs array<string>, refs_table array<string>"


def pars(spark, rows):
    return spark.createDataFrame([(p, u, s, k, f"p{k}", path, "x", t, refs, tabs) for p, u, s, k, path, t, refs, tabs in rows], PARS)


def test_sections_carry_forward(spark):
    df = pars(spark, [("a", "1", 0, 0, ["Introduction"], "t", [], []), ("a", "2", 1, 0, ["Methods"], "t", [], []), ("a", "3", 2, 0, ["Odd"], "t", [], []), ("a", "4", 3, 0, ["Funding"], "t", [], []), ("a", "5", 4, 0, [None, " "], "t", [], []), ("b", "6", 0, 0, ["Odd"], "t", [], [])])
    got = {(r["paper_id"], r["sec_ord"]): r["section_type"] for r in documents.carried_sections(df).collect()}
    assert got == {("a", 0): "intro", ("a", 1): "methods", ("a", 2): "methods", ("a", 3): "back", ("a", 4): "methods", ("b", 0): "other"}


def test_repeats_citations_and_homes(spark):
    df = pars(spark, [("a", "1", 0, 0, [], "See [1-3] and [5].", ["ref 1", "ref9"], ["t1"]), ("a", "2", 1, 0, [], " see [1-3]  and [5].", None, ["t1"]), ("a", "2", 1, 0, [], " see [1-3]  and [5].", None, ["t1"]), ("a", "3", 2, 0, None, None, None, None)])
    assert [tuple(r) for r in documents.repeated_paragraphs(df).collect()] == [("a", "2", "1")]
    assert {r["number"] for r in documents.citations(df).collect()} == {1, 2, 3, 5}
    gap = documents.citation_gaps(df).first()
    assert (gap["cited"], gap["highest"], gap["missing"]) == (4, 5, 1)
    linked = {r["par_uid"]: (r["linked"], r["unknown"]) for r in documents.relinked(df).collect()}
    assert linked == {"1": (1, 3), "2": (0, 4)}
    floats = spark.createDataFrame([("a", "u1", "t1"), ("a", "u2", "t2")], "paper_id string, table_uid string, id string")
    assert {r["table_uid"]: r["par_uid"] for r in documents.float_homes(df, floats, "table_uid", "refs_table").collect()} == {"u1": "1", "u2": None}


def test_packing():
    size = lambda g: (sum(len(t) for _, t in g) + 2 * (len(g) - 1)) // 4
    groups = documents.pack([(str(i), "x" * n) for i, n in enumerate([400, 400, 1600, 2000, 100, 2700, 40])], 550, 700, 80)
    assert [p for g in groups for p, _ in g] == list("0123456")
    assert all(size(g) <= 700 for g in groups)
    assert all(size(g) >= 80 for g in groups)
    assert documents.pack([], 550, 700, 80) == []
    parts = documents.split_long("One two. " * 400 + "y" * 9000, 100, 120)
    assert all(len(p) <= 480 for p in parts) and "One two." in parts[0]


def test_chunks(spark):
    long = "A sentence of some words. " * 300
    df = pars(spark, [("a", "1", 0, 0, ["R"], long, [], []), ("a", "2", 0, 1, ["R"], "tail", [], []), ("a", "3", 1, 0, ["D"], "next", [], []), ("n", "4", 0, 0, None, " ", [], [])])
    papers = spark.createDataFrame([("a", ("Title",))], "paper_id string, meta struct<title:string>")
    got = documents.chunk_papers(df, papers).orderBy("seq").collect()
    assert max(r["n_tokens"] for r in got) <= 700
    assert [r["seq"] for r in got] == list(range(1, len(got) + 1))
    assert got[0]["header"] == "[Title] > R" and got[-1]["header"] == "[Title] > D" and list(got[-1]["para_ids"]) == ["p0"]


def test_view_and_overlay(spark):
    df = pars(spark, [("a", "1", 0, 0, ["R", "S"], "t1", [], []), ("a", "2", 0, 1, ["R", "S"], "t2", [], []), ("a", "3", 1, 0, ["R", "U"], "t3 [1]", [], [])])
    got = [r["markdown"] for r in documents.markdown_view(df).orderBy("sec_ord", "par_ord").collect()]
    assert got == ["## R\n\n### S\n\nt1", "t2", "### U\n\nt3 [1]"]
    papers = spark.createDataFrame([("a", "abs", ("T",))], "paper_id string, abstract string, meta struct<title:string>")
    units = documents.units(df, papers)
    cache = spark.createDataFrame([("a", "p:3", "anders [1]"), ("a", "p:1", "falsch [2]"), ("a", "abstract", "kurz")], "paper_id string, key string, text string")
    got = {r["key"]: (r["text"], r["translated"]) for r in documents.overlaid(units, cache).collect()}
    assert got["p:3"] == ("anders [1]", True) and got["p:1"] == ("t1", False) and got["abstract"] == ("kurz", True) and got["h:r"] == ("R", False)


def test_tables(spark):
    t = spark.createDataFrame(
        [("ok", "Table 1", "| a | b |\n| --- | --- |\n| 1 | x\\y |\n| 2 | |"), ("ragged", "", "| a | b |\n| --- | --- |\n| 1 |"), ("bare", "Sidebar", "| a |"), ("none", "", None), ("refs", "Box", "| Smith et al | 2001 |\n| --- | --- |\n| Doe et al | 2 |")],
        "table_uid string, caption string, markdown string",
    )
    got = {r["table_uid"]: (r["n_rows"], r["n_cols"], r["data_rows"], list(r["problems"])) for r in tables.check(t).collect()}
    assert got["ok"] == (3, 2, 2, []) and got["none"] == (0, 0, 0, ["empty"]) and got["ragged"][3] == ["ragged_columns"]
    assert got["bare"][3] == ["no_separator", "no_data_rows", "single_column"]
    back = {r["table_uid"]: r["markdown"] for r in tables.to_markdown(tables.grid(t)).collect()}
    assert back["ok"] == "| a | b |\n| --- | --- |\n| 1 | x\\y |\n| 2 |  |"
    assert {(r["table_uid"], r["reason"]) for r in tables.not_tables(t).collect()} == {("bare", "columns"), ("none", "columns"), ("refs", "references")}
    assert {r["table_uid"] for r in tables.empty_tables(t).collect()} == {"bare", "none"}
    df = spark.createDataFrame([("1 2 2", "2 1 2 3"), ("1 2 2", "2 1"), (None, "1")], "a string, b string")
    assert [r[0] for r in df.select(tables.loses_numbers(F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_as_of(spark):
    a = spark.createDataFrame([("k", 5, "x"), ("k", 1, "y"), ("m", 9, "z")], "k string, t int, v string")
    b = spark.createDataFrame([("k", 2, "b2"), ("k", 5, "b5"), ("k", 5, "a5"), ("k", 7, "b7")], "k string, at int, w string")
    assert {(r["v"], r["w"]) for r in joins.as_of(a, b, "k", "t", "at", ["w"]).collect()} == {("x", "b5"), ("y", None), ("z", None)}


def test_located_and_owned(spark):
    body = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega. " * 1
    n = spark.createDataFrame([("k", "n1", body[6:200]), ("k", "n2", "nothing of it at all, really nothing of it at all, no words of it at all")], "k string, needle string, text string")
    h = spark.createDataFrame([("k", body + " and more")], "k string, text string")
    got = joins.located(n, h, "k").collect()
    assert [(r["needle"], r["place"], r["length"]) for r in got] == [("n1", 5, 70)]
    s = spark.createDataFrame([("k", 1, True, "own words " + "abc def ghi " * 20), ("k", 2, False, body * 2)], "k string, segment int, own boolean, text string")
    got = {r["needle"]: r["owner"] for r in joins.owners(spark.createDataFrame([("k", "a", "abc def ghi " * 20), ("k", "b", body), ("k", "c", "short")], "k string, needle string, text string"), s, "k").collect()}
    assert got == {"a": "own", "b": "other", "c": "unknown"}


def test_references(spark):
    printed = spark.createDataFrame(
        [("p", 1, "Grafting of the knee in adults", 2001, None, "x"), ("p", 2, "Light for the face", 2010, "10.1/A", "y"), ("p", 3, None, 2005, None, "Böhm, 2005, Skin Notes 3"), ("p", 4, "Unmatched title here", 1990, None, "z")],
        "paper_id string, pos int, title string, year int, doi string, raw string",
    )
    items = spark.createDataFrame(
        [("p", 1, "Light for the face", 2010, "10.1/a", "Doe", "J"), ("p", 2, "Grafting of the knees in adults", 2002, "10.1/b", "Roe", "J"), ("p", 3, "Another one altogether", 2005, None, "Böhm", "Skin Notes"), ("p", 4, "Only listed", 2000, "10.1/c", "X", "Y")],
        "paper_id string, pos int, title string, year int, doi string, author string, journal string",
    )
    assert {(r["pos"], r["item"]) for r in joins.paired(printed, items).collect()} == {(1, 2), (2, 1), (3, 3)}
    merged = joins.merged_references(printed, items).collect()
    assert sorted(r["source"] for r in merged) == ["listed", "parsed", "parsed+listed", "parsed+listed", "parsed+listed"]
    keys = spark.createDataFrame([("p", 1, None), ("p", 2, 2), ("p", 3, None), ("p", 4, 4), ("p", 5, None), ("p", 6, 9), ("p", 7, None)], "paper_id string, pos int, number int")
    assert [r["number"] for r in joins.filled_numbers(keys).orderBy("pos").collect()] == [1, 2, 3, 4, None, 9, 10]


def test_layout(spark):
    rows = []
    for page in (0, 1):
        rows.append(("d", page, 0, f"Journal {page}", 50.0, 20.0, 200.0, 30.0, 7.0))
        rows.append(("d", page, 1, "wide title line across", 50.0, 100.0, 550.0, 110.0, 12.0))
        for i in range(10):
            rows.append(("d", page, 2 + i, f"left {page} {i} " + "x" * 50, 50.0, 120.0 + 12 * i, 290.0, 130.0 + 12 * i, 9.0))
            rows.append(("d", page, 20 + i, f"right {page} {i} " + "x" * 50, 310.0, 120.0 + 12 * i, 550.0, 130.0 + 12 * i, 9.0))
    lines = spark.createDataFrame([(*r, 600.0, 800.0) for r in rows], "doc_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, size double, page_w double, page_h double")
    order = [r["text"].split(" x")[0] for r in layout.reading_order(lines).orderBy("place").collect()]
    assert order[:3] == ["Journal 0", "wide title line across", "left 0 0"] and order[11:13] == ["left 0 9", "right 0 0"]
    assert layout.body_size(lines).first()["size"] == 9.0
    assert [tuple(r) for r in layout.running_lines(lines).collect()] == [("d", "journal #", 2)]
    words = spark.createDataFrame([("d", 0, t, x, y, x + 20, y + 10) for t, x, y in [("a", 0.0, 0.0), ("b", 30.0, 1.0), ("c", 0.0, 14.0), ("d", 30.0, 14.5)]], "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r["text"]: r["row"] for r in layout.word_rows(words).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    rules = spark.createDataFrame([("d", 0, "h", 10.2, 0.0, 50.0), ("d", 0, "h", 10.9, 50.5, 90.0), ("d", 0, "h", 10.5, 200.0, 300.0)], "doc_id string, page int, kind string, pos double, a double, b double")
    assert sorted((r["a"], r["b"]) for r in layout.merged_intervals(rules).collect()) == [(0.0, 90.0), (200.0, 300.0)]
    gaps = spark.createDataFrame([("d", 0, float(y)) for y in (0, 20, 40, 60, 500)], "doc_id string, page int, pos double")
    assert [r["part"] for r in layout.large_gaps(gaps).orderBy("pos").collect()] == [0, 0, 0, 0, 1]
