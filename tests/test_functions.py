import pytest
from papercairn import config
from papercairn.functions import encoders
from papercairn.functions import python as P
from papercairn.functions import text as X
from pyspark.sql import functions as F


def one(spark, f, *values):
    kinds = {str: "string", int: "int", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([values], ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values)))
    r = df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]
    return r.asDict() if hasattr(r, "asDict") else r


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.terms, "NB-UVB and IL-17", ["nb-uvb", "il-17", "nb", "uvb", "il", "17"]),
        (X.terms, "F-VASI of the TGF-β", ["f-vasi", "tgf-β", "vasi", "tgf"]),
        (X.terms, "a of the", []),
        (X.words, "Sjögren, 5 µg", ["sjögren", "5", "µg"]),
        (X.citation_numbers, "15,16", [15, 16]),
        (X.citation_numbers, "[12-14]", [12, 13, 14]),
        (X.citation_numbers, "Smith et al., 2019", []),
        (X.citation_numbers, "3-90", []),
        (X.citation_numbers, "]", []),
        (X.markers, "as shown [2, 3] and [3][5-6].", [2, 3, 5, 6]),
        (X.dehyphenate, "the do- mains of inter- and intraobserver, self- reported", "the domains of inter- and intraobserver, self- reported"),
        (X.tidy_punctuation, "P = .001 , 1 : 1.6 ( 95 % CI ) [1], [2] ( )", "P = .001, 1 : 1.6 (95% CI) [1][2] "),
        (X.normalize_title, " 3.1.  Study  design: ", "Study design"),
        (X.classify_section, "3. Materials and Methods", "methods"),
        (X.classify_section, "SEVERITY SCORING METHODS", "methods"),
        (X.classify_section, "Results and discussion", "results"),
        (X.classify_section, "Conflict of interest", "back"),
        (X.classify_section, "0123456789();:", "other"),
        (X.classify_section, None, "other"),
        (X.classify_path, ["Results", "Study Population"], "results"),
        (X.classify_path, ["0123456789();:", "Methods"], "methods"),
        (X.classify_path, ["Odd", "Discussion", "Odd too"], "discussion"),
        (X.classify_path, [], "other"),
        (X.is_not_heading, "13-15", True),
        (X.is_not_heading, "Results:", True),
        (X.is_not_heading, "Results", False),
        (X.is_not_heading, "TABLE 2 Strength", True),
        (X.clean_doi, "see 10.1000/Ab.12). More", "10.1000/ab.12"),
        (X.clean_doi, "none", None),
        (X.canonical_doi, "https://doi.org/10.1000//AB", "10.1000/ab"),
        (X.slug, "a/b: c", "a_b__c"),
        (X.slug, None, "unknown"),
        (X.approx_tokens, "abc", 1),
        (X.approx_tokens, "x" * 41, 10),
        (X.ascii_key, "Böhm, Rodríguez", "bohm rodriguez"),
        (X.surname, "Böhm, A. B.", "bohm"),
        (X.surname, "Ana Rodríguez", "rodriguez"),
        (X.table_number, "Table IV. Results", 4),
        (X.table_number, "Fig. 12: x", 12),
        (X.table_number, "No label", None),
        (X.year_range, "2018-2025", {"low": 2018, "high": 2025}),
        (X.year_range, "2018-", {"low": 2018, "high": None}),
        (X.year_range, "-2015", {"low": None, "high": 2015}),
        (X.year_range, "2020", {"low": 2020, "high": 2020}),
        (X.year_range, "2018 2025", {"low": None, "high": None}),
        (X.journal_abbreviation, "Archive of Dermatological Colour Research", "AODCR"),
        (X.journal_abbreviation, "Skin : SK", "SK"),
        (X.paper_key_kind, "sha1:abc", "sha1"),
        (X.is_truncated, "and so on", True),
        (X.is_truncated, "p53 readings", True),
        (X.is_truncated, "pH readings", False),
        (X.broken_characters, "a�b (cid:12)\x01", 3),
        (P.norm_text, " ﬁne\t\tＡ ", "fine A"),
        (P.despace_heading, "M ATER I A L S A N D M ETHODS", "MATERIALS AND METHODS"),
        (P.despace_heading, "J AM ACAD DERMATOL", "J AM ACAD DERMATOL"),
        (P.despace_heading, "Materials and Methods", "Materials and Methods"),
    ],
)
def test_values(spark, f, value, want):
    if value is None:
        assert one(spark, f, None) == want
    else:
        assert one(spark, f, value) == want


def test_captions(spark):
    got = one(spark, X.caption_parts, "Suppl. Table S2. Mean area")
    assert (got["kind"], got["number"], got["supplementary"], got["description"]) == ("table", None, True, "Mean area")
    got = one(spark, X.caption_parts, "TABLE II: Mean area")
    assert (got["label"], got["number"], got["description"]) == ("Table 2", 2, "Mean area")
    assert one(spark, X.caption_parts, "Plain text")["kind"] is None


def test_shingles_and_coverage(spark):
    assert one(spark, lambda c: X.shingles(X.words(c), 3), "a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, lambda c: X.shingles(X.words(c), 3), "a b") == []
    assert one(spark, X.coverage, ["a", "b"], ["b", "c"]) == 0.5
    assert one(spark, X.coverage, [], ["b"]) == 0.0


def test_identity(spark):
    assert one(spark, X.paper_identity, None, "12", "ab", "f.pdf") == "pmid:12"
    assert one(spark, X.paper_identity, None, None, None, "x/y/f.1.pdf") == "file:f.1"
    assert one(spark, X.paper_identity, " 10.1/AB ", "12", "ab", "f") == "10.1/ab"


def test_pieces():
    words = frozenset("TABLE CONFLICT OF INTEREST".split())
    assert P.pieces("CONFLICTOFINTEREST", words) == ["CONFLICT", "OF", "INTEREST"]
    assert P.pieces("XYTABLE", words) == ["XY", "TABLE"]
    assert P.pieces("XYTABLE", words, False) is None
    assert P.pieces("", words) == []


def test_vectors(spark):
    df = spark.createDataFrame([("light on the knee",), ("light on the knee",), ("another text",), ("",), (None,)], "t string")
    a, b, c, d, e = (r[0] for r in df.select(encoders.encode(F.col("t"), dim=64)).collect())
    assert a == b and a != c and len(a) == 64
    assert sum(x * x for x in a) == pytest.approx(1, abs=1e-5)
    assert set(d) == set(e) == {0.0}
    with pytest.raises(KeyError):
        encoders.encode(F.col("t"), "auto")
    assert one(spark, lambda c: P.l2_normalized(F.transform(c, lambda x: x.cast("double"))), ["3", "4"]) == [0.6, 0.8]


def test_similarity(spark):
    assert P.similarity("Mean area of the face", "Mean area of the face") == 100
    assert P.similarity("of the face and more words", "Mean area of the face and more words") == 100
    assert P.similarity("of the face", "Mean area of the face and more words") == 0  # too short to say anything
    assert P.similarity("abc", "xyz") == 0 and P.similarity(None, "x") == 0
    df = spark.createDataFrame([("Mean area of the face", "mean area of: the face"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(P.text_similarity(F.col("a"), F.col("b"))).collect()] == [100.0, 0.0]


def test_config(tmp_path):
    assert config.load()["chunk"]["max_tokens"] == 700
    (tmp_path / "c.yaml").write_text("chunk: {max_tokens: 9}\nextra: 1\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert c["chunk"] == {"target_tokens": 550, "max_tokens": 9, "min_tokens": 80, "overlap_sentences": 2} and c["extra"] == 1
    assert config.DEFAULTS["chunk"]["max_tokens"] == 700
