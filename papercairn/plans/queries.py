"""The named queries of the core, and SQL that gives the same rows."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papercairn.functions import text as X
from papercairn.functions import python as P
from papercairn.functions.encoders import encode
from papercairn.operators import captions, corpus, documents, joins, matching, retrieval, tables
from papercairn.sources import files, sinks
from papercairn.streaming import ingest
from papercairn.tables import read, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- retrieval -------------------------------------------------------------------------------------------------------

GOLDEN = captions.load_queries(Path(__file__).with_name("golden.json"))
_q = lambda x: "NULL" if x is None else f"{x}".lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
_GOLDEN_SQL = "(VALUES " + ", ".join(f"({_q(g['id'])}, {_q(g['query'])}, {_q(g['anchor'])}, {_q(g['lang'])}, {_q(g['hard'])}, {_q(','.join(g['section_types']) or None)})" for g in GOLDEN) + ") AS golden(qid, query, anchor, lang, hard, kinds)"
_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"


def golden(spark: SparkSession) -> DataFrame:
    rows = [(g["id"], g["query"], g["anchor"], g["lang"], g["hard"], g["section_types"]) for g in GOLDEN]
    return spark.createDataFrame(rows, "qid string, query string, anchor string, lang string, hard boolean, section_types array<string>")


def indexed(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """Chunks, or only those of some ids, with the text that is indexed: embed_text, else header and text, in NFKC."""
    c = read(spark, d, "chunks")
    c = (c if only is None else c.join(only, "chunk_id", "left_semi")).dropDuplicates(["chunk_id"])
    return c.withColumn("body", P.norm_text(F.coalesce("embed_text", F.concat("context_header", F.lit("\n"), "text"), "text")))


def _nfkc_sql(column: str) -> str:
    """NFKC of a text as far as its letters and digits go, by replacing character by character."""
    one, more = [], []
    for c in map(chr, range(0x80, 0x10000)):
        n = unicodedata.normalize("NFKC", c)
        if n != c and not "\ud800" <= c <= "\udfff":
            if len(n) == 1:
                one.append((c, n))
            elif (c < "\u2500" or "\ufb00" <= c <= "\ufb06") and any(x.isalnum() for x in n):
                more.append((c, n))
    one = [(a, b) for a, b in one if b != "'"]
    out = f"translate({column}, '{''.join(a for a, _ in one)}', '{''.join(b for _, b in one)}')"
    some = "".join(a for a, _ in more)
    chain = "x"
    for a, b in more:
        chain = f"replace({chain}, '{a}', '{b}')"
    return f"nfc_normalize(CASE WHEN regexp_matches({column}, '[{some}]') THEN list_transform([{out}], lambda x: {chain})[1] ELSE {out} END)"


def _terms_sql(column: str) -> str:
    tokens = rf"regexp_extract_all(lower({_nfkc_sql(column)}), '[\p{{L}}\p{{N}}]+(?:[-/][\p{{L}}\p{{N}}]+)*')"
    every = f"flatten(list_transform({tokens}, lambda t: CASE WHEN regexp_matches(t, '[-/]') THEN list_concat([t], regexp_split_to_array(t, '[-/]')) ELSE [t] END))"
    return f"list_filter({every}, lambda t: length(t) > 1 AND NOT list_contains([{_STOP_SQL[1:-1]}], t))"


_BODY_SQL = "SELECT DISTINCT ON (chunk_id) chunk_id, paper_id, section_type, kind, meta, coalesce(embed_text, context_header || chr(10) || text, text) AS body FROM chunks"
_BM25_SQL = f"""
c AS ({_BODY_SQL}),
t AS (SELECT chunk_id, {_terms_sql("coalesce(body, '')")} AS t FROM c),
n AS (SELECT count(*) AS n, coalesce(nullif(sum(len(t)) / count(*), 0), 1) AS average FROM t),
q AS (SELECT qid, unnest(list_distinct({_terms_sql("query")})) AS term FROM golden_set),
p AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p GROUP BY term),
s AS (SELECT qid, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT average FROM n)))), 6) AS score FROM p JOIN w USING (term) JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s)"""
_SET_SQL = f"golden_set AS (SELECT * FROM {_GOLDEN_SQL})"


@query(f"WITH {_SET_SQL}, {_BM25_SQL} SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(indexed(spark, d), "chunk_id", F.col("body"), golden(spark), 20)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d)


@query(f"WITH c AS ({_BODY_SQL}), t AS (SELECT chunk_id, unnest({_terms_sql('body')}) AS term FROM c), p AS (SELECT DISTINCT chunk_id, term FROM t) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM c) - count(*) + 0.5) / (count(*) + 0.5)), 9) AS idf FROM p GROUP BY term")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    c = indexed(spark, d)
    return retrieval.idf(retrieval.postings(c, "chunk_id", F.col("body")), c.count()).withColumn("idf", F.round("idf", 9))


@query(f"WITH c AS ({_BODY_SQL}), t AS (SELECT chunk_id, unnest({_terms_sql('body')}) AS term FROM c) SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(indexed(spark, d), "chunk_id", F.col("body"))


_DENSE_SQL = """
v AS (SELECT DISTINCT ON (chunk_id) chunk_id, vector::DOUBLE[] AS vector FROM vectors WHERE len(vector) = 64 AND (list_max(vector) > 0 OR list_min(vector) < 0)),
ds AS (SELECT a.chunk_id AS qid, b.chunk_id, round(list_cosine_similarity(a.vector, b.vector), 6) AS score FROM v a CROSS JOIN v b WHERE a.chunk_id IN (SELECT chunk_id FROM vector_probes)),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ds)"""


def probes(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "vector_probes").select("chunk_id").distinct()


@query(f"WITH {_DENSE_SQL} SELECT qid, chunk_id, score, rank FROM dr WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "vectors")
    asked = v.filter(F.size("vector") == 64).join(probes(spark, d), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("qid"), "vector")
    return retrieval.dense(v, "chunk_id", "vector", asked, 10)


@query(f"""WITH {_DENSE_SQL}, golden_set AS (SELECT chunk_id AS qid, body AS query FROM ({_BODY_SQL}) WHERE chunk_id IN (SELECT chunk_id FROM vector_probes)), {_BM25_SQL},
a AS (SELECT qid, chunk_id, rank AS dense_rank FROM dr WHERE rank <= 50), b AS (SELECT qid, chunk_id, rank AS bm25_rank FROM r WHERE rank <= 50),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, dense_rank, bm25_rank, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 9) AS rrf FROM a FULL JOIN b ON a.qid = b.qid AND a.chunk_id = b.chunk_id)
SELECT *, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, coalesce(dense_rank, 1000000000), chunk_id) AS rank FROM f) WHERE rank <= 8""".replace("SELECT *, rank FROM (", "SELECT * FROM ("))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """More like this: each probe chunk's vector and text, both rankings fused."""
    c, v = indexed(spark, d), read(spark, d, "vectors")
    own = probes(spark, d)
    vectors = v.filter(F.size("vector") == 64).join(own, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("qid"), "vector")
    texts = indexed(spark, d, own).select(F.col("chunk_id").alias("qid"), F.col("body").alias("query"))
    return retrieval.fuse(retrieval.dense(v, "chunk_id", "vector", vectors, 50), retrieval.bm25(c, "chunk_id", F.col("body"), texts, 50), "chunk_id", 8)


_FILTER_SQL = "lower(section_type) IN ('methods', 'results') AND meta.year BETWEEN 2015 AND 2022"


@query(f"""WITH {_SET_SQL}, {_BM25_SQL}, k AS (SELECT chunk_id FROM c WHERE {_FILTER_SQL}),
z AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s WHERE chunk_id IN (SELECT chunk_id FROM k))
SELECT qid, chunk_id, round(1 / (60 + rank), 9) AS score, rank, rank AS bm25_rank FROM z WHERE rank <= 8""")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """By words alone, among methods and results of some years."""
    hits = retrieval.search(indexed(spark, d), "chunk_id", F.col("body"), golden(spark), 8, retrieval.passes(section_types=["Methods", "results"], years=(2015, 2022)))
    return hits.select("qid", "chunk_id", "score", "rank", "bm25_rank")


def _probe_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each probe chunk as a query: its text and its vector."""
    own = probes(spark, d)
    vectors = read(spark, d, "vectors").filter(F.size("vector") == 64).join(own, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("qid"), "vector")
    texts = indexed(spark, d, own).select(F.col("chunk_id").alias("qid"), F.col("body").alias("query"))
    return texts.join(vectors, "qid", "left")


_HYBRID_SQL = f"""golden_set AS (SELECT chunk_id AS qid, body AS query FROM ({_BODY_SQL}) WHERE chunk_id IN (SELECT chunk_id FROM vector_probes) AND trim(body) <> ''), {_BM25_SQL}, {_DENSE_SQL},
k AS (SELECT chunk_id FROM c WHERE kind = 'text' AND meta.year >= 2010),
zd AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS dense_rank FROM ds WHERE chunk_id IN (SELECT chunk_id FROM k) AND qid IN (SELECT qid FROM golden_set)),
zb AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS bm25_rank FROM s WHERE chunk_id IN (SELECT chunk_id FROM k)),
a AS (SELECT * FROM zd WHERE dense_rank <= 50), b AS (SELECT * FROM zb WHERE bm25_rank <= 50),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, dense_rank, bm25_rank, round(coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 9) AS rrf FROM a FULL JOIN b ON a.qid = b.qid AND a.chunk_id = b.chunk_id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, coalesce(dense_rank, 1000000000), chunk_id) AS place FROM f)"""


@query(f"WITH {_HYBRID_SQL} SELECT qid, chunk_id, rrf AS score, place AS rank, dense_rank, bm25_rank FROM o WHERE place <= 8")
def filtered_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and words fused, among text chunks of 2010 or later."""
    hits = retrieval.search(indexed(spark, d), "chunk_id", F.col("body"), _probe_queries(spark, d), 8, retrieval.passes(kinds=["Text"], years=(2010, None)), read(spark, d, "vectors"))
    return hits.select("qid", "chunk_id", "score", "rank", "dense_rank", "bm25_rank")


@query(f"""WITH {_HYBRID_SQL}, h AS (SELECT o.qid, o.chunk_id, place, rrf, length(c.body) AS rerank FROM o JOIN c USING (chunk_id) WHERE place <= 20)
SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, place) AS rank, rerank::DOUBLE AS rerank, rrf FROM h) WHERE rank <= 5""".replace("length(c.body)", f"length(trim(regexp_replace({_nfkc_sql('c.body')}, '[ \\t]+', ' ', 'g')))"))
def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """As filtered_hybrid, the first 20 put in order of a scorer: here the length of the text, in place of a model."""
    hits = retrieval.search(indexed(spark, d), "chunk_id", F.col("body"), _probe_queries(spark, d), 5, retrieval.passes(kinds=["Text"], years=(2010, None)), read(spark, d, "vectors"), scorer=lambda q, t: F.char_length(t), rerank_k=20)
    return hits.select("qid", "chunk_id", "rank", "rerank", "rrf")


_EVAL_SQL = f"""{_SET_SQL}, {_BM25_SQL},
m AS (SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, s.chunk_id) AS place FROM s JOIN c USING (chunk_id) JOIN golden_set g USING (qid) WHERE g.kinds IS NULL OR lower(c.section_type) = g.kinds),
h AS (SELECT qid, paper_id, min(place) AS rank FROM m JOIN c USING (chunk_id) WHERE place <= 50 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM h),
x AS (SELECT DISTINCT qid, paper_id FROM golden_set, papers WHERE contains(meta.title, anchor) AND paper_id IS NOT NULL),
f AS (SELECT qid, min(place) AS place FROM o JOIN x USING (qid, paper_id) GROUP BY qid),
e AS (SELECT g.qid, lang, hard, (SELECT count(*) FROM m WHERE m.qid = g.qid AND place <= 50) AS n_hits, f.place AS rank,
  CASE WHEN g.qid IN (SELECT qid FROM x) THEN coalesce(place <= 8, false) END AS hit, CASE WHEN g.qid IN (SELECT qid FROM x) THEN coalesce(1 / place, 0) END AS reciprocal,
  CASE WHEN kinds IS NOT NULL THEN TRUE END AS filter_ok FROM golden_set g LEFT JOIN f USING (qid))"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    c = indexed(spark, d)
    g = golden(spark)
    free, bound = g.filter(F.size("section_types") == 0), g.filter(F.size("section_types") > 0)
    hits = retrieval.search(c, "chunk_id", F.col("body"), free, 50)
    kinds = sorted({k for x in GOLDEN for k in x["section_types"]})
    for kind in kinds:  # one search for each filter of the set
        hits = hits.unionByName(retrieval.search(c, "chunk_id", F.col("body"), bound.filter(F.array_contains("section_types", kind)), 50, retrieval.passes(section_types=[kind])))
    hits = hits.join(c.select("chunk_id", "paper_id", F.lower("section_type").alias("kind")), "chunk_id")
    kept_to = hits.join(bound.select("qid", "section_types"), "qid").groupBy("qid").agg(F.bool_and(F.array_contains("section_types", F.col("kind"))).alias("filter_ok"))
    titles = read(spark, d, "papers").filter("paper_id IS NOT NULL AND meta.title IS NOT NULL").select("paper_id", F.col("meta.title").alias("title"))
    asked = F.filter(F.array(*[F.struct(F.lit(x["id"]).alias("qid"), F.lit(x["anchor"]).alias("anchor")) for x in GOLDEN if x["anchor"]]), lambda x: F.col("title").contains(x["anchor"]))
    answers = titles.select("paper_id", F.explode(asked).alias("x")).select("paper_id", "x.qid").groupBy("qid").agg(F.collect_set("paper_id").alias("anchors"))
    scored = retrieval.evaluate(hits, g.join(answers, "qid", "left").select("qid", F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors")), 8)
    return scored.join(g.select("qid", "lang", "hard"), "qid").join(kept_to, "qid", "left")


@query(f"WITH {_EVAL_SQL} SELECT qid, n_hits, rank, hit, reciprocal, filter_ok FROM e")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """hit@8 and reciprocal rank of the golden set; answers are papers whose title holds the anchor."""
    return _evaluated(spark, d).drop("lang", "hard")


@query(f"""WITH {_EVAL_SQL} SELECT lang, hard, count(hit) AS queries, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / greatest(count(hit), 1), 6) AS share, round(sum(coalesce(reciprocal, 0)) / greatest(count(hit), 1), 6) AS mrr,
  count(filter_ok) AS filters, count(*) FILTER (filter_ok) AS filters_kept FROM e GROUP BY lang, hard""")
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The golden set's figures by language, and apart for queries that share few words with their answers."""
    return retrieval.report(_evaluated(spark, d), "lang", "hard")


# ---- text of headings ------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('1. Introduction', 'intro'), ('Materials and Methods', 'methods'), ('METHODS', 'methods'), ('Statistical Analyses', 'methods'), ('Irb approval status', 'methods'), ('Literature review of trials', 'methods'),
('Ethics approval and consent to participate', 'back'), ('ETHICS STATEMENT', 'methods'), ('Severity scoring methods', 'methods'), ('3.2. Adverse events', 'results'), ('Case Summary', 'results'), ('Effect of interventions', 'results'), ('Key findings', 'results'),
('Mechanism of Action', 'discussion'), ('Clinical implications', 'discussion'), ('Concluding remarks:', 'discussion'), ('IV. Discussion', 'discussion'), ('Associated Data', 'back'), ('Funding', 'back'), ('Conflicts of interest', 'back'), ('References cited', 'back'),
('Downloaded from the site', 'other'), ('Capsule summary', 'other'), ('Licence', 'other'), ('Primer', 'other'), ('', 'other'), ('Something else', 'other'), ('Abstract', 'abstract'), ('Data availability statement', 'back'), ('Data availability', 'methods'), ('Outcomes', 'results'), ('Outcome measures', 'methods')) AS t(title, kind)""")
def section_examples(spark: SparkSession, d: str) -> DataFrame:
    """What headings stand for, one example of every rule."""
    titles = ["1. Introduction", "Materials and Methods", "METHODS", "Statistical Analyses", "Irb approval status", "Literature review of trials", "Ethics approval and consent to participate", "ETHICS STATEMENT", "Severity scoring methods", "3.2. Adverse events", "Case Summary", "Effect of interventions", "Key findings", "Mechanism of Action", "Clinical implications", "Concluding remarks:", "IV. Discussion", "Associated Data", "Funding", "Conflicts of interest", "References cited", "Downloaded from the site", "Capsule summary", "Licence", "Primer", "", "Something else", "Abstract", "Data availability statement", "Data availability", "Outcomes", "Outcome measures"]
    return spark.createDataFrame([(t,) for t in titles], "title string").select("title", X.classify_section(F.col("title")).alias("kind"))


@query(r"""WITH h AS (SELECT DISTINCT unnest(path) AS x FROM paragraphs UNION SELECT * FROM (VALUES ('13-15'), ('77, 82'), ('B'), ('TABLE 2 Strength of recommendation'), ('Fig. IV'), ('KEYWORDS'), ('Results:'), ('Conclusion :'), ('Conclusion'), ('Table of contents'), ('Figures'), ('1234')) AS v(x))
SELECT x AS title, regexp_matches(trim(regexp_replace(x, '\s+', ' ', 'g')), '(?i)^(\d{1,3}(\s*[,\-–]\s*\d{1,3})*|[a-z]|(table|fig(ure)?)\s*\.?\s*[\divx]+\b.*|keywords?|(results?|conclusions?|background|objectives?|methods?|limitations?|importance|findings?|meaning)\s*:)$') AS no_heading FROM h WHERE x IS NOT NULL""")
def no_headings(spark: SparkSession, d: str) -> DataFrame:
    """All headings of the collection, and some that are none."""
    planted = ["13-15", "77, 82", "B", "TABLE 2 Strength of recommendation", "Fig. IV", "KEYWORDS", "Results:", "Conclusion :", "Conclusion", "Table of contents", "Figures", "1234"]
    h = read(spark, d, "paragraphs").select(F.explode("path").alias("title")).union(spark.createDataFrame([(p,) for p in planted], "title string")).filter("title IS NOT NULL").distinct()
    return h.select("title", X.is_not_heading(F.col("title")).alias("no_heading"))


# ---- the collection --------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT DISTINCT file, coalesce('doi:' || lower(nullif(trim(doi), '')), 'sha1:' || nullif(trim(sha1), ''), 'path:' || file) AS g FROM manifest)
SELECT file, g AS dup_group, file = min(file) OVER (PARTITION BY g) AS is_primary FROM m""")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_groups(read(spark, d, "manifest"))


@query("SELECT DISTINCT file, sha1, title_guess FROM manifest WHERE (doi IS NULL OR trim(doi) = '') AND coalesce(len(doi_candidates), 0) = 0")
def unidentified_files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unidentified(read(spark, d, "manifest"))


@query("""SELECT DISTINCT lower(trim(doi)) AS paper_id, file FROM manifest WHERE is_primary AND error IS NULL AND doi IS NOT NULL
AND lower(trim(doi)) NOT IN (SELECT lower(trim(paper_id)) FROM papers WHERE paper_id IS NOT NULL AND length(paper_id) % 2 = 0)""")
def work_selection(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do where only papers with ids of even length are done."""
    return corpus.to_process(read(spark, d, "manifest"), read(spark, d, "papers").filter("length(paper_id) % 2 = 0"))


@query("SELECT par_uid, paper_id, epoch_us(ingested_at) AS arrived FROM (SELECT *, row_number() OVER (PARTITION BY par_uid ORDER BY ingested_at DESC, paper_id) AS n FROM paragraphs) WHERE n = 1")
def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    p = corpus.latest(read(spark, d, "paragraphs").select("par_uid", "paper_id", "ingested_at"), "par_uid", "ingested_at")
    return p.select("par_uid", "paper_id", F.unix_micros("ingested_at").alias("arrived"))


@query("""WITH f AS (SELECT paper_id, min(file) AS file, max(pages) AS pages, max(total_chars) AS total_chars FROM manifest WHERE is_primary GROUP BY paper_id)
SELECT DISTINCT p.paper_id, p.source, f.file, f.pages, f.total_chars FROM papers p LEFT JOIN f USING (paper_id)""")
def papers_with_files(spark: SparkSession, d: str) -> DataFrame:
    return corpus.enriched(read(spark, d, "papers"), read(spark, d, "manifest")).select("paper_id", "source", "file", "pages", "total_chars").distinct()


@query(r"""WITH p AS (SELECT DISTINCT file, regexp_replace(regexp_replace(lower(trim(x)), '^(https?://)?(dx\.)?(doi\.org/)?(doi:\s*)?', ''), '/+', '/', 'g') AS doi FROM (SELECT file, unnest(doi_candidates) AS x FROM manifest))
SELECT doi, count(*) AS files, count(*) >= 3 AS banned FROM p GROUP BY doi""")
def doi_claims(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doi_claims(read(spark, d, "manifest"))


@query("""SELECT kind, count(*) AS papers FROM (SELECT DISTINCT paper_id, CASE WHEN regexp_matches(paper_id, '^10\\.\\d{4,9}/') THEN 'doi' WHEN paper_id LIKE 'pmid:%' THEN 'pmid' WHEN paper_id LIKE 'sha1:%' THEN 'sha1' WHEN paper_id LIKE 'file:%' THEN 'file' WHEN paper_id IS NOT NULL THEN 'other' END AS kind FROM papers) GROUP BY kind""".replace("\\\\", "\\"))
def identity_kinds(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "papers").select("paper_id").distinct().groupBy(X.paper_key_kind(F.col("paper_id")).alias("kind")).agg(F.count(F.lit(1)).alias("papers"))


@query("""WITH k AS (SELECT DISTINCT chunk_id, greatest(1, floor(length(text) / 4))::INT AS t, count(*) OVER () AS n FROM (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks WHERE text IS NOT NULL)),
o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, n FROM k)
SELECT share, t AS value FROM o, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) AS q(share) WHERE i = round_even(share * (n - 1), 0)""")
def token_percentiles(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "chunks").filter("text IS NOT NULL").dropDuplicates(["chunk_id"]).select(X.approx_tokens(F.col("text")).alias("tokens"))
    return corpus.nearest_rank(t, "tokens", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])


@query("SELECT kind, section_type, count(DISTINCT chunk_id) AS chunks, count(DISTINCT paper_id) AS papers FROM chunks GROUP BY GROUPING SETS ((kind), (kind, section_type), ())")
def chunk_distribution(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "chunks").select("chunk_id", "paper_id", "kind", "section_type").createOrReplaceTempView("papercairn_chunks")
    return spark.sql("SELECT kind, section_type, count(DISTINCT chunk_id) AS chunks, count(DISTINCT paper_id) AS papers FROM papercairn_chunks GROUP BY GROUPING SETS ((kind), (kind, section_type), ())")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a title and abstract, once each, and the title's length n, by which the sources and the damage below are
    dealt out."""
    t = read(spark, d, "papers").filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("abstract"), F.min("meta.title").alias("title"))
    return t.withColumn("n", F.char_length(F.coalesce("title", F.lit(""))))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of all papers, with what other sources would say of each, and with damage put into the paragraphs: a
    little for every flag of the audit."""
    t = _titles(spark, d)
    n = F.col("n")
    api = F.when(n % 4 == 0, F.col("abstract")).when(n % 4 == 1, F.substring("abstract", F.lit(1), F.floor(F.char_length("abstract") / 2).cast("int"))).when(n % 4 == 2, F.concat("abstract", F.repeat(F.lit(" other words of a longer abstract"), F.lit(60))))
    name = F.when(n % 6 == 5, "2021-03-A Entirely unrelated words about something else.pdf").otherwise(F.concat(F.translate(F.coalesce("title", F.lit("")), "/\\", "  "), F.lit(".pdf")))
    metadata = t.select("paper_id", api.alias("api_abstract"), ((n % 7) * 4).alias("reference_count"), (~F.col("paper_id").startswith("file:")).alias("known"), (n % 11 != 0).alias("resolves"), name.alias("file_name"))
    damage = {
        0: [F.repeat(F.lit("ﬁ"), F.lit(9))], 1: [F.lit("(cid:12) and (cid:3)")], 2: [F.lit("the families.2–5 and methods.3,4 and results.12-14 and lesions.7–9 were seen")],
        3: [F.lit(f"Smith AB, Jones C. A study of the fold in men. Journal. 2019;{i}") for i in range(3)], 4: [F.lit("Received: 3 May"), F.lit("doi: 10.1000/x")], 5: [F.concat(F.lit("a"), F.repeat(F.lit("�"), F.lit(5)))],
    }
    put = F.when(n < 0, F.array().cast("array<string>"))
    for k, texts in damage.items():
        put = put.when(n % 6 == k, F.array(*texts))
    planted = t.select("paper_id", F.lit(999).alias("sec_ord"), F.posexplode(put).alias("par_ord", "text"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("array<string>").alias("cited_keys"))
    paragraphs = read(spark, d, "paragraphs").select("paper_id", "sec_ord", "par_ord", "text", "path", "cited_keys").unionByName(planted)
    return corpus.signals(read(spark, d, "papers"), paragraphs, read(spark, d, "paper_tables"), read(spark, d, "manifest"), metadata)


_SIGNALS_SQL = r"""
tt AS (SELECT paper_id, min(source) AS source, min(abstract) AS abstract, min(abstract_source) AS abstract_source, min(meta.title) AS title, length(coalesce(min(meta.title), '')) AS n, min(array_to_string(meta.pub_types, ' ')) AS pub_types FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
pl AS (SELECT paper_id, 999 AS sec_ord, unnest(range(0, len(x))) AS par_ord, unnest(x) AS text FROM (SELECT paper_id, CASE n % 6 WHEN 0 THEN [repeat('ﬁ', 9)] WHEN 1 THEN ['(cid:12) and (cid:3)'] WHEN 2 THEN ['the families.2–5 and methods.3,4 and results.12-14 and lesions.7–9 were seen']
  WHEN 3 THEN ['Smith AB, Jones C. A study of the fold in men. Journal. 2019;0', 'Smith AB, Jones C. A study of the fold in men. Journal. 2019;1', 'Smith AB, Jones C. A study of the fold in men. Journal. 2019;2'] WHEN 4 THEN ['Received: 3 May', 'doi: 10.1000/x'] ELSE ['a' || repeat(chr(65533), 5)] END AS x FROM tt)),
p AS (SELECT DISTINCT paper_id, sec_ord, par_ord, text, path, coalesce(text, '') AS t, path[-1] AS head FROM (SELECT paper_id, sec_ord, par_ord, text, path FROM paragraphs UNION ALL SELECT paper_id, sec_ord, par_ord, text, NULL FROM pl)),
s1 AS (SELECT paper_id, count(DISTINCT sec_ord) AS n_sections, count(*) AS n_paragraphs, sum(length(t)) + greatest(0, count(*) - 1) AS n_chars,
  sum(length(regexp_replace(t, '[^\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]', '', 'g'))) AS broken, sum(len(regexp_extract_all(t, '[ﬀﬁﬂﬃﬄﬆ]'))) AS ligatures, sum(len(regexp_extract_all(t, '\(cid:\d+\)'))) AS cid,
  sum(len(regexp_extract_all(t, '\b[a-z]{4,}\.\d{1,3}[,\-–]\d{1,3}\b'))) AS glued, count(*) FILTER (regexp_matches(trim(t), '^[A-Z][a-zA-Z\-]+ [A-Z]{1,3}(,| et al).{0,120}\.\s.{5,}\.\s.{0,60}\d{4}')) AS listed,
  count(text) - count(DISTINCT text) AS duplicates,
  count(*) FILTER (regexp_matches(t, '(?i)^\s*(received:|accepted:|correspondence\b|©|copyright|downloaded from|e-?mail|how to cite|this article|funding information|conflict of interest|doi:\s*10\.)')) AS frontmatter,
  count(DISTINCT CASE WHEN head IS NOT NULL AND (regexp_matches(head, '^[\d\s.|)]+$') OR length(head) = 1 OR length(head) > 150) THEN sec_ord END) AS bad_headings FROM p GROUP BY paper_id),
s2 AS (SELECT paper_id, count(*) AS n_tables, sum(CASE WHEN trim(coalesce(markdown, '')) = '' THEN 1 ELSE 0 END) AS empty_tables FROM (SELECT DISTINCT paper_id, table_uid, markdown FROM paper_tables) GROUP BY paper_id),
s3 AS (SELECT paper_id, max(pages) AS pages, max(total_chars) AS total_chars, max(is_scanned_candidate) AS scanned FROM manifest WHERE paper_id IS NOT NULL GROUP BY paper_id),
s4 AS (SELECT paper_id, count(DISTINCT ref) AS n_references FROM (SELECT paper_id, unnest(cited_keys) AS ref FROM paragraphs) GROUP BY paper_id),
g AS (SELECT tt.*, coalesce(n_sections, 0) AS n_sections, coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(n_chars, 0) AS n_chars, coalesce(broken, 0) AS broken, coalesce(ligatures, 0) AS ligatures, coalesce(cid, 0) AS cid, coalesce(glued, 0) AS glued, coalesce(listed, 0) AS listed,
  coalesce(duplicates, 0) AS duplicates, coalesce(frontmatter, 0) AS frontmatter, coalesce(bad_headings, 0) AS bad_headings, coalesce(n_references, 0) AS n_references,
  coalesce(n_tables, 0) AS n_tables, coalesce(empty_tables, 0) AS empty_tables, coalesce(pages, 0) AS pages, coalesce(total_chars, 0) AS total_chars, coalesce(scanned, false) AS scanned,
  CASE n % 4 WHEN 0 THEN abstract WHEN 1 THEN substr(abstract, 1, length(abstract) // 2) WHEN 2 THEN abstract || repeat(' other words of a longer abstract', 60) END AS api, (n % 7) * 4 AS registered, NOT starts_with(paper_id, 'file:') AND n % 11 <> 0 AS sound
  FROM tt LEFT JOIN s1 USING (paper_id) LEFT JOIN s2 USING (paper_id) LEFT JOIN s3 USING (paper_id) LEFT JOIN s4 USING (paper_id))"""
_AUDIT_SQL = f"""WITH {_SIGNALS_SQL}, l AS (SELECT *, regexp_matches(coalesce(pub_types, ''), '(?i)letter|comment|editorial|reply|correspondence') OR regexp_matches(CASE WHEN n % 6 = 5 THEN '' ELSE coalesce(title, '') END, '-[LC]-') AS letter FROM g), a AS (SELECT paper_id, list_filter([
  CASE WHEN total_chars > 4000 AND round(n_chars / total_chars, 2) < 0.12 THEN 'under_extracted' END, CASE WHEN NOT letter AND pages >= 3 AND n_sections <= 1 THEN 'no_sections' END, CASE WHEN NOT letter AND pages >= 4 AND n_chars < 1500 THEN 'too_little_body' END,
  CASE WHEN ligatures > 8 THEN 'unresolved_ligatures' END, CASE WHEN broken > 3 THEN 'broken_chars' END, CASE WHEN cid > 0 THEN 'cid_artifacts' END, CASE WHEN frontmatter >= 2 THEN 'frontmatter_leak' END, CASE WHEN glued >= 4 THEN 'cite_contamination' END, CASE WHEN listed >= 3 THEN 'references_in_body' END,
  CASE WHEN bad_headings >= 2 THEN 'suspicious_headings' END, CASE WHEN duplicates >= 3 THEN 'duplicate_paragraphs' END, CASE WHEN coalesce(title, '') = '' THEN 'no_title' END, CASE WHEN NOT letter AND registered >= 8 AND n_references < registered * 0.5 THEN 'references_missing' END], lambda x: x IS NOT NULL) AS flags FROM l)"""
_SIGNAL_COLUMNS = "paper_id, n_sections, n_paragraphs, n_chars, broken, ligatures, cid, glued, listed, duplicates, frontmatter, bad_headings, n_references, n_tables, empty_tables, pages, total_chars, scanned"


@query(f"WITH {_SIGNALS_SQL} SELECT {_SIGNAL_COLUMNS} FROM g")
def paper_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(*_SIGNAL_COLUMNS.split(", "))


@query(_AUDIT_SQL + " SELECT paper_id, array_to_string(flags, ',') AS flags FROM a")
def paper_audit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit(_signals(spark, d)).select("paper_id", F.array_join("flags", ",").alias("flags"))


@query(_AUDIT_SQL + " SELECT flag, count(*) AS papers FROM (SELECT unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['clean'] END) AS flag FROM a) GROUP BY flag")
def flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.flag_counts(corpus.audit(_signals(spark, d)))


_COMMON_SQL = "coalesce(list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x))))), 0)"
_QUALITY_SQL = rf"""WITH {_SIGNALS_SQL}, ft AS (SELECT paper_id, arg_min(text, (sec_ord, par_ord, text)) AS first_text FROM p WHERE trim(t) <> '' GROUP BY paper_id),
w AS (SELECT g.*, regexp_extract_all(lower(trim(coalesce(abstract, ''))), '[\p{{L}}\p{{N}}]+') AS wa, regexp_extract_all(lower(trim(coalesce(api, ''))), '[\p{{L}}\p{{N}}]+') AS wp, regexp_extract_all(lower(coalesce(first_text, '')), '[\p{{L}}\p{{N}}]+') AS wf,
  list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 3) AS wt, trim(coalesce(abstract, '')) <> '' AS there, trim(coalesce(api, '')) <> '' AS has_api FROM g LEFT JOIN ft USING (paper_id)),
c AS (SELECT *, {_COMMON_SQL.format('wa', 'wp')} AS ap, {_COMMON_SQL.format('wa', 'wf')} AS af FROM w),
f AS (SELECT *, there AND has_api AS compared, CASE WHEN len(wp) > 0 THEN ap / len(wp) ELSE 0 END AS recall, CASE WHEN len(wa) > 0 THEN ap / len(wa) ELSE 0 END AS precision,
  there AND len(wa) > 0 AND len(wf) > 0 AND least(af / len(wa), af / len(wf)) >= 0.90 AS echo, there AND len(wt) > 0 AND len(list_intersect(wa, wt)) = 0 AS alien FROM c),
y AS (SELECT *, scanned AS f1, n_sections = 0 OR n_paragraphs = 0 AS f2, compared AND recall < 0.85 AS f5, compared AND precision < 0.80 AS f6, there AND NOT has_api AND NOT echo AND NOT alien AS f7, NOT sound AS f8, n % 6 = 5 AND length(title) >= 15 AS f9,
  registered > 0 AND n_references = 0 AS f10, registered > 0 AND n_references > 0 AND abs(n_references - registered) / greatest(registered, 1) > 0.5 AS f11, broken / greatest(n_chars, 1) > 0.005 AS f12 FROM f),
x AS (SELECT *, 1 - (0.5::DOUBLE * f1::INT + 0.4::DOUBLE * f2::INT + 0.3::DOUBLE * echo::INT + 0.3::DOUBLE * alien::INT + 0.25::DOUBLE * f5::INT + 0.15::DOUBLE * f6::INT + 0.5::DOUBLE * f8::INT + 0.5::DOUBLE * f9::INT + 0.15::DOUBLE * f10::INT + 0.1::DOUBLE * f11::INT + 0.2::DOUBLE * f12::INT) AS plain FROM y),
m AS (SELECT *, CASE WHEN abstract_source = 'extracted' AND compared THEN least(plain, 0.6 + 0.4 * round(recall, 3)) ELSE plain END AS matched FROM x),
z AS (SELECT *, greatest(0, round(CASE WHEN source = 'pdf_fallback' THEN least(matched, 0.7) - 0.05 ELSE matched END, 3))::DOUBLE AS quality_score FROM m)
SELECT paper_id, source, array_to_string(list_filter([CASE WHEN f1 THEN 'scanned_no_text_layer' END, CASE WHEN f2 THEN 'no_sections' END, CASE WHEN echo THEN 'abstract_is_body_first_paragraph' END, CASE WHEN alien THEN 'abstract_title_zero_overlap' END, CASE WHEN f5 THEN 'abstract_truncated_or_foreign' END, CASE WHEN f6 THEN 'abstract_polluted' END,
  CASE WHEN f7 THEN 'abstract_unverified' END, CASE WHEN f8 THEN 'doi_unresolved' END, CASE WHEN f9 THEN 'identity_mismatch' END, CASE WHEN f10 THEN 'no_references_extracted' END, CASE WHEN f11 THEN 'ref_count_off' END, CASE WHEN f12 THEN 'char_corruption' END, CASE WHEN source = 'pdf_fallback' THEN 'fallback_needs_grobid' END], lambda x: x IS NOT NULL), ',') AS flags,
  quality_score, quality_score >= 0.6 AND NOT f2 AND NOT f8 AND NOT f9 AS passed FROM z"""


@query(_QUALITY_SQL)
def paper_quality(spark: SparkSession, d: str) -> DataFrame:
    return corpus.quality(_signals(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query(f"SELECT flag, count(*) AS papers FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM ({_QUALITY_SQL}) WHERE flags <> '') GROUP BY flag")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """How many papers each flag of quality is put on."""
    return corpus.flag_counts(corpus.quality(_signals(spark, d))).filter("flag <> 'clean'")


# ---- papers as paragraphs --------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT DISTINCT ON (par_uid) par_uid, paper_id, sec_ord, par_ord, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM paragraphs WHERE regexp_matches(coalesce(text, ''), '[^\\s]'))
SELECT paper_id, par_uid, first_uid FROM (SELECT *, first_value(par_uid) OVER (PARTITION BY paper_id, t ORDER BY sec_ord, par_ord, par_uid) AS first_uid FROM p) WHERE par_uid <> first_uid""".replace("\\\\", "\\"))
def repeated_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents.repeated_paragraphs(read(spark, d, "paragraphs"))


@query(r"""WITH p AS (SELECT DISTINCT paper_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\d+', '#', 'g') AS text FROM paragraphs),
n AS (SELECT count(DISTINCT coalesce(paper_id, '-')) AS n FROM paragraphs)
SELECT text, count(paper_id) AS papers FROM p WHERE length(text) BETWEEN 1 AND 200 GROUP BY text HAVING count(paper_id) >= 2 AND count(paper_id) >= 0.05 * (SELECT n FROM n)""")
def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return documents.boilerplate(read(spark, d, "paragraphs"))


_RUNS_SQL = r"CASE WHEN len(w) >= 6 THEN list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 5), ' '))) ELSE [] END"


@query(rf"""WITH a AS (SELECT paper_id, {_RUNS_SQL} AS g FROM (SELECT paper_id, regexp_extract_all(lower(min(abstract)), '[\p{{L}}\p{{N}}]+') AS w FROM papers WHERE abstract IS NOT NULL AND paper_id IS NOT NULL GROUP BY paper_id)),
p AS (SELECT DISTINCT ON (par_uid) paper_id, par_uid, {_RUNS_SQL} AS g FROM (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT paper_id, par_uid, text FROM paragraphs UNION ALL SELECT paper_id, 'echo-' || paper_id, min(abstract) || ' And so on.' FROM papers WHERE paper_id IS NOT NULL AND abstract IS NOT NULL GROUP BY paper_id) WHERE text IS NOT NULL))
SELECT p.paper_id, par_uid, len(list_intersect(p.g, a.g)) / len(p.g) AS coverage FROM p JOIN a USING (paper_id) WHERE len(p.g) > 0 AND len(list_intersect(p.g, a.g)) / len(p.g) >= 0.8""")
def abstract_echoes(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that say what the abstract does, with one in each paper."""
    papers = read(spark, d, "papers")
    echo = papers.filter("paper_id IS NOT NULL AND abstract IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("text")).select("paper_id", F.concat(F.lit("echo-"), "paper_id").alias("par_uid"), F.concat("text", F.lit(" And so on.")).alias("text"))
    return documents.abstract_echoes(papers, read(spark, d, "paragraphs").select("paper_id", "par_uid", "text").unionByName(echo))


_MARKS_SQL = r"""
p AS (SELECT DISTINCT ON (par_uid) paper_id, par_uid, text, cited_refs FROM paragraphs WHERE text IS NOT NULL),
m AS (SELECT paper_id, par_uid, unnest(regexp_split_to_array(regexp_replace(x, '[\[\]\s]', '', 'g'), ',')) AS x FROM (SELECT paper_id, par_uid, unnest(regexp_extract_all(text, '\[\d{1,4}(?:\s*[,–-]\s*\d{1,4})*\]')) AS x FROM p)),
ab AS (SELECT paper_id, par_uid, CAST(regexp_extract(x, '^\d+') AS INT) AS a, CAST(coalesce(nullif(regexp_extract(x, '[-–](\d+)$', 1), ''), regexp_extract(x, '^\d+')) AS INT) AS b FROM m WHERE regexp_matches(x, '^\d{1,4}([-–]\d{1,4})?$')),
z AS (SELECT DISTINCT paper_id, par_uid, CAST(unnest(range(a, b + 1)) AS INT) AS number FROM ab WHERE b >= a AND b - a <= 40)"""


@query(f"WITH {_MARKS_SQL} SELECT paper_id, par_uid, number FROM z")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return documents.citations(read(spark, d, "paragraphs"))


@query(f"WITH {_MARKS_SQL} SELECT paper_id, count(DISTINCT number) AS cited, max(number) AS highest, max(number) - count(DISTINCT number) AS missing FROM z GROUP BY paper_id")
def citation_gaps(spark: SparkSession, d: str) -> DataFrame:
    return documents.citation_gaps(read(spark, d, "paragraphs"))


@query(rf"""WITH {_MARKS_SQL}, l AS (SELECT DISTINCT par_uid, CAST(regexp_extract(x, '(\d+)$', 1) AS INT) AS number FROM (SELECT par_uid, unnest(cited_refs) AS x FROM p) WHERE regexp_matches(x, '\d$'))
SELECT z.paper_id, z.par_uid, count(l.number) AS linked, count(*) - count(l.number) AS unknown FROM z LEFT JOIN l ON z.par_uid = l.par_uid AND z.number = l.number GROUP BY ALL""")
def relinked(spark: SparkSession, d: str) -> DataFrame:
    return documents.relinked(read(spark, d, "paragraphs"))


def _homes_sql(table: str, key: str, refs: str) -> str:
    return f"""WITH r AS (SELECT DISTINCT paper_id, sec_ord, par_ord, par_uid, unnest({refs}) AS id FROM paragraphs),
h AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY paper_id, id ORDER BY sec_ord, par_ord, par_uid) = 1)
SELECT f.paper_id, f.{key}, f.id, h.par_uid, h.sec_ord, h.par_ord FROM (SELECT DISTINCT paper_id, {key}, id FROM {table}) f LEFT JOIN h USING (paper_id, id)"""


@query(_homes_sql("paper_tables", "table_uid", "refs_table"))
def table_homes(spark: SparkSession, d: str) -> DataFrame:
    return documents.float_homes(read(spark, d, "paragraphs"), read(spark, d, "paper_tables"), "table_uid", "refs_table")


@query(_homes_sql("paper_figures", "figure_uid", "refs_figure"))
def figure_homes(spark: SparkSession, d: str) -> DataFrame:
    return documents.float_homes(read(spark, d, "paragraphs"), read(spark, d, "paper_figures"), "figure_uid", "refs_figure")


_JUNK_SQL = "^(0123456789|capsule summary|j am acad dermatol|downloaded (from|for)|see related|this article is protected|copyright|licen[sc]e)"


def _classify_sql(t: str) -> str:
    """The class of a normalised lower-case title."""
    q = lambda xs: ", ".join(f"'{x}'" for x in xs)
    main = [k for k in X.SECTIONS if k != "back"]
    rules = [f"WHEN {t} = '' OR regexp_matches({t}, '{_JUNK_SQL}') THEN 'other'", f"WHEN {t} IN ({q(X.SECTIONS['back'])}) THEN 'back'"]
    rules += [f"WHEN {t} IN ({q(X.SECTIONS[k])}) THEN '{k}'" for k in main]
    rules += [f"WHEN regexp_matches({t}, '^({X._any_of(X.SECTIONS[k])})') THEN '{k}'" for k in [*main, "back"]]
    last = rf"regexp_extract({t}, '([\p{{L}}\p{{N}}_-]+)$', 1)"
    rules += [f"WHEN {last} IN ({q([w for w, k in X.LAST_WORDS.items() if k == kind])}) THEN '{kind}'" for kind in dict.fromkeys(X.LAST_WORDS.values())]
    return "CASE " + " ".join(rules) + " ELSE 'other' END"


_TITLE_SQL = r"lower(regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '(?i)^\s*(\d+(\.\d+)*|[ivxlcdm]+|[a-z])[.)]\s+', ''), '^[ :.\-—–\t]+|[ :.\-—–\t]+$', '', 'g'))"
_SECTIONS_SQL = f"""
h AS (SELECT paper_id, sec_ord, min(path) AS path FROM paragraphs GROUP BY ALL),
parts AS (SELECT paper_id, sec_ord, i, {_TITLE_SQL} AS t FROM (SELECT paper_id, sec_ord, unnest(path) AS x, unnest(range(1, len(path) + 1)) AS i FROM h) WHERE x IS NOT NULL AND trim(x) <> ''),
kinds AS (SELECT paper_id, sec_ord, i, {_classify_sql('t')} AS k, row_number() OVER (PARTITION BY paper_id, sec_ord ORDER BY i) AS n FROM parts WHERE NOT regexp_matches(t, '{_JUNK_SQL}')),
one AS (SELECT coalesce(paper_id, '-') AS pk, sec_ord, coalesce(max(CASE WHEN n = 1 AND k <> 'other' THEN k END), arg_max(CASE WHEN k <> 'other' THEN k END, CASE WHEN k <> 'other' THEN i END)) AS own FROM kinds GROUP BY ALL),
sec AS (SELECT paper_id, sec_ord, coalesce(own, 'other') AS own FROM h LEFT JOIN one ON coalesce(h.paper_id, '-') = one.pk AND h.sec_ord = one.sec_ord)""".replace("h LEFT JOIN one ON coalesce(h.paper_id, '-') = one.pk AND h.sec_ord = one.sec_ord", "h LEFT JOIN (SELECT pk, sec_ord AS so, own FROM one) ON coalesce(paper_id, '-') = pk AND sec_ord IS NOT DISTINCT FROM so")


@query(f"WITH {_SECTIONS_SQL} SELECT paper_id, sec_ord, own FROM sec")
def section_types(spark: SparkSession, d: str) -> DataFrame:
    return documents.sections(read(spark, d, "paragraphs")).select("paper_id", "sec_ord", "own")


@query(f"""WITH {_SECTIONS_SQL}, k AS (SELECT *, CASE WHEN own IN ('intro', 'methods', 'results', 'discussion') THEN own END AS known FROM sec),
w AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY sec_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, list_distinct(list(known) OVER (PARTITION BY paper_id)) AS types FROM k)
SELECT paper_id, sec_ord, own, CASE WHEN own = 'other' AND len(list_filter(types, lambda x: x IS NOT NULL)) >= 2 AND list_has_any(types, ['methods', 'results']) THEN coalesce(last, 'other') ELSE own END AS section_type FROM w""")
def carried_sections(spark: SparkSession, d: str) -> DataFrame:
    return documents.carried_sections(read(spark, d, "paragraphs"))


@query()
def chunked_papers(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunk_papers(read(spark, d, "paragraphs"), read(spark, d, "papers"))


@query(r"""WITH p AS (SELECT DISTINCT ON (par_uid) paper_id, sec_ord, par_ord, par_uid, text, list_filter(coalesce(path, []), lambda x: x IS NOT NULL AND trim(x) <> '') AS parts FROM paragraphs WHERE regexp_matches(coalesce(text, ''), '[^\s]')),
b AS (SELECT *, coalesce(lag(parts) OVER (PARTITION BY paper_id ORDER BY sec_ord, par_ord, par_uid), []) AS before FROM p)
SELECT paper_id, sec_ord, par_ord, par_uid, array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: parts[1:i] IS DISTINCT FROM before[1:i]), lambda i: repeat('#', CAST(i AS INT) + 1) || ' ' || parts[i] || chr(10) || chr(10)), '') || trim(regexp_replace(text, '\s+', ' ', 'g')) AS markdown FROM b""".replace("\\\\", "\\"))
def markdown_view(spark: SparkSession, d: str) -> DataFrame:
    return documents.markdown_view(read(spark, d, "paragraphs"))


@query(r"""WITH a AS (SELECT paper_id, 'abstract' AS key, min(abstract) AS text FROM papers WHERE abstract IS NOT NULL AND paper_id IS NOT NULL GROUP BY paper_id),
p AS (SELECT DISTINCT ON (par_uid) * FROM paragraphs WHERE regexp_matches(coalesce(text, ''), '[^\s]')),
h AS (SELECT paper_id, 'h:' || lower(x) AS key, min(x) AS text FROM (SELECT paper_id, unnest(path) AS x FROM p) WHERE trim(coalesce(x, '')) <> '' GROUP BY paper_id, lower(x))
SELECT * FROM a UNION ALL SELECT * FROM h UNION ALL SELECT paper_id, 'p:' || par_uid, text FROM p""")
def translation_units(spark: SparkSession, d: str) -> DataFrame:
    return documents.units(read(spark, d, "paragraphs"), read(spark, d, "papers"))


# ---- tables and boxes ------------------------------------------------------------------------------------------------

_SEP_SQL = r"regexp_matches(trim(x), '^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$')"
_ROWS_SQL = rf"""
t AS (SELECT DISTINCT table_uid, caption, markdown FROM paper_tables),
l AS (SELECT table_uid, x, i, {_SEP_SQL} AS sep FROM (SELECT table_uid, unnest(regexp_split_to_array(coalesce(markdown, ''), '\r\n|\n')) AS x, unnest(range(1, len(regexp_split_to_array(coalesce(markdown, ''), '\r\n|\n')) + 1)) AS i FROM t) WHERE trim(x) <> ''),
w AS (SELECT table_uid, i, row_number() OVER (PARTITION BY table_uid ORDER BY i) - 1 AS row, list_transform(string_split(regexp_replace(replace(trim(x), '\|', chr(1)), '^\||\|$', '', 'g'), '|'), lambda y: replace(y, chr(1), '|')) AS c FROM l WHERE NOT sep)"""


@query(rf"""WITH {_ROWS_SQL}, s AS (SELECT table_uid, count(*) AS n_rows, max(len(c)) AS n_cols, min(len(c)) AS least FROM w GROUP BY table_uid),
k AS (SELECT DISTINCT table_uid, markdown FROM t), e AS (SELECT table_uid, count(*) AS n_lines, bool_or(sep) AS has, min(place) FILTER (sep) AS sep_at, trim(arg_min(x, i)) AS first, trim(arg_max(x, i)) AS last FROM (SELECT *, row_number() OVER (PARTITION BY table_uid ORDER BY i) AS place FROM l) GROUP BY table_uid)
SELECT table_uid, coalesce(n_rows, 0) AS n_rows, coalesce(n_cols, 0) AS n_cols, greatest(0, coalesce(n_rows, 0) - 1) AS data_rows,
  array_to_string(list_filter([CASE WHEN n_lines IS NULL THEN 'empty' END, CASE WHEN n_lines > 0 AND NOT has THEN 'no_separator' END, CASE WHEN sep_at <> 2 THEN 'separator_misplaced' END, CASE WHEN n_lines > 0 AND coalesce(n_rows, 0) <= 1 THEN 'no_data_rows' END, CASE WHEN n_lines > 0 AND n_cols = 1 THEN 'single_column' END,
    CASE WHEN n_lines > 0 AND n_cols <> least THEN 'ragged_columns' END, CASE WHEN n_lines > 0 AND n_cols >= 12 AND n_rows <= 2 THEN 'collapsed' END, CASE WHEN starts_with(first, '|') AND NOT ends_with(last, '|') THEN 'truncated' END,
    CASE WHEN 3 * length(regexp_replace(markdown, '[^\x{{FFFD}}\x{{E000}}-\x{{F8FF}}\x{{0080}}-\x{{009F}}]', '', 'g')) > length(regexp_replace(markdown, '[\s|:-]', '', 'g')) THEN 'unreadable' END], lambda x: x IS NOT NULL), ',') AS problems
FROM k LEFT JOIN s USING (table_uid) LEFT JOIN e USING (table_uid)""")
def markdown_check(spark: SparkSession, d: str) -> DataFrame:
    return tables.check(read(spark, d, "paper_tables")).withColumn("problems", F.array_join("problems", ","))


@query(rf"WITH {_ROWS_SQL} SELECT table_uid, row, unnest(range(0, len(c))) AS col, trim(unnest(c)) AS value, row = 0 AS is_header FROM w")
def table_grid(spark: SparkSession, d: str) -> DataFrame:
    return tables.grid(read(spark, d, "paper_tables"))


@query(rf"""WITH {_ROWS_SQL}, x AS (SELECT table_uid, max(len(c)) AS width FROM w GROUP BY table_uid),
r AS (SELECT table_uid, row, width, '| ' || array_to_string(list_resize(list_transform(c, lambda y: replace(trim(y), '|', '\|')), width, ''), ' | ') || ' |' AS line FROM w JOIN x USING (table_uid))
SELECT table_uid, string_agg(CASE WHEN row = 0 THEN line || chr(10) || '| ' || array_to_string(list_transform(range(0, width), lambda i: '---'), ' | ') || ' |' ELSE line END, chr(10) ORDER BY row) AS markdown FROM r GROUP BY table_uid""")
def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every table's Markdown read into cells and written again, one separator row each."""
    return tables.to_markdown(tables.grid(read(spark, d, "paper_tables")))


_EMPTY_SQL = _ROWS_SQL.replace("FROM paper_tables)", "FROM (SELECT table_uid, caption, markdown FROM paper_tables UNION ALL SELECT 'e-' || table_uid, left(caption, 8), CASE WHEN length(caption) % 2 = 0 THEN '| a |' END FROM paper_tables))")


@query(f"WITH {_EMPTY_SQL} SELECT DISTINCT t.table_uid FROM t LEFT JOIN (SELECT table_uid, count(*) AS n FROM w GROUP BY table_uid) USING (table_uid) WHERE coalesce(n, 0) <= 1 AND length(trim(coalesce(caption, ''))) < 15")
def empty_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables without a body and a caption, with one of each table's number alone."""
    t = read(spark, d, "paper_tables").select("table_uid", "caption", "markdown")
    bare = t.select(F.concat(F.lit("e-"), "table_uid").alias("table_uid"), F.left("caption", F.lit(8)).alias("caption"), F.when(F.char_length("caption") % 2 == 0, "| a |").alias("markdown"))
    return tables.empty_tables(t.unionByName(bare))


_CAPTIONS = r"(?i)^\s*(suppl(?:ementary|\.)?\s+)?(table|tab|figure|fig)\.?\s*(S?)(\d{1,3}|[ivx]{1,4})\b[.:)]?\s*"


@query(rf"""WITH c AS (SELECT DISTINCT 'table' AS tbl, table_uid AS uid, caption FROM paper_tables UNION SELECT 'figure', figure_uid, caption FROM paper_figures),
p AS (SELECT *, lower(regexp_extract(caption, '{_CAPTIONS}', 2)) AS word, regexp_extract(caption, '(?i)^\s*(?:table|tab|figure|fig)\.?\s*(\d{{1,3}}|[ivx]{{1,4}})\b', 1) AS n FROM c)
SELECT uid, CASE WHEN word LIKE 't%' THEN 'table' WHEN word LIKE 'f%' THEN 'figure' END AS kind,
  CASE WHEN regexp_matches(n, '^\d+$') THEN CAST(n AS INT) WHEN n <> '' THEN nullif(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], upper(n)), 0) END AS number,
  trim(regexp_replace(caption, '{_CAPTIONS}', '')) AS description FROM p""")
def caption_parts(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "paper_tables").select(F.col("table_uid").alias("uid"), "caption").distinct()
    f = read(spark, d, "paper_figures").select(F.col("figure_uid").alias("uid"), "caption").distinct()
    return t.unionByName(f).withColumn("p", X.caption_parts(F.col("caption"))).select("uid", "p.kind", "p.number", "p.description")


_BOXES_SQL = """
b AS (SELECT DISTINCT paper_id, table_uid, pdf_span.page AS page, least(pdf_span.x0, pdf_span.x1) AS x0, least(pdf_span.y0, pdf_span.y1) AS y0, greatest(pdf_span.x0, pdf_span.x1) AS x1, greatest(pdf_span.y0, pdf_span.y1) AS y1 FROM paper_tables WHERE pdf_span IS NOT NULL),
e AS (SELECT *, max(y1) OVER (PARTITION BY paper_id, page ORDER BY y0, y1, table_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM b),
bands AS (SELECT *, sum(CASE WHEN upto IS NULL OR y0 > upto THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, page ORDER BY y0, y1, table_uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM e)"""


@query(f"WITH {_BOXES_SQL} SELECT paper_id, page, band, min(y0) AS y0, max(y1) AS y1, count(*) AS boxes FROM bands GROUP BY ALL")
def merged_bands(spark: SparkSession, d: str) -> DataFrame:
    return tables.merged_bands(tables.boxes(read(spark, d, "paper_tables")))


@query(f"""WITH {_BOXES_SQL}, o AS (SELECT a.paper_id, a.page, a.table_uid AS first, b.table_uid AS second, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area,
  least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS least FROM b a JOIN b ON a.paper_id = b.paper_id AND a.page = b.page AND a.table_uid < b.table_uid) SELECT paper_id, page, first, second, area / least AS share FROM o WHERE least > 0 AND area > 0""")
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    return tables.overlapping(tables.boxes(read(spark, d, "paper_tables")))


# ---- text functions --------------------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT paper_id, regexp_replace(coalesce(meta.title, ''), '[^-_.\p{L}\p{N}]', '_', 'g') AS name FROM papers WHERE meta.title <> ''""")
def title_slugs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "papers").filter("meta.title <> ''").select("paper_id", X.slug(F.col("meta.title")).alias("name")).distinct()


@query(r"""SELECT DISTINCT file, nullif(lower(regexp_replace(regexp_extract(title_guess || ' ' || coalesce(doi, ''), '10\.\d{4,9}/[^\s"<>]+'), '[).,;:\]]+$', '')), '') AS doi FROM manifest WHERE title_guess IS NOT NULL""")
def printed_dois(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "manifest").filter("title_guess IS NOT NULL")
    return m.select("file", X.clean_doi(F.concat("title_guess", F.lit(" "), F.coalesce("doi", F.lit("")))).alias("doi")).distinct()


@query(r"""SELECT DISTINCT par_uid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+([,;)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g'), '(\d)\s+%', '\1%', 'g'), '\](,\s*|\s+)\[', '][', 'g'), '\(\s*\)', '', 'g') AS text FROM paragraphs WHERE text IS NOT NULL""")
def tidy_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "paragraphs").filter("text IS NOT NULL").select("par_uid", X.tidy_punctuation(F.col("text")).alias("text")).distinct()


@query(r"""SELECT DISTINCT doc_id, length(regexp_replace(text, '[^\p{N}]', '', 'g')) / length(text) > 0.3 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.55 AND length(text) >= 20 AS junk FROM documents WHERE length(text) > 0""")
def junk_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter(F.char_length("text") > 0).select("doc_id", X.is_junk_sentence(F.col("text")).alias("junk")).distinct()


@query(r"""WITH w AS (SELECT DISTINCT ON (c.chunk_id) c.chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(context_header), '[\p{L}\p{N}]+') AS b FROM chunks c WHERE text IS NOT NULL AND context_header IS NOT NULL),
k AS (SELECT chunk_id, len(a) AS la, len(b) AS lb, list_sum(list_transform(list_distinct(b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS common FROM w)
SELECT chunk_id, coalesce(common, 0)::INT AS common, CASE WHEN lb > 0 THEN coalesce(common, 0) / lb END AS precision, CASE WHEN la > 0 THEN coalesce(common, 0) / la END AS recall FROM k""")
def lexical_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How far the words of a chunk's header stand in its text, as multisets."""
    c = read(spark, d, "chunks").filter("text IS NOT NULL AND context_header IS NOT NULL").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", corpus.lexical_agreement(F.col("context_header"), F.col("text")).alias("x")).select("chunk_id", "x.*")


@query(r"""SELECT DISTINCT paper_id, trim(regexp_replace(strip_accents(lower(meta.authors[1])), '[^\p{L}\p{N}]+', ' ', 'g')) AS author FROM papers WHERE len(meta.authors) > 0""")
def author_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "papers").filter(F.size("meta.authors") > 0).select("paper_id", X.ascii_key(F.get("meta.authors", 0)).alias("author")).distinct()


@query("""WITH t AS (SELECT DISTINCT ON (table_uid) table_uid, paper_id, ingested_at FROM paper_tables WHERE paper_id IS NOT NULL ORDER BY table_uid, ingested_at),
p AS (SELECT paper_id, ingested_at, max(par_uid) AS par_uid FROM paragraphs WHERE paper_id IS NOT NULL GROUP BY ALL)
SELECT t.table_uid, p.par_uid FROM t ASOF LEFT JOIN p ON t.paper_id = p.paper_id AND t.ingested_at >= p.ingested_at""")
def arrived_before(spark: SparkSession, d: str) -> DataFrame:
    """The paragraph of its paper that arrived last before each table."""
    t = read(spark, d, "paper_tables").filter("paper_id IS NOT NULL").groupBy("table_uid").agg(F.min_by(F.struct("paper_id", "ingested_at"), "ingested_at").alias("r")).select("table_uid", "r.*")
    p = read(spark, d, "paragraphs").filter("paper_id IS NOT NULL").select("paper_id", F.col("ingested_at").alias("at"), "par_uid")
    return joins.as_of(t, p, "paper_id", "ingested_at", "at", ["par_uid"]).select("table_uid", "par_uid")


@query(r"""WITH p AS (SELECT DISTINCT ON (par_uid) paper_id, par_uid, text FROM paragraphs WHERE text IS NOT NULL),
s AS (SELECT DISTINCT paper_id FROM p WHERE regexp_matches(text, '(\p{L}|\)) ¼ [\d.−-]')),
a AS (SELECT p.paper_id, par_uid, text, regexp_replace(regexp_replace(text, '(\d)Á(\d)', '\1·\2', 'g'), '(\d)Á(\d)', '\1·\2', 'g') AS point, s.paper_id IS NOT NULL AS shown FROM p LEFT JOIN s ON p.paper_id = s.paper_id),
b AS (SELECT *, CASE WHEN shown THEN regexp_replace(regexp_replace(point, '(\p{L}|\)) ¼ ([\d.−-])', '\1 = \2', 'g'), '([\p{L}\p{N}]) þ ', '\1 + ', 'g') ELSE point END AS good FROM a)
SELECT paper_id, par_uid, good AS text FROM b WHERE good <> text""")
def repaired_symbols(spark: SparkSession, d: str) -> DataFrame:
    return documents.repaired_symbols(read(spark, d, "paragraphs"))


@query(rf"""WITH s AS (SELECT DISTINCT paper_id, text, unnest({_RUNS_SQL}) AS g FROM (SELECT DISTINCT ON (doc_id) paper_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 25),
c AS (SELECT DISTINCT paper_id, unnest({_RUNS_SQL}) AS g FROM (SELECT paper_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM paragraphs WHERE text IS NOT NULL)),
v AS (SELECT s.paper_id, s.text, count(c.g) / count(*) AS coverage FROM s LEFT JOIN c ON s.paper_id = c.paper_id AND s.g = c.g GROUP BY ALL)
SELECT * FROM v WHERE coverage < 0.5""")
def missing_prose(spark: SparkSession, d: str) -> DataFrame:
    """Texts of documents that the paragraphs of their paper hardly have."""
    source = read(spark, d, "documents").select("paper_id", "text").distinct()
    return documents.missing_prose(source, read(spark, d, "paragraphs"), "paper_id")


@query()
def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "paragraphs").filter("text IS NOT NULL").select("par_uid", P.norm_text(F.col("text")).alias("text")).dropDuplicates(["par_uid"])


@query()
def hashed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A feature-hashed vector of each chunk."""
    return indexed(spark, d).select("chunk_id", encode(F.col("body"), "hash", 256).alias("vector"))


@query(rf"""WITH h AS (SELECT DISTINCT x FROM (SELECT unnest(path) AS x FROM paragraphs) WHERE x IS NOT NULL),
t AS (SELECT x, trim(regexp_replace(x, '\s+', ' ', 'g')) AS joined, {_TITLE_SQL} AS t FROM h)
SELECT x AS printed, joined, regexp_replace(regexp_replace(joined, '(?i)^\s*(\d+(\.\d+)*|[ivxlcdm]+|[a-z])[.)]\s+', ''), '^[ :.\-—–\t]+|[ :.\-—–\t]+$', '', 'g') AS title, {_classify_sql('t')} AS section_type FROM t""".replace("\\\\", "\\"))
def headings(spark: SparkSession, d: str) -> DataFrame:
    """Every heading as printed, joined where its capitals are set apart, and without its number."""
    h = read(spark, d, "paragraphs").select(F.explode("path").alias("printed")).filter("printed IS NOT NULL").distinct()
    return h.select("printed", P.despace_heading(F.col("printed")).alias("joined")).select("printed", "joined", X.normalize_title(F.col("joined")).alias("title"), X.classify_section(F.col("joined")).alias("section_type"))


@query(f"WITH {_SET_SQL}, {_BM25_SQL} SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 8")
def saved_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index written, read again, and asked."""
    c, at = indexed(spark, d), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    sinks.save_index(retrieval.postings(c, "chunk_id", F.col("body")), retrieval.lengths(c, "chunk_id", F.col("body")), at)
    return sinks.index_search(sinks.load_index(spark, at), "chunk_id", golden(spark), 8)


@query("SELECT section_type, count(*) AS paragraphs FROM (SELECT DISTINCT par_uid, section_type FROM paragraphs) GROUP BY section_type")
def streamed_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs taken in as a stream, each key once, and counted."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    static = read(spark, d, "paragraphs")
    stream = ingest.arrivals(spark, f"{d}/paragraphs*.parquet", static.schema)
    ingest.into(ingest.once_each(stream, "par_uid", "ingested_at", "90 days"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("section_type").agg(F.count(F.lit(1)).alias("paragraphs"))


@query("""WITH k AS (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL),
s AS (SELECT paper_id, count(DISTINCT sec_ord) AS sections, count(DISTINCT par_uid) AS paragraphs FROM paragraphs GROUP BY paper_id),
f AS (SELECT paper_id, count(DISTINCT figure_uid) AS figures FROM paper_figures GROUP BY paper_id), t AS (SELECT paper_id, count(DISTINCT table_uid) AS tables FROM paper_tables GROUP BY paper_id)
SELECT paper_id, coalesce(sections, 0)::INTEGER AS sections, coalesce(paragraphs, 0)::INTEGER AS paragraphs, coalesce(figures, 0)::INTEGER AS figures, coalesce(tables, 0)::INTEGER AS tables FROM k LEFT JOIN s USING (paper_id) LEFT JOIN f USING (paper_id) LEFT JOIN t USING (paper_id)""")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, figures and tables nested into canonical documents and taken apart again: rows of each kind per paper."""
    p = documents.distinct_paragraphs(read(spark, d, "paragraphs")).filter("paper_id IS NOT NULL")
    papers = read(spark, d, "papers").filter("paper_id IS NOT NULL").dropDuplicates(["paper_id"])
    f = read(spark, d, "paper_figures").dropDuplicates(["figure_uid"]).select("paper_id", F.col("figure_uid").alias("ord"), "id", "caption", "image")
    t = read(spark, d, "paper_tables").dropDuplicates(["table_uid"]).select("paper_id", F.col("table_uid").alias("ord"), "id", "caption", "markdown", "source", "graphic", "footnote")
    none = spark.createDataFrame([], "paper_id string, ord string, key string, number int, doi string, pmid string, title string, year int, journal string, authors array<string>, raw string, source string")
    docs = files.nested({"papers": papers, "paragraphs": p.select("paper_id", "sec_ord", "par_ord", "path", "section_type", "id", "text", "cited_refs", "cited_keys", "refs_figure", "refs_table"), "figures": f, "tables": t, "references": none})
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return docs.select("paper_id", n("body_text").alias("sections"), F.coalesce(F.aggregate("body_text", F.lit(0), lambda a, s: a + F.size(s["paragraphs"])), F.lit(0)).alias("paragraphs"), n("figures").alias("figures"), n("tables").alias("tables"))


# ---- captions, abstracts, references ---------------------------------------------------------------------------------

_FLOATS_SQL = r"""
c AS (SELECT DISTINCT paper_id, table_uid AS uid, 'table' AS kind, caption FROM paper_tables UNION SELECT paper_id, figure_uid, 'figure', caption FROM paper_figures),
n AS (SELECT *, regexp_extract(caption, '(?i)^\s*(?:table|tab|figure|fig)\.?\s*(\d{1,3}|[ivx]{1,4})\b', 1) AS n FROM c),
f AS (SELECT *, CASE WHEN regexp_matches(n, '^\d+$') THEN CAST(n AS INT) WHEN n <> '' THEN nullif(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], upper(n)), 0) END AS number FROM n)"""


def _floats(spark: SparkSession, d: str) -> DataFrame:
    return captions.floats(read(spark, d, "paper_tables"), read(spark, d, "paper_figures"))


@query(f"WITH {_FLOATS_SQL} SELECT paper_id, kind, number, arg_max(caption, (length(caption), caption)) AS caption, count(DISTINCT caption) AS claims FROM f WHERE number IS NOT NULL GROUP BY ALL")
def caption_map(spark: SparkSession, d: str) -> DataFrame:
    return captions.caption_map(_floats(spark, d))


@query(f"""WITH {_FLOATS_SQL}, f2 AS (SELECT paper_id, kind, number, caption FROM f UNION SELECT paper_id, kind, number, 'Other words under one number' FROM f WHERE number IS NOT NULL AND length(caption) % 3 = 0), b AS (SELECT paper_id, kind, number, arg_max(caption, (length(caption), caption)) AS best FROM f2 WHERE number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT caption) > 1)
SELECT DISTINCT f.paper_id, f.kind, f.number FROM f2 f JOIN b ON f.paper_id = b.paper_id AND f.kind = b.kind AND f.number = b.number WHERE 1 - levenshtein(caption, best) / greatest(length(caption), length(best)) < 0.7""")
def ambiguous_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that unlike captions claim, a third of them made so."""
    f = _floats(spark, d)
    more = f.filter("number IS NOT NULL AND length(caption) % 3 = 0").withColumn("caption", F.lit("Other words under one number"))
    return captions.ambiguous_numbers(f.unionByName(more))


@query(rf"""WITH {_FLOATS_SQL}, l AS (SELECT paper_id, uid, array_to_string(list_slice(w, 1, 6), ' ') AS g FROM (SELECT *, regexp_extract_all(lower(caption), '[\p{{L}}\p{{N}}]+') AS w FROM c) WHERE len(w) >= 6),
p AS (SELECT paper_id, par_uid, unnest({_RUNS_SQL}) AS g FROM (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (SELECT paper_id, par_uid, text FROM paragraphs UNION ALL SELECT paper_id, 'leak-' || uid, 'As seen, ' || caption || ' was so.' FROM c WHERE length(caption) % 4 = 0) WHERE text IS NOT NULL))
SELECT DISTINCT p.paper_id, uid, par_uid FROM p JOIN l ON p.paper_id = l.paper_id AND p.g = l.g""")
def leaked_captions(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that hold a caption, with some put there."""
    f = _floats(spark, d)
    leak = f.filter("length(caption) % 4 = 0").select("paper_id", F.concat(F.lit("leak-"), "uid").alias("par_uid"), F.concat(F.lit("As seen, "), "caption", F.lit(" was so.")).alias("text"))
    return captions.leaked_captions(read(spark, d, "paragraphs").select("paper_id", "par_uid", "text").unionByName(leak), f)


@query(r"""WITH w AS (SELECT DISTINCT ON (chunk_id) chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(embed_text), '[\p{L}\p{N}]+') AS b FROM chunks),
k AS (SELECT chunk_id, len(coalesce(a, [])) AS la, len(coalesce(b, [])) AS lb, coalesce(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS n FROM w)
SELECT chunk_id, CASE WHEN la > 0 AND lb > 0 THEN n / la END AS precision, CASE WHEN la > 0 AND lb > 0 THEN n / lb END AS recall, CASE WHEN la > 0 AND lb > 0 THEN n / lb >= 0.85 AND n / la >= 0.8 END AS ok FROM k""")
def text_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on a text by a second witness of it: chunks against what was embedded of them."""
    c = read(spark, d, "chunks").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", captions.abstract_verdict(F.col("text"), F.col("embed_text")).alias("v")).select("chunk_id", "v.*")


#: Terms looked for in texts.
GLOSSARY = ("melanocyte", "melanocyte reservoir", "basal layer", "erythema index", "narrowband light", "light", "graft site", "hair bulb", "mast cell", "mast cell cluster", "skin fold", "fold", "suction blister grafting")
_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in sorted(set(GLOSSARY), key=lambda t: (-len(t), t))) + "]"


@query(f"""WITH p AS (SELECT DISTINCT ON (par_uid) par_uid, list_filter({_TERMS_SQL}, lambda t: contains(lower(text), t)) AS found FROM paragraphs WHERE text IS NOT NULL)
SELECT par_uid, array_to_string(list_filter(found, lambda t: len(list_filter(found, lambda u: u <> t AND contains(u, t))) = 0), '|') AS terms FROM p WHERE len(found) > 0""")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "paragraphs").filter("text IS NOT NULL").select("par_uid", captions.terms_in(F.col("text"), list(GLOSSARY)).alias("t")).filter(F.size("t") > 0)
    return p.select("par_uid", F.array_join("t", "|").alias("terms")).dropDuplicates(["par_uid"])


@query(r"""SELECT DISTINCT paper_id, concat_ws('. ', nullif(trim(array_to_string(meta.authors[1:6], ', ') || CASE WHEN len(meta.authors) > 6 THEN ', et al' ELSE '' END), ''), nullif(trim(meta.title), ''), nullif(trim(meta.journal), ''), meta.year::VARCHAR, 'doi:' || nullif(trim(meta.doi), '')) AS line FROM papers""")
def reference_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "papers").select("paper_id", captions.reference_line(F.col("meta")).alias("line")).distinct()


@query(r"""SELECT DISTINCT paper_id, trim(substr(trim(regexp_replace(concat_ws(' ', meta.year::VARCHAR, CASE WHEN regexp_matches(meta.journal, ' : (.+)$') THEN regexp_extract(meta.journal, ' : (.+)$', 1) WHEN length(meta.journal) <= 24 THEN meta.journal ELSE
  substr(array_to_string(list_transform(list_filter(regexp_split_to_array(meta.journal, '[^\p{L}]+'), lambda w: length(w) > 0), lambda w: upper(substr(w, 1, 1))), ''), 1, 8) END, regexp_replace(coalesce(meta.title, ''), '[\\/:*?"<>|]', ' ', 'g')), '\s+', ' ', 'g')), 1, 110)) AS name FROM papers""")
def human_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "papers").select("paper_id", captions.human_name(F.col("meta")).alias("name")).distinct()


@query("WITH p AS (SELECT DISTINCT paper_id, par_uid, text FROM paragraphs WHERE text IS NOT NULL) SELECT paper_id, " + ", ".join(f"sum(CASE WHEN regexp_matches(text, '{p}') THEN 1 ELSE 0 END) AS {name}" for name, p in captions.SIGNATURES.items()) + " FROM p GROUP BY paper_id")
def encoding_profile(spark: SparkSession, d: str) -> DataFrame:
    return captions.encoding_profile(documents.distinct_paragraphs(read(spark, d, "paragraphs")), "paper_id")


@query(r"""WITH z AS (SELECT DISTINCT paper_id, par_uid, unnest(list_zip(cited_keys, cited_refs)) AS x FROM paragraphs WHERE cited_keys IS NOT NULL AND cited_refs IS NOT NULL),
v AS (SELECT paper_id, x[1] AS key, TRY_CAST(x[2] AS INT) AS number, count(*) AS n FROM z WHERE x[1] IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM v WHERE number BETWEEN 1 AND 999 QUALIFY row_number() OVER (PARTITION BY paper_id, key ORDER BY n DESC, number) = 1)
SELECT paper_id, min(key) AS key, number FROM b GROUP BY paper_id, number HAVING count(*) = 1""")
def marker_numbers(spark: SparkSession, d: str) -> DataFrame:
    return captions.marker_numbers(read(spark, d, "paragraphs"))


@query(r"""WITH m AS (SELECT DISTINCT file, title_guess, regexp_replace(regexp_replace(lower(trim(x)), '^(https?://)?(dx\.)?(doi\.org/)?(doi:\s*)?', ''), '/+', '/', 'g') AS doi FROM (SELECT file, title_guess, unnest(doi_candidates) AS x FROM (SELECT file, title_guess, doi, doi_candidates FROM manifest UNION ALL SELECT 'planted/' || paper_id, meta.title || 's', NULL, [paper_id, '10.1/other'] FROM papers WHERE paper_id LIKE '10.%') WHERE doi IS NULL AND title_guess IS NOT NULL)),
p AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(paper_id)), '^(https?://)?(dx\.)?(doi\.org/)?(doi:\s*)?', ''), '/+', '/', 'g') AS doi, meta.title AS title FROM papers),
k AS (SELECT file, doi, trim(regexp_replace(strip_accents(lower(title_guess)), '[^\p{L}\p{N}]+', ' ', 'g')) AS a, trim(regexp_replace(strip_accents(lower(title)), '[^\p{L}\p{N}]+', ' ', 'g')) AS b FROM m JOIN p USING (doi)),
s AS (SELECT file, doi, round(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))), 1) AS score FROM k WHERE greatest(length(a), length(b)) > 0)
SELECT file, doi, score FROM s WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, doi) = 1""")
def resolved_dois(spark: SparkSession, d: str) -> DataFrame:
    """Files without a DOI, with one for each paper that prints its DOI and nearly its title."""
    papers = read(spark, d, "papers")
    more = papers.filter("paper_id LIKE '10.%'").select(F.concat(F.lit("planted/"), "paper_id").alias("file"), F.concat("meta.title", F.lit("s")).alias("title_guess"), F.lit(None).cast("string").alias("doi"), F.array("paper_id", F.lit("10.1/other")).alias("doi_candidates"))
    return corpus.resolved_dois(read(spark, d, "manifest").select("file", "title_guess", "doi", "doi_candidates").unionByName(more), papers)


@query(r"""WITH t AS (SELECT *, regexp_extract(caption, '(?i)^\s*(?:table|tab)\.?\s*(\d{1,3})', 1) AS n FROM (SELECT DISTINCT paper_id, table_uid, caption, markdown FROM paper_tables UNION SELECT paper_id, 'k-' || table_uid, left(caption, 12) || ' (continued)', markdown FROM paper_tables WHERE length(caption) % 3 = 0))
SELECT paper_id, CAST(n AS INT) AS number, array_to_string(list_sort(list(table_uid)), ',') AS parts, sum(greatest(0, len(list_filter(string_split(coalesce(markdown, ''), chr(10)), lambda r: trim(r) <> '')) - 2)) AS rows FROM t WHERE n <> '' GROUP BY ALL HAVING bool_or(regexp_matches(caption, '(?i)\bcont(inued|\.|d\.?)'))""")
def continued_tables(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "paper_tables").select("paper_id", "table_uid", "caption", "markdown")
    more = t.filter("length(caption) % 3 = 0").select("paper_id", F.concat(F.lit("k-"), "table_uid").alias("table_uid"), F.concat(F.left("caption", F.lit(12)), F.lit(" (continued)")).alias("caption"), "markdown")
    return captions.continued_tables(t.unionByName(more)).withColumn("parts", F.array_join("parts", ","))


@query()
def shown_hits(spark: SparkSession, d: str) -> DataFrame:
    """The golden set's first five hits, put in order by the length of the text, as lines."""
    c = indexed(spark, d)
    hits = retrieval.bm25(c, "chunk_id", F.col("body"), golden(spark), 5).join(c.select("chunk_id", "paper_id", "context_header", "text"), "chunk_id")
    return captions.shown(captions.reranked(hits, F.char_length("text"), 3))


@query()
def float_chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.float_chunks(read(spark, d, "paper_tables"), read(spark, d, "paper_figures"), read(spark, d, "papers"))


# ---- matching --------------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT DISTINCT paper_id, regexp_extract(source_file, '([^/\\\\]+)$', 1) AS name FROM papers WHERE source_file IS NOT NULL), q AS (SELECT *, lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem FROM p),
f AS (SELECT DISTINCT file, regexp_extract(file, '([^/\\\\]+)$', 1) AS name FROM manifest), a AS (SELECT name, min(file) AS a FROM f GROUP BY name), b AS (SELECT lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem, min(file) AS b FROM f GROUP BY ALL)
SELECT DISTINCT paper_id, coalesce(a, b) AS file, CASE WHEN a IS NOT NULL THEN 'name' ELSE 'stem' END AS by FROM q LEFT JOIN a USING (name) LEFT JOIN b USING (stem) WHERE coalesce(a, b) IS NOT NULL""".replace("\\\\", "\\"))
def found_files(spark: SparkSession, d: str) -> DataFrame:
    return matching.found_files(read(spark, d, "papers"), read(spark, d, "manifest")).distinct()


_KEY_SQL = r"list_distinct(regexp_extract_all(trim(regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '[\p{{L}}\p{{N}}]+'))"


@query("""WITH t AS (SELECT paper_id, length(coalesce(min(meta.title), '')) AS n FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id)
SELECT paper_id, CASE WHEN n >= 15 THEN n % 6 <> 5 END AS ok FROM t""")
def identities(spark: SparkSession, d: str) -> DataFrame:
    """Whether a file's name says a paper's title: of files named after it, but for a sixth."""
    n = F.char_length("title")
    name = F.when(n % 6 == 5, "inbox/Entirely unrelated words about something else.pdf").otherwise(F.concat(F.lit("inbox/2020-01-A1 "), F.translate("title", "/\\", "  "), F.lit(".pdf")))
    t = _titles(spark, d).withColumn("title", F.coalesce("title", F.lit(""))).select("paper_id", name.alias("source_file"), F.struct("title").alias("meta"))
    return matching.identities(t).select("paper_id", "ok")


@query(rf"""WITH {_FLOATS_SQL}, v AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM paragraphs WHERE text IS NOT NULL),
k AS (SELECT DISTINCT paper_id, uid, w FROM (SELECT paper_id, uid, unnest(regexp_extract_all(lower(coalesce(caption, '')), '[\p{{L}}\p{{N}}]+')) AS w FROM c) WHERE length(w) >= 4)
SELECT k.paper_id, uid, count(v.w) / count(*) AS coverage FROM k LEFT JOIN v ON k.paper_id = v.paper_id AND k.w = v.w GROUP BY ALL""")
def topical_coverage(spark: SparkSession, d: str) -> DataFrame:
    return matching.topical_coverage(_floats(spark, d), read(spark, d, "paragraphs"))


@query("""WITH p AS (SELECT paper_id, min(source) AS source FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id), a AS (SELECT paper_id, count(DISTINCT par_uid) AS n FROM paragraphs GROUP BY paper_id),
b AS (SELECT paper_id, count(DISTINCT table_uid) AS n FROM paper_tables GROUP BY paper_id), c AS (SELECT paper_id, count(DISTINCT figure_uid) AS n FROM paper_figures GROUP BY paper_id)
SELECT source, count(*) AS papers, coalesce(sum(a.n), 0)::BIGINT AS paragraphs, coalesce(sum(b.n), 0)::BIGINT AS tables, coalesce(sum(c.n), 0)::BIGINT AS figures FROM p LEFT JOIN a ON p.paper_id = a.paper_id LEFT JOIN b ON p.paper_id = b.paper_id LEFT JOIN c ON p.paper_id = c.paper_id GROUP BY source""")
def unit_counts(spark: SparkSession, d: str) -> DataFrame:
    return matching.unit_counts(*(read(spark, d, t) for t in ("papers", "paragraphs", "paper_tables", "paper_figures")))


@query(r"""SELECT DISTINCT title_guess AS title, length(trim(regexp_replace(title_guess, '\\s+', ' ', 'g'))) >= 20 AND len(regexp_extract_all(lower(title_guess), '[\\p{L}\\p{N}]+')) >= 3 AND length(regexp_replace(title_guess, '[^\\p{L}]', '', 'g')) / length(trim(regexp_replace(title_guess, '\\s+', ' ', 'g'))) >= 0.6 AS plausible FROM manifest WHERE regexp_matches(title_guess, '\\S')""".replace("\\\\", "\\"))
def plausible_titles(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "manifest").filter(F.col("title_guess").rlike(r"\S"))
    return m.select(F.col("title_guess").alias("title"), X.is_plausible_title(F.col("title_guess")).alias("plausible")).distinct()


#: Columns whose numbers DuckDB gives in another type than Spark.
_TYPES = {
    "INTEGER": {"bm25_topk": "rank", "dense_topk": "rank", "hybrid_search": "dense_rank bm25_rank rank", "filtered_search": "rank bm25_rank", "filtered_hybrid": "rank dense_rank bm25_rank", "reranked_search": "rank", "saved_index_search": "rank", "evaluation": "rank", "relinked": "linked unknown", "markdown_check": "n_rows n_cols data_rows", "table_grid": "row col"},
    "BIGINT": {"paper_signals": "n_chars broken ligatures cid glued frontmatter empty_tables", "merged_bands": "band", "encoding_profile": " ".join(captions.SIGNATURES), "continued_tables": "rows"},
}
for _type, _names in _TYPES.items():
    for _name, _columns in _names.items():
        SQL[_name] = "SELECT * REPLACE (" + ", ".join(f'CAST("{c}" AS {_type}) AS "{c}"' for c in _columns.split()) + f") FROM ({SQL[_name]})"
