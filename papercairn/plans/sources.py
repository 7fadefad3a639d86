"""Named queries over what comes in and goes out, matching, and layout, with SQL; inputs are made of the standard tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import python as P
from papercairn.operators import captions, corpus, documents, joins, layout, matching, pages, tables
from papercairn.plans.pages import _LINES_SQL, _TITLES_SQL, _lines, _titles
from papercairn.plans.queries import _COMMON_SQL, _ROWS_SQL, query
from papercairn.sources import files, sinks
from papercairn.tables import read, shared_dir

# ---- files and ledgers -----------------------------------------------------------------------------------------------


def _some(spark: SparkSession, d: str) -> DataFrame:
    """par_uid, paper_id, text (letters, figures, blanks and points only) and n, once a paragraph."""
    p = read(spark, d, "paragraphs").filter("text IS NOT NULL AND paper_id IS NOT NULL").dropDuplicates(["par_uid"])
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 .]", " "), " +", " "))
    return p.select("par_uid", "paper_id", "sec_ord", clean.alias("text"), F.char_length("text").alias("n"))


_SOME_SQL = "so AS (SELECT DISTINCT ON (par_uid) par_uid, paper_id, sec_ord, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .]', ' ', 'g'), ' +', ' ', 'g')) AS text, length(text) AS n FROM paragraphs WHERE text IS NOT NULL AND paper_id IS NOT NULL)"


@query(f"WITH {_SOME_SQL} SELECT par_uid, CAST(CASE WHEN n % 5 <> 0 THEN n END AS INT) AS n, n % 5 <> 0 AS good FROM so")
def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON of which a fifth are torn: what is read of each, and the keys of those that can't be."""
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    whole = F.to_json(F.struct("par_uid", "n", "text"))
    _some(spark, d).select(F.when(F.col("n") % 5 == 0, F.concat(F.lit('{"par_uid":"'), "par_uid", F.lit('","n":1'))).otherwise(whole).alias("value")).write.text(at)
    good, bad = files.tolerant_lines(spark, at, "par_uid string, n int, text string")
    lost = bad.select(F.regexp_extract("line", '"par_uid":"([^"]+)', 1).alias("par_uid"), F.lit(None).cast("int").alias("n"), F.lit(False).alias("good"))
    return good.select("par_uid", "n", F.lit(True).alias("good")).unionByName(lost)


@query(f"WITH {_SOME_SQL}, r AS (SELECT paper_id, sec_ord, text, row_number() OVER (PARTITION BY paper_id, sec_ord ORDER BY par_uid) - 1 AS par_ord FROM so WHERE text <> '') SELECT paper_id || '#' || sec_ord AS paper_id, CAST(par_ord AS INT) AS par_ord, 'Part ' || sec_ord AS title, text || ' [7]' AS text, 'r' || par_ord AS cited FROM r")
def xml_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every section written as XML, each paragraph with a reference to the literature, and read again."""
    p = _some(spark, d).filter("text <> ''").withColumn("k", F.row_number().over(W.partitionBy("paper_id", "sec_ord").orderBy("par_uid")) - 1)
    mark = F.concat(F.lit('<p>'), "text", F.lit(' <xref ref-type="bibr" rid="r'), F.col("k").cast("string"), F.lit('">7</xref></p>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", mark.alias("x")))), lambda s: s["x"]), "")
    xml = p.groupBy("paper_id", "sec_ord").agg(body.alias("b")).select(F.concat("paper_id", F.lit("#"), F.col("sec_ord").cast("string")).alias("paper_id"), F.concat(F.lit("<article><body><sec><title>Part "), F.col("sec_ord").cast("string"), F.lit("</title>"), "b", F.lit("</sec></body></article>")).alias("xml"))
    rows = files.from_xml(xml).filter("kind = 'paragraph'")
    return rows.select("paper_id", "par_ord", F.get("path", F.lit(0)).alias("title"), "text", F.get("cited_keys", F.lit(0)).alias("cited"))


@query(f"WITH {_SOME_SQL}, h AS (SELECT par_uid, n, sha1(par_uid) AS sha1 FROM so) SELECT sha1, par_uid, CAST(n AS INT) AS n FROM h WHERE left(sha1, 2) = left((SELECT min(sha1) FROM h), 2)")
def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """A folder of the store, by the content's hash: that of the first one."""
    at = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    docs = _some(spark, d).select(F.sha1("par_uid").alias("sha1"), "par_uid", "n")
    sinks.store_documents(docs, at)
    first = sinks.stored(spark, at).agg(F.min("sha1")).first()[0]
    return sinks.stored(spark, at).filter(F.col("prefix") == (first or "")[:2]).select("sha1", "par_uid", "n")


@query(f"WITH {_SOME_SQL} SELECT par_uid, n + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS n FROM so")
def resumed_ledger(spark: SparkSession, d: str) -> DataFrame:
    """A ledger with a third of its entries done anew."""
    s = _some(spark, d).select("par_uid", F.col("n").cast("long").alias("n"))
    return corpus.resume(s, s.filter("n % 3 = 0").withColumn("n", F.col("n") + 1), "par_uid")


@query(f"WITH {_SOME_SQL} SELECT par_uid, CAST(n AS INT) AS n FROM so WHERE n % 4 = 0 OR n % 3 = 0")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """What is new (a quarter) or other than before (a third)."""
    s = _some(spark, d).select("par_uid", "n")
    before = s.filter("n % 4 <> 0").withColumn("n", F.when(F.col("n") % 3 == 0, F.col("n") + 7).otherwise(F.col("n")))
    return corpus.changed(before, s, "par_uid", "n")


@query(f"""WITH {_TITLES_SQL}, r AS (SELECT paper_id, CASE WHEN n % 2 = 0 THEN title END AS title, CASE WHEN n % 3 = 0 THEN year END AS year, 1 AS priority FROM t UNION ALL SELECT paper_id, upper(title), CASE WHEN n % 5 <> 0 THEN year + 1 END, 2 FROM t UNION ALL SELECT paper_id, 'last', 1900, 3 FROM t)
SELECT paper_id, arg_min(title, priority) AS title, arg_min(year, priority) AS year FROM r GROUP BY paper_id""")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Titles and years of three sources that each know some."""
    t = _titles(spark, d)
    n = F.col("n")
    one = t.select("paper_id", F.when(n % 2 == 0, F.col("title")).alias("title"), F.when(n % 3 == 0, F.col("year")).alias("year"), F.lit(1).alias("priority"))
    two = t.select("paper_id", F.upper("title").alias("title"), F.when(n % 5 != 0, F.col("year") + 1).alias("year"), F.lit(2).alias("priority"))
    three = t.select("paper_id", F.lit("last").alias("title"), F.lit(1900).alias("year"), F.lit(3).alias("priority"))
    return captions.merged_metadata(one.unionByName(two).unionByName(three), "paper_id", "priority")


@query(rf"""WITH t AS (SELECT paper_id, min(abstract) AS abstract, length(coalesce(min(meta.title), '')) AS n FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id),
a AS (SELECT *, CASE n % 4 WHEN 0 THEN abstract WHEN 1 THEN substr(abstract, 1, length(abstract) // 2) WHEN 2 THEN abstract || repeat(' other words of a longer abstract', 60) END AS api FROM t),
w AS (SELECT *, regexp_extract_all(lower(abstract), '[\p{{L}}\p{{N}}]+') AS wx, regexp_extract_all(lower(api), '[\p{{L}}\p{{N}}]+') AS wy FROM a), c AS (SELECT *, {_COMMON_SQL.format('wx', 'wy')} AS shared FROM w)
SELECT paper_id, CASE WHEN abstract IS NULL THEN 'none' WHEN api IS NULL THEN 'extracted_unver' WHEN shared >= 0.85 * len(wy) AND shared >= 0.80 * len(wx) THEN 'extracted' ELSE 'api' END AS source FROM c""")
def chosen_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Which of two sources' abstracts is taken: the other one's is the same, half, longer, or missing."""
    t = read(spark, d, "papers").filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("abstract"), F.char_length(F.coalesce(F.min("meta.title"), F.lit(""))).alias("n"))
    n = F.col("n") % 4
    api = F.when(n == 0, F.col("abstract")).when(n == 1, F.substring("abstract", F.lit(1), F.floor(F.char_length("abstract") / 2).cast("int"))).when(n == 2, F.concat("abstract", F.repeat(F.lit(" other words of a longer abstract"), F.lit(60))))
    return t.select("paper_id", captions.chosen_abstract(F.col("abstract"), api)["source"].alias("source"))


@query(f"WITH {_SOME_SQL} SELECT paper_id, par_uid AS key, CASE WHEN n % 3 = 0 THEN 'Übersetzt [3] und [1]' ELSE text || ' [1] [3]' END AS text, n % 3 = 0 AS translated FROM so")
def overlaid(spark: SparkSession, d: str) -> DataFrame:
    """Translations laid over where they keep the citations: a third do, a third lose one, a third are missing."""
    s = _some(spark, d)
    units = s.select("paper_id", F.col("par_uid").alias("key"), F.concat("text", F.lit(" [1] [3]")).alias("text"))
    cache = s.filter("n % 3 < 2").select("paper_id", F.col("par_uid").alias("key"), F.when(F.col("n") % 3 == 0, "Übersetzt [3] und [1]").otherwise("Übersetzt [1]").alias("text"))
    return documents.overlaid(units, cache)


@query(f"WITH {_SOME_SQL} SELECT paper_id, par_uid AS key, text FROM so WHERE n % 3 = 2")
def untranslated(spark: SparkSession, d: str) -> DataFrame:
    """Units that no translation is kept of."""
    u = _some(spark, d).select("paper_id", F.col("par_uid").alias("key"), "text", "n")
    return documents.untranslated(u.drop("n"), u.filter("n % 3 < 2"))


@query(f"WITH {_SOME_SQL} SELECT par_uid, CAST(CASE WHEN text = '' THEN 0 WHEN n % 2 = 0 THEN 1 ELSE 5 END AS BIGINT) AS edits FROM so")
def edit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edits of texts with a sign before them, or a line behind them."""
    s = _some(spark, d)
    after = F.when(F.col("text") == "", "").when(F.col("n") % 2 == 0, F.concat(F.lit("§"), "text")).otherwise(F.concat("text", F.lit("\nabcde")))
    return s.select("par_uid", P.edit_count(F.col("text"), after).alias("edits"))


# ---- matching --------------------------------------------------------------------------------------------------------

_LISTS_SQL = """
q AS (SELECT DISTINCT meta.journal AS paper_id, meta.title AS title, min(meta.year) AS year FROM papers WHERE meta.journal IS NOT NULL AND length(meta.title) >= 15 GROUP BY ALL),
l AS (SELECT paper_id, title, year, length(title) AS n, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY title) AS INT) AS pos FROM q)"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A journal's titles as printed references, and two thirds of them as listed ones."""
    q = read(spark, d, "papers").filter("meta.journal IS NOT NULL AND length(meta.title) >= 15").groupBy(F.col("meta.journal").alias("paper_id"), F.col("meta.title").alias("title")).agg(F.min("meta.year").alias("year"))
    q = q.withColumn("pos", F.row_number().over(W.partitionBy("paper_id").orderBy("title")))
    none = F.lit(None).cast("string")
    printed = q.select("paper_id", "pos", "title", "year", none.alias("doi"), F.lit("").alias("raw"))
    items = q.filter(F.char_length("title") % 3 != 0).select("paper_id", (1000 - F.col("pos")).alias("pos"), F.upper("title").alias("title"), "year", F.concat(F.lit("10.1/"), F.col("pos").cast("string")).alias("doi"), none.alias("author"), none.alias("journal"))
    return printed, items


@query(f"WITH {_LISTS_SQL} SELECT paper_id, pos, 1000 - pos AS item, 200.0::DOUBLE AS score FROM l WHERE n % 3 <> 0")
def paired_references(spark: SparkSession, d: str) -> DataFrame:
    return joins.paired(*_lists(spark, d))


@query(f"WITH {_LISTS_SQL} SELECT paper_id, pos, title, CASE WHEN n % 3 <> 0 THEN '10.1/' || pos END AS doi, CASE WHEN n % 3 <> 0 THEN 'parsed+listed' ELSE 'parsed' END AS source FROM l")
def merged_references(spark: SparkSession, d: str) -> DataFrame:
    return joins.merged_references(*_lists(spark, d)).select("paper_id", "pos", "title", "doi", "source")


@query(f"""WITH {_LINES_SQL}, k AS (SELECT doc AS paper_id, ord AS pos, CASE WHEN n % 3 = 0 THEN ord + CASE WHEN ord >= 10 THEN 3 ELSE 1 END END AS number FROM l0),
w AS (SELECT *, last_value(CASE WHEN number IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS ap, last_value(number IGNORE NULLS) OVER u AS an, first_value(CASE WHEN number IS NOT NULL THEN pos END IGNORE NULLS) OVER v AS bp, first_value(number IGNORE NULLS) OVER v AS bn FROM k
  WINDOW u AS (PARTITION BY paper_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY paper_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT paper_id, pos, CAST(CASE WHEN number IS NOT NULL THEN number WHEN ap IS NULL AND bp IS NULL THEN NULL WHEN ap IS NULL THEN CASE WHEN bn - (bp - pos) > 0 THEN bn - (bp - pos) END WHEN bp IS NULL THEN an + pos - ap WHEN bp - ap = bn - an THEN an + pos - ap END AS INT) AS number FROM w""")
def filled_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of references filled in between known ones, but for a gap in each list."""
    o = F.col("ord")
    return joins.filled_numbers(_lines(spark, d).select(F.col("doc").alias("paper_id"), o.alias("pos"), F.when(F.col("n") % 3 == 0, o + F.when(o >= 10, 3).otherwise(1)).alias("number")))


@query(rf"""WITH {_SOME_SQL}, k AS (SELECT paper_id || '#' || sec_ord AS key, par_uid AS needle, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g') AS n FROM so), h AS (SELECT key, string_agg(n, '' ORDER BY needle) AS h FROM k GROUP BY key),
t AS (SELECT key, needle, n, h, unnest([70, 110, 160, 240, 400]) AS size FROM k JOIN h USING (key) WHERE n <> ''), c AS (SELECT *, instr(h, substr(n, 1, size)) AS at FROM t)
SELECT key, needle, CAST(at - 1 AS INT) AS place, CAST(size AS INT) AS length FROM c WHERE at > 0 AND instr(substr(h, at + 1), substr(n, 1, size)) = 0 QUALIFY row_number() OVER (PARTITION BY key, needle ORDER BY size) = 1""".replace(" AS at ", " AS spot ").replace("at - 1", "spot - 1").replace("WHERE at > 0", "WHERE spot > 0").replace("substr(h, at + 1)", "substr(h, spot + 1)"))
def located(spark: SparkSession, d: str) -> DataFrame:
    """Where each paragraph stands in its section's letters."""
    s = _some(spark, d).select(F.concat("paper_id", F.lit("#"), F.col("sec_ord").cast("string")).alias("key"), F.col("par_uid").alias("needle"), "text")
    whole = s.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("needle", "text"))), lambda x: x["text"]), "").alias("text"))
    return joins.located(s, whole, "key")


_NUMBERED_SQL = r"""
t AS (SELECT DISTINCT ON (table_uid) paper_id, table_uid AS uid, caption, CAST(regexp_extract(caption, '(?i)^\s*(?:table|tab)\.?\s*(\d{1,3})\b', 1) AS INT) AS number FROM paper_tables WHERE paper_id IS NOT NULL AND regexp_matches(caption, '(?i)^\s*(?:table|tab)\.?\s*\d{1,3}\b')),
o AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY paper_id, number) = 1)"""


@query(f"WITH {_NUMBERED_SQL} SELECT paper_id, uid, number + 7 AS pos, 'number' AS \"by\" FROM o")
def aligned_captions(spark: SparkSession, d: str) -> DataFrame:
    """Tables and the captions printed, by numbers that each has once in a paper."""
    t = read(spark, d, "paper_tables").filter("paper_id IS NOT NULL").dropDuplicates(["table_uid"])
    number = F.nullif(F.regexp_extract("caption", r"(?i)^\s*(?:table|tab)\.?\s*(\d{1,3})\b", 1), F.lit("")).cast("int")
    t = t.select("paper_id", F.col("table_uid").alias("uid"), "caption", number.alias("number")).filter("number IS NOT NULL")
    once = t.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("paper_id", "number"))).filter("k = 1").drop("k")
    return matching.aligned(once, once.select("paper_id", (F.col("number") + 7).alias("pos"), "number", F.concat(F.lit("Printed: "), "caption").alias("caption")))


@query(rf"""WITH {_ROWS_SQL}, c AS (SELECT table_uid AS uid, row, unnest(range(0, len(c))) AS col, trim(unnest(c)) AS value FROM w), v0 AS (SELECT uid, lower(value) AS value, row_number() OVER (PARTITION BY uid ORDER BY row * 1000 + col) AS n FROM c WHERE value <> ''),
v AS (SELECT DISTINCT uid, value FROM v0 WHERE n <= 14), p AS (SELECT uid, length(uid) % 3 AS page, string_agg(value, ' ' ORDER BY row * 1000 + col) AS text FROM c GROUP BY uid UNION ALL SELECT uid, 9, '0 1 2' FROM c GROUP BY uid),
x AS (SELECT DISTINCT uid, page, unnest(regexp_split_to_array(lower(text), '\s+')) AS value FROM p), s AS (SELECT uid, page, count(*) AS votes FROM v JOIN x USING (uid, value) GROUP BY ALL)
SELECT uid, CAST(page AS INT) AS page, votes FROM s WHERE votes >= 3 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY votes DESC, page) = 1""")
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page that has most of a table's first values."""
    c = tables.grid(read(spark, d, "paper_tables")).select(F.col("table_uid").alias("paper_id"), F.col("table_uid").alias("uid"), (F.col("row") * 1000 + F.col("col")).alias("ord"), "value")
    own = c.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), " ").alias("text")).withColumn("page", F.char_length("paper_id") % 3)
    other = c.select("paper_id").distinct().select("paper_id", F.lit("0 1 2").alias("text"), F.lit(9).alias("page"))
    return matching.table_pages(c, own.unionByName(other)).select("uid", "page", "votes")


@query(f"""WITH {_LINES_SQL}, h AS (SELECT doc AS doc_id, ord, CASE n % 4 WHEN 0 THEN '1' WHEN 1 THEN '1.1' WHEN 2 THEN '1.1.1.' END AS number, 'T' || ord AS title, CASE n % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END AS depth FROM l0),
k AS (SELECT *, {", ".join(f"last_value(CASE WHEN depth <= {i} THEN struct_pack(d := depth, t := title) END IGNORE NULLS) OVER w AS h{i}" for i in (1, 2, 3))} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT doc_id, ord, array_to_string(list_filter([{", ".join(f"CASE WHEN depth >= {i} AND h{i}.d = {i} THEN h{i}.t END" for i in (1, 2, 3))}], lambda x: x IS NOT NULL), '>') AS path FROM k""")
def numbered_paths(spark: SparkSession, d: str) -> DataFrame:
    """The headings above each, by its number."""
    n = F.col("n") % 4
    h = _lines(spark, d).select(F.col("doc").alias("doc_id"), "ord", F.when(n == 0, "1").when(n == 1, "1.1").when(n == 2, "1.1.1.").alias("number"), F.concat(F.lit("T"), F.col("ord").cast("string")).alias("title"))
    return captions.numbered_paths(h).withColumn("path", F.array_join("path", ">"))


# ---- layout ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES_SQL}, s AS (SELECT doc, 8.0::DOUBLE + n % 3 AS size, sum(CASE WHEN length(left(whole, 80)) >= 45 THEN length(left(whole, 80)) ELSE 0 END) AS long, sum(length(left(whole, 80))) AS total FROM l0 GROUP BY ALL)
SELECT doc AS doc_id, size FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY long DESC, total DESC, size) = 1""")
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    l = _lines(spark, d).select(F.col("doc").alias("doc_id"), F.left("whole", F.lit(80)).alias("text"), (8.0 + F.col("n") % 3).alias("size"))  # noqa: E741
    return layout.body_size(l)


@query(f"""WITH {_LINES_SQL}, e AS (SELECT doc, page, unnest(['running head ' || page, 'only ' || doc || ord, left(whole, 30)]) AS text, unnest([5.0, 795.0, 400.0]) AS y0 FROM l0), n AS (SELECT doc, count(DISTINCT page) AS n FROM e GROUP BY doc),
t AS (SELECT doc, trim(regexp_replace(lower(text), '\\d+', '#', 'g')) AS text, count(DISTINCT page) AS pages FROM e WHERE y0 + 10 < 96 OR y0 > 704 GROUP BY ALL) SELECT doc AS doc_id, text, pages FROM t JOIN n USING (doc) WHERE text <> '' AND pages >= 2 AND pages >= 0.5 * n""")
def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """Heads and feet of pages, with a head on each."""
    every = F.array(F.struct(F.concat(F.lit("running head "), F.col("page").cast("string")).alias("text"), F.lit(5.0).alias("y0")), F.struct(F.concat(F.lit("only "), "doc", F.col("ord").cast("string")).alias("text"), F.lit(795.0).alias("y0")), F.struct(F.left("whole", F.lit(30)).alias("text"), F.lit(400.0).alias("y0")))
    l = _lines(spark, d).select(F.col("doc").alias("doc_id"), "page", F.explode(every).alias("e")).select("doc_id", "page", "e.*")  # noqa: E741
    return layout.running_lines(l.withColumns({"y1": F.col("y0") + 10, "page_h": F.lit(800.0)}))


_EDGES_SQL = "b AS (SELECT DISTINCT ON (table_uid) paper_id AS doc_id, pdf_span.page AS page, table_uid, least(pdf_span.x0, pdf_span.x1) AS a, greatest(pdf_span.x0, pdf_span.x1) AS b, pdf_span.y0 AS pos FROM paper_tables WHERE pdf_span IS NOT NULL AND paper_id IS NOT NULL), s AS (SELECT doc_id, page, floor(pos / 2) * 2 AS pos, a, b FROM b UNION ALL SELECT doc_id, page, floor(pos / 2) * 2, b + 0.5, b + 40 FROM b UNION ALL SELECT doc_id, page, floor((pos + 90) / 2) * 2, a, b FROM b UNION ALL SELECT doc_id, page, floor((pos + 400) / 2) * 2, a, b FROM b)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "paper_tables").filter("pdf_span IS NOT NULL AND paper_id IS NOT NULL").dropDuplicates(["table_uid"])
    b = t.select(F.col("paper_id").alias("doc_id"), F.col("pdf_span.page").alias("page"), F.lit("h").alias("kind"), F.col("pdf_span.y0").alias("pos"), F.least("pdf_span.x0", "pdf_span.x1").alias("a"), F.greatest("pdf_span.x0", "pdf_span.x1").alias("b"))
    two = b.withColumns({"a": F.col("b") + 0.5, "b": F.col("b") + 40})
    return b.unionByName(two).unionByName(b.withColumn("pos", F.col("pos") + 90)).unionByName(b.withColumn("pos", F.col("pos") + 400))


@query(f"""WITH {_EDGES_SQL}, e AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page, pos ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s), g AS (SELECT *, sum(CASE WHEN upto IS NULL OR a > upto + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, pos ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT doc_id, page, CAST(pos AS BIGINT) AS pos, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, page, pos, g""")
def merged_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that lie on one line and touch, as one."""
    return layout.merged_intervals(_edges(spark, d)).select("doc_id", "page", F.col("pos").cast("long").alias("pos"), "a", "b")


@query(f"""WITH {_EDGES_SQL}, p AS (SELECT DISTINCT doc_id, page, pos FROM s), g AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id, page ORDER BY pos) AS gap FROM p), m AS (SELECT doc_id, page, quantile_disc(gap, 0.5) AS median FROM g GROUP BY ALL)
SELECT g.doc_id, g.page, CAST(pos AS BIGINT) AS pos, CAST(sum(CASE WHEN gap > greatest(3.5 * median, 60) THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id, g.page ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g JOIN m USING (doc_id, page)""")
def rule_parts(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a page, parted at large gaps."""
    e = _edges(spark, d).withColumn("pos", F.floor(F.col("pos") / 2) * 2)
    return layout.large_gaps(e).select("doc_id", "page", F.col("pos").cast("long").alias("pos"), "part")


@query(f"""WITH {_LINES_SQL} SELECT doc, ord, trim(trim(left(whole, 20)) || CASE WHEN n % 3 = 0 THEN ' mg12' ELSE '' END) AS text, CASE WHEN n % 2 = 0 THEN '12,13' ELSE '' END AS cited FROM l0""")
def superscripts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of spans, with citations raised behind some and small letters behind others."""
    n = F.col("n")
    span = lambda k, t, size: F.struct(F.lit(k).alias("k"), t.alias("text"), F.lit(size).alias("size"))
    spans = F.array(span(0, F.trim(F.left("whole", F.lit(20))), 10.0), span(1, F.when(n % 2 == 0, "12,13").otherwise(""), 6.0), span(2, F.when(n % 3 == 0, " mg12").otherwise(""), 6.0))
    s = _lines(spark, d).select("doc", "ord", F.explode(F.filter(spans, lambda x: x["text"] != "")).alias("s")).select("doc", "ord", "s.*", F.lit(None).cast("boolean").alias("raised"))
    every = _lines(spark, d).select("doc", "ord")
    got = pages.line_text(s, 10.0)
    return every.join(got, ["doc", "ord"], "left").select("doc", "ord", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("cited", F.lit("")).alias("cited"))


@query(rf"""WITH {_ROWS_SQL}, a AS (SELECT table_uid, row, c FROM w UNION ALL SELECT table_uid, 1000 + k, CASE k WHEN 0 THEN ['* P below 0.05', ''] WHEN 1 THEN ['UVB, light of a kind', ''] ELSE ['', 'https://a.b/c'] END FROM (SELECT DISTINCT table_uid FROM w), (VALUES (0), (1), (2)) AS v(k) WHERE length(table_uid) + k > 0),
o AS (SELECT *, list_filter(c, lambda x: trim(x) <> '') AS f FROM a), s AS (SELECT *, len(f) = 1 AND (regexp_matches(trim(f[1]), '(?i)^(https?://|doi:|www\.)\S+$') OR regexp_matches(trim(f[1]), '^[*†‡§¶]|^[a-z]\)?\s[A-Z]') OR regexp_matches(trim(f[1]), '\b[A-Z]{{2,6}}\s?[,=:]\s')) AS sign FROM o),
z AS (SELECT table_uid, coalesce(max(CASE WHEN NOT coalesce(sign, false) THEN row END), -1) AS last FROM s GROUP BY table_uid) SELECT table_uid AS "table", CAST(row AS INT) AS row, CASE WHEN row > last THEN trim(f[1]) END AS note FROM s JOIN z USING (table_uid)""")
def table_notes(spark: SparkSession, d: str) -> DataFrame:
    """Rows at the end of tables that are notes, three put to each."""
    r = tables.grid(read(spark, d, "paper_tables")).groupBy(F.col("table_uid").alias("table"), "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("cells"))
    notes = F.array(*[F.struct(F.lit(1000 + k).alias("row"), F.array(F.lit(a), F.lit(b)).alias("cells")) for k, (a, b) in enumerate((("* P below 0.05", ""), ("UVB, light of a kind", ""), ("", "https://a.b/c")))])
    return pages.without_notes(r.unionByName(r.select("table").distinct().select("table", F.explode(notes).alias("x")).select("table", "x.*")))
