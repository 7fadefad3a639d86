"""Named queries over pages, references and signs of print, with SQL: lines, boxes and lists are made of the standard tables,
all of their rows, with what each rule looks for dealt out by the lengths of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import signs as S
from papercairn.functions import text as X
from papercairn.operators import captions, pages, references, retrieval
from papercairn.plans.queries import _probe_queries, indexed, query
from papercairn.tables import kept, read

_LINES_SQL = """
pg AS (SELECT DISTINCT ON (par_uid) paper_id AS doc, sec_ord AS page, par_uid, coalesce(text, '') AS whole, length(coalesce(text, '')) AS n FROM paragraphs WHERE paper_id IS NOT NULL),
l0 AS (SELECT doc, page, whole, n, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, par_uid) - 1 AS INT) AS ord FROM pg)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """doc, page, ord, whole (a paragraph's text as one line), n (its length)."""
    p = read(spark, d, "paragraphs").filter("paper_id IS NOT NULL").dropDuplicates(["par_uid"])
    t = F.coalesce("text", F.lit(""))
    w = W.partitionBy("doc").orderBy("page", "par_uid")
    return p.select(F.col("paper_id").alias("doc"), F.col("sec_ord").alias("page"), "par_uid", t.alias("whole"), F.char_length(t).alias("n")).withColumn("ord", F.row_number().over(w) - 1).drop("par_uid")


@query(f"""WITH {_LINES_SQL}, b AS (SELECT doc, page, ord, CASE WHEN n % 3 = 0 THEN (ord % 2) * 120.0::DOUBLE ELSE 0 END AS x0, (ord // 2) * 14.0::DOUBLE AS y0 FROM l0), l AS (SELECT *, x0 + 100 AS x1, y0 + 10 AS y1 FROM b),
h AS (SELECT a.doc, a.ord AS o1, b.ord AS o2 FROM l a JOIN l b ON a.doc = b.doc AND a.page = b.page AND (b.y0 > a.y0 OR b.y0 = a.y0 AND b.ord > a.ord) AND b.y0 < a.y1 - greatest(1, a.y1 - a.y0) * 0.5 AND (b.x0 > a.x1 + 1 OR b.x1 < a.x0 - 1))
SELECT doc, ord, NOT EXISTS (SELECT 1 FROM h WHERE h.doc = l.doc AND (o1 = ord OR o2 = ord)) AS alone FROM l""")
def lines_alone(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    l = _lines(spark, d).withColumns({"col": F.lit(0), "x0": F.when(n % 3 == 0, (F.col("ord") % 2) * 120.0).otherwise(0.0), "y0": F.floor(F.col("ord") / 2) * 14.0})  # noqa: E741
    return pages.alone(l.withColumns({"x1": F.col("x0") + 100, "y1": F.col("y0") + 10})).select("doc", "ord", "alone")


_STARTS_SQL = f"""{_LINES_SQL}, l AS (SELECT doc, page, ord, CAST(ord // 5 % 2 AS INT) AS col, CASE WHEN n % 4 = 0 THEN 12.0::DOUBLE ELSE 0 END AS x0, ord * 12.0::DOUBLE + CASE WHEN n % 7 = 0 THEN 9 ELSE 0 END AS y0, CASE WHEN n % 3 = 0 THEN left(whole, 30) || '-' ELSE left(whole, 60) END AS text FROM l0),
v AS (SELECT *, lag(col) OVER w AS pc, lag(x0) OVER w AS px, lag(y0 + 10) OVER w AS py, lag(text) OVER w AS pt FROM l WINDOW w AS (PARTITION BY doc, page ORDER BY ord)),
s AS (SELECT *, pc IS NULL OR col <> pc OR (y0 >= py - 1 AND (y0 - py > 7 OR (x0 - px > 8 AND regexp_matches(rtrim(pt), '[.:?]$')))) AS starts FROM v),
g AS (SELECT *, CAST(sum(starts::INT) OVER (PARTITION BY doc, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS INT) AS paragraph FROM s)"""


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    l = _lines(spark, d).withColumns({"col": (F.floor(F.col("ord") / 5) % 2).cast("int"), "x0": F.when(n % 4 == 0, 12.0).otherwise(0.0), "y0": F.col("ord") * 12.0 + F.when(n % 7 == 0, 9).otherwise(0)})  # noqa: E741
    l = l.withColumns({"y1": F.col("y0") + 10, "text": F.when(n % 3 == 0, F.concat(F.left("whole", F.lit(30)), F.lit("-"))).otherwise(F.left("whole", F.lit(60)))})  # noqa: E741
    return pages.paragraph_starts(l, 10.0)


@query(f"WITH {_STARTS_SQL} SELECT doc, page, ord, starts, paragraph FROM g")
def paragraph_starts(spark: SparkSession, d: str) -> DataFrame:
    return _page_lines(spark, d).select("doc", "page", "ord", "starts", "paragraph")


@query(rf"""WITH {_STARTS_SQL}, j AS (SELECT doc, page, paragraph, string_agg(trim(text), chr(10) ORDER BY ord) AS t FROM g WHERE trim(text) <> '' GROUP BY ALL),
k AS (SELECT doc, page, paragraph, replace(regexp_replace(t, '(^|[^ -])-\n(\p{{Ll}})', '\1\2', 'g'), chr(10), ' ') AS text FROM j) SELECT * FROM k WHERE length(text) >= 40""")
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.joined_paragraphs(_page_lines(spark, d))


_SIGN_SQL = r"(regexp_matches({0}, '\b(19|20)\d\d;\s?\d+') OR regexp_matches({0}, '\bet al\b') OR regexp_matches({0}, '\b10\.\d{{4,9}}/') OR regexp_matches({0}, '^\s*\[?\d{{1,3}}[.\])]\s+[A-Z]') OR regexp_matches({0}, '\b[A-Z][a-z]+ [A-Z]{{1,3}}[,.]'))"


@query(rf"""WITH {_LINES_SQL}, z AS (SELECT *, count(*) OVER (PARTITION BY doc) AS total FROM l0),
l AS (SELECT doc, ord, total, CASE WHEN ord >= 0.6 * total AND ord < 0.9 * total THEN ord || '. Smith AB, et al. The fold. J. 2019;12:3' WHEN ord + 1 >= 0.6 * total AND ord < 0.6 * total AND total % 2 = 0 THEN 'References' ELSE 'the fold ' || n END AS text FROM z WHERE total >= 20),
s AS (SELECT *, {_SIGN_SQL.format('text')}::INT AS sign, regexp_matches(text, '^\s*\[?\d{{1,3}}[.\])]\s+[A-Z]')::INT AS item FROM l),
c AS (SELECT *, coalesce(sum(sign) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING), 0) AS s12, sum(sign) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS s25, sum(item) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS i25, sum(sign) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s20 FROM s),
f AS (SELECT doc, any_value(total) AS total, coalesce(min(ord) FILTER (ord >= floor(total * 0.35) AND text = 'References' AND s12 >= 4), min(ord) FILTER (ord >= floor(total * 0.35) AND item = 1 AND i25 >= 4 AND s25 >= 6)) AS first FROM c GROUP BY doc)
SELECT f.doc, CAST(first AS INT) AS first, CAST(coalesce((SELECT min(ord) FROM c WHERE c.doc = f.doc AND ord > first AND f.total - ord >= 25 AND s20 < 2) - 1, f.total - 1) AS INT) AS last FROM f WHERE first IS NOT NULL""")
def reference_zones(spark: SparkSession, d: str) -> DataFrame:
    """Where the list of references begins and ends: in papers whose later lines are made references, some with a heading."""
    l = _lines(spark, d)  # noqa: E741
    l = l.join(l.groupBy("doc").agg(F.count(F.lit(1)).alias("total")), "doc")  # noqa: E741
    o, total = F.col("ord"), F.col("total")
    text = F.when((o >= 0.6 * total) & (o < 0.9 * total), F.concat(o.cast("string"), F.lit(". Smith AB, et al. The fold. J. 2019;12:3"))).when((o + 1 >= 0.6 * total) & (o < 0.6 * total) & (total % 2 == 0), "References").otherwise(F.concat(F.lit("the fold "), F.col("n").cast("string")))
    return pages.reference_zone(l.select("doc", "ord", text.alias("text")))


@query(rf"""WITH {_LINES_SQL}, l AS (SELECT doc, ord, ord // 6 AS block, CASE n % 9 WHEN 0 THEN 'Smith A | Jones B' WHEN 1 THEN 'A. Stone MD, B. Reed PhD' WHEN 2 THEN 'Received 3 May' ELSE left(whole, 140) END AS text FROM l0),
o AS (SELECT *, text IN ('Smith A | Jones B', 'A. Stone MD, B. Reed PhD', 'Received 3 May') OR regexp_matches(text, '(?i)^\s*(received|accepted|correspond|funding|conflicts? of interest|©|copyright)\b')
  OR contains(text, ',') AND len(regexp_extract_all(text, '\b(MD|PhD|MSc|MPH|MBBS|BSc|DO|RN|DrPH)\b')) >= 2 AS own FROM l),
b AS (SELECT doc, block, count(*) AS n, sum(length(text)) AS chars, min(ord) FILTER (own) AS first FROM o GROUP BY ALL)
SELECT doc, ord FROM o JOIN b USING (doc, block) WHERE own OR (n <= 12 AND chars <= 700 AND ord >= first)""")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of front matter, and those behind them in small blocks."""
    n = F.col("n")
    text = F.when(n % 9 == 0, "Smith A | Jones B").when(n % 9 == 1, "A. Stone MD, B. Reed PhD").when(n % 9 == 2, "Received 3 May").otherwise(F.left("whole", F.lit(140)))
    return pages.front_matter(_lines(spark, d).select("doc", "ord", F.floor(F.col("ord") / 6).alias("block"), text.alias("text")))


_FIG_SQL = "f0 AS (SELECT paper_id AS doc, figure_uid, id, caption, length(coalesce(caption, '')) AS n, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY figure_uid) AS INT) AS k FROM (SELECT DISTINCT ON (figure_uid) * FROM paper_figures) WHERE paper_id IS NOT NULL)"


def _figures(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "paper_figures").filter("paper_id IS NOT NULL").dropDuplicates(["figure_uid"])
    return f.select(F.col("paper_id").alias("doc"), "figure_uid", "id", "caption", F.char_length(F.coalesce("caption", F.lit(""))).alias("n")).withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy("figure_uid")))


@query(f"""WITH {_FIG_SQL}, i AS (SELECT doc, k AS page, n % 3 AS image, (n % 3) * 50 + (n % 2) * 4.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, CASE WHEN n % 3 = 2 THEN 900 ELSE 40 END AS side FROM f0),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM i GROUP BY doc), a AS (SELECT doc, image, count(DISTINCT page) AS on_pages, max(round(x0)) - min(round(x0)) AS dx, max(side * side) AS area FROM i GROUP BY ALL)
SELECT doc, CAST(image AS INT) AS image FROM a JOIN p USING (doc) WHERE on_pages >= 2 AND ((dx <= 6 AND area < 0.25 * 595.0 * 842.0) OR (on_pages >= greatest(2, ceil(pages * 0.5)) AND area < 6000))""")
def ornaments(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    i = _figures(spark, d).select("doc", F.col("k").alias("page"), (n % 3).alias("image"), ((n % 3) * 50 + (n % 2) * 4.0).alias("x0"), F.lit(20.0).alias("y0"), F.when(n % 3 == 2, 900.0).otherwise(40.0).alias("side"))
    return pages.ornaments(i.withColumns({"x1": F.col("x0") + F.col("side"), "y1": F.col("y0") + F.col("side")}).drop("side"))


@query(f"""WITH {_FIG_SQL}, p AS (SELECT doc, figure_uid, k * 60.0::DOUBLE + (n % 5) * 40 AS y0 FROM f0), q AS (SELECT *, y0 + 20 AS y1 FROM p),
g AS (SELECT *, coalesce(min(y0) OVER (PARTITION BY doc ORDER BY y1 DESC, figure_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - y1 > 96, false) AS far FROM q),
c AS (SELECT *, sum(far::INT) OVER (PARTITION BY doc ORDER BY y1 DESC, figure_uid ROWS UNBOUNDED PRECEDING) AS cut FROM g) SELECT doc AS region, figure_uid AS piece, y0, y1 FROM c WHERE cut = 0""")
def grown_pieces(spark: SparkSession, d: str) -> DataFrame:
    p = _figures(spark, d).select(F.col("doc").alias("region"), F.col("figure_uid").alias("piece"), (F.col("k") * 60.0 + (F.col("n") % 5) * 40).alias("y0"))
    return pages.grown(p.withColumn("y1", F.col("y0") + 20))


_BOX_SQL = "b AS (SELECT DISTINCT ON (table_uid) paper_id AS doc, pdf_span.page AS page, table_uid AS uid, least(pdf_span.x0, pdf_span.x1) AS x0, greatest(pdf_span.x0, pdf_span.x1) AS x1, least(pdf_span.y0, pdf_span.y1) AS y0, greatest(pdf_span.y0, pdf_span.y1) AS y1 FROM paper_tables WHERE pdf_span IS NOT NULL AND paper_id IS NOT NULL), s AS (SELECT doc, page, x0, x1, y1 + 30 AS y0, y1 + 40 AS y1 FROM b UNION ALL SELECT doc, page, x0, x1, y0 - 50, y0 - 40 FROM b)"


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = read(spark, d, "paper_tables").filter("pdf_span IS NOT NULL AND paper_id IS NOT NULL").dropDuplicates(["table_uid"])
    s = "pdf_span."
    b = t.select(F.col("paper_id").alias("doc"), F.col(s + "page").alias("page"), F.col("table_uid").alias("uid"), F.least(s + "x0", s + "x1").alias("x0"), F.greatest(s + "x0", s + "x1").alias("x1"), F.least(s + "y0", s + "y1").alias("y0"), F.greatest(s + "y0", s + "y1").alias("y1"))
    below = b.select("doc", "page", "x0", "x1", (F.col("y1") + 30).alias("y0"), (F.col("y1") + 40).alias("y1"))
    return b, below.unionByName(b.select("doc", "page", "x0", "x1", (F.col("y0") - 50).alias("y0"), (F.col("y0") - 40).alias("y1")))


@query(f"WITH {_BOX_SQL} SELECT b.doc, b.page, uid, min(s.y0) AS stop FROM b LEFT JOIN s ON b.doc = s.doc AND b.page = s.page AND s.y0 >= b.y1 AND s.x0 < b.x1 AND s.x1 > b.x0 GROUP BY ALL")
def region_stops(spark: SparkSession, d: str) -> DataFrame:
    return pages.next_stop(*_boxes(spark, d))


@query(f"""WITH {_BOX_SQL} SELECT b.doc, b.page, uid, max(CASE WHEN s.y1 <= b.y0 THEN s.y1 END) AS above, min(CASE WHEN s.y0 >= b.y1 THEN s.y0 END) AS below FROM b LEFT JOIN s ON b.doc = s.doc AND b.page = s.page AND greatest(0, least(b.x1, s.x1) - greatest(b.x0, s.x0)) >= 0.45 * (b.x1 - b.x0) GROUP BY ALL""")
def figure_barriers(spark: SparkSession, d: str) -> DataFrame:
    return pages.barriers(*_boxes(spark, d))


@query(f"""WITH {_BOX_SQL}, k AS (SELECT doc, page, x0, x1, y0, CASE WHEN length(uid) % 2 = 0 THEN y0 + 0.5 ELSE y1 END AS y1, CASE WHEN right(uid, 1) IN ('0', '2', '4') THEN 'line' ELSE 'box' END AS kind FROM b UNION ALL SELECT doc, page, x0, x1, y1, y1 + 2, 'box' FROM b UNION ALL SELECT doc, page, x0, x0 + 0.5, y0, y1, 'line' FROM b),
r AS (SELECT *, CASE WHEN y1 - y0 <= CASE WHEN kind = 'line' THEN 0.8 ELSE 3 END AND x1 - x0 >= 20 THEN 'h' WHEN x1 - x0 <= CASE WHEN kind = 'line' THEN 0.8 ELSE 3 END AND y1 - y0 >= 20 THEN 'v' END AS way FROM k)
SELECT doc, page, way, CASE WHEN way = 'h' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS at, CASE WHEN way = 'h' THEN x0 ELSE y0 END AS low, CASE WHEN way = 'h' THEN x1 ELSE y1 END AS high FROM r WHERE way IS NOT NULL""")
def page_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules among the edges of tables, drawn as lines and as thin boxes."""
    b, _ = _boxes(spark, d)
    one = b.select("doc", "page", "x0", "x1", "y0", F.when(F.char_length("uid") % 2 == 0, F.col("y0") + 0.5).otherwise(F.col("y1")).alias("y1"), F.when(F.right("uid", F.lit(1)).isin("0", "2", "4"), "line").otherwise("box").alias("kind"))
    two = b.select("doc", "page", "x0", "x1", F.col("y1").alias("y0"), (F.col("y1") + 2).alias("y1"), F.lit("box").alias("kind"))
    three = b.select("doc", "page", "x0", (F.col("x0") + 0.5).alias("x1"), "y0", "y1", F.lit("line").alias("kind"))
    return pages.rules(one.unionByName(two).unionByName(three))


@query(f"WITH {_BOX_SQL}, m AS (SELECT uid, x0, y0, x1, y1, length(uid || doc) % 3 AS m FROM b) SELECT uid, CASE m WHEN 1 THEN -y1 WHEN 2 THEN y0 ELSE x0 END AS x0, CASE m WHEN 1 THEN x0 WHEN 2 THEN -x1 ELSE y0 END AS y0, CASE m WHEN 1 THEN -y0 WHEN 2 THEN y1 ELSE x1 END AS x1, CASE m WHEN 1 THEN x1 WHEN 2 THEN -x0 ELSE y1 END AS y1 FROM m")
def turned_boxes(spark: SparkSession, d: str) -> DataFrame:
    b, _ = _boxes(spark, d)
    mode = F.char_length(F.concat("uid", "doc")) % 3
    return b.select("uid", pages.turned(F.struct("x0", "y0", "x1", "y1"), mode).alias("box")).select("uid", "box.*")


@query(rf"""WITH {_FIG_SQL}, s AS (SELECT doc, figure_uid, substr(regexp_replace(doc, '[^-_.\p{{L}}\p{{N}}]', '_', 'g'), 1, 80) || '_figs' AS folder, coalesce(id, 'fig') AS id0, id, CASE WHEN n % 3 > 0 THEN 'fig' || CASE WHEN n % 2 = 0 THEN 'S' ELSE '' END || (n % 3) ELSE substr(regexp_replace(coalesce(id, 'fig'), '[^-_.\p{{L}}\p{{N}}]', '_', 'g'), 1, 60) END AS stem FROM f0),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY id) AS k FROM s) SELECT folder, CASE WHEN k = 1 THEN stem ELSE stem || '_' || k END AS name FROM r""")
def figure_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    f = _figures(spark, d).select(F.col("doc").alias("paper_id"), "id", F.when(n % 3 > 0, n % 3).alias("number"), (n % 2 == 0).alias("supplementary"))
    return pages.figure_names(f).select("folder", "name")


@query(f"WITH {_LINES_SQL} SELECT doc, ord, CASE WHEN n % 2 = 0 THEN translate(left(whole, 100), 'abct', 'αβχτ') ELSE left(whole, 100) END AS text FROM l0")
def glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Texts of two fonts, one of them with a map of its glyphs."""
    maps = spark.createDataFrame([("Symbol", "a", "α"), ("Symbol", "b", "β"), ("symbol", "c", "χ"), ("ABCDEF+Symbol", "t", "τ")], "font string, code string, printed string")
    l = _lines(spark, d).select("doc", "ord", F.when(F.col("n") % 2 == 0, "XYZABC+Symbol").otherwise("Times").alias("font"), F.left("whole", F.lit(100)).alias("text"))  # noqa: E741
    return pages.glyphs(l, maps).select("doc", "ord", "text")


@query(r"""WITH p AS (SELECT DISTINCT text FROM paragraphs WHERE text IS NOT NULL), q AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{2,}-[A-Za-z]{2,}'))) AS p FROM p),
s AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(text, '[A-Za-z]{2,}-[A-Za-z]{2,}', ' ', 'g')), '[a-z]{6,}')) AS word FROM p), w AS (SELECT DISTINCT replace(p, '-', '') AS word FROM q UNION SELECT word FROM s)
SELECT word, arg_min(p, instr(p, '-')) AS restored FROM w JOIN q ON replace(q.p, '-', '') = word WHERE regexp_matches(word, '^[a-z]{6,}$') AND word NOT IN (SELECT word FROM s) GROUP BY word""")
def rehyphenated(spark: SparkSession, d: str) -> DataFrame:
    """Words as they would be without their hyphens, with those the paragraphs print."""
    p = read(spark, d, "paragraphs").filter("text IS NOT NULL").select("text").distinct()
    pair = r"([A-Za-z]{2,}-[A-Za-z]{2,})"
    joined = p.select(F.explode(F.transform(F.regexp_extract_all("text", F.lit(pair), 1), lambda x: F.lower(F.replace(x, F.lit("-"), F.lit(""))))).alias("word"))
    solid = p.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1)).alias("word"))
    return pages.rehyphenated(joined.union(solid), p)


_CAPS_SQL = r"""
c AS (SELECT DISTINCT paper_id, uid, kind, caption, CASE WHEN regexp_matches(x, '^\d+$') THEN CAST(x AS INT) WHEN x <> '' THEN nullif(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV'], upper(x)), 0) END AS number
  FROM (SELECT paper_id, uid, kind, caption, regexp_extract(caption, '(?i)^\s*(?:table|tab|figure|fig)\.?\s*(\d{1,3}|[ivx]{1,4})\b', 1) AS x FROM (SELECT paper_id, table_uid AS uid, 'table' AS kind, caption FROM paper_tables UNION SELECT paper_id, figure_uid, 'figure', caption FROM paper_figures)) WHERE paper_id IS NOT NULL),
i AS (SELECT paper_id, kind, number, CASE WHEN length(uid || caption) % 5 = 0 THEN NULL WHEN length(uid || caption) % 5 = 1 THEN left(caption, 20) ELSE caption END AS caption FROM c WHERE number IS NOT NULL AND length(caption) % 4 <> 0 UNION ALL SELECT paper_id, kind, number + 50, caption FROM c WHERE number IS NOT NULL AND length(caption) % 9 = 0)"""


def _floats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The captions of tables and figures, and a paper's items with some captions lost or cut, some missing, some too many."""
    c = captions.floats(read(spark, d, "paper_tables"), read(spark, d, "paper_figures")).filter("paper_id IS NOT NULL")
    n, m = F.char_length("caption"), F.char_length(F.concat("uid", "caption"))
    some = c.filter("number IS NOT NULL")
    held = some.filter(n % 4 != 0).select("paper_id", "kind", "number", F.when(m % 5 == 0, None).when(m % 5 == 1, F.left("caption", F.lit(20))).otherwise(F.col("caption")).alias("caption"))
    return held.unionByName(some.filter(n % 9 == 0).select("paper_id", "kind", (F.col("number") + 50).alias("number"), "caption")), c


@query(f"""WITH {_CAPS_SQL}, a AS (SELECT paper_id, kind, number, count(*) AS n, max(trim(coalesce(caption, ''))) AS held FROM i GROUP BY ALL), p AS (SELECT DISTINCT paper_id, kind, number, 1 AS printed FROM c WHERE number IS NOT NULL)
SELECT paper_id, kind, number, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN printed IS NULL THEN 'extra' WHEN held = '' THEN 'empty' ELSE 'ok' END AS state FROM a FULL JOIN p USING (paper_id, kind, number)""")
def floats_audit(spark: SparkSession, d: str) -> DataFrame:
    return pages.floats_audit(*_floats(spark, d))


@query(f"""WITH {_CAPS_SQL}, o AS (SELECT paper_id, kind, number, max(caption) AS printed FROM c WHERE number IS NOT NULL GROUP BY ALL HAVING count(DISTINCT caption) = 1), h AS (SELECT paper_id, kind, number, max(caption) AS held, true AS there FROM i GROUP BY ALL),
x AS (SELECT paper_id, kind, number, held, printed, CASE WHEN there IS NULL THEN 'added' WHEN trim(coalesce(held, '')) = '' AND trim(coalesce(printed, '')) <> '' THEN 'filled' WHEN trim(coalesce(printed, '')) <> '' AND trim(coalesce(held, '')) <> trim(printed) AND starts_with(trim(printed), trim(coalesce(held, ''))) THEN 'replaced' ELSE 'kept' END AS action FROM h FULL JOIN o USING (paper_id, kind, number))
SELECT paper_id, kind, number, CASE WHEN action = 'kept' THEN held ELSE printed END AS caption, action FROM x""")
def repaired_floats(spark: SparkSession, d: str) -> DataFrame:
    return pages.repaired_floats(*_floats(spark, d))


@query(f"""WITH {_CAPS_SQL} SELECT DISTINCT paper_id, number, caption FROM c WHERE number IS NOT NULL AND kind = 'table' AND NOT regexp_matches(caption, '(?i)\\bcont(inued|\\.|d\\.?)')
AND NOT EXISTS (SELECT 1 FROM i WHERE i.kind = 'table' AND i.paper_id = c.paper_id AND i.number = c.number) AND length(uid || caption) % 6 <> 0""".replace("\\\\b", "\\b").replace("\\\\.", "\\."))
def discovered_tables(spark: SparkSession, d: str) -> DataFrame:
    items, c = _floats(spark, d)
    t = c.filter("kind = 'table'")
    foreign = t.filter(F.char_length(F.concat("uid", "caption")) % 6 == 0)
    return pages.discovered(t.join(foreign.select("uid"), "uid", "left_anti").select("paper_id", "number", "caption"), items.filter("kind = 'table'"), foreign)


# ---- references ------------------------------------------------------------------------------------------------------

_TITLES_SQL = "t AS (SELECT paper_id, min(meta.title) AS title, length(coalesce(min(meta.title), '')) AS n, min(source) AS source, min(meta.year) AS year FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id)"


def _titles(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "papers").filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("meta.title").alias("title"), F.min("source").alias("source"), F.min("meta.year").alias("year"))
    return t.withColumn("n", F.char_length(F.coalesce("title", F.lit(""))))


@query(f"WITH {_TITLES_SQL} SELECT paper_id, n % 5 = 0 AND n >= 12 AS corrupt, CASE WHEN NOT (n % 5 = 0 AND n >= 12) THEN title END AS title, CASE WHEN NOT (n % 5 = 0 AND n >= 12) THEN year END AS year FROM t")
def distrusted_references(spark: SparkSession, d: str) -> DataFrame:
    """References of which a fifth have another paper's printed text."""
    raw = F.when(F.col("n") % 5 == 0, "Qwx ZZ. Uvvy jjk qpp vvuu zyx. 1999;1:1").otherwise(F.concat(F.lit("Smith AB. "), F.col("title"), F.lit(". J Notes 2019;3:4")))
    return references.distrusted(_titles(spark, d).withColumn("raw", raw)).select("paper_id", "corrupt", "title", "year")


@query(f"""WITH {_LINES_SQL}, z AS (SELECT doc AS paper_id, ord AS pos, count(*) OVER (PARTITION BY doc) AS total, n FROM l0), p AS (SELECT *, pos >= 3 AND n % 9 <> 0 AS paired, total - 3 AS listed, total - 4 AS highest FROM z),
a AS (SELECT paper_id, count(*) AS n, count(*) FILTER (paired) AS hits, min(pos) FILTER (paired) AS lo, max(pos) FILTER (paired) AS hi, max(listed) AS listed, max(highest) AS highest FROM p GROUP BY paper_id),
s AS (SELECT *, unnest([0, 1, 2]) AS k FROM a WHERE n >= 5 AND hits >= 3 AND highest >= 2 AND listed >= 3 AND n > highest), r AS (SELECT *, CASE WHEN k = 2 THEN 0 ELSE lo END AS a, CASE WHEN k = 1 THEN n ELSE hi + 1 END AS b FROM s),
o AS (SELECT paper_id, a, b FROM r WHERE n - (b - a) >= 2 AND hits >= 0.7 * (b - a) AND highest <= b - a AND abs(b - a - listed) <= greatest(2, 0.4 * listed) QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY k) = 1)
SELECT p.paper_id, pos, CASE WHEN o.a IS NULL OR (pos >= a AND pos < b) THEN CAST(pos + 1 - coalesce(a, 0) AS INT) END AS number, o.a IS NOT NULL AND (pos < a OR pos >= b) AS foreign FROM p LEFT JOIN o USING (paper_id)""".replace("AS foreign FROM", 'AS "foreign" FROM'))
def foreign_references(spark: SparkSession, d: str) -> DataFrame:
    """Lists whose first three references are another paper's."""
    l = _lines(spark, d)  # noqa: E741
    total = l.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    p = l.join(total, "doc").select(F.col("doc").alias("paper_id"), F.col("ord").alias("pos"), ((F.col("ord") >= 3) & (F.col("n") % 9 != 0)).alias("paired"), (F.col("total") - 3).alias("listed"), (F.col("total") - 4).alias("highest"))
    return references.foreign_block(p)


@query(f"WITH {_TITLES_SQL} SELECT paper_id, CAST(CASE WHEN n % 3 <> 0 THEN n % 3 END AS INT) AS number FROM t WHERE n % 3 <> 0 OR n % 2 = 0")
def references_without_debris(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    r = _titles(spark, d).select("paper_id", F.when(n % 3 != 0, n % 3).alias("number"), F.when(n % 2 != 0, "JAMA 2017;3:4").alias("raw"))
    return references.without_debris(r).select("paper_id", F.col("number").cast("int").alias("number"))


@query(r"""WITH m AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(x)), '^(https?://)?(dx\.)?(doi\.org/)?(doi:\s*)?', ''), '/+', '/', 'g') AS doi FROM (SELECT unnest(doi_candidates) AS x FROM manifest))
SELECT doi, CASE WHEN length(doi) % 3 = 0 THEN NULL ELSE length(doi) % 3 = 1 END AS exists FROM m""".replace("AS exists FROM", 'AS "exists" FROM'))
def verified_dois(spark: SparkSession, d: str) -> DataFrame:
    """DOIs a registry has, hasn't, or wasn't asked for."""
    m = read(spark, d, "manifest").select(F.explode("doi_candidates").alias("x")).select(X.canonical_doi(F.col("x")).alias("doi")).distinct()
    n = F.char_length("doi") % 3
    return references.verified(m, m.filter(n > 0).select("doi", (n == 1).alias("exists")))


@query(f"""WITH {_TITLES_SQL}, x AS (SELECT paper_id, n, unnest(['pmc_xml', 'grobid', 'pdf_fallback']) AS source, unnest([n % 2, n % 3, 1]) AS paragraphs FROM t)
SELECT paper_id, source, CAST(paragraphs AS INT) AS paragraphs FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN paragraphs > 0 THEN 0 ELSE 1 END, list_position(['pmc_xml', 'grobid', 'pdf_fallback'], source)) AS r FROM x) WHERE r = 1""")
def chosen_sources(spark: SparkSession, d: str) -> DataFrame:
    """Of each paper's three readings the first, in order, that has a body."""
    n = F.col("n")
    every = F.array(*[F.struct(F.lit(s).alias("source"), c.cast("int").alias("paragraphs")) for s, c in (("pmc_xml", n % 2), ("grobid", n % 3), ("pdf_fallback", F.lit(1)))])
    return references.best_source(_titles(spark, d).select("paper_id", F.explode(every).alias("x")).select("paper_id", "x.*"), ["pmc_xml", "grobid", "pdf_fallback"])


@query(f"WITH {_TITLES_SQL} SELECT paper_id FROM t WHERE NOT (n % 4 = 0 AND n % 3 = 0)")
def without_empty(spark: SparkSession, d: str) -> DataFrame:
    t = _titles(spark, d)
    return references.without_empty(t.select("paper_id", (F.col("n") % 4).alias("body_chars")), t.filter(F.col("n") % 3 == 0)).select("paper_id")


@query("""WITH w AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(lower(meta.title), '[a-z]{4,}')) AS name FROM papers WHERE paper_id IS NOT NULL), s AS (SELECT *, length(name) % 10 / 10 AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, name) AS k FROM s WHERE score >= 0.3) SELECT paper_id, array_to_string(list(name ORDER BY k), ',') AS concepts FROM r WHERE k <= 12 GROUP BY paper_id""")
def concepts(spark: SparkSession, d: str) -> DataFrame:
    w = read(spark, d, "papers").filter("paper_id IS NOT NULL").select("paper_id", F.explode(F.regexp_extract_all(F.lower("meta.title"), F.lit("([a-z]{4,})"), 1)).alias("name")).distinct()
    return references.concepts(w.withColumn("score", F.char_length("name") % 10 / 10)).withColumn("concepts", F.array_join("concepts", ","))


# ---- signs -----------------------------------------------------------------------------------------------------------

_PUT_SQL = """CASE n % 12 WHEN 0 THEN 'A. Stone MD, B. Reed PhD, C. Lake MPH' WHEN 1 THEN 'Smith A | Jones B' WHEN 2 THEN 'Ann Stone, Bo Reed' WHEN 3 THEN 'Department of Skin' WHEN 4 THEN 'doi: 10.1000/abc.d.' WHEN 5 THEN '3. Roe AB, Doe C. Title. J 2019;3:4'
WHEN 6 THEN 'RESULTS OF THE STUDY' WHEN 7 THEN 'International, Delphi survey' ELSE left(whole, 120) END"""


@query(rf"""WITH {_LINES_SQL}, t AS (SELECT doc, ord, trim({_PUT_SQL}) AS t FROM l0), w AS (SELECT *, regexp_extract_all(t, '[A-Za-z][A-Za-z''’\-]*') AS w, list_filter(list_transform(regexp_split_to_array(t, '\s*[|,]\s*'), lambda x: trim(x)), lambda x: x <> '') AS p FROM t)
SELECT doc, ord, len(regexp_extract_all(t, '\b(MD|PhD|MSc|MPH|MBBS|BSc|DO|RN|DrPH)\b')) >= 3 AS byline, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) >= 3 AND NOT regexp_matches(regexp_replace(t, '[^\p{{L}}]', '', 'g'), '\p{{Ll}}') AS capitals,
  contains(t, '@') OR regexp_matches(t, '(?i)\b(e-?mail|correspondence|department|university|hospital|college of medicine)\b') OR (len(w) >= 2 AND len(list_filter(w, lambda x: lower(x) IN ('the', 'of', 'and', 'in', 'for', 'with', 'to', 'on', 'by', 'from', 'was', 'were', 'is', 'are', 'an', 'a'))) = 0
    AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.8 * len(w) AND (contains(t, ',') OR regexp_matches(t, '\b(MD|PhD|MSc|MBBS|MPH|iD)\b') OR regexp_matches(t, '\d\s*[,*]'))) AS author,
  length(t) < 160 AND len(p) >= 2 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[A-Z][\w.''’\-]*( [A-Z][\w.''’\-]*){{0,4}}$'))) = 0 AND (contains(t, '|') OR len(p) >= 3 OR len(list_filter(p, lambda x: NOT contains(x, ' '))) = 0) AS list,
  length(t) >= 60 AND len(regexp_split_to_array(t, '\s+')) >= 10 AND length(regexp_replace(t, '\D', '', 'g')) <= 0.12 * length(t) AS prose, regexp_matches(t, '^\s*\[?\d{{1,3}}[.\])]\s+[A-Z]') AS item, {_SIGN_SQL.format('t')} AS sign,
  nullif(regexp_replace(regexp_extract(t, '(?i)^\s*(?:https?://(?:dx\.)?doi\.org/|doi:?\s*)?(10\.\d{{4,9}}/\S+)\s*$', 1), '[.,;]+$', ''), '') AS doi,
  length(t) > 0 AND length(regexp_replace(t, '[^\x{{AC00}}-\x{{D7A3}}]', '', 'g')) > 0.15 * length(t) AS "foreign" FROM w""")
def line_signs(spark: SparkSession, d: str) -> DataFrame:
    """What each line looks like."""
    n = F.col("n") % 12
    put = ["A. Stone MD, B. Reed PhD, C. Lake MPH", "Smith A | Jones B", "Ann Stone, Bo Reed", "Department of Skin", "doi: 10.1000/abc.d.", "3. Roe AB, Doe C. Title. J 2019;3:4", "RESULTS OF THE STUDY", "International, Delphi survey"]
    text = F.when(n == 0, put[0])
    for k, x in enumerate(put[1:], 1):
        text = text.when(n == k, x)
    l = _lines(spark, d).withColumn("t", F.trim(text.otherwise(F.left("whole", F.lit(120)))))  # noqa: E741
    t = F.col("t")
    return l.select("doc", "ord", S.is_byline(t).alias("byline"), S.is_capitals(t).alias("capitals"), S.looks_author(t).alias("author"), S.is_author_list(t).alias("list"), S.looks_prose(t).alias("prose"), S.reference_item(t).alias("item"), S.reference_sign(t).alias("sign"), S.doi_line(t).alias("doi"), S.foreign_scope(t).alias("foreign"))


@query("""WITH k AS (SELECT DISTINCT paper_id, section_type AS kind FROM paragraphs WHERE paper_id IS NOT NULL), l AS (SELECT paper_id, list_filter(list(kind), lambda x: x IN ('abstract', 'intro', 'methods', 'results', 'discussion')) AS kinds FROM k GROUP BY paper_id)
SELECT paper_id, len(kinds) >= 2 AND list_has_any(kinds, ['methods', 'results']) AS imrad FROM l""")
def imrad_papers(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "paragraphs").filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.collect_set("section_type").alias("kinds"))
    return p.select("paper_id", S.is_imrad(F.col("kinds")).alias("imrad"))


@query(r"""WITH c AS (SELECT DISTINCT figure_uid, caption, length(caption) AS n FROM paper_figures WHERE caption IS NOT NULL), s AS (SELECT figure_uid, trim(regexp_replace(CASE n % 3 WHEN 0 THEN 'F I G U R E ' || n || '. ' || caption WHEN 1 THEN 'A B c ' || 'Fig. 2. ' || caption ELSE caption END, '\s+', ' ', 'g')) AS s FROM c),
l AS (SELECT figure_uid, s, regexp_extract(s, '^(T ?A ?B ?L ?E|F ?I ?G ?U ?R ?E|F ?I ?G)[ .]*\d', 1) AS label FROM s), j AS (SELECT figure_uid, CASE WHEN label <> '' THEN replace(label, ' ', '') || substr(s, length(label) + 1) ELSE s END AS s FROM l)
SELECT figure_uid, CASE WHEN regexp_matches(s, '^(?:\(?[A-Ha-h]\)?[ .,]+){1,8}(?i:fig|table)') THEN regexp_replace(s, '^(?:\(?[A-Ha-h]\)?[ .,]+){1,8}', '') ELSE s END AS caption FROM j""")
def prepared_captions(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "paper_figures").filter("caption IS NOT NULL").select("figure_uid", "caption").distinct()
    n = F.char_length("caption")
    put = F.when(n % 3 == 0, F.concat(F.lit("F I G U R E "), n.cast("string"), F.lit(". "), F.col("caption"))).when(n % 3 == 1, F.concat(F.lit("A B c Fig. 2. "), F.col("caption"))).otherwise(F.col("caption"))
    return f.select("figure_uid", S.caption_prepared(put).alias("caption"))


@query("""WITH m AS (SELECT DISTINCT paper_id, list_filter(coalesce(meta.mesh, []), lambda x: trim(x) <> '') AS a, list_filter(coalesce(meta.keywords, []), lambda x: trim(x) <> '') AS b FROM papers WHERE paper_id IS NOT NULL),
e AS (SELECT paper_id, trim(unnest(list_concat(a, list_transform(a, lambda x: upper(x)), b))) AS x, unnest(range(0, 2 * len(a) + len(b))) AS i FROM m), f AS (SELECT paper_id, arg_min(x, i) AS x, min(i) AS i FROM e GROUP BY paper_id, lower(x))
SELECT m.paper_id, coalesce((SELECT string_agg(x, '|' ORDER BY i) FROM f WHERE f.paper_id = m.paper_id), '') AS terms FROM m""")
def subject_terms(spark: SparkSession, d: str) -> DataFrame:
    """Subject headings, then keywords, here with every heading in capitals among them."""
    p = read(spark, d, "papers").filter("paper_id IS NOT NULL").select("paper_id", F.col("meta.mesh").alias("mesh"), F.col("meta.keywords").alias("keywords")).distinct()
    more = F.concat(F.transform(F.coalesce("mesh", F.array().cast("array<string>")), F.upper), F.coalesce("keywords", F.array().cast("array<string>")))
    return p.select("paper_id", F.array_join(S.heading_terms(F.col("mesh"), more), "|").alias("terms"))


# ---- repairs that had no query ---------------------------------------------------------------------------------------

_HEADS = "self non pre post anti co mid sub well long short high low single double open case cross follow first second third one two three multi semi intra inter trans re de over under new old full half whole time site dose sex gender age race year week month day drug skin sun body risk".replace(" ", "', '")
_TAILS = "and or nor to but with without versus vs than then plus related associated based induced free like dependent independent specific negative positive matched mediated controlled resistant naive term type level dose sparing old linked blind only wide rich poor driven derived guided treated exposed".replace(" ", "', '")


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, ' ([a-z]{{4,}}) ', 1)) AS w FROM paragraphs), s AS (SELECT w, left(w, length(w) // 2) AS a, substr(w, length(w) // 2 + 1) AS b FROM w UNION SELECT * FROM (VALUES ('x1', 'cell', 'free'), ('x2', 'self', 'reported'), ('x3', 'dose', 'level'), ('x4', 'do', 'mains'), ('x5', 'inter', 'and'), ('x6', 'character', 'istically')) AS v(w, a, b))
SELECT w AS word, CASE WHEN length(a) >= 2 AND length(b) BETWEEN 2 AND 7 AND a NOT IN ('{_HEADS}') AND b NOT IN ('{_TAILS}') THEN a || b ELSE a || '- ' || b END AS text FROM s""")
def dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    """Every word cut in half by a line's end, and compounds."""
    words = read(spark, d, "paragraphs").filter("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit(" ([a-z]{4,}) "), 1)).alias("word")).distinct()
    half = F.floor(F.char_length("word") / 2).cast("int")
    cut = words.select("word", F.concat(F.substring("word", F.lit(1), half), F.lit("- "), F.substring("word", half + 1, F.char_length("word"))).alias("text"))
    planted = spark.createDataFrame([("x1", "cell- free"), ("x2", "self- reported"), ("x3", "dose- level"), ("x4", "do- mains"), ("x5", "inter- and"), ("x6", "character- istically")], cut.schema)
    return cut.union(planted).select("word", X.dehyphenate(F.col("text")).alias("text"))


@query("""WITH a AS (SELECT paper_id, min(abstract) AS abstract FROM papers WHERE abstract IS NOT NULL AND paper_id IS NOT NULL GROUP BY paper_id), b AS (SELECT paper_id, trim(abstract) AS t, length(abstract) % 6 AS k FROM a)
SELECT paper_id, CASE WHEN length(t) <= 120 AND k < 5 THEN NULL ELSE CASE k WHEN 4 THEN t || ' We used common keywords related to skin.' ELSE t END END AS abstract FROM b WHERE NOT regexp_matches(t, '(K ?E ?Y|Key ?[Ww]ord|The online|supplementary|[(]\\s*$)')""".replace("\\\\s", "\\s"))
def abstracts_without_tails(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts that were given a tail of each kind, without it; the word keywords in a sentence is none."""
    a = read(spark, d, "papers").filter("abstract IS NOT NULL AND paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("abstract").alias("abstract"))
    a = a.filter(~F.trim("abstract").rlike(r"(K ?E ?Y|Key ?[Ww]ord|The online|supplementary|[(]\s*$)"))
    t, k = F.trim("abstract"), F.char_length("abstract") % 6
    tail = F.when(k == 0, " Keywords: skin, light").when(k == 1, " K E Y W O R D S skin").when(k == 2, " (J Am Notes 2018;79:836-42.)").when(k == 3, " The online version of this article has more.").when(k == 4, " We used common keywords related to skin.").otherwise("")
    return a.select("paper_id", F.when((F.char_length(t) <= 120) & (k < 5), None).otherwise(captions.abstract_tail(F.concat(t, tail))).alias("abstract"))


@query("""WITH j AS (SELECT DISTINCT paper_id, meta.journal AS j FROM papers WHERE paper_id IS NOT NULL AND length(trim(meta.journal)) >= 12)
SELECT paper_id, k, replace(replace(CASE k WHEN 0 THEN 'the publication year, country and type' WHEN 1 THEN 'as printed in the @ of the year' WHEN 2 THEN 'It ended. @ then began' WHEN 3 THEN 'we saw the lesion reduced twice it' ELSE 'It grew @ Cream helped' END, '@', j), '#', '') AS text FROM j, (VALUES (0), (1), (2), (3), (4)) AS v(k)""")
def texts_without_journals(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with the journal's name put into them: in their midst, where it is called for, and where one begins."""
    j = read(spark, d, "papers").filter("paper_id IS NOT NULL").select("paper_id", F.col("meta.journal").alias("j")).distinct().filter(F.char_length(F.trim("j")) >= 12)
    puts = ["the publication year, @ country and type", "as printed in the @ of the year", "It ended. @ then began", "we saw the lesion @ reduced twice # it", "It grew @ Cream helped"]
    rows = j.select("paper_id", "j", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(puts)])).alias("x"))
    text = F.replace(F.replace(F.col("x.t"), F.lit("@"), F.col("j")), F.lit("#"), F.upper("j"))
    return rows.select("paper_id", F.col("x.k").alias("k"), captions.without_journal(text, F.col("j")).alias("text"))


@query()
def evaluation_variants(spark: SparkSession, d: str) -> DataFrame:
    """The probes' own papers as answers: vectors alone, words alone, and both, by hit@8 and mean reciprocal rank."""
    c, q = indexed(spark, d), _probe_queries(spark, d)
    answers = kept(indexed(spark, d, q.select(F.col("qid").alias("chunk_id"))).groupBy(F.col("chunk_id").alias("qid")).agg(F.collect_set("paper_id").alias("anchors")))
    asked = q.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    # Each ranking once, for all variants
    words = kept(retrieval.bm25(c, "chunk_id", F.col("body"), asked.select("qid", "query"), 50))
    near = kept(retrieval.dense(read(spark, d, "vectors"), "chunk_id", "vector", asked.filter("vector IS NOT NULL").select("qid", "vector"), 50))
    hits = None
    for name, one, two in (("vectors", near, words.limit(0)), ("words", near.limit(0), words), ("both", near, words)):
        part = retrieval.fuse(one, two, "chunk_id", 50).filter(F.col("qid") != F.col("chunk_id")).select("qid", "chunk_id", "rank", F.lit(name).alias("variant"))
        hits = part if hits is None else hits.unionByName(part)
    hits = kept(hits.join(c.select("chunk_id", "paper_id"), "chunk_id"))
    out = None
    for name in ("vectors", "words", "both"):
        part = retrieval.evaluate(hits.filter(F.col("variant") == name), answers, 8).withColumns({"variant": F.lit(name), "filter_ok": F.lit(None).cast("boolean")})
        out = part if out is None else out.unionByName(part)
    return retrieval.report(out, "variant")
