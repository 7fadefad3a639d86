"""The queries of the nine problems, over their whole tables, and SQL for those that SQL can answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.llm import encoding, knn, mix, neardup, pack, scans, sentences, spans, split
from papercairn.tables import blank, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    row = read(spark, d, "size_limits").filter(F.col("limit_name") == name).first()
    return row["max_tokens"], row["overlap_sentences"] or 0


@query
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized chunk."""
    chunks = read(spark, d, "chunks")
    return split.split_oversized(chunks, *limit(spark, d, "chunk"), sentences.train(chunks.select("text")))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("chunk_id").distinct()


SQL["p1_found"] = r"""
SELECT DISTINCT chunk_id FROM (
  SELECT chunk_id, coalesce(embed_text, context_header || chr(10) || chr(10) || text, text) AS body FROM chunks)
WHERE greatest(1, floor(length(body) / 4)) > (SELECT max_tokens FROM size_limits WHERE limit_name = 'chunk')
  AND regexp_matches(body, '\S')
"""


@query
def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized chunk the characters its pieces cover, and whether every piece is within the limit, begins where
    the one before ends or earlier, and says what stands there."""
    most, overlap = limit(spark, d, "chunk")
    w = W.partitionBy("chunk_id").orderBy("piece")
    p = p1_pieces(spark, d).withColumn("before", F.lag("end").over(w))
    good = (F.col("n_tokens") <= most) & (F.col("before").isNull() & (F.col("start") == 0) | (F.col("start") <= F.col("before")) & (F.col("before") < F.col("end"))) & (F.col("overlap") <= overlap)
    return p.groupBy("chunk_id").agg(F.max("end").alias("n_chars"), F.bool_and(good).alias("whole"))


SQL["p1_cover"] = r"""
SELECT DISTINCT chunk_id, (length(body) - CASE WHEN context_header <> '' AND starts_with(body, context_header || chr(10) || chr(10))
  AND 2 * (length(context_header) + 2) <= 4 * m + 3 THEN length(context_header) + 2 ELSE 0 END)::INTEGER AS n_chars, TRUE AS whole
FROM (SELECT chunk_id, context_header, coalesce(embed_text, context_header || chr(10) || chr(10) || text, text) AS body, (SELECT max_tokens FROM size_limits WHERE limit_name = 'chunk') AS m FROM chunks)
WHERE greatest(1, floor(length(body) / 4)) > m AND regexp_matches(body, '\S')
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "paragraphs").select(F.lit("paragraphs").alias("tbl"), F.col("par_uid").alias("id"), "text")
    return p.unionByName(read(spark, d, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.near_duplicates(_texts(spark, d), 0.6, 3)
    return neardup.pairs_of_rows(links, members)


def _classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """tbl, id, class (its smallest id), links: the number of other classes linked to it."""
    g = neardup.groups(links, members)
    first = members.groupBy("tbl", "cls").agg(F.min("id").alias("class"))
    return g.join(first, ["tbl", "cls"]).select("tbl", "id", "class", "links")


@query
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of linked classes of every paragraph and chunk, at five words and 0.8."""
    return _classes(*neardup.near_duplicates(_texts(spark, d), 0.8))


@query
def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """As p6_groups, at the three words and 0.6 of p6_found."""
    return _classes(*neardup.near_duplicates(_texts(spark, d), 0.6, 3))


def _classes_sql(size: int, threshold: float, rows: bool = False) -> str:
    """By all pairs of texts that have a run of words in common: classes, or pairs of rows, copies included."""
    found = """SELECT u.tbl, u.id, u.class, coalesce(links, 0)::BIGINT AS links FROM u LEFT JOIN l ON l.tbl = u.tbl AND l.x = u.class"""
    if rows:
        found = """SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.tbl = b.tbl AND a.class = b.class AND a.id < b.id
UNION SELECT o.tbl, least(a.id, b.id), greatest(a.id, b.id) FROM o JOIN u a ON a.tbl = o.tbl AND a.class = x JOIN u b ON b.tbl = o.tbl AND b.class = y"""
    return rf"""
WITH t AS (SELECT DISTINCT 'paragraphs' AS tbl, par_uid AS id, text FROM paragraphs UNION SELECT DISTINCT 'chunks', chunk_id, text FROM chunks),
  w AS (SELECT tbl, id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM t WHERE text IS NOT NULL),
  u AS (SELECT tbl, id, w, min(id) OVER (PARTITION BY tbl, array_to_string(w, ' ')) AS class FROM w WHERE len(w) >= 20),
  c AS (SELECT tbl, class, any_value(w) AS w FROM u GROUP BY ALL),
  g AS (SELECT DISTINCT tbl, class, array_to_string(w[i : i + {size - 1}], ' ') AS s FROM (SELECT tbl, class, w, unnest(range(1, len(w) - {size - 2})) AS i FROM c)),
  n AS (SELECT tbl, class, count(*) AS n FROM g GROUP BY ALL),
  p AS (SELECT a.tbl, a.class AS x, b.class AS y, count(*) AS common FROM g a JOIN g b ON a.tbl = b.tbl AND a.s = b.s AND a.class <> b.class GROUP BY ALL),
  o AS (SELECT p.tbl, x, y FROM p JOIN n a ON a.tbl = p.tbl AND a.class = x JOIN n b ON b.tbl = p.tbl AND b.class = y WHERE common >= {threshold} * (a.n + b.n - common)),
  l AS (SELECT tbl, x, count(*) AS links FROM o GROUP BY ALL)
{found}
"""


SQL["p6_groups"], SQL["p6_classes"], SQL["p6_found"] = _classes_sql(5, 0.8), _classes_sql(3, 0.6), _classes_sql(3, 0.6, True)


@query
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(read(spark, d, "documents"), limit(spark, d, "document_container")[0])


@query
def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Of each document its size, put together again from its pieces, whether it was split, and whether all its containers
    hold what they may at most."""
    most = limit(spark, d, "document_container")[0]
    c = p7_containers(spark, d)
    over = c.groupBy("container").agg(F.sum("size").alias("held")).withColumn("fits", F.col("held") <= most)
    by = c.join(over, "container").groupBy("doc_id").agg((F.sum("size") - F.count(F.lit(1)) + 1).alias("tokens"), (F.count(F.lit(1)) > 1).alias("split"), F.bool_and(F.col("fits") & (F.col("held") == F.col("fill"))).alias("fits"))
    return by


SQL["p7_sizes"] = """
SELECT doc_id, any_value(coalesce(strlen(text), 0) + 1)::BIGINT AS tokens, any_value(coalesce(strlen(text), 0) + 1 > (SELECT max_tokens FROM size_limits WHERE limit_name = 'document_container')) AS split, TRUE AS fits
FROM documents GROUP BY doc_id
"""


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # White space that fills more than a container is cut as any text, but is no case
    empty = read(spark, d, "documents").filter(blank(F.col("text"))).select("doc_id")
    return p7_containers(spark, d).filter("pieces > 1").select("doc_id").distinct().join(empty, "doc_id", "left_anti")


SQL["p7_found"] = """
SELECT DISTINCT doc_id FROM documents
WHERE regexp_matches(text, '\\S') AND strlen(text) + 1 > (SELECT max_tokens FROM size_limits WHERE limit_name = 'document_container')
"""


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.report(read(spark, d, "documents"), read(spark, d, "mix_targets"))


@query
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document stands in each plan's mixture; documents that don't are left out."""
    sized = mix.sized(read(spark, d, "documents"))
    return mix.mixture(sized, mix.rates(sized, read(spark, d, "mix_targets"))).filter("copies > 0")


@query
def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """For each target: the tokens the source has, whether the mixture comes within two documents of what the source can
    give, and whether no document stands in it too often."""
    docs = read(spark, d, "documents")
    most = mix.sized(docs).agg(F.max("size")).first()[0] or 0
    r = p8_report(spark, d)
    goal = F.least(F.col("target_share") * F.col("total"), (F.col("available") * F.col("max_repeats")).cast("double"))
    return r.select("plan_id", "source", "available", (F.abs(F.col("tokens") - goal) <= 2 * most).alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


SQL["p8_bounds"] = r"""
WITH u AS (SELECT DISTINCT doc_id, lower(trim(source, E' \t\r\n')) AS source, coalesce(strlen(text), 0) + 1 AS size FROM documents)
SELECT plan_id, lower(trim(t.source, E' \t\r\n')) AS source, (SELECT coalesce(sum(size), 0) FROM u WHERE u.source = lower(trim(t.source, E' \t\r\n')))::BIGINT AS available, TRUE AS near, TRUE AS capped
FROM mix_targets t
"""


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).filter("unreachable").select("plan_id", "source")


SQL["p8_found"] = r"""
WITH u AS (SELECT DISTINCT doc_id, lower(trim(source, E' \t\r\n')) AS source, coalesce(strlen(text), 0) + 1 AS size FROM documents),
  by_source AS (SELECT source, sum(size) AS available FROM u GROUP BY source)
SELECT plan_id, t.source FROM mix_targets t LEFT JOIN by_source b ON b.source = lower(trim(t.source, E' \t\r\n'))
WHERE coalesce(available, 0) * max_repeats < target_share * (SELECT sum(size) FROM u)
"""


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.pairs_of_documents(*spans.shared(read(spark, d, "documents")))


SQL["p9_found"] = r"""
WITH u AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200 AND regexp_matches(text, '\S')),
  g AS (SELECT doc_id, hash(substr(text, CAST(i AS BIGINT), 200)) AS h, substr(text, CAST(i AS BIGINT), 200) AS s
        FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM u)),
  hot AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
  k AS (SELECT DISTINCT doc_id, s FROM g WHERE h IN (SELECT h FROM hot))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id
"""


@query
def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every longest shared span, between one document of each text; p9_coverage has the class of every document."""
    found, members = spans.shared(read(spark, d, "documents"))
    first = members.groupBy("cls").agg(F.min("doc_id").alias("doc"))
    a, b = first.select(F.col("cls").alias("cls_a"), F.col("doc").alias("doc_a")), first.select(F.col("cls").alias("cls_b"), F.col("doc").alias("doc_b"))
    return found.join(a, "cls_a").join(b, "cls_b").select("doc_a", "doc_b", "start_a", "start_b", "length")


@query
def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    found = spans.coverage(read(spark, d, "documents"))
    first = found.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("class"))
    return found.join(first, "cls", "left").drop("cls")


SQL["p9_coverage"] = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents), u AS (SELECT * FROM d WHERE length(text) >= 200 AND regexp_matches(text, '\S')),
  g AS (SELECT doc_id, i, hash(substr(text, CAST(i AS BIGINT), 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM u)),
  hot AS (SELECT h FROM (SELECT DISTINCT doc_id, h FROM g) GROUP BY h HAVING count(*) > 1),
  k AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g WHERE h IN (SELECT h FROM hot)),
  c AS (SELECT doc_id, sum(least(200, coalesce(i - p, 200))) AS chars, sum(CASE WHEN p IS NULL OR i - p > 200 THEN 1 ELSE 0 END) AS n FROM k GROUP BY doc_id),
  f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class FROM u)
SELECT doc_id, coalesce(length(text), 0)::INTEGER AS n_chars, coalesce(chars, 0)::BIGINT AS shared_chars, coalesce(n, 0)::BIGINT AS n_spans,
  CASE WHEN length(text) > 0 THEN coalesce(chars, 0) / length(text) ELSE 0 END AS share, class FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    v = knn.valid(read(spark, d, "vectors"), "chunk_id", "vector", 64)
    probes = read(spark, d, "vector_probes").select(F.col("chunk_id").alias("id")).distinct()
    return knn.nearest(v, v.join(probes, "id", "left_semi")).select(F.col("id").alias("chunk_id"), "neighbour_id")


SQL["p5_found"] = """
WITH v AS (SELECT DISTINCT chunk_id, vector::DOUBLE[] AS vector FROM vectors WHERE len(vector) = 64 AND (list_max(vector) > 0 OR list_min(vector) < 0)),
  s AS (SELECT a.chunk_id, b.chunk_id AS neighbour_id, list_cosine_similarity(a.vector, b.vector) AS s
        FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id IN (SELECT chunk_id FROM vector_probes))
SELECT chunk_id, neighbour_id FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(s, 12) DESC, neighbour_id) <= 10
"""


@query
def p5_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every embedding whose id is divisible by 20."""
    v = knn.valid(read(spark, d, "embeddings"), "vec_id", "embedding", 64)
    near = knn.nearest(v, v.filter(F.col("id") % 20 == 0))
    return near.select(F.col("id").cast("long").alias("vec_id"), F.col("neighbour_id").cast("long").alias("neighbour_id"), "rank")


@query
def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors were asked for, and whether nine tenths of their true neighbours were found."""
    v = knn.valid(read(spark, d, "vectors"), "chunk_id", "vector", 64)
    q = v.join(read(spark, d, "vector_probes").select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    by = knn.recall(knn.nearest(v, q), v, q)
    return by.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


SQL["p5_recall"] = """
SELECT count(DISTINCT chunk_id) AS queries, TRUE AS reached FROM vectors
WHERE chunk_id IN (SELECT chunk_id FROM vector_probes) AND len(vector) = 64 AND (list_max(vector) > 0 OR list_min(vector) < 0)
"""


SQL["p5_embeddings"] = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE len(embedding) = 64 AND (list_max(embedding) > 0 OR list_min(embedding) < 0)),
  s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.vector, b.vector), 12) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT vec_id, neighbour_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, CAST(neighbour_id AS VARCHAR)) AS rank FROM s) WHERE rank <= 10
"""


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "paragraphs").select(F.col("par_uid").alias("id"), "text")
    sample = read(spark, d, "sentence_sample").select(F.col("par_uid").alias("id")).distinct()
    found = sentences.sentences(p.join(sample, "id", "left_semi"), sentences.train(p.select("text")))
    return found.select(F.col("id").alias("par_uid"), F.col("end").alias("sent_end"))


@query
def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every paragraph."""
    p = read(spark, d, "paragraphs").select(F.col("par_uid").alias("id"), "text")
    return sentences.sentences(p, sentences.train(p.select("text"))).withColumnRenamed("id", "par_uid")


@query
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every wrongly decoded paragraph and caption, as it stands and restored."""
    p = read(spark, d, "paragraphs")
    texts = p.select(F.lit("paragraphs").alias("tbl"), F.col("par_uid").alias("rec_id"), "text")
    for name, key in (("paper_tables", "table_uid"), ("paper_figures", "figure_uid")):
        texts = texts.unionByName(read(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), F.col("caption").alias("text")))
    return encoding.restored(texts)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("tbl", "rec_id")


@query
def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph and table with damage of scanning, repaired."""
    p = read(spark, d, "paragraphs").select(F.lit("paragraphs").alias("tbl"), F.col("par_uid").alias("rec_id"), "text", F.lit(False).alias("is_table"))
    t = read(spark, d, "paper_tables").select(F.lit("paper_tables").alias("tbl"), F.col("table_uid").alias("rec_id"), F.col("markdown").alias("text"), F.lit(True).alias("is_table"))
    return scans.repaired(p.unionByName(t))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repaired(spark, d).filter("hyphens + misread + furniture > 0").select("tbl", "rec_id")
