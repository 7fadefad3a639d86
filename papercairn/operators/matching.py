"""Matching of what belongs together: files and papers, items and captions, tables and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions import text as X
from papercairn.functions.python import identity_score, similarity


def base_name(path) -> F.Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def found_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, file, by): the file of each paper (paper_id, source_file): of the same name, else of the same name without its
    ending and in any case; the first by name where there are several. Papers without one have no row."""
    stem = lambda c: F.lower(F.regexp_replace(base_name(c), r"\.[^.]*$", ""))
    p = papers.filter("source_file IS NOT NULL").select("paper_id", base_name(F.col("source_file")).alias("name"), stem(F.col("source_file")).alias("stem")).distinct()
    by_name = files.groupBy(base_name(F.col("file")).alias("name")).agg(F.min("file").alias("a"))
    by_stem = files.groupBy(stem(F.col("file")).alias("stem")).agg(F.min("file").alias("b"))
    both = p.join(by_name, "name", "left").join(by_stem, "stem", "left").filter("a IS NOT NULL OR b IS NOT NULL")
    return both.select("paper_id", F.coalesce("a", "b").alias("file"), F.when(F.col("a").isNotNull(), "name").otherwise("stem").alias("by"))


def to_look_up(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys the cache knows nothing of; one known to have no answer is not asked again."""
    return keys.select(key).filter(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")


def listed_items(records: DataFrame) -> DataFrame:
    """(paper_id, pos, pmid): listed references (paper_id, pmid, references) in order, without the paper itself."""
    x = records.select("paper_id", "pmid", F.posexplode("references").alias("pos", "ref"))
    return x.filter(~F.col("ref").eqNullSafe(F.col("pmid"))).select("paper_id", "pos", F.col("ref").alias("pmid"))


def identities(papers: DataFrame, least: float = 70.0) -> DataFrame:
    """(paper_id, file, score, ok): whether a paper's title is what the name of its file (source_file) says; score and ok are
    null where either says too little."""
    t = papers.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("source_file").alias("file"), F.min("meta.title").alias("title"))
    both = t.withColumn("score", identity_score(F.col("title"), F.col("file")))
    return both.select("paper_id", "file", "score", (F.col("score") >= least).alias("ok"))


def topical_coverage(captions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paper_id, uid, coverage): the share of a caption's content words that the paper's paragraphs have. Vocabularies are
    distinct words per paper, joined on them."""
    v = paragraphs.filter("text IS NOT NULL").select("paper_id", F.explode(X.content_words(F.col("text"))).alias("w")).distinct().withColumn("hit", F.lit(1))
    c = captions.select("paper_id", "uid", F.explode(X.content_words(F.col("caption"))).alias("w")).distinct()
    return c.join(v, ["paper_id", "w"], "left").groupBy("paper_id", "uid").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage"))


def aligned(items: DataFrame, printed: DataFrame, least: float = 80.0) -> DataFrame:
    """(paper_id, uid, pos, by): tables or figures (paper_id, uid, number, caption) and the captions printed (paper_id, pos,
    number, caption), one to one: of the same number first, where only one is printed of it; then the likeliest unused one,
    at 80 of 100 or more. A task holds one paper's captions."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, used = [], set()
        counts = b["number"].value_counts()
        open_items = []
        for r in a.sort_values("uid").itertuples():
            same = b[(b["number"] == r.number)] if pd.notna(r.number) and counts.get(r.number, 0) == 1 else b.iloc[:0]
            if len(same) and int(same["pos"].iloc[0]) not in used:
                used.add(int(same["pos"].iloc[0]))
                out.append((r.paper_id, r.uid, int(same["pos"].iloc[0]), "number"))
            else:
                open_items.append(r)
        scores = sorted((-s, r.uid, int(q.pos), r.paper_id) for r in open_items for q in b.itertuples() if int(q.pos) not in used and (s := similarity(r.caption, q.caption)) >= least)
        done = set()
        for _, uid, pos, paper in scores:
            if uid not in done and pos not in used:
                done.add(uid)
                used.add(pos)
                out.append((paper, uid, pos, "text"))
        return pd.DataFrame(out, columns=["paper_id", "uid", "pos", "by"])

    left = items.select("paper_id", "uid", "number", "caption")
    # Names of their own, as both may come of one relation, whose columns would be taken for the same
    right = printed.select(F.col("paper_id").alias("_paper"), *[F.col(c).alias(f"_{c}") for c in ("pos", "number", "caption")])
    return left.groupBy("paper_id").cogroup(right.groupBy("_paper")).applyInPandas(lambda a, b: work(a, b.rename(columns=lambda c: c[1:])), "paper_id string, uid string, pos int, by string")


# Of a table so many values are looked for, and so many must stand on its page
FIRST_VALUES, LEAST_VOTES = 14, 3


def table_pages(cells: DataFrame, pages: DataFrame, first: int = FIRST_VALUES, least: int = LEAST_VOTES) -> DataFrame:
    """(paper_id, uid, page, votes): the page (paper_id, page, text) on which most of the first 14 values of a table (paper_id,
    uid, ord, value) stand as words, three at least; the earliest of equals. Joined on the values."""
    v = cells.filter(F.trim("value") != "").withColumn("n", F.row_number().over(W.partitionBy("paper_id", "uid").orderBy("ord"))).filter(F.col("n") <= first)
    v = v.select("paper_id", "uid", F.lower(F.trim("value")).alias("value")).distinct()
    w = pages.select("paper_id", "page", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("value"))
    votes = v.join(w, ["paper_id", "value"]).groupBy("paper_id", "uid", "page").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("paper_id", "uid").agg(F.max(F.struct("votes", (-F.col("page")).alias("p"))).alias("b")).select("paper_id", "uid", (-F.col("b.p")).alias("page"), F.col("b.votes").alias("votes")).filter(F.col("votes") >= least)


def unit_counts(papers: DataFrame, paragraphs: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """One row per source of papers: papers, paragraphs, tables, figures; each counted on its own key first."""
    one = lambda df, key: df.select("paper_id", key).distinct().groupBy("paper_id").agg(F.count(F.lit(1)).alias(key))
    p = papers.filter("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("source").alias("source"))
    for df, key in ((paragraphs, "par_uid"), (tables, "table_uid"), (figures, "figure_uid")):
        p = p.join(one(df, key), "paper_id", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("papers"), total("par_uid", "paragraphs"), total("table_uid", "tables"), total("figure_uid", "figures"))
