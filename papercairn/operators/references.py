"""Printed references: which fields can be trusted, whose list they belong to, and fragments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.functions.python import partial_ratio, title_key

FIELDS = ("title", "doi", "pmid", "year", "journal")


def distrusted(printed: DataFrame, least: float = 80.0) -> DataFrame:
    """printed (title, raw and other columns) with a column corrupt: whether the parsed title stands nowhere in the printed
    text (likeness under 80 of 100; titles under 12 and texts under 20 characters aren't judged). All parsed fields of such
    a reference are blanked, as they are another paper's; the printed text stays."""

    def judge(titles: pd.Series, raws: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(titles, raws):
            t, r = title_key(t if isinstance(t, str) else None), title_key(r if isinstance(r, str) else None)
            out.append(len(t) >= 12 and len(r) >= 20 and partial_ratio(t, r) < least)
        return pd.Series(out, dtype=bool)

    marked = printed.withColumn("corrupt", F.pandas_udf(judge, "boolean")("title", "raw"))
    return marked.withColumns({c: F.when(~F.col("corrupt"), F.col(c)) for c in FIELDS if c in printed.columns})


def foreign_block(printed: DataFrame) -> DataFrame:
    """(paper_id, pos, number, foreign) of printed references (paper_id, pos from 0, paired, listed, highest): where a page
    holds the end of another paper's list, its references are foreign and the others are numbered from 1.

    listed: how many references another source knows; highest: the highest number cited in the text. Tried are the stretch
    from the first paired reference to the last, that from the first to the end, and that from the beginning to the last,
    in this order. One is the paper's own if two references or more lie outside, three or more and seven tenths of it are
    paired, it is as long as the highest number, and about as long as listed (two or 40 % off at most). Lists under five
    references, of fewer than three paired, two cited or three listed, or no longer than the highest number are left as
    they are. Per-paper numbers are aggregates; no list is gathered."""
    p = printed.select("paper_id", "pos", F.coalesce("paired", F.lit(False)).alias("paired"), "listed", "highest")
    by = p.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("paired").cast("int")).alias("hits"), F.min(F.when(F.col("paired"), F.col("pos"))).alias("lo"), F.max(F.when(F.col("paired"), F.col("pos"))).alias("hi"), F.max("listed").alias("listed"), F.max("highest").alias("highest"))
    able = (F.col("n") >= 5) & (F.col("hits") >= 3) & (F.col("highest") >= 2) & (F.col("listed") >= 3) & (F.col("n") > F.col("highest"))
    spans = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((F.col("lo"), F.col("hi") + 1), (F.col("lo"), F.col("n").cast("int")), (F.lit(0), F.col("hi") + 1))])

    def fits(s):
        size = s["b"] - s["a"]
        # All paired ones lie between the first and the last, so within each of the three
        return (F.col("n") - size >= 2) & (F.col("hits") >= 0.7 * size) & (F.col("highest") <= size) & (F.abs(size - F.col("listed")) <= F.greatest(F.lit(2.0), 0.4 * F.col("listed")))

    own = by.select("paper_id", F.when(able, F.get(F.filter(spans, fits), F.lit(0))).alias("own"))
    joined = p.join(own.withColumnRenamed("paper_id", "_p"), F.col("paper_id").eqNullSafe(F.col("_p")))
    foreign = F.col("own").isNotNull() & ((F.col("pos") < F.col("own.a")) | (F.col("pos") >= F.col("own.b")))
    return joined.select("paper_id", "pos", F.when(~foreign, F.col("pos") + 1 - F.coalesce(F.col("own.a"), F.lit(0))).cast("int").alias("number"), foreign.alias("foreign"))


def without_debris(references: DataFrame) -> DataFrame:
    """references (number, raw, ...) without those that have printed text but no number: parts of others."""
    return references.filter(F.col("number").isNotNull() | (F.trim(F.coalesce("raw", F.lit(""))) == ""))


def verified(dois: DataFrame, known: DataFrame) -> DataFrame:
    """(doi, exists): whether a registry (doi, exists) has each DOI; null where it wasn't asked: unknown is not absent."""
    k = known.groupBy("doi").agg(F.bool_or("exists").alias("exists"))
    return dois.select("doi").distinct().join(k, "doi", "left")


def best_source(documents: DataFrame, order: list[str]) -> DataFrame:
    """The document of each paper (paper_id, source, paragraphs, ...): of the first source in order that yields a paragraph,
    else of the first. Papers of the hot key are reduced before the shuffle."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    place = F.struct((F.coalesce("paragraphs", F.lit(0)) <= 0).cast("int"), F.when(rank > 0, rank).otherwise(len(order) + 1), "source")
    row = F.struct(*documents.columns)
    return documents.groupBy("paper_id").agg(F.min_by(row, place).alias("r")).select("r.*")


def without_empty(documents: DataFrame, fallback: DataFrame) -> DataFrame:
    """documents (paper_id, body_chars, ...) without the empty ones that `fallback` (paper_id) takes the place of."""
    empty = F.coalesce("body_chars", F.lit(0)) <= 0
    there = documents.filter(~empty)
    return there.unionByName(documents.filter(empty).join(fallback.select("paper_id").distinct(), "paper_id", "left_anti"))


def concepts(scored: DataFrame, least: float = 0.3, most: int = 12) -> DataFrame:
    """(paper_id, concepts): names of a paper's concepts (paper_id, name, score) of score 0.3 or more, best first, twelve at
    most; ties by name."""
    w = W.partitionBy("paper_id").orderBy(F.desc("score"), "name")
    top = scored.filter(F.col("score") >= least).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return top.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("concepts"))
