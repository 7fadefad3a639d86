"""Where results go: ledgers, the store of documents, indexes. Spark's commit makes each write whole or not there."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURE = "ts timestamp, stage string, item string, error_type string, message string"


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, added to what is there."""
    df.write.mode("append").json(path)


def record_failures(failed: DataFrame, path: str, stage: str) -> None:
    """Failures (item, error_type, message) added to the ledger, cut at 500 and 2000 characters."""
    failed.select(F.current_timestamp().alias("ts"), F.lit(stage).alias("stage"), F.substring("item", 1, 500).alias("item"), "error_type", F.substring("message", 1, 2000).alias("message")).write.mode("append").json(path)


def failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE).json(path)


def store_documents(docs: DataFrame, path: str) -> None:
    """Documents (sha1, ...) in folders by the first two digits of their content's hash. Only the folders written are
    replaced, each whole: give what is there together with what is new (see corpus.resume)."""
    docs.withColumn("prefix", F.substring("sha1", 1, 2)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)


def stored(spark: SparkSession, path: str, sha1: str | None = None) -> DataFrame:
    """The store, or one document of it: only its folder is read."""
    df = spark.read.parquet(path)
    return df if sha1 is None else df.filter((F.col("prefix") == sha1[:2]) & (F.col("sha1") == sha1))


def summary(docs: DataFrame) -> DataFrame:
    """(sha1, paper_id, title, journal, year, source, quality_score): the index of the store, derived from it anew."""
    return docs.select("sha1", "paper_id", "meta.title", "meta.journal", "meta.year", "source", "quality_score")


def save_index(posts: DataFrame, lengths: DataFrame, path: str, k1: float = 1.5, b: float = 0.75) -> None:
    """An inverted index: postings in files by ranges of terms, so that a query's terms prune what is read; lengths of
    documents; and the corpus' numbers."""
    posts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).withColumns({"k1": F.lit(k1), "b": F.lit(b)}).write.mode("overwrite").parquet(f"{path}/corpus")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {k: spark.read.parquet(f"{path}/{k}") for k in ("postings", "lengths", "corpus")}


def index_search(index: dict[str, DataFrame], key: str, queries: DataFrame, k: int) -> DataFrame:
    """retrieval.bm25 over a saved index: (qid, key, score, rank)."""
    from papercairn.functions.python import norm_text
    from papercairn.functions.text import terms
    from papercairn.operators.retrieval import ranked

    c = index["corpus"].first()
    asked = queries.select("qid", F.explode(F.array_distinct(terms(norm_text(F.col("query"))))).alias("term"))
    posts = index["postings"].join(asked.select("term").distinct(), "term", "left_semi")
    weights = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + (c["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf")
    gain = F.col("idf") * tf * (c["k1"] + 1) / (tf + c["k1"] * (1 - c["b"] + c["b"] * F.col("dl") / (c["avgdl"] or 1.0)))
    scored = posts.join(index["lengths"], key).join(weights, "term").join(asked, "term").groupBy("qid", key).agg(F.round(F.sum(gain), 6).alias("score"))
    return ranked(scored, "qid", ["-score", key], k)


def save_vectors(vectors: DataFrame, path: str, encoder: str, dim: int) -> None:
    """Vectors and what they were made by; the fingerprint is of their ids."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    n, mark = vectors.agg(F.count(F.lit(1)), F.sum(F.xxhash64("chunk_id") % 1_000_000_007)).first()
    vectors.sparkSession.createDataFrame([(encoder, dim, n, hashlib.sha1(json.dumps([n, mark]).encode()).hexdigest())], "encoder string, dim int, n bigint, fingerprint string").write.mode("overwrite").parquet(f"{path}/meta")


def load_vectors(spark: SparkSession, path: str, encoder: str, dim: int) -> tuple[DataFrame, list[str]]:
    """The vectors, and in what they differ from what is expected: encoder, dim, fingerprint."""
    v, m = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta").first()
    n, mark = v.agg(F.count(F.lit(1)), F.sum(F.xxhash64("chunk_id") % 1_000_000_007)).first()
    now = hashlib.sha1(json.dumps([n, mark]).encode()).hexdigest()
    return v, [k for k, bad in (("encoder", m["encoder"] != encoder), ("dim", m["dim"] != dim), ("fingerprint", m["fingerprint"] != now)) if bad]
