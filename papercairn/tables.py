"""Reading the standard tables and keeping intermediate ones."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name, one Parquet file or folder each."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; rows delivered again carry the same content, so any of them will do. Rows with a null key stay
    together as one."""
    return df.dropDuplicates(list(keys))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, if all executors are this
    process; on a cluster that is an error, as tables on one machine would be lost to the others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="papercairn-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Tables written by this process and not removed yet; the innermost open scope is last.
_SCOPES: list[list[str]] = [[]]


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for path in paths:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            return


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that kept() wrote within it: for what is collected or written out inside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _remove(spark, _SCOPES.pop())


def kept(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read back: it cuts the lineage and survives lost executors. It is
    removed at the end of the scope() it was made in, or else of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/papercairn-{uuid.uuid4().hex}"
    if len(_SCOPES) == 1 and not _SCOPES[0]:
        atexit.register(lambda: _remove(spark, _SCOPES[0]))
    _SCOPES[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt evenly over tasks by its keys, for work that takes long on few bytes: a number of partitions given outright
    isn't put together again at runtime. It is spark.sql.shuffle.partitions, so it grows with what the cluster is set to."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blank(text) -> F.Column:
    """Null or nothing but white space (of Unicode)."""
    return text.isNull() | ~text.rlike(r"[^\s\p{Z}\u0085]")
