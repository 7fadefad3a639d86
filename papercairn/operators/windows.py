"""Windows over keys that may hold a large part of all rows: rows are parted by ranges of key and order, so that a frequent key
is spread over many tasks, and what crosses a part's border comes from one summary row per key and part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papercairn.tables import kept


def _parted(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return kept(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))


def _with(parts: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    s = summary.withColumnRenamed(key, "_key").withColumnRenamed("_part", "_own")
    return parts.join(s, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_own")), "left").drop("_key", "_own")


def carried(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last value that isn't null of the rows before each row of its key, in order; null where there is none. Rows
    of a null key are one key. The order has to tell rows of a key apart."""
    parts = _parted(df.withColumn("_v", value), key, order)
    local = F.last("_v", ignorenulls=True).over(W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    ends = parts.groupBy(key, "_part").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    return _with(parts.withColumn("_l", local), ends, key).withColumn(name, F.coalesce("_l", "_before")).drop("_v", "_l", "_before", "_part")


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with the number, from 1, of each row among those of its key, in order."""
    parts = _parted(df, key, order)
    local = F.row_number().over(W.partitionBy(key, "_part").orderBy(*order))
    sizes = parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    return _with(parts.withColumn("_l", local), sizes, key).withColumn(name, (F.col("_l") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_l", "_before", "_part")
