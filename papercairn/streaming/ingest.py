"""Papers that keep arriving: incremental ingestion as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, form: str = "parquet", per_batch: int = 64) -> DataFrame:
    """Files of a folder as a stream; a file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(form).load(path)


def once_each(stream: DataFrame, key: str, time: str, late: str = "60 days") -> DataFrame:
    """The first delivery of each key; a second within `late` of event time is dropped, and keys older than that forgotten, so
    that the state stays bounded."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def per_day(stream: DataFrame, time: str, late: str, *groups: str) -> DataFrame:
    """Rows a day of event time and group; a day is given out once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), *groups).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), *groups, "n")


def into(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None, failed: str | None = None) -> StreamingQuery:
    """All that has arrived, worked on batch by batch and appended. A batch is written under its number: one that is run again
    after a failure replaces what it wrote. Rows `work` marks with a value in `error` go to `failed` and don't stop it."""

    def write(batch: DataFrame, number: int) -> None:
        out = work(batch) if work else batch
        if "error" in out.columns and failed:
            bad = out.filter("error IS NOT NULL")
            bad.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(failed)
            out = out.filter("error IS NULL").drop("error")
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """What each batch of a query read and how long it took."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["batchDuration"]} for p in query.recentProgress]
