"""Incremental runs as file streams: each key once, and scores kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import missing_only


def follow(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def once_per_key(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key is not in the table yet; a replayed batch adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            done = spark.read.schema(batch.schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], batch.schema)
        missing_only(new, done, *keys).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Error share by window of event time, for streams of commands."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
