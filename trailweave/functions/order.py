"""Positions and ranks over a whole column without a single sorting task, and cutting lineage."""

from __future__ import annotations

import posixpath
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or the context's; a folder of our own only where the master is local and none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or posixpath.join(tempfile.gettempdir(), "checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _bucket(df: DataFrame, column: str, buckets: int) -> Column:
    """The range bucket of a value. The bounds come from a bounded sample (the values of least hash); any bounds give right ranks, these give even buckets."""
    some = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(16 * buckets)
    values = sorted(r[0] for r in some.collect())
    bounds = values[16::16]
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column))) if bounds else F.lit(0)


def ranked(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(column, n, before): each distinct value with its rows and the rows of lesser values; nulls are left out.

    Values are range-bucketed, summed within their bucket, and offset by the
    counts of the buckets below, of which there are `buckets` at most.
    """
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).withColumn("_b", _bucket(df, column, buckets))
    total = per.groupBy("_b").agg(F.sum("n").alias("_t"))
    below = total.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = F.sum("n").over(Window.partitionBy("_b").orderBy(column)) - F.col("n")
    return per.withColumn("_i", inner).join(F.broadcast(below), "_b").select(column, "n", (F.col("_i") + F.col("_o")).alias("before"))


def positions(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(column, idx): the distinct values with their place in order, from 0."""
    return ranked(df.select(column).distinct(), column, buckets).select(column, F.col("before").alias("idx"))


def mid_ranks(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(column, rank): the average rank of each distinct value, from 1."""
    return ranked(df, column, buckets).select(column, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
