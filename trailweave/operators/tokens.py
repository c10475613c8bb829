"""Likelihood metrics from token tables, and vector blocks.

tokens: teacher, task, turn, pos (in its turn), logprob, rank; one row per
assistant token, as a model has scored it elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scores import ols

KEY = ["teacher", "task"]


def global_nll(tokens: DataFrame) -> DataFrame:
    """Mean log-probability over all assistant tokens."""
    return tokens.groupBy(*KEY).agg(F.avg("logprob").alias("score"), F.count("logprob").alias("n"))


def local_nll(tokens: DataFrame) -> DataFrame:
    """Mean over turns of each turn's mean: every turn weighs the same."""
    return tokens.groupBy(*KEY, "turn").agg(F.avg("logprob").alias("m")).groupBy(*KEY).agg(F.avg("m").alias("score"), F.count("*").alias("n"))


def step_drop(tokens: DataFrame, skip: int = 2, empty: float = -16.0) -> DataFrame:
    """Means with and without the first tokens of each step, and the share of those; no tokens give 0."""
    head = F.col("pos") < skip
    return tokens.groupBy(*KEY).agg(
        F.coalesce(F.avg(F.when(~head, F.col("logprob"))), F.when(F.count("*") == 0, 0.0).otherwise(empty)).alias("drop"),
        F.coalesce(F.avg("logprob"), F.lit(0.0)).alias("mean"), F.count_if(head).alias("heads"), (F.count_if(head) / F.count("*")).alias("ratio"),
    )


def adjusted_for_heads(stats: DataFrame, controls: tuple[str, ...] = ("ratio",)) -> DataFrame:
    """Mean less gamma times the head ratio, gamma from least squares over all trajectories."""
    gamma = ols(stats, "mean", controls)[1]
    return stats.withColumn("score", F.col("mean") - F.lit(gamma) * F.col("ratio"))


def rank_surprisal(tokens: DataFrame, clip: int = 100) -> DataFrame:
    """Average clipped rank over average surprisal, with both sums for ratio-of-means aggregation."""
    sums = tokens.groupBy(*KEY).agg(F.sum(F.least(F.col("rank"), F.lit(clip))).alias("num"), F.sum(-F.col("logprob")).alias("den"), F.count("*").alias("n"))
    return sums.withColumn("score", F.when(F.col("den") > 0, F.col("num") / F.col("den")))


def context(messages: Column, turn: Column, k: int) -> Column:
    """The first message and the k pairs before a turn."""
    start = F.greatest(turn - 2 * k, F.lit(1))
    return F.concat(F.slice(messages, 1, 1), F.slice(messages, start + 1, F.greatest(turn - start, F.lit(0))))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean unit vector of each group, one sum per dimension (a map-side combine)."""
    parts = rows.select(by, F.posexplode(unit(F.col(vector).cast("array<double>"))).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"), F.max("n").alias("n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_blocks(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """For pairs of groups the mean cosine of their members (the product of mean unit vectors); within a group also without the diagonal."""
    m = mean_vectors(rows, by, vector)
    a, b = m.toDF("a", "ma", "na"), F.broadcast(m.toDF("b", "mb", "nb"))  # groups are a small dimension
    j = a.join(b, F.col("a") <= F.col("b")).withColumn("mean_cosine", dot(F.col("ma"), F.col("mb")))
    off = F.when((F.col("a") == F.col("b")) & (F.col("na") > 1), (F.col("mean_cosine") * F.col("na") * F.col("na") - F.col("na")) / (F.col("na") * (F.col("na") - 1)))
    return j.select("a", "b", "mean_cosine", off.alias("off_diagonal"))


def projected(rows: DataFrame, key: str, vector: str, dims: int = 512, seed: int = 0) -> DataFrame:
    """(key, projected): random signs in place of a matrix, from the hash of (seed, coordinate, dimension), over the square root of the length.

    Every engine and executor draws the same signs, so nothing is broadcast;
    distances hold in expectation, not bit for bit with other generators.
    """
    n = F.size(vector)
    sign = lambda i, j: F.when(F.pmod(F.xxhash64(F.lit(seed), i, j), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    one = lambda j: F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * sign(i, j)), F.lit(0.0), lambda s, x: s + x) / F.sqrt(n.cast("double"))
    return rows.select(key, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), one)).alias("projected"))


def response_spans(ids: list[int], header: list[int], end: list[int], blank: frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """Half-open spans of what follows each header up to the next end mark or the end; one leading blank token is left out, empty spans too."""
    out, i = [], 0
    at = lambda mark, since: next((k for k in range(since, len(ids) - len(mark) + 1) if ids[k : k + len(mark)] == mark), None)
    while header and (head := at(header, i)) is not None:
        start = head + len(header)
        stop = at(end, start) if end else None
        i = len(ids) if stop is None else stop + len(end)
        stop = len(ids) if stop is None else stop
        start += start < stop and ids[start] in blank
        if start < stop:
            out.append((start, stop))
    return out
