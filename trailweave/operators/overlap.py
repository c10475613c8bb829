"""Train/eval overlap: exact normalised matches and Jaccard of word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def exact_matches(train: DataFrame, evals: DataFrame) -> DataFrame:
    """(train_id, eval_ids): equal texts after normalisation; empty texts equal each other."""
    digest = F.sha2(T.normal(F.coalesce("text", F.lit(""))).cast("binary"), 256)  # so that texts are not shuffled
    e, t = evals.select("eval_id", digest.alias("norm")), train.select("train_id", digest.alias("norm"))
    return t.join(e, "norm").groupBy("train_id").agg(F.array_join(F.array_sort(F.collect_list("eval_id")).cast("array<string>"), ",").alias("eval_ids"))


def jaccard_pairs(train: DataFrame, evals: DataFrame, width: int = 5, few: int = 200_000) -> DataFrame:
    """(train_id, eval_id, jaccard) of all pairs that share a shingle, by an inverted index.

    An evaluation set of at most `few` shingles is broadcast, so the training
    side is filtered where it is read and only hits are shuffled; a larger one
    is joined by a shuffle of both sides.
    """

    def exploded(df: DataFrame, key: str, n: str) -> DataFrame:
        w = df.select(key, T.words(F.coalesce("text", F.lit(""))).alias("w"))  # a column of its own, or the lambda would tokenise for each shingle
        s = w.select(key, T.shingles(F.col("w"), width).alias("s"))
        return s.select(key, F.size("s").alias(n), F.explode_outer("s").alias("shingle"))

    e, t = exploded(evals, "eval_id", "n_eval"), exploded(train, "train_id", "n_train")
    small = e.limit(few + 1).count() <= few
    both = t.join(F.broadcast(e) if small else e, "shingle").groupBy("train_id", "eval_id").agg(F.count("*").alias("both"), F.first("n_train").alias("a"), F.first("n_eval").alias("b"))
    return both.select("train_id", "eval_id", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("jaccard"))


def top_pairs(pairs: DataFrame, n: int = 20) -> DataFrame:
    return pairs.orderBy(F.desc("jaccard"), "train_id", "eval_id").limit(n)


def padded_top(train: DataFrame, evals: DataFrame, n: int = 20, width: int = 5) -> DataFrame:
    """The n best pairs of the whole product; pairs without overlap fill up by id when too few overlap."""
    first = lambda df, key: df.select(key).orderBy(key).limit(n + 1)  # noqa: E731  of equal pairs the first by ids count, so n of each side do
    none = lambda df, key: first(df.where(F.size(T.words(F.coalesce("text", F.lit("")))) == 0), key)
    empty = none(train, "train_id").crossJoin(none(evals, "eval_id")).withColumn("jaccard", F.lit(1.0))  # by convention
    scored = jaccard_pairs(train, evals, width).unionByName(empty)
    best = top_pairs(scored, n)
    zero = first(train, "train_id").crossJoin(first(evals, "eval_id")).join(scored, ["train_id", "eval_id"], "left_anti").withColumn("jaccard", F.lit(0.0))
    return top_pairs(best.unionByName(zero), n)


def audit(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """Counts for the report: exact matches, pairs at 0.5 and at 0.8, the maximum."""
    p = pairs.agg(F.count_if(F.expr("jaccard >= 0.5")).alias("over_half"), F.count_if(F.expr("jaccard >= 0.8")).alias("near"), F.coalesce(F.max("jaccard"), F.lit(0.0)).alias("largest"))
    return p.join(F.broadcast(exact.agg(F.count("*").alias("exact"))))
