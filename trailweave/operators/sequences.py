"""Operators over ordered turns: error profiles, retries, recovery, look-back and look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def error_rate(events: DataFrame, by: str, failed: Column) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"), (F.count_if(failed) / F.count("*")).alias("rate"))


def next_k(events: DataFrame, by: str, order: list[str], good: Column, k: int = 3) -> DataFrame:
    """Adds `recovered`: whether one of the next k rows of the same sequence is good."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1, k)
    return events.withColumn("recovered", F.coalesce(F.max(good.cast("int")).over(w) == 1, F.lit(False)))


def next_is(events: DataFrame, by: str, order: list[str], good: Column) -> Column:
    """Whether the very next row of the sequence is good (format recovery)."""
    return F.coalesce(F.lead(good).over(Window.partitionBy(by).orderBy(*order)), F.lit(False))


def recovery_profile(marked: DataFrame, teacher: str, category: str, failed: Column) -> DataFrame:
    """E (errors over all rows of the teacher) and R (recovered over occurring) by category."""
    total = marked.groupBy(teacher).agg(F.count("*").alias("n"))
    e = marked.where(failed).groupBy(teacher, category).agg(F.count("*").alias("occurring"), F.count_if("recovered").alias("fixed"))
    return e.join(total, teacher).select(teacher, category, "occurring", (F.col("occurring") / F.col("n")).alias("e_t"), (F.col("fixed") / F.col("occurring")).alias("r_t"))


def student_profile(marked: DataFrame, category: str, failed: Column) -> DataFrame:
    """Errors of each category over all rows, and those never recovered over all rows."""
    total = marked.agg(F.count("*").alias("n"))
    per = marked.where(failed).groupBy(category).agg(F.count("*").alias("own"), F.count_if(~F.col("recovered")).alias("own_open"))
    return per.join(F.broadcast(total)).select(category, (F.col("own") / F.col("n")).alias("q_all"), (F.col("own_open") / F.col("n")).alias("q_unrecovered"))


def weighted_recovery(profile: DataFrame, student: DataFrame, teacher: str, category: str) -> DataFrame:
    """Sum of q * E * R by teacher, and the controls: densities and the unweighted recovery rate."""
    j = profile.join(F.broadcast(student), category, "left").fillna(0.0, ["q_all", "q_unrecovered"])
    return j.groupBy(teacher).agg(
        F.sum(F.expr("q_all * e_t * r_t")).alias("all_errors"), F.sum(F.expr("q_unrecovered * e_t * r_t")).alias("unrecovered"),
        F.sum("e_t").alias("error_density"), F.sum(F.expr("e_t * r_t")).alias("recovery_density"),
        (F.sum(F.expr("occurring * r_t")) / F.sum("occurring")).alias("recovery_rate"),
    )


def smoothed(counts: DataFrame, by: str, category: str, n: str) -> DataFrame:
    """Distributions over the union of categories, each count raised by EPSILON."""
    grid = counts.select(by).distinct().crossJoin(F.broadcast(counts.select(category).distinct()))
    full = grid.join(counts, [by, category], "left").fillna(0, [n])
    total = full.groupBy(by).agg(F.sum(n).alias("total"), F.count("*").alias("kinds"))
    p = (F.col(n) + EPSILON) / (F.col("total") + EPSILON * F.col("kinds"))
    return full.join(total, by).select(by, category, p.alias("p"))


def divergence(p: DataFrame, by: str, category: str, against: str) -> DataFrame:
    """KL(reference || each) and the overlap sum of products, the reference being one of the groups."""
    ref = p.where(F.col(by) == against).select(category, F.col("p").alias("q"))
    return p.where(F.col(by) != against).join(F.broadcast(ref), category).groupBy(by).agg(F.sum(F.expr("q * ln(q / p)")).alias("kl"), F.sum(F.expr("p * q")).alias("overlap"))


def profile_cosine(p: DataFrame, by: str, category: str, n: str, against: str) -> DataFrame:
    ref = p.where(F.col(by) == against).select(category, F.col(n).alias("q"))
    norm = p.where(F.col(by) == against).agg(F.sqrt(F.sum(F.col(n) * F.col(n))).alias("norm"))
    j = p.where(F.col(by) != against).join(F.broadcast(ref), category, "left")
    dot = j.groupBy(by).agg(F.sum(F.col(n) * F.coalesce("q", F.lit(0))).alias("dot"), F.sqrt(F.sum(F.col(n) * F.col(n))).alias("own"))
    return dot.join(F.broadcast(norm)).select(by, F.when((F.col("own") > 0) & (F.col("norm") > 0), F.col("dot") / (F.col("own") * F.col("norm"))).otherwise(0.0).alias("cosine"))


def consecutive_retry(events: DataFrame, by: str, order: list[str], tool: str, failed: Column) -> DataFrame:
    """How often a failed command is followed at once by the same tool."""
    nxt = F.lead(tool).over(Window.partitionBy(by).orderBy(*order))
    e = events.withColumns({"_next": nxt, "_failed": failed})
    return e.groupBy(by).agg(F.count_if("_failed").alias("failed"), F.count_if(F.col("_failed") & (F.col("_next") == F.col(tool))).alias("retried"))


def cross_turn_retry(events: DataFrame, by: str, turn: str, tool: str, failed: Column) -> DataFrame:
    """Pairs of neighbouring turns in which one tool failed both times; pairs = turns - 1."""
    per = events.groupBy(by, turn).agg(F.array_sort(F.collect_set(F.when(failed, F.col(tool)))).alias("bad"))
    before = F.lag("bad").over(Window.partitionBy(by).orderBy(turn))
    return per.withColumn("again", F.coalesce(F.arrays_overlap("bad", before), F.lit(False))).groupBy(by).agg((F.count("*") - 1).alias("pairs"), F.count_if("again").alias("cycles"))


def seen_before(events: DataFrame, by: str, order: list[str], key: str, act: Column, look: Column) -> DataFrame:
    """Share of actions with an earlier observation of the same key."""
    first = F.min(F.when(look, F.col("_at"))).over(Window.partitionBy(by, key))
    e = events.withColumns({"_at": F.row_number().over(Window.partitionBy(by).orderBy(*order)), "_act": act}).withColumn("_first", first)
    return e.where("_act").groupBy(by).agg(F.count("*").alias("actions"), F.count_if(F.expr("_first < _at")).alias("grounded")).withColumn("rate", F.col("grounded") / F.col("actions"))


def checked_after(events: DataFrame, by: str, order: list[str], act: Column, check: Column, horizon: int = 3) -> DataFrame:
    """Share of actions that a check follows within the horizon."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1, horizon)
    e = events.withColumns({"_act": act, "_hit": F.coalesce(F.max(check.cast("int")).over(w), F.lit(0))})
    return e.where("_act").groupBy(by).agg(F.count("*").alias("actions"), F.sum("_hit").alias("verified")).withColumn("rate", F.col("verified") / F.col("actions"))


def alternation(turns: DataFrame) -> DataFrame:
    """By conversation: turns, and whether roles strictly alternate from a user (after a system turn) to an assistant."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.where("role <> 'system'").withColumns({"_before": F.lag("role").over(w), "_last": F.lead("role").over(w).isNull()})
    bad = (F.col("_before") == F.col("role")) | (F.col("_before").isNull() & (F.col("role") != "user")) | (F.col("_last") & (F.col("role") != "assistant"))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.count_if(F.coalesce(bad, F.lit(False))) == 0).alias("strict"))
