"""Error profiles from labelled segments: command errors, student profiles, teacher components, weighted recovery.

segments: teacher, task, kind (command or format), failure, category,
subcategory, and for some operators recovered, reward, valid_pair, parsed. A
key is "category :: subcategory". Labels come from a table; nothing here calls
a model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = " :: "
FORMAT = "Agent format" + SEPARATOR + "Unparseable response"


def key_of() -> Column:
    """category :: subcategory of a segment; format segments have a class of their own."""
    return F.when(F.col("kind") == "format", FORMAT).otherwise(F.concat_ws(SEPARATOR, "category", "subcategory"))


def category_of(key: Column | str) -> Column:
    return F.split_part(key if isinstance(key, Column) else F.col(key), F.lit(SEPARATOR), F.lit(1))


def command_errors(segments: DataFrame) -> DataFrame:
    """By trajectory: commands, failed, rate, score (-rate), both views, category counts, invalid pairs, unparseable labels."""
    by = ["teacher", "task"]
    cmd = segments.where("kind = 'command'").withColumn("key", key_of())
    per = cmd.groupBy(*by).agg(
        F.count("*").alias("commands"), F.count_if("failure").alias("failed"),
        F.count_if(F.col("failure") & ~F.coalesce("valid_pair", F.lit(False))).alias("invalid_pairs"), F.count_if(~F.coalesce("parsed", F.lit(True))).alias("unparseable"),
    )
    counts = cmd.where("failure").groupBy(*by, "key").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("category_counts"))
    rate = F.col("failed") / F.col("commands")
    out = per.join(counts, by, "left").withColumns({"rate": rate, "score": -rate})
    return out.withColumn("score_views", F.create_map(F.lit("fewer_errors"), -F.col("rate"), F.lit("more_errors"), F.col("rate")))


def valid_pairs(segments: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Adds valid_pair: whether the taxonomy, a dimension of some ninety rows, has the pair."""
    known = F.broadcast(taxonomy.select("category", "subcategory").distinct().withColumn("_known", F.lit(True)))
    return segments.join(known, ["category", "subcategory"], "left").withColumn("valid_pair", F.coalesce("_known", F.lit(False))).drop("_known")


def student_profiles(segments: DataFrame) -> DataFrame:
    """(view, key, q): errors over commands, for all, unrecovered and failed trajectories' commands, by key and by category.

    A trajectory without reward counts as failed. The denominators are all
    commands of the subset, so a profile sums to its error rate.
    """
    cmd = segments.where("kind = 'command'").withColumns({"key": key_of(), "lost": F.coalesce(F.col("reward") == 0, F.lit(True))})
    total = cmd.agg(F.count("*").alias("n"), F.count_if("lost").alias("n_lost"))
    bad = cmd.where("failure").groupBy("key").agg(F.count("*").alias("all"), F.count_if(~F.coalesce("recovered", F.lit(False))).alias("open"), F.count_if("lost").alias("lost"))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    views = {"qS_all_episodes": share("all", "n"), "qS_unrecovered": share("open", "n"), "qS_failed_trajectories": share("lost", "n_lost")}
    rows = F.array(*(F.struct(F.lit(v).alias("view"), q.alias("q")) for v, q in views.items()))
    long = bad.join(F.broadcast(total)).select("key", F.explode(rows).alias("r")).select("r.view", "key", "r.q").where("q > 0")
    coarse = long.groupBy(F.concat("view", F.lit("_cat")).alias("view"), category_of("key").alias("key")).agg(F.sum("q").alias("q"))
    return long.unionByName(coarse)


def student_recovery(segments: DataFrame) -> DataFrame:
    """(key, occurrences, unrecovered, rate): local recovery of the student, format episodes included."""
    bad = segments.where("failure").withColumn("key", key_of())
    per = bad.groupBy("key").agg(F.count("*").alias("occurrences"), F.count_if(~F.coalesce("recovered", F.lit(False))).alias("unrecovered"))
    return per.withColumn("rate", 1 - F.col("unrecovered") / F.col("occurrences"))


def components(segments: DataFrame) -> DataFrame:
    """(teacher, task, level, key, occurrences, recovered, n, e_t, r_t) for keys and for categories.

    E is errors over all segments of the trajectory, format ones included, R
    the recovered share of them; one pass by grouping sets.
    """
    s = segments.withColumns({"_key": key_of()}).withColumn("_cat", category_of("_key"))
    n = s.groupBy("teacher", "task").agg(F.count("*").alias("n"))
    bad = s.where("failure").groupingSets([["teacher", "task", "_key"], ["teacher", "task", "_cat"]], "teacher", "task", "_key", "_cat")
    per = bad.agg(F.count("*").alias("occurrences"), F.count_if(F.coalesce("recovered", F.lit(False))).alias("recovered"), F.grouping("_key").alias("g"))
    per = per.select("teacher", "task", F.when(F.col("g") == 1, "category").otherwise("key").alias("level"), F.when(F.col("g") == 1, F.col("_cat")).otherwise(F.col("_key")).alias("key"), "occurrences", "recovered")
    return per.join(n, ["teacher", "task"]).withColumns({"e_t": F.col("occurrences") / F.col("n"), "r_t": F.col("recovered") / F.col("occurrences")})


def weighted_views(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """(teacher, task, view, score): sum of q * E * R in all views, and the controls; a trajectory without errors scores 0."""
    c = components(segments)
    level = F.when(F.endswith("view", F.lit("_cat")), "category").otherwise("key")
    p = F.broadcast(profiles.withColumn("level", level))  # at most six rows for each key of the taxonomy
    hit = c.join(p, ["level", "key"]).groupBy("teacher", "task", "view").agg(F.sum(F.expr("q * e_t * r_t")).alias("score"))
    every = segments.select("teacher", "task").distinct().join(F.broadcast(profiles.select("view").distinct()))
    scored = every.join(hit, ["teacher", "task", "view"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = c.where("level = 'key'").groupBy("teacher", "task").agg(
        F.sum(F.expr("e_t * r_t")).alias("recovery_density"), F.sum("e_t").alias("total_error_rate"), (F.sum("recovered") / F.first("n")).alias("recovery_event_rate"), (F.sum("recovered") / F.sum("occurrences")).alias("recovery_rate_unweighted"),
    )
    names = ("recovery_density", "total_error_rate", "recovery_event_rate", "recovery_rate_unweighted")
    rows = F.array(*(F.struct(F.lit(f"control_{v}").alias("view"), F.col(v).alias("score")) for v in names))
    return scored.unionByName(own.select("teacher", "task", F.explode(rows).alias("r")).select("teacher", "task", "r.*"))


def failed_and_recovered(teacher: DataFrame, student: DataFrame, name: str = "student") -> DataFrame:
    """(agent, category, failed, recovered, place): the bars of the report, categories placed by their total over all agents.

    teacher: components(); student: student_recovery().
    """
    t = teacher.where("level = 'category'").groupBy(F.col("teacher").cast("string").alias("agent"), F.col("key").alias("category")).agg(F.sum("occurrences").alias("failed"), F.sum("recovered").alias("recovered"))
    s = student.groupBy(F.lit(name).alias("agent"), category_of("key").alias("category")).agg(F.sum("occurrences").alias("failed"), (F.sum("occurrences") - F.sum("unrecovered")).alias("recovered"))
    bars = t.unionByName(s)
    totals = bars.groupBy("category").agg(F.sum("failed").alias("all")).agg(F.array_sort(F.collect_list(F.struct((-F.col("all")).alias("m"), "category"))).alias("o"))
    order = totals.select(F.posexplode(F.transform("o", lambda x: x["category"])).alias("place", "category"))
    return bars.join(F.broadcast(order), "category").select("agent", "category", "failed", "recovered", "place")


def roll_up(views: dict[str, DataFrame]) -> DataFrame:
    """Profiles of several subsets as one long table with a column view."""
    return reduce(DataFrame.unionByName, (df.withColumn("view", F.lit(v)) for v, df in views.items()))
