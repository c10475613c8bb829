"""The selection pool: trajectories with their scores and token counts, the arms drawn from it, and the subset reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import guard
from . import scores

KEY = ["teacher", "task"]
#: arm: the column it optimises and its direction.
ARMS: Mapping[str, tuple[str, int]] = {"rsr_low": ("rsr", -1), "rsr_high": ("rsr", 1), "tor_high": ("tor", 1), "nll_low": ("nll", -1), "rank_low": ("rank", -1)}


def candidates(trajectories: DataFrame, score_rows: DataFrame, token_audit: DataFrame | None = None, truncated: str = "sft_turns_truncated") -> DataFrame:
    """One row per (teacher, task) that every teacher has in every input and none truncates.

    trajectories (teacher, task, trajectory_id, ...) joins score_rows and
    token_audit (teacher, task, trajectory_id, ...) by key; an identifier that
    differs between them fails the query.
    """
    out = trajectories
    for other in (score_rows, token_audit):
        if other is not None:
            o = other.withColumnRenamed("trajectory_id", "_other")
            out = guard(out.join(o, KEY), ~F.col("trajectory_id").eqNullSafe(F.col("_other")), "trajectory ids differ between inputs").drop("_other")
    if token_audit is not None:
        return scores.complete_tasks(out, truncated)
    return scores.common_support(out.withColumn("_one", F.lit(1.0)), value="_one").drop("_one")


def utility(arm: str, undefined: float = -1.0) -> Column:
    """The utility of an arm; an undefined grounding share ranks below every defined one."""
    column, sign = ARMS[arm]
    return (F.coalesce(F.col(column), F.lit(undefined)) if column == "tor" else F.col(column)) * sign


def arms(pool: DataFrame, names: Iterable[str] = tuple(ARMS)) -> DataFrame:
    """(arm, task, teacher, utility) of the unconstrained arms."""
    out = None
    for name in names:
        made = scores.best_per_task(pool, utility(name)).select(F.lit(name).alias("arm"), "task", "teacher", "utility")
        out = made if out is None else out.unionByName(made)
    return out


def global_arm(pool: DataFrame, teacher: str) -> DataFrame:
    """Every task from one teacher."""
    return pool.where(F.col("teacher") == teacher).select("task", "teacher")


def arm_overlap(arm_rows: DataFrame, base: str) -> DataFrame:
    """(arm, n, shared, share): how many of each arm's choices the base arm makes too."""
    b = arm_rows.where(F.col("arm") == base).select("task", "teacher", F.lit(1).alias("hit"))
    j = arm_rows.join(b, ["task", "teacher"], "left")
    return j.groupBy("arm").agg(F.count("*").alias("n"), F.count("hit").alias("shared"), (F.count("hit") / F.count("*")).alias("share"))


def summary(rows: DataFrame, *columns: str) -> DataFrame:
    """min, median, mean and max of columns, one row for each."""
    parts = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns))
    return rows.select(F.explode(parts).alias("r")).select("r.*").groupBy("field").agg(F.min("v").alias("min"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def at_positions(manifest: DataFrame, records: DataFrame, own_id: str = "own_task") -> DataFrame:
    """The record of each (task, teacher) at the position that the manifest gives; one with another task's id fails.

    manifest: task, teacher_record_index (teacher -> position); records:
    teacher, pos, own_task and anything else.
    """
    wanted = manifest.select("task", F.explode("teacher_record_index").alias("teacher", "pos"))
    return guard(wanted.join(records, ["teacher", "pos"]), ~F.col("task").eqNullSafe(F.col(own_id)), "the manifest points at another task's record")


def difficulty_counts(rows: DataFrame) -> DataFrame:
    """(difficulty, tasks): blank values are missing; two values for one task fail."""
    d = F.nullif(F.trim("difficulty"), F.lit(""))
    per = rows.groupBy("task").agg(F.countDistinct(d).alias("kinds"), F.max(d).alias("difficulty"))
    return guard(per, F.col("kinds") > 1, "difficulty differs across teachers").groupBy("difficulty").agg(F.count("*").alias("tasks"))


def missing_by_teacher(rows: DataFrame, *columns: str) -> DataFrame:
    """(teacher, field, missing): null or blank metadata."""
    parts = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias("v")) for c in columns))
    return rows.select("teacher", F.explode(parts).alias("r")).groupBy("teacher", "r.field").agg(F.count_if(F.expr("r.v = ''")).alias("missing"))


def alignment(rows: DataFrame, *texts: str) -> DataFrame:
    """(field, tasks, equal): tasks whose text is the same for every teacher."""
    parts = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in texts))
    per = rows.select("task", F.explode(parts).alias("r")).groupBy("task", "r.field").agg((F.countDistinct("r.v") == 1).alias("same"))
    return per.groupBy("field").agg(F.count("*").alias("tasks"), F.count_if("same").alias("equal"))
