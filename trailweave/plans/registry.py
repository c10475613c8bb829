"""Metrics by name: functions of (spark, tables) that give score rows, and hooks for what is computed elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shell
from ..operators import profiles, tokens

Tables = Mapping[str, DataFrame]
METRICS: dict[str, Callable[[Tables], DataFrame]] = {}


def metric(name: str):
    def keep(f):
        METRICS[name] = f
        return f

    return keep


def run(name: str, tables: Tables) -> DataFrame:
    """Score rows of one metric; an unknown name and one that is only listed fail."""
    if name not in METRICS:
        raise KeyError(f"no metric {name}")
    return METRICS[name](tables)


def with_missing(rows: DataFrame, teachers: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row for every (teacher, task), `missing` where there is none."""
    grid = teachers.select("teacher").distinct().crossJoin(F.broadcast(tasks.select("task").distinct()))
    return grid.join(rows.withColumn("_have", F.lit(True)), ["teacher", "task"], "left").withColumn("missing", F.col("_have").isNull()).drop("_have")


@metric("teacher_bench")
def _bench(t: Tables) -> DataFrame:
    """Sourced benchmark results, the same for every task; a teacher without one fails."""
    from ..sources.readers import guard

    j = t["trajectories"].select("teacher", "task").join(F.broadcast(t["bench"].select("teacher", F.col("score").cast("double"))), "teacher", "left")
    return guard(j, F.col("score").isNull(), "a teacher has no sourced score")


@metric("traj_length")
def _length(t: Tables) -> DataFrame:
    return shell.trajectory_length(t["trajectories"]).select("teacher", "task", "score", "score_views")


def _grounded(column: str):
    return lambda t: shell.grounding(shell.with_events(t["trajectories"])).select("teacher", "task", F.col(column).alias("score"))


METRICS |= {"tor": _grounded("tor_list_loose_any"), "egs_post": _grounded("egs_post"), "egs_loop": _grounded("egs_loop")}


@metric("error_retry")
def _retry(t: Tables) -> DataFrame:
    r = shell.error_retry(shell.with_events(t["trajectories"]))
    rate = F.when(F.col("turn_pairs") > 0, F.col("cycles") / F.col("turn_pairs"))
    return r.select("teacher", "task", (-F.col("cycles")).cast("double").alias("score"), F.create_map(F.lit("rate"), -rate, F.lit("verbatim"), -F.col("verbatim_cycles").cast("double")).alias("score_views"))


METRICS |= {
    "global_nll": lambda t: tokens.global_nll(t["tokens"]),
    "rsr": lambda t: tokens.rank_surprisal(t["tokens"]),
    "aslec_drop": lambda t: tokens.step_drop(t["tokens"]).withColumn("score", F.col("drop")),
    "aslec_casl": lambda t: tokens.adjusted_for_heads(tokens.step_drop(t["tokens"])),
    "cmd_error": lambda t: profiles.command_errors(t["segments"]),
    "scrf": lambda t: profiles.weighted_views(t["segments"], t.get("profiles") or profiles.student_profiles(t["student"])),
}
METRICS |= {f"local_nll_k{k}": (lambda t, k=k: tokens.local_nll(t[f"tokens_k{k}"])) for k in (1, 2, 4, 8)}


@metric("scas")
def _blocks(t: Tables) -> DataFrame:
    return tokens.cosine_blocks(t["vectors"], "teacher", "vector")


def by_teacher(vectors: DataFrame, statistic: Callable[[pd.Series], float]) -> DataFrame:
    """(teacher, score) of a statistic over a teacher's vectors; the formula is the caller's."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"teacher": [key[0]], "score": [float(statistic(rows.vector))]})

    return vectors.select("teacher", "vector").groupBy("teacher").applyInPandas(one, "teacher string, score double")


@metric("grace")
def _grace(t: Tables) -> DataFrame:
    """Teacher-level only: each trajectory keeps its vector and no score of its own."""
    return t["vectors"].select("teacher", "task", F.lit(None).cast("double").alias("score"), F.col("vector").alias("grad_proj"))


@metric("lark")
def _lark(t: Tables) -> DataFrame:
    raise NotImplementedError("lark is listed but not implemented")
