"""Teacher-by-task scores: support, aggregation, ranks, rank statistics, winners, selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import mid_ranks

SIGN = {"higher_better": 1, "lower_better": -1}
#: Metrics whose direction is fixed, whatever a score file declares.
FIXED_DIRECTION = {"grace": "lower_better", "rsr": "lower_better"}


def direction_of(metric: str, declared: str | None = None) -> str:
    """The direction that counts; one that is neither up nor down fails."""
    out = FIXED_DIRECTION.get(metric, declared or "higher_better")
    if out not in SIGN:
        raise ValueError(f"{metric}: unknown direction {out!r}")
    return out


def stale(scores: DataFrame, setting: str, current: str) -> bool:
    """Whether a stored score table was made with another value of a setting in its meta; an empty table is not stale."""
    first = scores.select(F.col(f"meta.{setting}").cast("string").alias("v")).head(1)
    return bool(first) and first[0].v != current


def predicted_order(means: DataFrame, truth: DataFrame, value: str = "score") -> DataFrame:
    """One row: the predicted order (ties as published), whether its ends are in the published end groups, and whether all scores tie."""
    t = means.join(F.broadcast(truth), "teacher")  # teachers are a small dimension
    a = t.agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("m"), "pos", "teacher", "grp"))).alias("o"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.countDistinct(value).alias("k"))
    free = F.col("k") > 1
    return a.select(
        F.array_join(F.transform("o", lambda x: x["teacher"]), " > ").alias("predicted"), (free & (F.element_at("o", 1)["grp"] == F.col("lo"))).alias("top1_correct"),
        (free & (F.element_at("o", -1)["grp"] == F.col("hi"))).alias("worst_correct"), (~free).alias("all_tied"),
    )


def common_support(scores: DataFrame, by: str = "teacher", task: str = "task", value: str = "score") -> DataFrame:
    """Rows of the tasks for which every teacher has a value (relational division)."""
    known = scores.where(F.col(value).isNotNull() & ~F.isnan(value))
    total = known.agg(F.countDistinct(by).alias("all"))
    full = known.groupBy(task).agg(F.countDistinct(by).alias("own")).join(F.broadcast(total), F.expr("own = all")).select(task)
    return known.join(full, task, "left_semi")


def teacher_means(scores: DataFrame, num: str = "num", den: str = "den", direction: str = "higher_better") -> DataFrame:
    """Ratio of sums by teacher, and the utility that points up whatever the direction."""
    if direction not in SIGN:
        raise ValueError(f"unknown direction: {direction}")
    ratio = F.sum(num) / F.sum(den)
    return scores.groupBy("teacher").agg(F.count("*").alias("n_tasks"), ratio.alias("raw")).withColumn("utility", F.col("raw") * SIGN[direction])


def unpivot_views(scores: DataFrame, views: str = "score_views") -> DataFrame:
    """One row per logical result: proxy/view."""
    kept = [c for c in scores.columns if c not in (views, "proxy", "score")]
    return scores.select(*kept, "proxy", F.explode(views).alias("view", "score")).select(*kept, F.concat_ws("/", "proxy", "view").alias("result"), "score")


def dispersion(scores: DataFrame) -> DataFrame:
    """Within-teacher spread; one value has a deviation of 0."""
    x = F.col("score")
    q = lambda p: F.percentile(x, F.lit(p))
    return scores.groupBy("teacher").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"),
        q(0.25).alias("q1"), q(0.75).alias("q3"), (q(0.75) - q(0.25)).alias("iqr"), F.min(x).alias("min"), F.max(x).alias("max"),
    )


def winner_share(scores: DataFrame) -> DataFrame:
    """Share of tasks that each teacher wins; a tie of k gives 1/k to each."""
    top = scores.groupBy("task").agg(F.max("score").alias("top"))
    won = scores.join(top, "task").where("score = top")
    ties = won.groupBy("task").agg(F.count("*").alias("k"))
    credit = won.join(ties, "task").groupBy("teacher").agg(F.sum(1 / F.col("k")).alias("wins"), F.count("*").alias("n_best"), F.max("k").alias("widest_tie"))
    total = top.agg(F.count("*").alias("tasks"))
    return credit.join(F.broadcast(total)).select("teacher", (F.col("wins") / F.col("tasks")).alias("share"), "n_best", "widest_tie")


def mid_rank(by: Sequence[str], value: str) -> Column:
    """Average rank of ties, from 1, ascending."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL without variance, where F.corr divides by zero and fails."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation in each group; NULL without variance or with fewer than two rows."""
    ranked = pairs.withColumns({"rx": mid_rank(by, x), "ry": mid_rank(by, y)})
    some = (F.count("*") > 1) & (F.var_pop("rx") > 0) & (F.var_pop("ry") > 0)
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(some, correlation("rx", "ry")).alias("rho"))


def competition_ranks(means: DataFrame, value: str = "score") -> DataFrame:
    """1224 ranks by exact value, and the ranking as text, ties joined by =."""
    w = Window.orderBy(F.desc(value))  # teachers are a small dimension
    ranked = means.withColumn("rank", F.rank().over(w))
    groups = ranked.groupBy("rank").agg(F.array_join(F.array_sort(F.collect_list("teacher")), " = ").alias("tied"))
    text = groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tied"))), lambda g: g["tied"]), " > ").alias("ranking"))
    return ranked.join(F.broadcast(text)).select("teacher", value, "rank", "ranking")


def rank_pivot(ranked: DataFrame, places: int = 4) -> DataFrame:
    """Columns teacher_rank_1.. with ties joined; the places after a tie stay empty."""
    cells = ranked.groupBy("rank").agg(F.array_join(F.array_sort(F.collect_list("teacher")), " = ").alias("cell"))
    return cells.agg(*(F.max(F.when(F.col("rank") == p, F.col("cell"))).alias(f"teacher_rank_{p}") for p in range(1, places + 1)))


def truth_table(spark, groups: Sequence[Sequence[str]], gains: Mapping[str, float] | None = None) -> DataFrame:
    """Ordered tie groups as rows (teacher, grp, pos, gain)."""
    rows, pos = [], 0
    for g, names in enumerate(groups):
        for name in names:
            rows.append((name, g, pos, float((gains or {}).get(name, 0.0))))
            pos += 1
    return spark.createDataFrame(rows, "teacher string, grp int, pos int, gain double")


def _pairs(means: DataFrame, truth: DataFrame) -> DataFrame:
    t = means.join(F.broadcast(truth), "teacher")
    return t.alias("a").join(F.broadcast(t).alias("b"), F.expr("a.pos < b.pos"))


def kendall_tau_b(means: DataFrame, truth: DataFrame, value: str = "score") -> DataFrame:
    """tau-b between utilities and the published order; NULL where it is undefined."""
    p = _pairs(means, truth).select(F.signum(F.col(f"a.{value}") - F.col(f"b.{value}")).alias("u"), F.signum(F.expr("b.grp - a.grp")).alias("g"))
    c = p.agg(
        F.count_if(F.expr("u * g > 0")).alias("concordant"), F.count_if(F.expr("u * g < 0")).alias("discordant"),
        F.count_if(F.expr("u <> 0")).alias("free_u"), F.count_if(F.expr("g <> 0")).alias("free_g"),
    )
    tau = (F.col("concordant") - F.col("discordant")) / F.sqrt(F.col("free_u") * F.col("free_g"))
    return c.select("concordant", "discordant", F.when((F.col("free_u") > 0) & (F.col("free_g") > 0), tau).alias("tau_b"))


def pairwise_accuracy(means: DataFrame, truth: DataFrame, value: str = "score") -> DataFrame:
    """Share of the pairs that the truth orders and the scores order alike; an exact tie counts half."""
    p = _pairs(means, truth).where("a.grp <> b.grp")
    right = F.when(F.col(f"a.{value}") > F.col(f"b.{value}"), 1.0).when(F.col(f"a.{value}") == F.col(f"b.{value}"), 0.5).otherwise(0.0)
    return p.agg(F.count("*").alias("comparable"), F.avg(right).alias("accuracy"))


def ndcg_regret(means: DataFrame, truth: DataFrame, value: str = "score") -> DataFrame:
    """NDCG at 1 and 2, and the gain lost by taking the top-ranked teacher; ties go by name."""
    t = means.join(F.broadcast(truth), "teacher")
    got = t.withColumn("i", F.row_number().over(Window.orderBy(F.desc(value), "teacher"))).withColumn("ideal", F.row_number().over(Window.orderBy(F.desc("gain"), "teacher")))
    dcg = lambda place, k: F.sum(F.when(F.col(place) <= k, F.col("gain") / F.log2(F.col(place) + 1)))
    top = F.max(F.when(F.col("i") == 1, F.col("gain")))
    return got.agg((dcg("i", 1) / dcg("ideal", 1)).alias("ndcg_1"), (dcg("i", 2) / dcg("ideal", 2)).alias("ndcg_2"), (F.max("gain") - top).alias("regret"))


def tie_key(*parts: str) -> Column:
    """Seedless tie-break: the first 64 bits of sha256 over the parts, in hex order."""
    return F.substring(F.sha2(F.concat_ws("\x00", *(F.col(p).cast("string") for p in parts)), 256), 1, 16)


def best_per_task(scores: DataFrame, utility: Column) -> DataFrame:
    """The teacher of the highest finite utility for each task; ties by hash, then name."""
    u = scores.withColumn("utility", utility.cast("double")).where("utility is not null and not isnan(utility) and abs(utility) < double('infinity')")
    best = F.max(F.struct("utility", tie_key("task", "teacher").alias("tie"), "teacher")).alias("b")
    return u.groupBy("task").agg(best).select("task", "b.teacher", "b.utility")


def arm_report(arm: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Rows, token sums and token share by teacher of one selection."""
    total = arm.agg(F.sum(tokens).alias("all_tokens"))
    per = arm.groupBy("teacher").agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens"), F.sum(F.col(tokens) * F.col(tokens)).alias("squared"), F.min(tokens).alias("least"), F.max(tokens).alias("most"))
    return per.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("all_tokens")).drop("all_tokens")


def within_task_spread(scores: DataFrame, value: str = "score") -> DataFrame:
    """Summary of (max - min) over the teachers of each task."""
    s = scores.groupBy("task").agg((F.max(value) - F.min(value)).alias("spread"))
    return s.agg(F.min("spread").alias("min"), F.median("spread").alias("median"), F.avg("spread").alias("mean"), F.max("spread").alias("max"))


def centered_spearman(scores: DataFrame, x: str, y: str, places: int = 9) -> DataFrame:
    """Spearman of two fields after each task's mean is taken off; `places` says what counts as a tie."""
    w = Window.partitionBy("task")
    c = scores.select(*(F.round(F.col(v) - F.avg(v).over(w), places).alias(v) for v in (x, y)))
    both = c.join(mid_ranks(c, x).withColumnRenamed("rank", "rx"), x).join(mid_ranks(c, y).withColumnRenamed("rank", "ry"), y)
    return both.agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho"))


def complete_tasks(rows: DataFrame, truncated: str, by: str = "teacher", task: str = "task") -> DataFrame:
    """Rows of tasks that every teacher has and none truncates."""
    bad = rows.where(F.col(truncated) > 0).select(task).distinct()
    return common_support(rows.withColumn("_one", F.lit(1.0)), by, task, "_one").drop("_one").join(bad, task, "left_anti")


def missing_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of two small dimensions, with the rows of each and whether it is missing."""
    have = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = rows.select(a).distinct().crossJoin(F.broadcast(rows.select(b).distinct()))
    return grid.join(have, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def ols(rows: DataFrame, y: str, xs: Sequence[str]) -> list[float]:
    """Least squares with intercept from sums over the cluster; the minimum-norm solution where columns depend."""
    import numpy as np

    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    sums = rows.agg(*(F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)), *(F.sum(a * F.col(y)).alias(f"b{i}") for i, a in enumerate(cols))).first()
    n = len(cols)
    return np.linalg.lstsq(np.array(sums[: n * n]).reshape(n, n), np.array(sums[n * n :]), rcond=None)[0].tolist()
