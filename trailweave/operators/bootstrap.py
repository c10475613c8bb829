"""Bootstrap over tasks: draws as a table (rep, idx, cnt), one join and one aggregation."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import positions


def indexed(scores: DataFrame) -> DataFrame:
    """Scores with idx, the position of their task in task order."""
    return scores.join(positions(scores, "task"), "task")


def counted(slots: DataFrame) -> DataFrame:
    """(rep, idx, cnt) of single draws, dealt by idx, which the join with the scores keeps."""
    return slots.repartition("idx").groupBy("rep", "idx").agg(F.count("*").alias("cnt"))


def hashed_draws(tasks: DataFrame, reps: int) -> DataFrame:
    """Draws with replacement that any engine can repeat: slot k of a replicate takes md5(rep:k) modulo n.

    The slots are a range of known length, so they are made all over the cluster and no plan takes them for a small side.
    """
    spark = tasks.sparkSession
    n = tasks.select("task").where("task is not null").distinct().count()
    parts = max(spark.sparkContext.defaultParallelism, n * reps // SLOTS_A_TASK)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.expr(f"id div {max(n, 1)}").cast("string"), (F.col("id") % max(n, 1)).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return counted(spark.range(0, n * reps, 1, parts).select(F.expr(f"id div {max(n, 1)}").cast("int").alias("rep"), (h % max(n, 1)).alias("idx")))


#: Slots that one task makes, and what the seeded shuffle may hold on the driver (`hashed_places` has no such bound).
SLOTS_A_TASK, SEEDED_MOST = 1_000_000, 10_000_000
#: Draws of the generator that are looked at together, whatever the pool.
BLOCK = 262_144


def _outputs(key, pos: int):
    """numpy's generator in a state of Python's, whose 32-bit outputs it repeats."""
    import numpy as np

    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, dtype="uint32"), "pos": pos}}
    return bits


def _below(raw, n: int):
    """What randrange(n) makes of 32-bit outputs; those that it turns down are left in, as n or more."""
    k = n.bit_length()
    if k <= 32:
        return raw >> (32 - k)
    return raw[::2] | raw[1::2] >> (64 - k) << 32


def _pieces(n: int, reps: int, seed: int, block: int) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(rep, key, pos, skip, take): where in the generator's output the draws of each replicate are, at most one block each. Holds one block."""
    import numpy as np

    *key, pos = random.Random(seed).getstate()[1]
    bits, words = _outputs(key, pos), 1 if n.bit_length() <= 32 else 2
    rep, left = 0, n
    while rep < reps:
        at, skip = bits.state["state"], 0
        key, pos = at["key"].tobytes(), int(at["pos"])
        rest = int(np.count_nonzero(_below(bits.random_raw(block * words), n) < n))
        while rest and rep < reps:
            take = min(rest, left)
            yield rep, key, pos, skip, take
            skip, rest, left = skip + take, rest - take, left - take
            if not left:
                rep, left = rep + 1, n


def seeded_draws(spark, n: int, reps: int, seed: int, block: int = BLOCK) -> DataFrame:
    """Draws of Python's generator in replicate order, for parity with seeded runs.

    The driver only runs through the generator's output, block by block, and
    notes its state before each; the tasks make the draws from there.
    """
    import numpy as np
    import pyarrow as pa

    def made(batches):
        for batch in batches:
            for x in batch.to_pylist():
                got = _below(_outputs(np.frombuffer(x["key"], "uint32"), x["pos"]).random_raw(block * (1 if n.bit_length() <= 32 else 2)), n)
                idx = got[got < n][x["skip"] : x["skip"] + x["take"]].astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array([x["rep"]] * len(idx), pa.int32()), pa.array(idx)], ["rep", "idx"])

    pieces = list(_pieces(n, reps, seed, block)) if n else []
    parts = max(1, min(len(pieces), max(spark.sparkContext.defaultParallelism, n * reps // SLOTS_A_TASK)))
    rows = spark.createDataFrame(pieces, "rep int, key binary, pos int, skip int, take int").repartition(parts)
    return counted(rows.mapInArrow(made, "rep int, idx long"))


def replicate_means(scores: DataFrame, draws: DataFrame) -> DataFrame:
    """(rep, teacher, mean): scores weighted by how often their task was drawn."""
    j = draws.join(indexed(scores).select("idx", "teacher", "score").hint("shuffle_hash"), "idx")  # the draws are many rows a task: they are neither broadcast nor sorted
    return j.groupBy("rep", "teacher").agg((F.sum(F.col("score") * F.col("cnt")) / F.sum("cnt")).alias("mean"))


def rank_distribution(means: DataFrame) -> DataFrame:
    """Share of replicates in which each teacher takes each place; ties go by name."""
    ranked = means.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("mean"), "teacher")))
    total = means.agg(F.countDistinct("rep").alias("reps"))
    return ranked.groupBy("teacher", "place").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("teacher", "place", (F.col("n") / F.col("reps")).alias("p"))


def interval(means: DataFrame) -> DataFrame:
    """Percentile bounds without interpolation: entries int(.025 n) and min(int(.975 n), n - 1)."""
    s = means.groupBy("teacher").agg(F.array_sort(F.collect_list("mean")).alias("s"), F.count("*").alias("n"))
    at = lambda p: F.get("s", F.least(F.floor(F.col("n") * p), F.col("n") - 1).cast("int"))
    return s.select("teacher", at(0.025).alias("low"), at(0.975).alias("high"))


def hashed_places(scores: DataFrame) -> DataFrame:
    """(task, at): the tasks in the order of their MD5 digests, without a single sorting task."""
    t = scores.select(F.col("task").cast("string").alias("task")).distinct().withColumn("_h", F.md5(F.col("task").cast("binary")))
    return t.join(positions(t, "_h"), "_h").select("task", F.col("idx").alias("at"))


def seeded_places(scores: DataFrame, seed: int) -> DataFrame:
    """(task, at): the tasks as Python's generator shuffles them, for parity with seeded runs; more than SEEDED_MOST are refused."""
    tasks = [str(r[0]) for r in scores.select("task").distinct().limit(SEEDED_MOST + 1).toLocalIterator()]
    if len(tasks) > SEEDED_MOST:
        raise ValueError("too many tasks for one generator, use hashed_places")
    tasks.sort()
    random.Random(seed).shuffle(tasks)
    return scores.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tasks)] or [], "task string, at int")


def nested_orders(scores: DataFrame, sizes: list[int], seed: int = 0, places: DataFrame | None = None) -> DataFrame:
    """(n, ranking) on nested prefixes of one task order, a seeded shuffle by default; sizes beyond the pool are clamped and merged."""
    spark = scores.sparkSession
    place = seeded_places(scores, seed) if places is None else places
    pool = place.count()
    grid = spark.createDataFrame([(n,) for n in sorted({min(n, pool) for n in sizes})], "n int")
    j = scores.select(F.col("task").cast("string").alias("task"), "teacher", "score").join(place, "task").join(F.broadcast(grid), F.expr("at < n"))
    means = j.groupBy("n", "teacher").agg(F.avg("score").alias("m"))
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "teacher"))), lambda s: s["teacher"]), " > ")
    return means.groupBy("n").agg(order.alias("ranking"))


def smallest_stable(orders: DataFrame, full: str) -> DataFrame:
    """The least n from which on every ranking is the full one."""
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return orders.withColumn("ok", F.every(F.col("ranking") == full).over(w)).where("ok").agg(F.min("n").alias("smallest_stable_n"))


def paired_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean difference, bounds and share above 0 of two statistics (rep, value) over the same draws."""
    d = a.join(b.withColumnRenamed("value", "other"), "rep").select((F.col("value") - F.col("other")).alias("mean"), F.lit("difference").alias("teacher"))
    return d.agg(F.avg("mean").alias("mean"), (F.count_if(F.expr("mean > 0")) / F.count("*")).alias("p_positive")).join(F.broadcast(interval(d).drop("teacher")))


def flips(orders: DataFrame) -> DataFrame:
    """(proxy, verdict): whether a proxy's order changes between students; fewer than two orders are invariant by absence."""
    k = orders.groupBy("proxy").agg(F.countDistinct("ranking").alias("k"), F.count("*").alias("n"))
    return k.select("proxy", F.when(F.col("n") < 2, "invariant").when(F.col("k") > 1, "yes").otherwise("no").alias("flips"))
