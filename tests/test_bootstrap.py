"""Draws, replicate means, intervals and stability."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trailweave.operators import bootstrap

ROWS = [(t, k, float((t * 7 + k * 3) % 11)) for t in range(6) for k in range(3)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(t, f"m{k}", s) for t, k, s in ROWS], "task int, teacher string, score double")


def test_hashed_draws_repeat_in_any_engine(spark, table):
    got = {(r.rep, r.idx): r.cnt for r in bootstrap.hashed_draws(table.select("task").distinct(), 3).collect()}
    want = Counter((rep, int(hashlib.md5(f"{rep}:{k}".encode()).hexdigest()[:8], 16) % 6) for rep in range(3) for k in range(6))
    assert got == dict(want)


def test_seeded_draws_follow_the_generator(spark):
    r = random.Random(42)
    want = [Counter(r.randrange(5) for _ in range(5)) for _ in range(4)]
    got = {(x.rep, x.idx): x.cnt for x in bootstrap.seeded_draws(spark, 5, 4, 42).collect()}
    assert got == {(rep, i): c for rep, draws in enumerate(want) for i, c in draws.items()}


@pytest.mark.parametrize(("n", "reps", "block"), [(5, 4, 7), (6, 3, 1000), (64, 3, 50), (1, 2, 3)])
def test_seeded_draws_follow_the_generator_across_blocks(spark, n, reps, block):
    r = random.Random(7)
    want = {(rep, i): c for rep in range(reps) for i, c in Counter(r.randrange(n) for _ in range(n)).items()}
    assert {(x.rep, x.idx): x.cnt for x in bootstrap.seeded_draws(spark, n, reps, 7, block).collect()} == want


def test_draws_of_two_words(spark):
    r, n = random.Random(3), 5_000_000_001
    rep, key, pos, skip, take = next(bootstrap._pieces(n, 1, 3, 500))
    got = bootstrap._below(bootstrap._outputs(np.frombuffer(key, "uint32"), pos).random_raw(1000), n)
    assert [int(x) for x in got[got < n][skip : skip + take]] == [r.randrange(n) for _ in range(take)]


def test_more_draws_than_one_driver_holds_are_made(spark):
    draws = bootstrap.seeded_draws(spark, 60_000, 200, 1)
    assert draws.agg({"cnt": "sum"}).first()[0] == 12_000_000


def test_hashed_draws_are_made_all_over_and_never_broadcast(spark):
    tasks = spark.range(2000).selectExpr("id AS task", "'m' AS teacher", "id * 1.0D AS score")
    draws = bootstrap.hashed_draws(tasks.select("task"), 200)
    assert "Range (0, 400000" in draws._jdf.queryExecution().toString()  # of known length, where an exploded row has none
    means = bootstrap.replicate_means(tasks, draws)
    assert "ShuffledHashJoin" in means._jdf.queryExecution().executedPlan().toString()
    assert means.count() == 200


def test_replicate_means_and_bounds(spark, table):
    draws = bootstrap.seeded_draws(spark, 6, 50, 1)
    counts = {(x.rep, x.idx): x.cnt for x in draws.collect()}
    score = {(t, f"m{k}"): s for t, k, s in ROWS}
    got = {(x.rep, x.teacher): x["mean"] for x in bootstrap.replicate_means(table, draws).collect()}
    for (rep, teacher), mean in got.items():
        own = {i: c for (p, i), c in counts.items() if p == rep}
        assert mean == pytest.approx(sum(score[i, teacher] * c for i, c in own.items()) / sum(own.values()))
    bounds = {x.teacher: (x.low, x.high) for x in bootstrap.interval(bootstrap.replicate_means(table, draws)).collect()}
    s = sorted(m for (_, t), m in got.items() if t == "m1")
    assert bounds["m1"] == (s[int(0.025 * 50)], s[min(int(0.975 * 50), 49)])
    shares = bootstrap.rank_distribution(bootstrap.replicate_means(table, draws)).groupBy("teacher").sum("p").collect()
    assert all(x["sum(p)"] == pytest.approx(1.0) for x in shares)


def test_smallest_stable_n(spark):
    orders = spark.createDataFrame([(5, "a > b"), (10, "b > a"), (20, "a > b"), (40, "a > b")], "n int, ranking string")
    assert bootstrap.smallest_stable(orders, "a > b").first().smallest_stable_n == 20


def test_paired_difference_and_flips(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(10)], "rep int, value double")
    b = spark.createDataFrame([(i, 4.5) for i in range(10)], "rep int, value double")
    got = bootstrap.paired_difference(a, b).first()
    assert (got["mean"], got.p_positive) == (0.0, 0.5)
    orders = spark.createDataFrame([("p", "a > b"), ("p", "b > a"), ("q", "a > b"), ("q", "a > b"), ("r", "a")], "proxy string, ranking string")
    assert {r.proxy: r.flips for r in bootstrap.flips(orders).collect()} == {"p": "yes", "q": "no", "r": "invariant"}
