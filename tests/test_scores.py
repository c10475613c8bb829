"""Support, aggregation and rank statistics against published constants and brute force."""

from __future__ import annotations

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailweave.operators import scores


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ratio_of_means_is_not_the_mean_of_ratios(spark):
    rows = [("A", "t1", 1.0, 1.0), ("B", "t1", 4.0, 1.0), ("A", "t2", 9.0, 9.0), ("B", "t2", 4.0, 1.0)]
    got = {r.teacher: (r.raw, r.utility) for r in scores.teacher_means(frame(spark, rows, "teacher string, task string, num double, den double"), direction="lower_better").collect()}
    assert got == {"A": (1.0, -1.0), "B": (4.0, -4.0)}


def test_unknown_direction_fails(spark):
    with pytest.raises(ValueError, match="unknown direction"):
        scores.teacher_means(frame(spark, [], "teacher string, num double, den double"), direction="sideways")


def test_common_support_leaves_out_tasks_without_every_value(spark):
    rows = [("A", 1, 1.0), ("B", 1, 2.0), ("A", 2, 1.0), ("B", 2, None), ("A", 3, float("nan")), ("B", 3, 1.0)]
    got = scores.common_support(frame(spark, rows, "teacher string, task int, score double")).collect()
    assert sorted((r.teacher, r.task) for r in got) == [("A", 1), ("B", 1)]


def test_views_become_results(spark):
    rows = [("p", "A", 1, 0.5, {"more": 2.0, "fewer": -2.0})]
    got = scores.unpivot_views(frame(spark, rows, "proxy string, teacher string, task int, score double, score_views map<string,double>"))
    assert sorted((r.result, r.score) for r in got.collect()) == [("p/fewer", -2.0), ("p/more", 2.0)]


def test_tau_b_with_a_tie_group(spark):
    truth = scores.truth_table(spark, [["DS"], ["GLM", "Q35"], ["CL"]])
    means = frame(spark, [("Q35", -4.0), ("GLM", -3.0), ("DS", -2.0), ("CL", -1.0)], "teacher string, score double")
    assert scores.kendall_tau_b(means, truth).first().tau_b == pytest.approx(-0.18257418583505536)
    assert scores.pairwise_accuracy(means, truth).first().accuracy == pytest.approx(0.4)


def test_tau_b_is_undefined_without_variation(spark):
    truth = scores.truth_table(spark, [["A"], ["B"]])
    assert scores.kendall_tau_b(frame(spark, [("A", 1.0), ("B", 1.0)], "teacher string, score double"), truth).first().tau_b is None


def test_ranking_text_and_pivot(spark):
    means = frame(spark, [("B", 29.4), ("A", 31.8), ("C", 29.4), ("D", 24.7)], "teacher string, score double")
    ranked = scores.competition_ranks(means)
    assert {r.teacher: r["rank"] for r in ranked.collect()} == {"A": 1, "B": 2, "C": 2, "D": 4}
    assert ranked.first().ranking == "A > B = C > D"
    assert tuple(scores.rank_pivot(ranked).first()) == ("A", "B = C", None, "D")


def test_one_value_has_no_deviation(spark):
    got = scores.dispersion(frame(spark, [("A", 2.0)], "teacher string, score double")).first()
    assert (got["std"], got["variance"], got["iqr"]) == (0.0, 0.0, 0.0)


def test_tied_winners_share(spark):
    rows = [("A", 1, 1.0), ("B", 1, 1.0), ("A", 2, 3.0), ("B", 2, 1.0)]
    got = {r.teacher: r.share for r in scores.winner_share(frame(spark, rows, "teacher string, task int, score double")).collect()}
    assert got == {"A": 0.75, "B": 0.25}


def test_best_per_task_breaks_ties_by_digest(spark):
    import hashlib

    rows = [("A", "t", 1.0), ("B", "t", 1.0), ("C", "t", None), ("D", "t", float("nan")), ("E", "t", float("inf"))]
    got = scores.best_per_task(frame(spark, rows, "teacher string, task string, u double"), F.col("u")).first()
    assert got.teacher == max("AB", key=lambda t: hashlib.sha256(f"t\x00{t}".encode()).hexdigest()[:16])


def brute_mid_ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=12))
def test_spearman_on_mid_ranks(spark, pairs):
    got = scores.spearman(frame(spark, [(1, float(x), float(y)) for x, y in pairs], "g int, x double, y double"), ["g"], "x", "y").first().rho
    a, b = brute_mid_ranks([x for x, _ in pairs]), brute_mid_ranks([y for _, y in pairs])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    va, vb = sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b)
    if va and vb:
        assert got == pytest.approx(sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(va * vb), abs=1e-9)
    else:
        assert got is None


def test_spearman_without_variance_is_null(spark):
    rows = [(1, 1.0, 2.0), (1, 2.0, 2.0), (2, 1.0, 1.0), (2, 2.0, 3.0)]
    assert {r.g: r.rho for r in scores.spearman(frame(spark, rows, "g int, x double, y double"), ["g"], "x", "y").collect()} == {1: None, 2: pytest.approx(1.0)}
    level = frame(spark, [("a", 1, 1.0, 2.0), ("b", 1, 1.0, 3.0)], "teacher string, task int, x double, y double")
    assert scores.centered_spearman(level, "x", "y").first().rho is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=4, max_size=4), st.permutations(["a", "b", "c", "d"]))
def test_tau_b_by_brute_force(spark, values, order):
    truth = [[order[0]], [order[1], order[2]], [order[3]]]
    group = {t: g for g, ts in enumerate(truth) for t in ts}
    means = frame(spark, [(t, float(v)) for t, v in zip("abcd", values, strict=True)], "teacher string, score double")
    u = {t: v for t, v in zip("abcd", values, strict=True)}
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(u[x] - u[y]), sign(group[y] - group[x])) for x, y in itertools.combinations("abcd", 2)]
    fu, fg = sum(a != 0 for a, _ in pairs), sum(b != 0 for _, b in pairs)
    want = sum(a * b for a, b in pairs) / math.sqrt(fu * fg) if fu and fg else None
    got = scores.kendall_tau_b(means, scores.truth_table(spark, truth)).first().tau_b
    assert got is None if want is None else got == pytest.approx(want)


def test_least_squares_from_sums(spark):
    rows = [(float(x), float(z), 3.0 + 2.0 * x - z) for x in range(5) for z in range(3)]
    assert scores.ols(frame(spark, rows, "x double, z double, y double"), "y", ["x", "z"]) == pytest.approx([3.0, 2.0, -1.0])


def test_a_truncated_task_goes_for_every_teacher(spark):
    rows = [("A", 1, 0), ("B", 1, 1), ("A", 2, 0), ("B", 2, 0), ("A", 3, 0)]
    got = scores.complete_tasks(frame(spark, rows, "teacher string, task int, cut int"), "cut").collect()
    assert sorted((r.teacher, r.task) for r in got) == [("A", 2), ("B", 2)]


def test_centred_ranks_ignore_task_levels(spark):
    rows = [("A", 1, 1.0, 10.0), ("B", 1, 2.0, 11.0), ("A", 2, 101.0, 510.0), ("B", 2, 102.0, 511.0)]
    assert scores.centered_spearman(frame(spark, rows, "teacher string, task int, x double, y double"), "x", "y").first().rho == pytest.approx(1.0)
