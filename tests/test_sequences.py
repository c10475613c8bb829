"""Operators over ordered turns against loops in Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import sequences

ORDER = ["at"]
KINDS = ("look", "act", "error", "fix")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(u, i, r.choice(KINDS), r.choice("xyz")) for u in range(6) for i in range(r.randrange(1, 15))]


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "who int, at int, kind string, tool string")


def by_user(rows):
    out = {}
    for u, i, kind, tool in sorted(rows):
        out.setdefault(u, []).append((kind, tool))
    return out


def test_next_k_looks_at_the_next_rows_only(events, rows):
    got = {(r.who, r.at): r.recovered for r in sequences.next_k(events, "who", ORDER, F.col("kind") == "fix", 3).collect()}
    want = {(u, i): any(k == "fix" for k, _ in seq[i + 1 : i + 4]) for u, seq in by_user(rows).items() for i in range(len(seq))}
    assert got == want


def test_consecutive_retry(events, rows):
    got = {r.who: (r.failed, r.retried) for r in sequences.consecutive_retry(events, "who", ORDER, "tool", F.col("kind") == "error").collect()}
    want = {u: (sum(k == "error" for k, _ in s), sum(a[0] == "error" and a[1] == b[1] for a, b in zip(s, s[1:], strict=False))) for u, s in by_user(rows).items()}
    assert got == want


def test_cross_turn_retry_counts_pairs_of_turns(spark):
    rows = [(1, 1, "x", True), (1, 2, "x", True), (1, 3, "y", True), (1, 4, "y", False), (2, 1, "x", True)]
    e = spark.createDataFrame(rows, "who int, turn int, tool string, bad boolean")
    assert {r.who: (r.pairs, r.cycles) for r in sequences.cross_turn_retry(e, "who", "turn", "tool", F.col("bad")).collect()} == {1: (3, 1), 2: (0, 0)}


def test_look_before_and_check_after(events, rows):
    look, act = F.col("kind") == "look", F.col("kind") == "act"
    before = {r.who: (r.actions, r.grounded) for r in sequences.seen_before(events, "who", ORDER, "tool", act, look).collect()}
    after = {r.who: (r.actions, r.verified) for r in sequences.checked_after(events, "who", ORDER, act, look, 2).collect()}
    for u, s in by_user(rows).items():
        acts = [i for i, (k, _) in enumerate(s) if k == "act"]
        if acts:
            assert before[u] == (len(acts), sum(any(k == "look" and t == s[i][1] for k, t in s[:i]) for i in acts))
            assert after[u] == (len(acts), sum(any(k == "look" for k, _ in s[i + 1 : i + 3]) for i in acts))
        else:
            assert u not in before


def test_profiles_and_their_weighted_sum(spark):
    rows = [("A", "c1", True, True), ("A", "c1", True, False), ("A", "c2", False, False), ("A", "c2", True, False), ("B", "c1", True, True), ("B", "c9", True, True)]
    m = spark.createDataFrame(rows, "teacher string, cat string, bad boolean, recovered boolean")
    profile = sequences.recovery_profile(m, "teacher", "cat", F.col("bad"))
    assert {(r.teacher, r.cat): (r.e_t, r.r_t) for r in profile.collect()} == {("A", "c1"): (0.5, 0.5), ("A", "c2"): (0.25, 0.0), ("B", "c1"): (0.5, 1.0), ("B", "c9"): (0.5, 1.0)}
    student = spark.createDataFrame([("c1", 0.6, 0.2), ("c2", 0.4, 0.8)], "cat string, q_all double, q_unrecovered double")
    got = {r.teacher: (r.all_errors, r.unrecovered) for r in sequences.weighted_recovery(profile, student, "teacher", "cat").collect()}
    assert got["A"] == pytest.approx((0.15, 0.05))
    assert got["B"] == pytest.approx((0.3, 0.1))  # a category that the student lacks adds nothing


def test_smoothed_divergence(spark):
    counts = spark.createDataFrame([("A", "x", 3), ("A", "y", 1), ("B", "x", 2), ("B", "z", 2)], "who string, cat string, n long")
    got = sequences.divergence(sequences.smoothed(counts, "who", "cat", "n"), "who", "cat", "A").first()
    p = {k: (v + 1e-6) / (4 + 3e-6) for k, v in {"x": 3, "y": 1, "z": 0}.items()}
    q = {k: (v + 1e-6) / (4 + 3e-6) for k, v in {"x": 2, "y": 0, "z": 2}.items()}
    assert got.kl == pytest.approx(sum(p[k] * math.log(p[k] / q[k]) for k in p))
    assert got.overlap == pytest.approx(sum(p[k] * q[k] for k in p))


def test_alternation(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "user"), (2, 1, "user"), (2, 2, "assistant"), (3, 0, "assistant"), (4, 0, "user")]
    got = {r.conv_id: r.strict for r in sequences.alternation(spark.createDataFrame(rows, "conv_id int, turn int, role string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
