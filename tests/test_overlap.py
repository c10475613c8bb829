"""Train/eval overlap against brute force."""

from __future__ import annotations

import pytest

from trailweave.operators import overlap

TRAIN = [(1, "Create THE file."), (2, "one two three four five six seven"), (3, ""), (4, None), (5, "one two three four five six eight")]
EVAL = [(10, "create the FILE!"), (11, "one two three four five six seven"), (12, "..."), (13, "nothing in common with any of them")]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(TRAIN, "train_id int, text string"), spark.createDataFrame(EVAL, "eval_id int, text string")


def brute(a, b):
    import re

    def grams(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_exact_matches_after_normalisation(sides):
    got = {r.train_id: r.eval_ids for r in overlap.exact_matches(*sides).collect()}
    assert got == {1: "10", 2: "11", 3: "12", 4: "12"}


@pytest.mark.parametrize("few", [200_000, 0])
def test_pairs_by_both_plans(sides, few):
    got = {(r.train_id, r.eval_id): r.jaccard for r in overlap.jaccard_pairs(*sides, few=few).collect()}
    want = {(t, e): brute(a, b) for t, a in TRAIN for e, b in EVAL if a and (a.strip()) and b != "..." and brute(a, b) > 0}
    assert got == pytest.approx(want)


def test_top_pairs_include_zeros_and_empty_texts(sides):
    got = [(r.train_id, r.eval_id, round(r.jaccard, 6)) for r in overlap.padded_top(*sides, n=20).collect()]
    want = sorted(((t, e, round(brute(a, b), 6)) for t, a in TRAIN for e, b in EVAL), key=lambda x: (-x[2], x[0], x[1]))[:20]
    assert got == want


def test_audit_counts(sides):
    got = overlap.audit(overlap.jaccard_pairs(*sides), overlap.exact_matches(*sides)).first()
    assert (got.over_half, got.near, got.largest, got.exact) == (3, 2, 1.0, 4)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "train_id int, text string"), spark.createDataFrame([], "eval_id int, text string")
    assert overlap.jaccard_pairs(*none).count() == 0
    got = overlap.audit(overlap.jaccard_pairs(*none), overlap.exact_matches(*none)).first()
    assert tuple(got) == (0, 0, 0.0, 0)
