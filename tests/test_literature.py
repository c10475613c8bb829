"""Merging, search, reconciliation and decisions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailweave.operators import literature


def test_candidates_merge_in_order(spark):
    rows = [("k", 2, "B", "s2", 1), ("k", 1, "", "s1", 3), ("k", 3, "C", "s2", 2), ("j", 1, None, "s9", 5)]
    df = spark.createDataFrame(rows, "key string, i int, title string, source string, hops int")
    got = {r.key: (r.title, r.source, r.hops) for r in literature.merge_candidates(df, "key", "i", ["title"], ["source"], ["hops"]).collect()}
    assert got == {"k": ("B", ["s1", "s2"], 1), "j": (None, ["s9"], 5)}


def test_citation_search_by_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 9)], "a long, b long")
    seeds = spark.createDataFrame([(1,), (1,)], "node long")
    assert {r.node: r.hops for r in literature.citation_search(seeds, edges, 2).collect()} == {1: 0, 2: 1, 3: 2}
    wide = spark.createDataFrame([(1, n) for n in range(2, 9)], "a long, b long")
    assert sorted(r.node for r in literature.citation_search(seeds, wide, 1, frontier=3).collect()) == list(range(1, 9))  # a cap bounds what is followed, not what is found


def test_only_gated_nodes_are_followed_and_the_most_reached_first(spark):
    """Seeds 1 and 2 reach 10 to 13; 12 is reached twice, 11 is not gated."""
    edges = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 12), (2, 13), (10, 100), (11, 110), (12, 120), (13, 130), (120, 1200)], "a long, b long")
    seeds, gate = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(10,), (12,), (13,)], "node long")
    found = lambda **kw: {r.node: r.hops for r in literature.citation_search(seeds, edges, **kw).collect()}
    first = {1: 0, 2: 0, 10: 1, 11: 1, 12: 1, 13: 1}
    assert found(hops=2, gate=gate) == first | {100: 2, 120: 2, 130: 2}
    assert found(hops=2, gate=gate, frontier=1) == first | {120: 2}
    assert found(hops=2, frontier=2) == first | {120: 2, 100: 2}
    assert found(hops=3, gate=gate) == first | {100: 2, 120: 2, 130: 2}  # 120 is not gated


def test_export_order(spark):
    rows = [(1, "reject"), (2, "gold"), (3, None), (4, "silver"), (5, "gold"), (6, "odd"), (7, "needs_review"), (8, "results_only")]
    got = literature.in_status_order(spark.createDataFrame(rows, "id long, status string"), "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [2, 5, 4, 7, 8, 1, 3, 6]
    assert literature.in_status_order(spark.createDataFrame([], "id long, status string"), "id").collect() == []


def test_inverted_index_gives_the_text(spark):
    df = spark.createDataFrame([("w", {"the": [0, 2], "cat": [1], "end": [3]})], "id string, inverted map<string,array<int>>")
    assert literature.rebuild_inverted(df).first().text == "the cat the end"


def test_index_and_text_are_made_row_by_row(spark):
    words = [["b", "a", "b", "b"], [], None, ["x"], ["b", "a", "c", "a"], [str(i % 7) for i in range(40)]]
    index = literature.inverted_index(spark.createDataFrame([(1 if i < 2 else i, w) for i, w in enumerate(words)], "id long, tokens array<string>"))
    assert [r.inverted for r in index.collect()][:4] == [{"b": [0, 2, 3], "a": [1]}, {}, {}, {"x": [0]}]
    texts = literature.rebuild_inverted(index)
    assert sorted((r.id, r.text) for r in texts.collect()) == [(1, "b a b b"), (3, "x"), (4, "b a c a"), (5, " ".join(words[5]))]
    assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(1, None), (2, {"a": None, "b": [0]}), (3, {"a": []}), (4, {})], "id long, inverted map<string,array<int>>")
    assert [(r.id, r.text) for r in literature.rebuild_inverted(odd).collect()] == [(2, "b")]


def test_gate_and_decisions(spark):
    df = spark.createDataFrame([("An Agent we TRAIN",), ("an agent",), (None,)], "t string")
    assert [r.g for r in df.select(literature.keyword_gate(F.col("t"), r"\bagent", "train").alias("g")).collect()] == [True, False, False]
    rows = spark.createDataFrame([("Yes ", "p. 3"), ("yes", " "), ("perhaps", "x"), (None, "x"), ("no", "x")], "v string, e string")
    assert [r.d for r in rows.select(literature.decision(F.col("v"), F.col("e")).alias("d")).collect()] == ["yes", "unclear", "unclear", "unclear", "no"]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, "gold"), ({"core": "no"}, "reject"), ({"teachers": 1}, "reject"), ({"core": "unclear"}, "needs_review"), ({"complete": False}, "needs_review"), ({"flagged": True}, "needs_review"),
        ({"public": "no"}, "results_only"), ({"found": False}, "needs_review"), ({"separable": "no"}, "needs_review"), ({"public": "unclear", "found": None}, "results_only"),
        ({"teachers": 2}, "silver"), ({"matched": "unclear"}, "silver"), ({"separable": "unclear"}, "silver"),
    ],
)
def test_status_tree(spark, change, want):
    x = {"core": "yes", "teachers": 3, "complete": True, "flagged": False, "public": "yes", "found": True, "separable": "yes", "matched": "yes"} | change
    found = F.lit(x["found"]).cast("boolean")
    made = literature.status([F.lit("yes"), F.lit(x["core"])], F.lit(x["teachers"]), F.lit(x["complete"]), F.lit(x["flagged"]), (F.lit(x["public"]), F.lit("yes")), (found, F.lit(True) if x["found"] is not None else found), F.lit(x["separable"]), F.lit(x["matched"]))
    assert spark.range(1).select(made.alias("s")).first().s == want


def test_field_diff_and_resolution(spark):
    schema = "id int, name string, org string, score string"
    a = spark.createDataFrame([(1, "A-1", "X", "41"), (2, "b", None, "1.0")], schema)
    b = spark.createDataFrame([(1, "a1", "Y", "40"), (2, "b", "Z", "1.0000000001")], schema)
    d = literature.field_diff(a, b, "id", ["org"], ["name"], ["score"])
    assert sorted((r.id, r.field, r.left, r.right) for r in d.collect()) == [(1, "org", "X", "Y"), (1, "score", "41", "40"), (2, "org", None, "Z")]
    verdicts = spark.createDataFrame([(1, "score", "right")], "id int, field string, side string")
    got = {(r.id, r.field): (r.value, r.unresolved) for r in literature.resolve(d, verdicts, "id").collect()}
    assert got[1, "score"] == ("40", False)
    assert got[1, "org"] == (None, True)


def test_greedy_alignment_leaves_residues(spark):
    schema = "paper string, id string, names array<string>"
    a = spark.createDataFrame([("p", "a1", ["x", "y", "z"]), ("p", "a2", ["x", "y", "w"]), ("q", "a3", ["k"])], schema)
    b = spark.createDataFrame([("p", "b1", ["x", "y", "z", "w"]), ("p", "b2", ["m"])], schema)
    got = {(r.paper, r.left_id, r.right_id) for r in literature.greedy_alignment(a, b, "paper").collect()}
    assert got == {("p", "a1", "b1"), ("p", "a2", None), ("p", None, "b2"), ("q", "a3", None)}


def test_latest_upsert_and_benchmark(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 2, "z")], "k string, i int, v string")
    assert {r.k: r.v for r in literature.latest(old, "k", "i").collect()} == {"a": "x", "b": "z"}
    new = spark.createDataFrame([("b", 3, "n")], "k string, i int, v string")
    assert sorted((r.k, r.v) for r in literature.upsert(old, new, "k").collect()) == [("a", "x"), ("b", "n")]
    rows = spark.createDataFrame([("p", "m1", False, 3), ("p", "m2", True, 1), ("q", "n2", False, 2), ("q", "n1", False, 2)], "paper string, benchmark string, declared boolean, teachers int")
    assert {r.paper: r.benchmark for r in literature.primary_benchmark(rows, "paper").collect()} == {"p": "m2", "q": "n1"}


def test_mentions_are_loose(spark):
    df = spark.createDataFrame([("GLM-4.6", "we use glm 4 6 here"), ("GLM-4.6", "glm5")], "n string, t string")
    assert [r.hit for r in df.select(F.regexp(F.col("t"), literature.mention(F.col("n"))).alias("hit")).collect()] == [True, False]
