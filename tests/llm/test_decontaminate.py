"""Pigeonhole edit matching against the quadratic program."""

from __future__ import annotations

import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import ROOT
from tests.llm.helpers import AWKWARD, documents, prose, with_clashes
from trailweave.llm import queries
from trailweave.llm.decontaminate import PieceIndex, decontaminate, match_items, myers, normal


def least_distance(pattern: str, text: str) -> int:
    """Edit distance of the pattern to its best substring of text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40))
def test_myers(pattern, text):
    masks = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    assert myers(masks, len(pattern), text) == least_distance(pattern, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=4), st.text("ab", max_size=80), st.sampled_from([0.0, 0.1, 0.2, 0.34]))
def test_every_match_within_the_budget_is_found(items, text, rate):
    got = PieceIndex(list(enumerate(items)), rate).find(text)
    want = {}
    for k, item in enumerate(items):
        d = least_distance(item, text)
        if d <= min(int(rate * len(item)), len(item) - 1):
            want[k] = d
    assert set(got) == set(want)
    assert all(got[k] >= want[k] for k in want)


def changed(r, text, n):
    for _ in range(n):
        p = r.randrange(len(text))
        text = r.choice([text[:p] + "#" + text[p + 1 :], text[:p] + text[p + 1 :], text[:p] + "#" + text[p:]])
    return text


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    items = [(k, prose(r, 30)) for k in range(6)] + [(50, ""), (51, None), (None, "a null item id"), (52, "tiny")]
    rows = list(AWKWARD)
    for k in range(40):
        item = normal(items[k % 6][1])
        rows.append((100 + k, prose(r, 40) + " " + changed(r, item, r.randrange(0, int(len(item) * 0.2))) + " " + prose(r, 40)))
    return rows, items


@pytest.mark.parametrize("block_chars", [8_000_000, 300])
def test_hits(spark, case, block_chars):
    rows, items = case
    docs = with_clashes(documents(spark, rows))
    table = spark.createDataFrame(items, "item_id long, text string")
    found = match_items(docs, table, block_chars=block_chars)
    assert found.columns == docs.columns
    got = {(g.doc_id, g.text): [h["item"] for h in g.hits] for g in found.collect()}
    want = {(i, t): sorted(k for k, x in items if k is not None and x and least_distance(normal(x), normal(t)) <= len(normal(x)) // 10) for i, t in rows}
    assert got == want
    assert any(want.values())
    left = decontaminate(documents(spark, rows), table).collect()
    assert sorted((repr((g.doc_id, g.text)) for g in left)) == sorted(repr((i, t)) for i, t in rows if not want[i, t])


def test_long_texts():
    """A text of a megabyte, against one distance over the whole of it for every item."""
    r = random.Random(12)
    items = [(k, normal(prose(r, 40))) for k in range(5)]
    text = prose(r, 60_000)
    for k, edits in ((0, 0), (1, 5), (2, len(items[2][1]) // 10), (3, len(items[3][1]) // 3)):
        at = r.randrange(len(text))
        text = text[:at] + changed(r, items[k][1], edits) + text[at:]
    text = normal(text * 4)
    assert len(text) > 1_000_000
    got = PieceIndex(items, 0.1).find(text)
    want = set()
    for k, item in items:
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        if myers(masks, len(item), text) <= len(item) // 10:
            want.add(k)
    assert set(got) == want >= {0, 1, 2}


def test_an_index_takes_a_bounded_memory_for_each_character():
    code = """
import random, resource
from trailweave.llm.decontaminate import PieceIndex
r = random.Random(1)
items = [(k, "".join(r.choice("abcdefghij ") for _ in range(250))) for k in range(4000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = PieceIndex(items, 0.1)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / sum(len(t) for _, t in items))
"""
    per_character = float(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout)
    assert per_character < 260


def test_blocks_are_passes_of_their_own(spark, case):
    """With several blocks no pass holds more than one index."""
    rows, items = case
    table = spark.createDataFrame(items, "item_id long, text string")
    found = match_items(documents(spark, rows), table, block_chars=300)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == [*documents(spark, rows).columns, "hits"]


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "x")]), spark.createDataFrame([], "item_id long, text string")
    assert match_items(docs, items).first().hits == []
    assert decontaminate(documents(spark, []), items).collect() == []


def test_query_over_the_table(spark, sf_dir):
    items = [(r.item_id, normal(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: normal(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {g.doc_id: {int(x) for x in g.item_ids.split(",") if x} for g in queries.op4_decontamination(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        assert {k for k, x in items if x in text} <= got[d]  # verbatim ones, all of them
        if len(text) < 1500:
            assert got[d] == {k for k, x in items if least_distance(x, text) <= len(x) // 10}
