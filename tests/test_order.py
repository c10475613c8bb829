"""Positions and ranks by range buckets."""

from __future__ import annotations

import random

import pytest

from trailweave.functions.order import mid_ranks, positions


@pytest.mark.parametrize("buckets", [1, 2, 64])
@pytest.mark.parametrize("kind", ["int", "double", "string"])
def test_ranks(spark, kind, buckets):
    r = random.Random(buckets)
    values = [r.randrange(400) for _ in range(1000)]
    values = [float(v) / 7 for v in values] if kind == "double" else [f"é{v}" if v % 5 else f"z{v}" for v in values] if kind == "string" else values
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}")
    order = sorted(set(values))
    assert {x.v: x.idx for x in positions(df, "v", buckets).collect()} == {v: i for i, v in enumerate(order)}
    want = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in order}
    assert {x.v: x["rank"] for x in mid_ranks(df, "v", buckets).collect()} == want


def test_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v int")
    assert positions(df, "v").collect() == []
    assert mid_ranks(df, "v").collect() == []
