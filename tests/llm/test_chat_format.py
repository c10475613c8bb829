"""Tool-call linking: order, validation and canonical JSON."""

from __future__ import annotations

import json

import pytest

from trailweave.llm import queries
from trailweave.llm.chat_format import CALL, format_chats

SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "mode": {"type": "string", "enum": ["x", "y"]}}, "required": ["a"]}}
SCHEMA = f"conv_id long, turn long, role string, text string, calls array<{CALL}>, call_id string, extra string, anchor int, depth int"


def made(spark, rows):
    return {(r.conv_id, r.turn): r for r in format_chats(spark.createDataFrame([(*r, "x", None, None) for r in rows], SCHEMA), SCHEMAS).collect()}


def test_results_follow_their_calls(spark):
    rows = [
        (1, 0, "user", "hi", None, None), (1, 3, "assistant", None, [("c1", "add", '{"a":1}'), ("c2", "add", '{"a":2}')], None),
        (1, 2, "tool", "early result", None, "c1"), (1, 4, "tool", "result", None, "c2"), (1, 5, "tool", "whose?", None, "c9"), (2, 0, "tool", "other conversation", None, "c1"),
    ]
    got = made(spark, rows)
    assert [(r.turn, r.role) for r in sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: (r.anchor, r.depth, r.turn))] == [(0, "user"), (3, "assistant"), (2, "tool"), (4, "tool"), (5, "tool")]
    assert [got[k].orphan for k in ((1, 2), (1, 4), (1, 5), (2, 0))] == [False, False, True, True]
    assert got[1, 2].call_turn == 3


def test_results_that_call_follow_their_calls(spark):
    ask = lambda *ids: [(i, "add", '{"a":1}') for i in ids]
    rows = [(1, 5, "assistant", None, ask("c1"), None), (1, 2, "tool", None, ask("c2"), "c1"), (1, 3, "tool", "r", None, "c2")]
    rows += [(2, 9 - i, "tool", None, ask(f"c{i + 1}"), f"c{i}" if i else None) for i in range(9)] + [(2, 20, "tool", "last", None, "c4")]
    rows += [(3, 4, "tool", None, ask("a"), "b"), (3, 6, "tool", None, ask("b"), "a"), (3, 2, "tool", None, ask("x"), "a"), (3, 1, "tool", "below a circle", None, "x"), (3, 0, "tool", None, ask("o"), "none"), (3, 3, "tool", None, ask("s"), "s")]
    got = made(spark, rows)
    key = lambda r: (r.anchor, r.depth, r.turn)
    assert [r.turn for r in sorted((r for r in got.values() if r.conv_id == 1), key=key)] == [5, 2, 3]
    circle = {(3, 4), (3, 6), (3, 3)}
    linked = [r for at, r in got.items() if r.call_turn is not None and at not in circle]
    assert len(linked) == 2 + 9 + 2
    assert all(key(r) > key(got[r.conv_id, r.call_turn]) for r in linked)


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("add", '{"a": 1, "b": 2.5, "mode": "x"}', ""), ("add", '{"b": 1}', "c: a: missing"), ("add", '{"a": -1}', "c: a: under 0"), ("add", '{"a": "1"}', "c: a: not integer"),
        ("add", '{"a": 1, "mode": "z"}', "c: mode: not listed"), ("add", "{", "c: not JSON"), ("sub", "{}", "c: unknown tool"), ("add", None, "c: not JSON"),
    ],
)
def test_arguments_are_held_against_schemas(spark, name, arguments, errors):
    assert made(spark, [(1, 0, "assistant", None, [("c", name, arguments)], None)])[1, 0].errors == errors


def test_json_is_canonical(spark):
    got = made(spark, [(1, 0, "assistant", 'say "é"\n', [("c", "add", '{ "b" : {"z": 1, "y": [2, 1]}, "a": 1 }')], None), (1, 1, "assistant", "x", [("d", "add", "no json")], None)])
    want = {"content": 'say "é"\n', "role": "assistant", "tool_calls": [{"arguments": {"a": 1, "b": {"y": [2, 1], "z": 1}}, "id": "c", "name": "add"}], "turn": 0}
    assert got[1, 0].json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got[1, 1].json)["tool_calls"][0]["arguments"] == "no json"


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None, None, None, None), (1, 0, "user", "", [], ""), (None, 1, "tool", "r", None, "c"), (None, 0, "assistant", None, [("c", "add", '{"a":1}')], None), (2, 0, "assistant", "", [(None, None, None)], None), (3, 0, "a", "t" * 200_000, [("k", "add", '{"a":1}'), ("k", "add", '{"a":1}')], None), (3, 1, "tool", "once", None, "k")]
    df = spark.createDataFrame([(*r, "x", None, None) for r in rows * 2], SCHEMA)
    got = format_chats(df, SCHEMAS).collect()
    assert len(got) == 2 * len(rows)
    assert all(r.orphan for r in got if r.conv_id is None and r.call_id)
    assert [r.call_turn for r in got if r.conv_id == 3 and r.turn == 1] == [0, 0]
    assert format_chats(spark.createDataFrame([], SCHEMA), SCHEMAS).collect() == []


def test_query_matches_sql(spark, sf_dir, same_as_sql):
    same_as_sql(queries.op3_tool_call_linking(spark, sf_dir), queries.SQL["op3_tool_call_linking"])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op3_tool_call_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
