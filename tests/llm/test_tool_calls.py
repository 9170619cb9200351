import functools
import json
import random

import pytest

from srcatlas.llm.queries import SCHEMAS as TOOLS
from srcatlas.llm.queries import calls_and_results
from srcatlas.llm.tool_calls import canonical, checked, levels, link_tool_calls, schema_errors

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["x"], "additionalProperties": False}}


def test_schemas():
    assert schema_errors({"x": 1, "tags": ["a"]}, SCHEMAS["add"]) == []
    assert schema_errors({"x": True}, SCHEMAS["add"]) == ["$.x: not integer"]
    assert schema_errors({"y": 1, "tags": [1]}, SCHEMAS["add"]) == ["$.x: missing", "$.tags[0]: not string", "$.y: not expected"]
    assert schema_errors([], {"type": ["object", "null"]}) == ["$: not object or null"]
    assert schema_errors("b", {"enum": ["a"], "pattern": "^a", "minLength": 2}) == ["$: not one of the listed values", "$: length out of bounds", "$: pattern not found"]
    assert checked("add", "{", SCHEMAS)[1] == ["$: not JSON"] and checked("add", "NaN", SCHEMAS)[1] == ["$: not JSON"]
    assert checked("sub", None, SCHEMAS) == ({}, ["unknown tool"])


def test_canonical_json_is_a_fixed_point():
    value = {"b": [1, 2.5, None, "é\n"], "a": {"z": True, "y": {}}}
    assert canonical(value) == '{"a":{"y":{},"z":true},"b":[1,2.5,null,"é\\n"]}' and canonical(json.loads(canonical(value))) == canonical(value)


def test_levels_of_a_long_chain_and_a_cycle(spark):
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(3000)] + [(2, "a", "b"), (2, "b", "a"), (2, "d", "a"), (2, "e", "gone")]
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()}
    assert all(got[1, f"c{i}"] == i for i in range(3000))
    assert [got[2, x] for x in "abde"] == [None, None, None, 0]


def test_linking(spark):
    calls = [
        (1, "p", 2, "add", '{"x": 1}', "q", "clash"), (1, "q", 3, "add", '{"x": -1}', None, "clash"), (1, "r", 4, "add", '{"tags":[],"x":3}', None, ""),
        (1, "r", 9, "add", "{}", None, ""), (1, "s", 5, None, None, None, ""), (2, "p", 1, "add", '{"x": 2}', "p", ""),
        (None, "p", 1, "add", "{}", None, ""), (3, None, 1, "add", "{}", None, ""), (4, "t", None, "add", '{"x": 1}', None, ""),
    ]
    results = [(1, "p", 6, "one"), (1, "q", 7, None), (1, "r", 4, "same turn"), (1, "z", 8, "alone"), (2, "p", 2, "x"), (1, "p", 10, "later")]
    got = {(r.conv_id, r.call_id): r for r in link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert {k: r.status for k, r in got.items()} == {
        (1, "p"): "linked", (1, "q"): "linked", (1, "r"): "early", (1, "s"): "unanswered", (1, "z"): "orphan", (2, "p"): "cycle", (4, "t"): "unanswered",
    }
    assert got[1, "q"].position < got[1, "p"].position and got[1, "z"].position == 4
    assert sorted(r.position for k, r in got.items() if k[0] == 1) == [0, 1, 2, 3, 4]
    assert got[1, "p"].valid and not got[1, "q"].valid and got[1, "q"].errors == "$.x: value out of bounds"
    assert got[1, "r"].json == '{"arguments":{"tags":[],"x":3},"id":"r","name":"add","result":"same turn"}'
    assert json.loads(got[1, "q"].json)["result"] is None


def test_empty_tables(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert link_tool_calls(calls, results, SCHEMAS).count() == 0


def slow_levels(calls, waits):
    after = {}
    for conv, call, up in waits:
        if (conv, call) in calls and (conv, up) in calls:
            after.setdefault((conv, call), set()).add((conv, up))
    out = {}
    for call in calls:

        @functools.cache
        def level(c, deep=0):
            return 1 + max(map(level, after[c])) if c in after else 0

        try:
            out[call] = level(call)
        except RecursionError:
            out[call] = None
    return out


@pytest.mark.parametrize("most", [0, 30, 10_000])
def test_levels_of_calls_that_wait_for_several_match_brute_force(spark, most):
    rng = random.Random(most)
    calls, waits = set(), []
    for conv in range(40):
        n = rng.randint(1, 25)
        calls |= {(conv, f"c{i}") for i in range(n)}
        for i in range(1, n):
            waits += [(conv, f"c{i}", f"c{rng.randrange(i)}") for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        if conv % 4 == 0:
            waits.append((conv, f"c{rng.randrange(n)}", f"c{rng.randrange(n)}"))  # may close a circle
        waits += [(conv, "c0", "gone"), (conv, "no call", "c0")]
    got = levels(spark.createDataFrame(sorted(calls), "conv_id long, call_id string"), spark.createDataFrame(waits, "conv_id long, call_id string, after string"), most)
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == slow_levels(calls, waits)


def test_a_long_ladder_is_ordered_by_tables(spark):
    rows = [(1, f"c{i}") for i in range(400)]
    waits = [(1, f"c{i}", f"c{i - 1}") for i in range(1, 400)] + [(1, f"c{i}", f"c{i - 9}") for i in range(100, 400, 100)]
    got = levels(spark.createDataFrame(rows, "conv_id long, call_id string"), spark.createDataFrame(waits, "conv_id long, call_id string, after string"), 50)
    assert {r.call_id: r.level for r in got.collect()} == {f"c{i}": i for i in range(400)}


@pytest.mark.parametrize(
    "arguments,error",
    [('{"x": 1e999}', "$: number out of range"), ("[" * 100_000, "$: nested too deep"), ("[" * 900 + "]" * 900, "$: not object"), ('{"x": Infinity}', "$: not JSON"),
     ('{"x": ' + "9" * 5000 + "}", "$: not JSON"), ('{"x": "\\ud800", "\\udfff": 1}', "$.x: not integer; $.\\udfff: not expected")],
)
def test_arguments_that_are_hard_to_write_do_not_end_the_job(spark, arguments, error):
    calls = spark.createDataFrame([(1, "a", 1, "add", arguments, None, "")], CALLS)
    row = link_tool_calls(calls, spark.createDataFrame([(1, "a", 2, "r")], RESULTS), SCHEMAS).first()
    assert row.errors == error and not row.valid and json.loads(row.json)["result"] == "r"
    assert canonical({"x": "\ud83d\ude00 \ud800"}) == '{"x":"😀 \\ud800"}'.replace("😀", "\\ud83d\\ude00")


def test_the_calls_of_conversations_use_every_turn_and_may_be_invalid(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "q" * 500), (1, 2, "assistant", "a"), (1, 3, "user", "short"), (1, 4, "assistant", None), (1, 5, None, None)]
    calls, results, waits = calls_and_results(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: r for r in link_tool_calls(calls, results, TOOLS, waits).collect()}
    assert {k: (r.name, r.level, r.valid) for k, r in got.items()} == {
        "1-0": ("setup", 0, False), "1-1": ("lookup", 1, False), "1-3": ("answer", 2, False), "1-5": ("lookup", 3, False)}
    assert {k: r.errors for k, r in got.items()} == {
        "1-0": "", "1-1": "$.prompt: length out of bounds", "1-3": "$.prompt: length out of bounds", "1-5": "$.prompt: missing"}
