import json
import random

import pytest

from corpusloom.llm.toolcalls import canonical, link_tool_calls, schema_errors, topological_levels

SCHEMA = "conv_id long, turn long, role string, text string, level string, line int"
TOOLS = {
    "search": {
        "type": "object",
        "properties": {"q": {"type": "string", "minLength": 1}, "k": {"type": "integer", "minimum": 1, "maximum": 9}, "in": {"type": ["string", "null"]}},
        "required": ["q"],
        "additionalProperties": False,
    },
    "add": {"type": "object", "properties": {"xs": {"type": "array", "items": {"type": "number"}}, "op": {"enum": ["sum", "max"]}}},
}


def call(*calls, content=None):
    value = {"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]}
    return json.dumps(value | ({"content": content} if content else {}))


def result(call_id, content):
    return json.dumps({"tool_call_id": call_id, "content": content})


def run(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, "l", 1) for c, t, r, x in rows], SCHEMA).repartition(3)
    return link_tool_calls(df, TOOLS).collect()


def test_links_levels_and_errors(spark):
    rows = [
        (1, 0, "user", "hi é \"q\"\n"),
        (1, 1, "assistant", call(("b", "search", {"q": "$a", "in": None}), ("a", "search", json.dumps({"q": "x", "k": 3})), content="Let me look.")),
        (1, 2, "tool", result("a", {"z": 1, "a": [1.5, "é"]})),
        (1, 3, "tool", result("b", "done")),
        (1, 4, "tool", result("zz", "whose?")),
        (1, 5, "assistant", call(("c", "add", {"xs": ["$a", "$b"]}), ("d", "nope", {}), ("e", "search", "{broken"), (5, "add", {}))),
        (2, 0, "tool", result("a", "early")),
        (2, 1, "assistant", call(("a", "add", {"op": "sum"}))),
        (2, 2, "tool", result("a", "again")),
        (2, 3, "assistant", call(("x", "add", {"op": "$y"}), ("y", "add", {"op": "$x"}), ("w", "search", {"q": "$x"}), ("m", "search", {"q": "$gone"}))),
        (3, 0, "assistant", '{"not": "calls"}'), (3, 1, "assistant", None), (3, 2, None, ""), (None, 3, "user", "no conversation"),
    ]
    got = {(r.conv_id, r.turn, r.item): r for r in run(spark, rows)}
    assert len(got) == 18
    assert got[(1, 0, 0)].line == '{"content":"hi é \\"q\\"\\n","role":"user"}'
    assert got[(1, 1, 0)].line == '{"content":"Let me look.","role":"assistant"}'
    a, b, c = got[(1, 1, 2)], got[(1, 1, 1)], got[(1, 5, 0)]
    assert (a.level, b.level, c.level) == (0, 1, 2) and a.valid and b.valid
    assert a.line == '{"call":{"arguments":{"k":3,"q":"x"},"name":"search"},"id":"a","result":{"a":[1.5,"é"],"z":1},"turn":1}'
    assert json.loads(b.line)["result"] == "done" and canonical(json.loads(b.line)) == b.line
    assert c.errors == "arguments.xs[0]: not number; arguments.xs[1]: not number; result: missing"
    assert got[(1, 5, 1)].errors == "name: unknown; result: missing"
    assert got[(1, 5, 2)].errors == "arguments: not JSON; result: missing"
    assert got[(1, 5, 3)].errors == "id: not string; result: missing" and got[(1, 5, 3)].call_id is None
    assert got[(1, 4, 0)].kind == "orphan" and got[(1, 4, 0)].line == '{"content":"whose?","id":"zz","role":"tool"}'
    assert got[(2, 1, 0)].errors == "result: repeated; result: before the call" and got[(2, 1, 0)].n_results == 2
    assert json.loads(got[(2, 1, 0)].line)["result"] == "early"
    assert [got[(2, 3, i)].level for i in range(4)] == [-1, -1, -1, 0]
    assert "reference: cycle" in got[(2, 3, 2)].errors and "reference: gone unknown" in got[(2, 3, 3)].errors
    assert got[(3, 0, 0)].kind == got[(3, 1, 0)].kind == got[(3, 2, 0)].kind == got[(None, 3, 0)].kind == "message"


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "assistant", call(("a", "search", {"q": "x"}))), (1, 1, "tool", result("a", "r"))]
    got = run(spark, [*rows, rows[0]])
    assert [r.errors for r in got] == ["id: repeated", "id: repeated"]
    assert run(spark, []) == []


def test_order_follows_references_in_a_long_chain(spark):
    rows = [(1, i, "assistant", call((f"c{i}", "search", {"q": f"$c{i + 1}" if i < 12 else "x"}))) for i in range(13)]
    assert {r.call_id: r.level for r in run(spark, rows)} == {f"c{i}": 12 - i for i in range(13)}


def test_schema_rules():
    assert schema_errors({"q": "a", "k": 3}, TOOLS["search"]) == []
    assert schema_errors({"q": "", "k": 10, "z": 1}, TOOLS["search"]) == [
        "arguments.k: above 9", "arguments.q: shorter than 1", "arguments.z: unknown",
    ]
    assert schema_errors({"k": True}, TOOLS["search"]) == ["arguments.q: missing", "arguments.k: not integer"]
    assert schema_errors([], TOOLS["search"]) == ["arguments: not object"]
    assert schema_errors({"op": "min"}, TOOLS["add"]) == ["arguments.op: not in enum"]


def call_of(**call):
    return json.dumps({"tool_calls": [call]})


OPEN_SCHEMA = {"f": {"type": "object"}}


def rows_of(spark, messages, schemas=OPEN_SCHEMA):
    docs = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return link_tool_calls(docs, schemas).collect()


def test_what_json_cannot_hold_is_an_error_of_its_call(spark):
    deep = "[" * 3000 + "]" * 3000
    half = "[" * 400 + "]" * 400
    texts = [
        '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1e999}}, {"id": "b", "name": "f", "arguments": {"x": 1}}]}',
        '{"tool_calls": [{"id": "c", "name": "f", "arguments": {"x": "\\ud800"}}]}',
        '{"tool_calls": [{"id": "d", "name": "f", "arguments": {"x": %s}}]}' % half,
        '{"tool_calls": [{"id": "e", "name": "f", "arguments": "{\\"x\\": %s}"}]}' % deep,
        '{"content": "\\udfff", "tool_calls": [{"id": "g\\ud800", "name": "f"}]}',
        '{"tool_calls": [{"id": "h", "name": "f", "arguments": {"x": %s}}]}' % ("9" * 5000),
    ]
    results = [("tool", json.dumps({"tool_call_id": "b", "content": None}).replace("null", "-1e999")), ("tool", '{"tool_call_id": "c", "content": "\\udc00"}')]
    rows = rows_of(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 10 + i, *r) for i, r in enumerate(results)])
    errors = {r.call_id: r.errors for r in rows if r.kind == "call"}
    assert "call: number out of range" in errors["a"] and errors["b"] == ""
    assert "half of a surrogate pair" in errors["c"] and "nested deeper than 100" in errors["d"]
    assert "nested deeper than 100" in errors["e"] and "g�" in errors
    assert "h" not in errors  # more digits than a number may have: the text stays a message
    for r in rows:
        json.loads(r.line)
        r.line.encode()


def test_conversations_without_id_are_not_number_minus_one(spark):
    text = call_of(id="a", name="f", arguments={})
    answer = json.dumps({"tool_call_id": "a", "content": "x"})
    rows = rows_of(spark, [(None, 0, "assistant", text), (-1, 0, "assistant", text), (0, 0, "assistant", text), (None, 1, "tool", answer)])
    assert sorted((r.conv_id is None, r.conv_id or 0, r.n_results, r.errors) for r in rows if r.kind == "call") == [
        (False, -1, 0, "result: missing"), (False, 0, 0, "result: missing"), (True, 0, 1, ""),
    ]


def test_enum_tells_true_from_one():
    for known, value, fits in (([True], 1, False), ([1], True, False), ([1], 1.0, True), ([[1, {"a": False}]], [1, {"a": 0}], False), ([[1]], [1.0], True)):
        assert (schema_errors(value, {"enum": known}) == []) == fits


def slow_levels(nodes, edges):
    parents = {n: {p for c, p in edges if c == n} for n in nodes}
    level = {}
    while True:
        ready = [n for n in nodes if n not in level and parents[n] <= level.keys()]
        if not ready:
            return {n: level.get(n, -1) for n in nodes}
        level |= {n: max((level[p] + 1 for p in parents[n]), default=0) for n in ready}


@pytest.mark.parametrize("seed", range(4))
def test_levels_equal_a_plain_reading(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range((40, 60, 90, 50)[seed])) if seed == 3 or a > b}
    found = topological_levels(
        spark.createDataFrame([(n,) for n in nodes], "key int"), spark.createDataFrame(sorted(edges), "child int, parent int")
    )
    assert {r.key: r.level for r in found.collect()} == slow_levels(nodes, edges)


def test_a_long_chain_takes_few_rounds(spark):
    count = 5000
    keys = spark.range(count).withColumnRenamed("id", "key")
    edges = spark.range(1, count).selectExpr("id AS child", "id - 1 AS parent")
    assert topological_levels(keys, edges).where("key <> level").count() == 0
