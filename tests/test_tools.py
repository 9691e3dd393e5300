"""JSON Schema over variants by cases; tool calls and their faults; the placeholder by role."""

import json

import pytest
from pyspark.sql import functions as F

from redactory.functions.schemas import valid
from redactory.operators.contracts import answers
from redactory.operators.fragments import mask, restore
from redactory.operators.toolcalls import assembled, released

#: schema, values that fit, values that don't.
CASES = [
    (True, [1, None], []), (False, [], [1, {}]),
    ({"type": "integer"}, [1, 1.0, -3], [1.5, "1", True, None]), ({"type": "number"}, [1, 1.5], ["1", False]), ({"type": ["string", "null"]}, ["a", None], [1, []]), ({"type": "boolean"}, [True], [0, "true"]),
    ({"enum": ["a", 1, None, [1, {"b": 2}]]}, ["a", 1, 1.0, None, [1, {"b": 2}]], ["b", 2, [1], [1, {"b": 3}], {}]), ({"const": {"a": [1]}}, [{"a": [1]}], [{"a": [2]}, {"a": [1], "b": 1}, {}]),
    ({"minimum": 2, "exclusiveMaximum": 5, "multipleOf": 0.5}, [2, 4.5, "x"], [1, 5, 2.3]), ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab", "aé漢", 7], ["a", "abcd", "ba"]),
    ({"type": "array", "items": {"type": "integer"}, "minItems": 1, "maxItems": 2}, [[1], [1, 2]], [[], [1, 2, 3], ["a"], {}]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}, 3], [{}, {"a": 1, "b": 2}]),
    ({"properties": {"a": {"type": "string"}, "b.c": {"type": "null"}}, "required": ["a"], "additionalProperties": False}, [{"a": "x"}, {"a": "x", "b.c": None}, 5], [{}, {"a": 1}, {"a": "x", "z": 1}, {"a": "x", "b.c": 1}]),
    ({"properties": {"a": True}, "additionalProperties": {"type": "integer"}}, [{"a": "x", "b": 1}], [{"a": 1, "b": "x"}]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 7, []], [3]), ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [3, 5.5], [7]), ({"allOf": [{"type": "integer"}, {"minimum": 5}]}, [7], [3, 5.5]), ({"not": {"type": "string"}}, [1], ["a"]),
    ({"$ref": "#/$defs/x~1y", "$defs": {"x/y": {"type": "object", "properties": {"k": {"$ref": "#/$defs/n"}}}, "n": {"minimum": 1}}}, [{"k": 1}, {}], [{"k": 0}, 1]),
]


def test_schema_words(spark):
    for schema, good, bad in CASES:
        rows = [(i, json.dumps(v)) for i, v in enumerate(good + bad)]
        got = spark.createDataFrame(rows, "i int, j string").select("i", valid(F.parse_json("j"), schema).alias("ok")).collect()
        assert [r.ok for r in sorted(got)] == [True] * len(good) + [False] * len(bad), schema


@pytest.mark.parametrize("schema", [{"$ref": "http://x"}, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"n": {"$ref": "#/$defs/a"}}}}}, {"unevaluatedItems": False}])
def test_schemas_that_are_refused(spark, schema):
    with pytest.raises(ValueError):
        valid(F.lit(None).cast("variant"), schema)


def test_budgets(spark):
    rows = [(1, c, 10 * c + i, "x" * 30 if c != 3 else "y" * 200) for c in range(8) for i in range(2)] + [(2, c, c, "é") for c in range(6)] + [(3, 1, 0, None), (3, 1, 1, "{}")]
    fragments = spark.createDataFrame(rows, "request int, call int, seq int, delta string, code string, text string" if False else "request int, call int, seq int, delta string")
    got = {(r.request, r.call): (r.text, r.code) for r in assembled(fragments, "request", "call", "seq", "delta", 100, 700, 5).collect()}
    assert [got[1, c][1] for c in range(8)] == [None, None, None, "CALL_TOO_LARGE", None, "TOO_MANY_CALLS", "TOO_MANY_CALLS", "TOO_MANY_CALLS"]
    assert [got[2, c][1] for c in range(6)] == [None] * 5 + ["TOO_MANY_CALLS"]
    assert got[3, 1] == ("{}", None)
    tight = {(r.request, r.call): r.code for r in assembled(fragments, "request", "call", "seq", "delta", 1000, 590, 50).collect()}
    assert [tight[1, c] for c in range(8)] == [None] * 4 + ["REQUEST_TOO_LARGE"] * 4


def test_release(spark):
    calls = {1: '{"a":"<ORG_001> <ORG_001>"}', 2: '{"a":"<ORG_002>"}', 3: '{"a":1}', 4: '{"a"', 5: "[]", 6: '{"<ORG_001>":"a"}', 7: '{"a":"<org-1>"}', 8: '{"a":"<BIG_001>"}', 9: '{"a":{"b":["\\u003cORG_001>",{"c":"x"}]}}', 10: '{"a":"","b":null}'}
    rows = spark.createDataFrame([("r", k, t, None) for k, t in calls.items()] + [("r", 11, None, "CALL_TOO_LARGE")], "request string, call int, text string, code string")
    names = spark.createDataFrame([("r", k, "t") for k in calls] + [("r", 12, "t")], "request string, call int, name string")
    mapping = spark.createDataFrame([("r", "<ORG_001>", 'A"<ORG_009>'), ("r", "<BIG_001>", "x" * 500)], "request string, token string, original string")
    schema = {"properties": {"a": {"type": ["string", "object"]}}}
    got = {r.call: (r.arguments, r.code) for r in released(rows, names, mapping, {"t": schema}, "request", "call", 400, 10_000).collect()}
    assert got[1] == (json.dumps({"a": 'A"<ORG_009> A"<ORG_009>'}, separators=(",", ":")), None)
    assert got[9] == (json.dumps({"a": {"b": ['A"<ORG_009>', {"c": "x"}]}}, separators=(",", ":")), None)
    assert got[10] == ('{"a":"","b":null}', None)
    assert {k: c for k, (_, c) in got.items() if c} == {2: "UNKNOWN_TOKEN", 3: "SCHEMA", 4: "MALFORMED_JSON", 5: "NOT_AN_OBJECT", 6: "TOKEN_IN_KEY", 7: "MALFORMED_TOKEN", 8: "RESTORED_TOO_LARGE", 11: "CALL_TOO_LARGE"}
    assert all(a is None for k, (a, c) in got.items() if c)


def test_answers(spark):
    def chat(*choices):
        return json.dumps({"id": "i", "model": "m", "choices": [{"message": c} for c in choices]})

    def calls(*arguments, name="t"):
        return {"content": None, "tool_calls": [{"id": "c", "function": {"name": name, "arguments": json.dumps(a)}} for a in arguments]}

    bodies = {
        1: chat({"content": "é <ORG_001>"}, {"content": "x", "reasoning_content": "<ORG_001>", "reasoning_details": [{"text": "a"}, {"text": "<PER_001>", "type": "t"}]} | calls({"a": ["<PER_001>"]}, {"a": "b"})),
        2: chat({"content": "x"}, {"content": "<ORG_009>"}), 3: chat({"content": "ORG_001"}), 4: chat({"content": "x"}, calls({"a": 1}) | {"content": "x"}), 5: chat(calls({"<ORG_001>": 1}, {"a": "x"})), 6: chat(calls({"a": "x"}, name="other")),
        7: chat(calls(*[{"a": "<BIG_001>"}] * 5)), 8: chat(calls({"a": 1}), calls({"a": "x"}, name="other")), 9: chat({"content": "x", "reasoning_details": [{"id": "<ORG_001>"}]}), 10: "{", 11: chat(), 12: chat({"content": "ORG_001"}), None: chat({"content": "<x"}),
    }
    rows = [(k, "chat", b) for k, b in bodies.items()] + [(20, "messages", '{"model":"m","content":[{"type":"text","text":"<ORG_001>"},{"type":"tool_use","id":"c","name":"t","input":{"a":"<PER_001>"}}]}'), (21, "other", bodies[2]), (22, "chat", None)]
    mapping = [(k, t, o) for k, _, _ in rows if k not in (12, None) for t, o in (("<ORG_001>", "<PER_001>"), ("<PER_001>", 'A"n'), ("<BIG_001>", "b" * 60_000))]
    found = answers(spark.createDataFrame(rows, "k int, p string, b string"), spark.createDataFrame(mapping, "k int, token string, original string"), "k", "b", "p", ("m",), {"t": {"properties": {"a": {"type": ["string", "array"]}}}})
    got = {r.k: (r.body, r.code) for r in found.collect()}
    assert {k: c for k, (_, c) in got.items() if c} == {
        2: "UNKNOWN_TOKEN", 3: "MALFORMED_TOKEN", 4: "SCHEMA", 5: "TOKEN_IN_KEY", 6: "UNKNOWN_TOOL", 7: "RESTORED_TOO_LARGE", 8: "SCHEMA", 9: "CONTRACT_VIOLATION", 10: "MALFORMED_JSON", 11: "CONTRACT_VIOLATION", 21: "CONTRACT_VIOLATION", 22: "MALFORMED_JSON",
    }
    first, second = (c["message"] for c in json.loads(got[1][0])["choices"])
    assert first == {"content": "é <PER_001>"}
    assert (second["content"], second["reasoning_content"], [d["text"] for d in second["reasoning_details"]], [c["function"]["arguments"] for c in second["tool_calls"]]) == (None, "<PER_001>", ["a", 'A"n'], ['{"a":["A\\"n"]}', '{"a":"b"}'])
    assert got[20][0] == '{"model":"m","content":[{"type":"text","text":"<PER_001>"},{"type":"tool_use","id":"c","name":"t","input":{"a":"A\\"n"}}]}'
    assert json.loads(got[12][0]) == json.loads(bodies[12])
    assert got[None][0] is not None and json.loads(got[None][0]) == json.loads(bodies[None])
    assert all(b is None for b, c in got.values() if c)


def test_roles_name_placeholders(spark):
    texts = [(1, 1, "甲方：宏远公司 与 乙方：大江公司"), (1, 2, "宏远公司"), (1, 3, "甲方 大江公司"), (1, 4, "甲方：新山公司"), (2, 5, "宏远公司")]
    fragments = spark.createDataFrame(texts, "request int, frag int, text string")
    spans = [(f, t.index(n), t.index(n) + 4, "ORG", 3, "x") for _, f, t in texts for n in ("宏远公司", "大江公司", "新山公司") if n in t]
    masked = mask(fragments, spark.createDataFrame(spans, "frag int, start int, end int, entity_type string, priority int, source string"), "request", "frag")
    got = {r.frag: r.redacted for r in masked.redacted.collect()}
    assert got == {1: "甲方：<PARTYA_001> 与 乙方：<ORG_001>", 2: "<PARTYA_001>", 3: "甲方 <ORG_001>", 4: "甲方：<PARTYA_002>", 5: "<ORG_001>"}
    back = {r.frag: r.restored for r in restore(masked.redacted, masked.mapping, "request", "redacted").collect()}
    assert back == {f: t for _, f, t in texts}
