"""Violations against a slow validator, on documents with planted and random faults."""

import json
import random
import re

import pytest

from pairloom.operators.json_schema import Nodes, violations

VARIANT = {"type": "object", "required": ["text", "role"], "additionalProperties": False, "properties": {"text": {"type": ["string", "null"], "minLength": 2}, "role": {"type": "string", "enum": ["none", "causal"]}, "flags": {"type": "array", "items": {"type": "string"}, "maxItems": 2, "uniqueItems": True}, "age": {"type": ["integer", "null"], "minimum": 0, "maximum": 120}}}
SCHEMA = {
    "$schema": "x", "type": "array", "items": {"$ref": "#/$defs/Record"},
    "$defs": {
        "Variant": VARIANT,
        "Record": {"type": "object", "required": ["id", "variants"], "additionalProperties": False, "properties": {
            "id": {"type": "string", "pattern": "^q_[0-9]+$"}, "score": {"type": "number", "exclusiveMinimum": 0}, "fixed": {"const": {"b": 1, "a": [True]}},
            "options": {"type": "object", "patternProperties": {"^[A-D]$": {"type": "string"}}, "additionalProperties": False, "minProperties": 2, "maxProperties": 4},
            "variants": {"type": "object", "additionalProperties": {"type": "object", "properties": {"one": {"$ref": "#/$defs/Variant"}}, "additionalProperties": {"$ref": "#/$defs/Variant"}}},
            "both": {"allOf": [{"type": "integer"}, {"minimum": 3}]},
        }},
    },
}
GOOD = {"id": "q_1", "score": 2, "fixed": {"a": [True], "b": 1}, "options": {"A": "x", "B": "y"}, "variants": {"race": {"one": {"text": "hello", "role": "none", "flags": ["a", "b"], "age": 3.0}, "two": {"text": None, "role": "causal"}}}, "both": 4}


def is_type(name, v):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}[name]


def slow(v, schema, path, out):
    """Paths and keywords."""
    if "$ref" in schema:
        return slow(v, SCHEMA["$defs"][schema["$ref"].split("/")[-1]], path, out)
    for s in schema.get("allOf", []):
        slow(v, s, path, out)
    types = schema.get("type", [])
    if types and not any(is_type(t, v) for t in ([types] if isinstance(types, str) else types)):
        out.add((path, "is not of type"))
    if "enum" in schema and v not in schema["enum"]:
        out.add((path, "is none of"))
    if "const" in schema and v != schema["const"]:
        out.add((path, "is not"))
    number = is_type("number", v)
    for keyword, wrong, words in [("minimum", lambda r: v < r, "is less than"), ("maximum", lambda r: v > r, "is more than"), ("exclusiveMinimum", lambda r: v <= r, "is not more than")]:
        if keyword in schema and number and wrong(schema[keyword]):
            out.add((path, words))
    if isinstance(v, str):
        if len(v) < schema.get("minLength", 0):
            out.add((path, "is shorter than"))
        if "pattern" in schema and not re.search(schema["pattern"], v):
            out.add((path, "does not match"))
    if isinstance(v, list):
        if len(v) > schema.get("maxItems", 99):
            out.add((path, "has more items than"))
        if schema.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v):
            out.add((path, "has items twice"))
        for i, x in enumerate(v):
            if "items" in schema:
                slow(x, schema["items"], f"{path}/{i}".strip("/"), out)
    if isinstance(v, dict):
        if len(v) < schema.get("minProperties", 0):
            out.add((path, "has fewer members than"))
        if len(v) > schema.get("maxProperties", 99):
            out.add((path, "has more members than"))
        for r in schema.get("required", []):
            if r not in v:
                out.add((path, f"lacks {r}"))
        for k, x in v.items():
            at = f"{path}/{k}".strip("/")
            subs = [schema["properties"][k]] if k in schema.get("properties", {}) else []
            subs += [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, k)]
            rest = schema.get("additionalProperties", True)
            if not subs and rest is False:
                out.add((path, f"must not have {k}"))
            elif not subs and isinstance(rest, dict):
                subs = [rest]
            for s in subs:
                slow(x, s, at, out)
    return out


def broken(rng, v):
    """A copy with some parts replaced."""
    wrong = [None, True, -1, 3.5, "", "z", [], ["a", "a", 1], {}, {"x": 1}, {"text": "ok", "role": "none"}]
    if rng.random() < 0.07:
        return rng.choice(wrong)
    if isinstance(v, dict):
        out = {k: broken(rng, x) for k, x in v.items() if rng.random() > 0.06}
        if rng.random() < 0.1:
            out[rng.choice(["A", "E", "extra", "one"])] = rng.choice(wrong)
        return out
    return [broken(rng, x) for x in v] if isinstance(v, list) else v


def test_violations_are_those_of_a_slow_validator(spark):
    rng = random.Random(1)
    docs = [(0, [GOOD])] + [(i, broken(rng, [GOOD] * rng.randrange(3))) for i in range(1, 150)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "path int, doc string")
    got = {}
    for r in violations(df.withColumnRenamed("path", "id"), "doc", SCHEMA, ["id"]).collect():
        words = r.message if r.message.startswith(("lacks", "must not have")) else re.match(r"(is not of type|is none of|is less than|is more than|is not more than|is not|is shorter than|does not match|has [a-z]+ [a-z]+( than)?)", r.message).group(1)
        got.setdefault(r.id, set()).add((r.path, words))
    for i, d in docs:
        assert got.get(i, set()) == slow(d, SCHEMA, "", set()), json.dumps(d)
    assert 0 not in got and len(got) > 80


def test_texts_that_are_no_json(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, "7"), (4, "[]")], "id int, doc string")
    assert sorted((r.id, r.path, r.message) for r in violations(df, "doc", SCHEMA, ["id"]).collect()) == [(1, "", "is no JSON"), (3, "", "is not of type array")]


def test_schemas_that_refer_to_themselves(spark):
    tree = {"$ref": "#/$defs/T", "$defs": {"T": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/T"}}}}}}
    doc = {"n": 1, "kids": [{"n": 2}, {"kids": [{"n": "x"}]}]}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string")
    assert {(r.path, r.message) for r in violations(df, "doc", tree, ["id"]).collect()} == {("kids/1", "lacks n"), ("kids/1/kids/0/n", "is not of type integer")}


def test_keywords_without_support_are_refused():
    with pytest.raises(ValueError, match="anyOf"):
        Nodes({"properties": {"a": {"anyOf": [{}]}}})
    with pytest.raises(ValueError, match="outside"):
        Nodes({"$ref": "other.json"})


def test_values_are_checked_in_compiled_columns(spark):
    """What a lambda does is interpreted; with one for all values of a row, 10 times sf0.1 took 106 s."""
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"enum": ["x"]}}}}, "c": {"type": "object", "additionalProperties": {"type": "integer", "maximum": 3}}}}
    df = spark.createDataFrame([(1, '{"a":[{"b":"x"},{"b":"y"}],"c":{"p":4},"d":1}'), (2, '{"c":{}}')], "id int, doc string")
    out = violations(df, "doc", schema, ["id"])
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == [(1, "", "must not have d"), (1, "a/1/b", 'is none of "x"'), (1, "c/p", "is more than 3.0"), (2, "", "lacks a")]


def test_other_members_may_be_the_whole_schema(spark):
    tree = {"type": "object", "additionalProperties": {"$ref": "#"}}
    df = spark.createDataFrame([(1, '{"a":{"b":{}}}'), (2, '{"a":{"b":{"c":7}}}')], "id int, doc string")
    assert [tuple(r) for r in violations(df, "doc", tree, ["id"]).collect()] == [(2, "a/b/c", "is not of type object")]


def test_nodes_that_meet_one_value_say_the_same_once(spark):
    schema = {"properties": {"ab": {"type": "string"}}, "patternProperties": {"^a": {"type": "string", "minLength": 2}, "b$": {"allOf": [{"type": "string"}, {"type": ["string", "null"]}]}}}
    df = spark.createDataFrame([(1, '{"ab":7}'), (2, '{"ab":"x","a":null,"b":null,"c":7}'), (3, "{}"), (4, "[7]")], "id int, doc string")
    text, either, short = "is not of type string", "is not of type string, null", "is shorter than 2"
    assert sorted(tuple(r) for r in violations(df, "doc", schema, ["id"]).collect()) == [(1, "ab", text), (1, "ab", either), (2, "a", text), (2, "ab", short), (2, "b", text)]
