"""Perturbed outputs fall into the right class; rules with combinators; strict reading."""
import json

import pytest
from pyspark.sql import functions as F

from callscope.operators import scoring as sc
from callscope.operators.schemarules import schema_rules

SCHEMA = {"type": "object", "properties": {
    "name": {"type": "string", "minLength": 2}, "n": {"type": "integer"},
    "mode": {"enum": ["fast", "slow"]}, "people": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "integer"}, "title": {"type": "string"}}}},
    "either": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]}},
    "required": ["name"], "additionalProperties": False}
GOLD = {"name": "Ada Lovelace.", "n": 3, "mode": "fast", "people": [{"id": 1, "title": "A"}, {"id": 2, "title": "B"}]}


def call(args, **top):
    return json.dumps({"tool": "t", "arguments": args, **top})


def without(k):
    return {x: v for x, v in GOLD.items() if x != k}


CASES = {
    "gold": (call(GOLD), None, True),
    "fenced": ("<think>x</think>\n```json\n" + call(GOLD) + "\n```", None, True),
    "duplicate keys keep the last": ('{"tool":"zz","tool":"t","arguments":' + json.dumps(GOLD) + "}", None, True),
    "nested function": (json.dumps({"function": {"name": "t", "arguments": GOLD}}), None, True),
    "case and period": (call({**GOLD, "name": " ada  LOVELACE"}), None, True),
    "number as float": (call({**GOLD, "n": 3.0}), None, True),
    "reversed people": (call({**GOLD, "people": GOLD["people"][::-1]}), None, True),
    "wrong tool": (json.dumps({"tool": "u", "arguments": GOLD}), "wrong tool", False),
    "prose": ("no json here", "malformed output", False),
    "missing": (call(without("name")), "missing required argument", False),
    "type": (call({**GOLD, "n": "3"}), "invalid argument type", False),
    "enum": (call({**GOLD, "mode": "Fast"}), "invalid enum/value", False),
    "extra": (call({**GOLD, "color": "red"}), "hallucinated field", False),
    "value": (call({**GOLD, "n": 4}), "correct tool, wrong argument", False),
    "short": (call({**GOLD, "name": "A"}), "ignored schema constraint", False),
    "one of none": (call({**GOLD, "either": 3}), "ignored schema constraint", False),
}


@pytest.fixture(scope="module")
def result(spark):
    res = spark.createDataFrame([(k, 1, "c", v[0]) for k, v in CASES.items()], "request_key string, task_id int, catalog_key string, raw_content string")
    tasks = sc.prepare_tasks(spark.createDataFrame([(1, "t", json.dumps(GOLD), ["people"])], "task_id int, tool_name string, gold_args string, unordered_paths array<string>"), variants=None)
    rules = schema_rules(spark.createDataFrame([("t", json.dumps(SCHEMA))], "tool_name string, body string"))
    cats = spark.createDataFrame([("c", ["t", "u"])], "catalog_key string, catalog_tools array<string>")
    names = spark.createDataFrame([("t", ["name", "n", "mode", "people", "id", "title", "either"])], "tool_name string, known_names array<string>")
    return {r.request_key: r for r in sc.score(res, tasks, rules, cats, names).select(
        "request_key", "failure_primary", "e2e_success", "arg_exact_match", "json_strict", "schema_errors", "extra_paths").collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_perturbations(result, name):
    r = result[name]
    assert (r.failure_primary, r.e2e_success) == CASES[name][1:], r


def test_exactness(result):
    assert result["gold"].arg_exact_match and result["reversed people"].arg_exact_match
    assert not result["case and period"].arg_exact_match
    assert result["one of none"].schema_errors[0].validator == "oneOf"
    assert result["extra"].extra_paths == ["color"]


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', '{"a":1e999}', '{"a":1} x', '```{"a":1}```', "{'a':1}", '{"a":"Infinity"}']
    df = sc.strict_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    assert {r.i for r in df.where("strict IS NOT NULL").collect()} == {0, 7}


def test_error_kinds(spark):
    rows = [(200, "free", ""), (400, "free", "exceeds the available context size"), (422, "constrained", "grammar rejected"), (422, "free", "grammar rejected"), (0, "free", "x")]
    df = spark.createDataFrame(rows, "http_status int, decoding string, error_message string").withColumn("error_code", F.lit(None).cast("string"))
    assert [r[0] for r in df.select(sc.error_kind()).collect()] == [None, "context_error", "engine_error", "http_error", "transport_error"]
