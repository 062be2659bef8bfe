"""Rules of all keywords against the errors that the drafts call for."""
import json

import pytest
from pyspark.sql import functions as F

from callscope.functions.jsontree import with_nodes
from callscope.operators import schemarules as sr

M = "https://json-schema.org/draft/2020-12/schema"
N = "https://json-schema.org/draft/2019-09/schema"
CASES = [
 ({"type":"object","properties":{"a":{"type":"integer"}},"required":["b"],"additionalProperties":False},{"a":"x","c":1},[("required",""),("type","a"),("additionalProperties","")]),
 ({"patternProperties":{"^x_":{"type":"integer"},"_y$":{"maxLength":3}},"additionalProperties":{"type":"string"}},{"x_a":"s","k_y":"long","o":1,"x_y":5},[("type","x_a"),("maxLength","k_y"),("type","o")]),
 ({"propertyNames":{"maxLength":3,"pattern":"^[a-z]"}},{"abcd":1,"Z":1,"ok":{}},[("maxLength",""),("pattern","")]),
 ({"dependencies":{"a":["b","c"],"d":{"required":["e"]}}},{"a":1,"d":2},[("dependencies",""),("dependencies",""),("required","")]),
 ({"$schema":M,"dependentRequired":{"a":["b"]},"dependentSchemas":{"d":{"properties":{"x":False}}}},{"a":1,"d":2,"x":3},[("dependentRequired",""),("false","x")]),
 ({"$schema":M,"prefixItems":[{"type":"integer"},{"type":"string"}],"items":{"minimum":0}},["a",1,-1,2],[("type","0"),("type","1"),("minimum","2")]),
 ({"$schema":M,"prefixItems":[True],"items":False},[1,2],[("items","")]),
 ({"items":[{"type":"integer"}],"additionalItems":False},[1,2,3],[("additionalItems","")]),
 ({"items":[{"type":"integer"}],"additionalItems":{"type":"string"}},["q",2,"z"],[("type","0"),("type","1")]),
 ({"$schema":M,"contains":{"const":1},"minContains":2,"maxContains":2},[1,0],[("minContains","")]),
 ({"$schema":M,"contains":{"const":1},"maxContains":1},[1,1],[("maxContains","")]),
 ({"contains":{"const":1},"minContains":0},[],[("contains","")]),
 ({"$schema":M,"contains":{"const":1},"minContains":0},[],[]),
 ({"$schema":M,"properties":{"a":{}},"allOf":[{"properties":{"b":{}}}],"anyOf":[{"required":["c"],"properties":{"c":{}}},{"properties":{"d":{"type":"string"}}}],"unevaluatedProperties":False},{"a":1,"b":2,"c":3,"d":4},[("unevaluatedProperties","")]),
 ({"$schema":M,"properties":{"a":{}},"allOf":[{"properties":{"b":{}}}],"anyOf":[{"required":["c"],"properties":{"c":{}}},{"properties":{"d":{"type":"string"}}}],"unevaluatedProperties":False},{"a":1,"b":2,"c":3,"d":"s"},[]),
 ({"$schema":M,"if":{"properties":{"a":{"const":1}},"required":["a"]},"then":{"properties":{"b":{}}},"else":{"properties":{"c":{}}},"unevaluatedProperties":False},{"a":1,"b":2},[]),
 ({"$schema":M,"if":{"properties":{"a":{"const":1}},"required":["a"]},"then":{"properties":{"b":{}}},"else":{"properties":{"c":{}}},"unevaluatedProperties":False},{"a":2,"c":2},[("unevaluatedProperties","")]),
 ({"$schema":M,"prefixItems":[{}],"contains":{"type":"string"},"unevaluatedItems":False},[1,"a",2],[("unevaluatedItems","")]),
 ({"$schema":M,"prefixItems":[{}],"contains":{"type":"string"},"unevaluatedItems":{"type":"integer"}},[1,"a",2],[]),
 ({"$schema":N,"items":[{}],"contains":{"type":"string"},"unevaluatedItems":False},[1,"a"],[("unevaluatedItems","")]),
 ({"$ref":"#/definitions/node","type":"string","definitions":{"node":{"properties":{"next":{"$ref":"#/definitions/node"},"v":{"maximum":5}},"required":["v"]}}},{"v":6,"next":{"v":1,"next":{}}},[("maximum","v"),("required","next/next")]),
 ({"$schema":M,"$ref":"#/$defs/a~1b%20c","type":"string","$defs":{"a/b c":{"minimum":5}}},3,[("type",""),("minimum","")]),
 ({"$ref":"#","type":"string"},3,[]),
 ({"$schema":M,"anyOf":[{"$ref":"#"},{"$ref":"#"}],"type":"string"},3,[("type","")]),
 ({"not":{"type":"string"},"oneOf":[{"minLength":1},{"maxLength":9}]},"abc",[("not",""),("oneOf","")]),
 ({"if":{"type":"string"},"then":{"minLength":9},"else":{"minimum":9}},"abc",[("minLength","")]),
 ({"if":{"type":"string"},"then":{"minLength":9},"else":{"minimum":9}},5,[("minimum","")]),
 ({"allOf":[{"properties":{"a":{"type":"string"}}},{"required":["z"]}]},{"a":1},[("type","a"),("required","")]),
 (False,{},[("false","")]),(True,{},[]),
 ({"properties":{"a":False}},{"a":1},[("false","a")]),
 ({"items":False},[1,2],[("false","0"),("false","1")]),
 ({"$schema":M,"additionalProperties":True,"unevaluatedProperties":False},{"q":1},[]),
 ({"properties":{"a":{"enum":[1,"x",None]},"b":{"const":{"q":[1]}}}},{"a":2,"b":{"q":[1]}},[("enum","a")]),
 ({"anyOf":[True,False],"allOf":[True]},1,[]),
 ({"anyOf":[False,{"type":"string"}]},1,[("anyOf","")]),
]


@pytest.fixture(scope="module")
def found(spark):
    d = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b, _) in enumerate(CASES)], "id int, body string, call string")
    calls = with_nodes(d.select("id", "call"), "call", "arg_nodes").join(sr.schema_rules(d, "id", "body"), "id")
    return {r["id"]: r for r in calls.select("id", F.expr(sr.rule_errors_sql()).alias("errors"), "unchecked").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_errors(found, i):
    assert sorted((e["validator"], e["path"]) for e in found[i]["errors"]) == sorted(CASES[i][2]) and found[i]["unchecked"] == []


def test_references_that_lead_nowhere_are_named(spark):
    given = [{"$ref": "#/definitions/no"}, {"properties": {"a": {"$ref": "other.json#/x"}}}, {"$schema": M, "$dynamicRef": "#x"}, {"$ref": "#/properties/a", "properties": {"a": {}}}]
    d = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(given)], "id int, body string")
    assert {r["id"]: r["unchecked"] for r in sr.schema_rules(d, "id").select("id", "unchecked").collect()} == {0: ["$ref"], 1: ["$ref"], 2: ["$dynamicRef"], 3: []}


def test_nested_recursion_and_empty_table(spark):
    body = {"$ref": "#/definitions/n", "definitions": {"n": {"properties": {"c": {"items": {"$ref": "#/definitions/n"}}}, "required": ["v"]}}}
    call: dict = {"w": 1}
    for _ in range(12):
        call = {"v": 1, "c": [call, {"v": 2}]}
    d = spark.createDataFrame([("t", json.dumps(body), json.dumps(call))], "tool_name string, body string, call string")
    calls = with_nodes(d.select("tool_name", "call"), "call", "arg_nodes")
    got = calls.join(sr.schema_rules(d), "tool_name").select(F.expr(sr.rule_errors_sql()).alias("e")).collect()
    assert [[(x["validator"], x["path"]) for x in r["e"]] for r in got] == [[("required", "/".join(["c/0"] * 12))]]
    assert sr.schema_rules(d.limit(0)).collect() == []


def test_places_give_the_errors_of_the_loops(spark):
    """Plain schemas are checked by place; what has another link, a mixed name or a false element schema is not."""
    tool = {"type": "object", "properties": {"k": {"type": "integer", "maximum": 9}, "no": False, "tags": {"minItems": 3, "items": {"type": "string"}},
                                             "in": {"properties": {"q": {"enum": [1]}}, "required": ["z"]}}, "required": ["k", "w"], "additionalProperties": False}
    mixed = {"properties": {"a.b": {"type": "string"}, "a": {"properties": {"b": {"type": "integer"}}}}}
    given = [(tool, {"k": 10.5, "no": 1, "tags": ["a", 1], "in": {"q": 2}, "x": 1}), (tool, {"in.q": 2, "k": 1}), (tool, {"": {"k": "s"}, "tags[]": 1}),
             (mixed, {"a.b": 1, "a": {"b": "s"}}), ({"items": False}, [1]), ({"not": {"type": "object"}, "properties": {"a": {"type": "string"}}}, {"a": 1}),
             ({"then": {"required": ["q"]}, "properties": {"a": {"type": "string"}}}, {"a": 1})]
    d = spark.createDataFrame([(i, json.dumps(b), json.dumps(c)) for i, (b, c) in enumerate(given)], "id int, body string, call string")
    calls = with_nodes(d.select("id", "call"), "call", "arg_nodes").join(sr.schema_rules(d, "id", "body"), "id")
    loops = calls.withColumn("rules", F.transform("rules", lambda r: r.withField("places", F.lit(None).cast("array<string>"))))
    errors = F.expr(sr.rule_errors_sql()).alias("e")
    got, want = ({r["id"]: sorted(tuple(x) for x in r["e"]) for r in t.select("id", errors).collect()} for t in (calls, loops))
    assert got == want and len(got[0]) == 9 and got[4] == [("false", "0")]
    assert [r["p"] for r in calls.orderBy("id").selectExpr("rules[0].places IS NOT NULL AS p").collect()] == [True, True, True, False, False, False, False]
