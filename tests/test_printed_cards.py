"""Texts of the four representations are made a few documents at a time, so a worker's memory does not follow its batch."""
import json

import pyarrow as pa

from callscope.functions.jsontext import HELD, printed_cards
from callscope.operators import represent as rp

BODY = '{"type":"object","properties":{"b":{"$ref":"#/definitions/d"},"a":{"type":"string"}},"definitions":{"d":{"type":"integer"}}}'


def test_batches_are_cut():
    n = 3 * HELD + 1
    head = '{"type":"function","function":{"name":"t","description":"d","parameters":'
    batch = pa.RecordBatch.from_pydict({"tool_id": [f"t{i}" for i in range(n)], "head": [head] * n, "body": [BODY] * n, "info": ["{}"] * n})
    got = list(printed_cards(iter([batch])))
    assert [b.num_rows for b in got] == [4 * HELD] * 3 + [4]
    ids = pa.concat_arrays([b.column("tool_id") for b in got]).to_pylist()
    assert ids == [f"t{i}" for i in range(n) for _ in range(4)]


def test_texts_of_a_tool(spark):
    cyclic = BODY.replace('{"type":"integer"}', '{"$ref":"#/definitions/d"}')
    tools = spark.createDataFrame([(1, 'a"b', "é", BODY), (2, "n", None, BODY), (3, "n", "d", None), (4, "n", "d", cyclic)],
                                  "tool_id long, tool_name string, description string, body string")
    got = {(r.tool_id, r.arm): r.text for r in rp.representations(tools).collect()}
    assert len(got) == 16
    card = lambda params: {"type": "function", "function": {"name": 'a"b', "description": "é", "parameters": params}}
    body = json.loads(BODY)
    assert got[1, "raw"] == json.dumps(card(body), indent=2, ensure_ascii=False)
    assert got[1, "minified"] == json.dumps(card(body), separators=(",", ":"), ensure_ascii=False)
    flat = {"type": "object", "properties": {"b": {"type": "integer"}, "a": {"type": "string"}}}
    assert got[1, "normalized"] == json.dumps(card(flat), indent=2, ensure_ascii=False)
    assert json.loads(got[1, "info"])["function"]["parameters"]["properties"] == {"b": {"type": "string"}, "a": {"type": "string"}}
    assert got[4, "normalized"] is None and got[4, "raw"] is not None
    assert got[3, "raw"] is None and got[3, "normalized"] is None
