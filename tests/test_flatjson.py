"""Flat JSON rows, reference inlining and key order on small values."""
import json

from hypothesis import given
from hypothesis import strategies as st

from callscope.functions.flatjson import build, flat
from callscope.functions.jsontext import inline_references
from callscope.functions.keyorder import _ranked
from callscope.functions.mutate import _without

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3),
                      lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


@given(VALUES)
def test_rows_rebuild_the_value(value):
    assert json.dumps(build(flat(value))) == json.dumps(value)


def inlined(doc):
    w = {"root": json.loads(json.dumps(doc))}
    return inline_references(w), w["root"]


def test_references():
    a = {"$ref": "#/d/a"}
    assert inlined({"x": a, "d": {"a": {"t": 1}}}) == ("ok", {"x": {"t": 1}, "d": {"a": {"t": 1}}})
    assert inlined({"x": {"$ref": "#/d/a", "t": 2, "u": a}, "d": {"a": {"t": 1}}})[1]["x"] == {"t": 2, "u": {"t": 1}}
    assert inlined({"x": {"$ref": "#/d/b"}, "d": {"a": {"t": 1}, "b": {"in": a}}})[1]["x"] == {"in": {"t": 1}}
    assert inlined({"x": a, "d": {"a": {"next": a}}})[0] == "cyclic"
    assert inlined({"x": {"$ref": "#"}})[0] == "cyclic"
    assert inlined({"x": {"$ref": "#/d/none"}})[0] == inlined({"x": {"$ref": "other.json"}})[0] == "nonlocal_or_unresolvable"
    assert inlined({"x": {"$ref": "#/l/1"}, "l": [1, [2]]}) == ("ok", {"x": [2], "l": [1, [2]]})
    assert inlined({"x": {"$ref": "#/d/a~1b%20c"}, "d": {"a/b c": 3}})[1]["x"] == 3


def test_declared_members_come_first():
    schema = {"properties": {"b": {"items": {"properties": {"y": {}, "x": {}}}}, "a": {}}}
    value = {"z": 1, "a": 2, "b": [{"x": 1, "w": 0, "y": 2}]}
    got = build([r[1:] for r in _ranked(value, schema)])
    assert json.dumps(got) == '{"b": [{"y": 2, "x": 1, "w": 0}], "a": 2, "z": 1}'


def test_removing_the_last_member_leaves_an_empty_object():
    rows = flat({"a": {"b": {"c": 1}}, "d": 2})
    assert build(_without(rows, ("a", "b", "c"))) == {"a": {"b": {}}, "d": 2}
    assert build(_without(rows, ("a",))) == {"d": 2}
