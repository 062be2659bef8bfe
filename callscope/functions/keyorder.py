"""Key order and key spelling helpers; order lives in the text, so these read JSON text."""
from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.flatjson import build, flat


def _ranked(value, schema) -> list:
    """Rows of a value, each behind its rank: a place per path step, declared members before the others.

    A schema governs members through ``properties``, else ``additionalProperties``, and elements through ``items``.
    """
    governs, place = {(): schema}, {(): ()}
    reading: dict[tuple, int] = {}
    for path, _ in flat(value):
        for n in range(1, len(path) + 1):
            at, above = path[:n], path[:n - 1]
            if at in place:
                continue
            rule = governs[above] if isinstance(governs[above], dict) else {}
            seen = reading[above] = reading.get(above, -1) + 1
            if isinstance(at[-1], int):
                governs[at], rank = rule.get("items") if isinstance(rule.get("items"), dict) else None, seen
            else:
                declared = rule.get("properties") if isinstance(rule.get("properties"), dict) else {}
                governs[at] = declared.get(at[-1], rule.get("additionalProperties"))
                rank = list(declared).index(at[-1]) if at[-1] in declared else len(declared) + seen
            place[at] = place[above] + (rank,)
    return sorted(((place[path], path, leaf) for path, leaf in flat(value)), key=lambda r: r[0])


@F.pandas_udf(T.StringType())
def order_like_schema(value: pd.Series, schema: pd.Series) -> pd.Series:
    """Value text with object keys in schema order, undeclared keys after them."""
    return pd.Series([None if v is None or s is None else
                      json.dumps(build([r[1:] for r in _ranked(json.loads(v), json.loads(s))]), ensure_ascii=False, separators=(",", ":"))
                      for v, s in zip(value, schema)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def caseless_keys(keys: pd.Series) -> pd.Series:
    """Compatibility-normalised, stripped and casefolded keys."""
    return keys.map(lambda ks: None if ks is None else [unicodedata.normalize("NFKC", k).strip().casefold() for k in ks])


def key_sequence(text: str) -> Column:
    """All member names of a JSON text in reading order (values cannot be followed by a colon)."""
    return F.expr(f"regexp_extract_all({text}, '\"((?:[^\"\\\\\\\\]|\\\\\\\\.)*+)\"[ \\t\\n\\r]*:', 1)")


def observed_property_order(observed: str, declared: str) -> Column:
    """Declared names as observed first, then the rest in declared order."""
    return F.expr(f"array_union(array_intersect({observed}, {declared}), {declared})")
