"""Small Arrow helpers for what needs the JSON text itself: order, number spelling, salvage.

VARIANT sorts keys and respells numbers, so digests and printed sizes use these. Each helper
handles one document at a time in vectorised batches; Spark does all grouping and joining.
"""
from __future__ import annotations

import json
import re
from graphlib import CycleError, TopologicalSorter
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT = (",", ":")


def _row(**fields):
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


TEXT, INT, BOOL = T.StringType(), T.IntegerType(), T.BooleanType()


def _dump(value, **kw) -> str:
    return json.dumps(value, ensure_ascii=False, **kw)


@F.pandas_udf(_row(chars_pretty=INT, chars_min=INT, bytes_min=INT, canonical=TEXT))
def text_forms(body: pd.Series) -> pd.DataFrame:
    """Printed sizes and the key-sorted compact text of each document."""
    def one(text):
        try:
            doc = json.loads(text)
        except (TypeError, ValueError):
            return None, None, None, None
        small = _dump(doc, separators=COMPACT)
        return (len(_dump(doc, indent=2)), len(small), len(small.encode()),
                _dump(doc, separators=COMPACT, sort_keys=True))
    out = pd.DataFrame([one(t) for t in body],
                       columns=["chars_pretty", "chars_min", "bytes_min", "canonical"])
    for c in ("chars_pretty", "chars_min", "bytes_min"):
        out[c] = out[c].astype("Int32")
    return out


def _slots(doc) -> dict[tuple, tuple]:
    """Container and key of every position of a document, by path."""
    out, todo = {}, [((), doc)]
    while todo:
        path, here = todo.pop()
        below = here.items() if isinstance(here, dict) else enumerate(here) if isinstance(here, list) else ()
        for key, value in below:
            out[path + (key,)] = (here, key)
            todo.append((path + (key,), value))
    return out


def _target(ref: str, slots: dict) -> tuple | None:
    """Path that a local pointer names, or None."""
    path: tuple = ()
    for raw in ref.split("/")[1:]:
        step = unquote(raw.replace("~1", "/").replace("~0", "~"))
        if path + (step,) in slots:
            path += (step,)
        elif step.lstrip("-").isdigit() and path + (int(step),) in slots:
            path += (int(step),)
        else:
            return None
    return path if ref == "#" or ref.startswith("#/") else None


def inline_references(wrapped: dict) -> str:
    """Replace the local references below ``root`` in place and say how it went.

    References wait for those inside their target and inside their own other members; an order in which none waits for a
    later one is an order of replacement, and no such order means a cycle.
    """
    slots = {(): (wrapped, "root"), **_slots(wrapped["root"])}
    holders = {p: v["$ref"] for p, (c, k) in slots.items() if isinstance(v := c[k], dict) and isinstance(v.get("$ref"), str)}
    targets = {p: _target(r, slots) for p, r in holders.items()}
    under = lambda p: [h for h in holders if h[:len(p)] == p]
    waits = {h: {x for x in under(h) if x != h} | set(under(t) if t is not None else ()) for h, t in targets.items()}
    try:
        order = list(TopologicalSorter(waits).static_order())
    except CycleError:
        return "cyclic"
    if None in targets.values():
        return "nonlocal_or_unresolvable"
    for h in order:
        container, key = slots[h]
        base, own = slots[targets[h]], {k: v for k, v in container[key].items() if k != "$ref"}
        base = base[0][base[1]]
        container[key] = {**base, **own} if isinstance(base, dict) else base
    return "ok"


# fixed values: root members a normalised document does not keep
ROOT_DROPPED = ("definitions", "$defs", "$schema", "$id", "$comment")


def _normalized(text) -> tuple:
    """Status and document without references and root metadata, order kept."""
    try:
        wrapped = {"root": json.loads(text)}
        status = inline_references(wrapped)
    except (TypeError, ValueError, RecursionError):
        return "not_json", None
    doc = wrapped["root"]
    if status == "ok" and isinstance(doc, dict):
        doc = {k: v for k, v in doc.items()
               if k not in ROOT_DROPPED and not (k == "id" and isinstance(v, str))}
    return status, doc


@F.pandas_udf(_row(status=TEXT, normalized=TEXT, canonical=TEXT))
def normalized_forms(body: pd.Series) -> pd.DataFrame:
    """Inline local references; drop definition containers and root metadata, order kept."""
    def one(text):
        status, doc = _normalized(text)
        if status != "ok":
            return status, None, None
        return "ok", _dump(doc, separators=COMPACT), _dump(doc, separators=COMPACT, sort_keys=True)
    return pd.DataFrame([one(t) for t in body], columns=["status", "normalized", "canonical"])


#: Documents whose texts a worker holds at once, so that its memory does not follow the size of a batch.
HELD = 128


def printed_cards(batches):
    """(tool_id, head, body, info) to (tool_id, arm, text): the card raw and printed, minified, normalised, of the info subset.

    A card is its head and one of the three parameter texts; without one of them it has no text.
    """
    def card(head, params):
        return None if head is None or params is None else json.loads(f"{head}{params}}}}}")

    def printed(doc, **kw):
        return None if doc is None else _dump(doc, **kw)

    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            part = batch.slice(at, HELD)
            texts = []
            for head, body, info in zip(*(part.column(c).to_pylist() for c in ("head", "body", "info"))):
                raw = card(head, body)
                status, doc = _normalized(body)
                texts += [printed(raw, indent=2), printed(raw, separators=COMPACT),
                          printed(card(head, _dump(doc, separators=COMPACT) if status == "ok" else None), indent=2),
                          printed(card(head, info), indent=2)]
            arms = ["raw", "minified", "normalized", "info"] * part.num_rows
            ids = part.column("tool_id").take(pa.array(np.repeat(np.arange(part.num_rows), 4)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(arms, pa.string()), pa.array(texts, pa.string())], names=["tool_id", "arm", "text"])


_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.DOTALL)


def _fragments(text: str) -> list[str]:
    """Pieces in balanced braces that lie in no other; literals are blanked, and the depth is a running sum held above zero."""
    plain = _LITERAL.sub(lambda m: "_" * len(m[0]), text)
    total = np.cumsum([(c == "{") - (c == "}") for c in plain] or [0])
    depth = total - np.minimum(np.minimum.accumulate(total), 0)
    before = np.concatenate([[0], depth[:-1]])
    return [text[a:z + 1] for a, z in zip(np.flatnonzero((before == 0) & (depth == 1)), np.flatnonzero((before == 1) & (depth == 0)))]


@F.pandas_udf(_row(strict=BOOL, found=INT, body=TEXT))
def salvage_json(text: pd.Series) -> pd.DataFrame:
    """Lenient reading for texts the JVM parser refused (NULL rows cost nothing).

    Re-emits the first readable object with the last of any duplicate keys.
    """
    def one(t):
        if t is None:
            return None, None, None
        try:
            return True, 0, _dump(json.loads(t))
        except (ValueError, RecursionError):
            pass
        hits = []
        for piece in _fragments(t):
            try:
                hits.append(json.loads(piece))
            except (ValueError, RecursionError):
                continue
        return False, len(hits), _dump(hits[0]) if hits else None
    out = pd.DataFrame([one(t) for t in text], columns=["strict", "found", "body"])
    out["strict"] = out["strict"].astype("boolean")
    out["found"] = out["found"].astype("Int32")
    return out
