"""JSON documents as arrays of nodes, built from VARIANT with higher-order functions.

``tree_nodes`` expands one nesting level per round inside a projection: no explode, no
shuffle and no Python worker. Rounds are a loop over each value's own brackets, so the plan
has one size whatever the data nest, and no document is cut short.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\\u0001"  # pointer token separator, inside SQL text
OBJ = "map<string,variant>"
ARR = "array<variant>"


def once(expr: str) -> Column:
    """Column computed exactly where it is defined.

    A later filter or explode would otherwise be pushed below the definition with the whole tree
    expression copied into it; the optimizer leaves non-deterministic columns in place.
    """
    return F.expr(f"if(spark_partition_id() >= 0, {expr}, NULL)")


def rounds_of(v: str) -> str:
    """SQL: numbers 1 to the opening brackets of a VARIANT's text, of which nesting can't use more."""
    return f"transform(array(to_json({v})), j -> sequence(1, greatest(1, length(j) - length(translate(j, '[{{', '')))))[0]"


def expand_rounds(v: str, start: str, kind: str, step: str) -> str:
    """SQL: the nodes of ``v`` from one open root, ``step`` giving the nodes that replace an open node x.

    A round leaves a tree without open nodes as it is, so rounds beyond the deepest level cost nothing.
    """
    return f"""aggregate({rounds_of(v)}, cast({start} as {kind}), (t, i) -> CASE WHEN NOT exists(t, x -> x.open) THEN t
        ELSE cast(flatten(transform(t, x -> {step})) as {kind}) END)"""


def strict_variant(text: str) -> str:
    """SQL: VARIANT of a text that is exactly one JSON document, else NULL.

    The parser ignores trailing text, so the document must be the first of two elements, followed by its own hash.
    """
    pair = "transform(array(try_parse_json(concat('[', t, ',', xxhash64(t), ']'))), p -> "
    return (f"transform(array({text}), t -> {pair}CASE WHEN try_variant_get(p, '$[1]', 'bigint') = xxhash64(t) "
            f"AND try_variant_get(p, '$[2]', 'variant') IS NULL THEN try_variant_get(p, '$[0]', 'variant') END)[0])[0]")


def tree_nodes(v: str) -> str:
    """SQL for array<struct> of all nodes of variant ``v``, containers included.

    path is ``a.b[0]`` and pos ``a.b[]``; ptr joins unescaped tokens with U+0001; key/pkey are the node's and
    its parent's member names; kind is one of OBJ ARR STR BIG DEC DOU BOO VOI.
    """
    # members and elements are read once, where a value is met; only values that have some stay open
    held = lambda path, pos, ptr, key, pkey, lvl, value: (
        f"transform(array(try_cast({value} as {OBJ})), o -> transform(array(CASE WHEN o IS NULL THEN try_cast({value} as {ARR}) END), a -> "
        f"named_struct('path', {path}, 'pos', {pos}, 'ptr', {ptr}, 'key', {key}, 'pkey', {pkey}, 'lvl', {lvl}, 'v', {value}, 'o', o, 'a', a, "
        f"'open', o IS NOT NULL OR a IS NOT NULL))[0])[0]")
    none = "cast(null as string)"
    start = f"array({held("''", "''", "''", none, none, '0', v)})"
    closed = ("array(named_struct('path', x.path, 'pos', x.pos, 'ptr', x.ptr, 'key', x.key, 'pkey', x.pkey, "
              "'lvl', x.lvl, 'v', x.v, 'o', x.o, 'a', x.a, 'open', false))")
    member = held("if(x.path = '', e.key, concat(x.path, '.', e.key))", "if(x.pos = '', e.key, concat(x.pos, '.', e.key))",
                  f"concat(x.ptr, '{SEP}', e.key)", "e.key", "x.key", "x.lvl + 1", "e.value")
    element = held("concat(x.path, '[', i, ']')", "concat(x.pos, '[]')", f"concat(x.ptr, '{SEP}', i)", none, "x.key", "x.lvl + 1", "e")
    step = f"""CASE WHEN NOT x.open THEN array(x)
          WHEN x.o IS NOT NULL THEN concat({closed}, transform(map_entries(x.o), e -> {member}))
          ELSE concat({closed}, transform(x.a, (e, i) -> {element})) END"""
    # start has the type of every round, so nothing is cast
    expr = f"aggregate({rounds_of(v)}, {start}, (t, i) -> CASE WHEN NOT exists(t, x -> x.open) THEN t ELSE flatten(transform(t, x -> {step})) END)"
    kind = "CASE WHEN x.o IS NOT NULL THEN 'OBJ' WHEN x.a IS NOT NULL THEN 'ARR' ELSE left(schema_of_variant(x.v), 3) END"
    return f"""transform({expr}, x -> transform(array({kind}), kind -> named_struct('path', x.path, 'pos', x.pos, 'ptr', x.ptr, 'key', x.key,
        'pkey', x.pkey, 'lvl', x.lvl, 'kind', kind, 'keys', map_keys(x.o), 'n', CASE WHEN x.o IS NOT NULL THEN cardinality(x.o) ELSE cardinality(x.a) END,
        'txt', CASE WHEN NOT x.open AND x.o IS NULL AND x.a IS NULL THEN cast(x.v as string) END,
        'num', CASE WHEN kind IN ('BIG', 'DEC', 'DOU') THEN try_cast(x.v as double) END,
        'json', CASE WHEN x.o IS NOT NULL OR x.a IS NOT NULL THEN to_json(x.v) END))[0])"""


def leaves_of(nodes: str) -> str:
    """SQL: leaf nodes only. Scalars and empty arrays are leaves; an empty object yields none."""
    return f"filter({nodes}, n -> n.kind NOT IN ('OBJ', 'ARR') OR (n.kind = 'ARR' AND n.n = 0))"


def with_nodes(df: DataFrame, text_col: str, out: str = "nodes") -> DataFrame:
    """Add the node array of a JSON text column (NULL where the text is not one document)."""
    return (df.withColumn("_v", once(strict_variant(text_col)))
              .withColumn(out, once(f"CASE WHEN _v IS NOT NULL THEN {tree_nodes('_v')} END"))
              .drop("_v"))


def leaf_table(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """Long leaf table (key, path, tokens, type, value) of any JSON column."""
    names = "CASE n.kind WHEN 'STR' THEN 'string' WHEN 'BOO' THEN 'boolean' WHEN 'VOI' THEN 'null' " \
            "WHEN 'ARR' THEN 'array' ELSE 'number' END"
    return (with_nodes(df.select(key, json_col), json_col, "nodes")
            .select(key, F.expr(f"explode({leaves_of('nodes')}) AS n"))
            .select(key, "n.path",
                    F.expr("regexp_extract_all(n.path, '[^.\\\\[\\\\]]+|\\\\[[0-9]+\\\\]', 0)").alias("tokens"),
                    F.expr(names).alias("type"),
                    F.expr("coalesce(n.txt, n.json)").alias("value")))
