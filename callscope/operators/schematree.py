"""JSON Schema documents as schema-position nodes and as flat rule tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.jsontree import ARR, OBJ, SEP, expand_rounds, once, strict_variant

# fixed values: members whose subtrees are schemas
MAP_KEYS = ("properties", "patternProperties", "definitions", "$defs", "dependentSchemas")
LIST_KEYS = ("allOf", "anyOf", "oneOf", "prefixItems")
SINGLE_KEYS = ("items", "additionalProperties", "additionalItems", "not", "if", "then", "else", "contains",
               "propertyNames", "unevaluatedProperties", "unevaluatedItems")


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _child(ptr, depth, via, name, feat, ipos, scope, v) -> str:
    return (f"named_struct('ptr', {ptr}, 'depth', {depth}, 'via', {via}, 'name', {name}, 'feat', {feat}, "
            f"'ipos', {ipos}, 'scope', {scope}, 'parent', x.ptr, 'v', {v}, 'open', true)")


OPEN_SCHEMA = ("array<struct<ptr:string,depth:int,via:string,name:string,feat:boolean,ipos:string,scope:string,"
               "parent:string,v:variant,open:boolean>>")


def schema_tree(v: str) -> str:
    """SQL: array of nodes at schema positions only; literals (enum, const, default) are not walked.

    feat marks nodes the feature walker reaches (list-valued items and dependencies belong to
    the keyword walker alone). ipos is the instance position a node constrains, scope the
    combinator branch it sits in.
    """
    none = "cast(null as string)"
    kids = f"""flatten(transform(map_entries(try_cast(x.v as {OBJ})), kv -> CASE
      WHEN kv.key IN ({sql_list(MAP_KEYS)}) THEN
        transform(ifnull(map_entries(try_cast(kv.value as {OBJ})), array()), e -> {_child(
            f"concat(x.ptr, '{SEP}', kv.key, '{SEP}', e.key)",
            "x.depth + if(kv.key = 'properties', 1, 0)", "kv.key", "e.key", "x.feat",
            f"if(kv.key = 'properties' AND x.ipos IS NOT NULL, if(x.ipos = '', e.key, concat(x.ipos, '.', e.key)), {none})",
            "x.scope", "e.value")})
      WHEN kv.key IN ({sql_list(LIST_KEYS)}) THEN
        transform(ifnull(try_cast(kv.value as {ARR}), array()), (e, i) -> {_child(
            f"concat(x.ptr, '{SEP}', kv.key, '{SEP}', i)", "x.depth", "kv.key", none, "x.feat",
            f"if(kv.key = 'prefixItems', {none}, x.ipos)",
            f"if(kv.key IN ('anyOf', 'oneOf'), concat(x.scope, '/', x.ptr, '~', kv.key, '#', i), x.scope)", "e")})
      WHEN kv.key IN ({sql_list(SINGLE_KEYS)}) AND try_cast(kv.value as {OBJ}) IS NOT NULL THEN
        array({_child(f"concat(x.ptr, '{SEP}', kv.key)", "x.depth + if(kv.key = 'items', 1, 0)",
            "kv.key", none, "x.feat",
            f"CASE WHEN kv.key = 'items' THEN concat(x.ipos, '[]') "
            f"WHEN kv.key IN ('not', 'if', 'then', 'else') THEN x.ipos ELSE {none} END",
            "if(kv.key IN ('not', 'if', 'then', 'else'), concat(x.scope, '/', x.ptr, '~', kv.key), x.scope)",
            "kv.value")})
      WHEN kv.key IN ({sql_list(SINGLE_KEYS)}) THEN
        transform(ifnull(try_cast(kv.value as {ARR}), array()), (e, i) -> {_child(
            f"concat(x.ptr, '{SEP}', kv.key, '{SEP}', i)", "x.depth", "kv.key", none, "false", none, "x.scope", "e")})
      WHEN kv.key = 'dependencies' THEN
        transform(ifnull(map_entries(try_cast(kv.value as {OBJ})), array()), e -> {_child(
            f"concat(x.ptr, '{SEP}', kv.key, '{SEP}', e.key)", "x.depth", "kv.key", "e.key", "false", none,
            "x.scope", "e.value")})
      ELSE array() END))"""
    closed = ("array(named_struct('ptr', x.ptr, 'depth', x.depth, 'via', x.via, 'name', x.name, 'feat', x.feat, "
              "'ipos', x.ipos, 'scope', x.scope, 'parent', x.parent, 'v', x.v, 'open', false))")
    start = (f"array(named_struct('ptr', '', 'depth', 0, 'via', {none}, 'name', {none}, 'feat', true, 'ipos', "
             f"cast('' as string), 'scope', '', 'parent', {none}, 'v', {v}, 'open', true))")
    step = f"CASE WHEN NOT x.open OR try_cast(x.v as {OBJ}) IS NULL THEN {closed} ELSE concat({closed}, {kids}) END"
    expr = expand_rounds(v, start, OPEN_SCHEMA, step)
    return f"""transform({expr}, x -> named_struct('ptr', x.ptr, 'parent', x.parent, 'depth', x.depth, 'via', x.via,
        'name', x.name, 'feat', x.feat, 'ipos', x.ipos, 'scope', x.scope,
        'keys', map_keys(try_cast(x.v as {OBJ})), 'v', x.v))"""


def with_schema_tree(schemas: DataFrame, body: str = "body", out: str = "tree") -> DataFrame:
    return (schemas.withColumn("_v", once(strict_variant(body)))
            .withColumn(out, once(f"CASE WHEN _v IS NOT NULL THEN {schema_tree('_v')} END")).drop("_v"))


def schema_nodes(schemas: DataFrame, profile: str = "keyword", key: str = "schema_id", body: str = "body") -> DataFrame:
    """Node table, one row per schema position (profile: feature | keyword walker)."""
    t = with_schema_tree(schemas.select(key, body), body)
    df = t.select(key, F.posexplode("tree").alias("node_id", "n")).where("n.keys IS NOT NULL")
    if profile == "feature":
        df = df.where("n.feat")
    return df.select(key, "node_id", "n.ptr", "n.parent", "n.via", "n.name", "n.depth", "n.keys", "n.ipos", "n.scope",
                     F.col("n.v").alias("node"))
