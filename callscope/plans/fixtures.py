"""Derived inputs: tool schemas, tasks, outputs and ledgers computed from the given tables.

Each definition is one SQL text that both Spark and an ANSI engine read the same way, so a
job and its check start from equal rows. Every derived table keeps all rows of its source.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

KINDS = ["signup", "error", "click", "view", "purchase"]

# fixed values: property names of the derived schema corpus
WORDS = ("amount author budget category city code color comment country currency date depth email enabled "
         "end event format group height host id label language level limit location method mode name note "
         "order owner path phone port price priority query rate region").split()

FX: dict[str, str] = {}

FX["fx_tasks"] = """
SELECT event_id AS task_id, user_id AS intent_id, event_id % 10 AS replicate,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'structured' ELSE 'flat' END AS stratum,
       event_type AS tool_name, event_type AS kind,
       cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k,
       cast(round(value * 100) AS bigint) AS cents
FROM events"""

_GOLD = ("'{\"k\":' || cast(k AS string) || ',\"cents\":' || cast(cents AS string) || ',\"kind\":\"' || kind || "
         "'\",\"tags\":[\"t' || cast(k % 3 AS string) || '\",\"u\"]}'")


def _args(k="cast(k AS string)", kind="kind", tags="'[\"t' || cast(k % 3 AS string) || '\",\"u\"]'", extra="''",
          with_k=True) -> str:
    head = f"'\"k\":' || {k} || ',' ||" if with_k else ""
    return (f"'{{' || {head} '\"cents\":' || cast(cents AS string) || ',\"kind\":\"' || {kind} || "
            f"'\",\"tags\":' || {tags} || {extra} || '}}'")


def _call(args: str, tool="tool_name", tk="tool", ak="arguments") -> str:
    return f"'{{\"{tk}\":\"' || {tool} || '\",\"{ak}\":' || {args} || '}}'"


FX["fx_task_rows"] = f"""
SELECT *, {_GOLD} AS gold_args,
       'U' || cast(intent_id AS string) || ' ' || kind || ' at ' || cast(cents AS string) || ' cents' AS prompt
FROM fx_tasks"""

FX["fx_results_key"] = """
SELECT *, CASE WHEN size = 1 THEN 'arggen' ELSE 'select' END AS family,
       CASE WHEN arm_no = 0 THEN 'raw' ELSE 'min' END AS arm,
       CASE WHEN arm_no = 0 THEN 'free' ELSE 'constrained' END AS decoding,
       CASE WHEN size = 1 THEN NULL ELSE 'C' || cast(size AS string) || '_R' || cast(replicate AS string) END AS catalog_id,
       CASE WHEN size = 1 THEN 'single:' || tool_name
            ELSE 'C' || cast(size AS string) || '_R' || cast(replicate AS string) END AS catalog_key,
       (CASE WHEN size = 1 THEN 'arggen' ELSE 'select' END) || '|' || (CASE WHEN arm_no = 0 THEN 'raw' ELSE 'min' END) || '|' ||
         (CASE WHEN size = 1 THEN 'single' ELSE 'C' || cast(size AS string) || '_R' || cast(replicate AS string) END)
         || '|' || cast(task_id AS string) AS request_key,
       (task_id * 31 + arm_no * 17 + size * 7) % 20 AS h,
       (task_id * 7 + arm_no * 3 + size) % 101 AS fault
FROM (SELECT *, $each(1, 5, 20) AS size FROM (SELECT *, $each(0, 1) AS arm_no FROM fx_tasks) t) a"""

_PLAIN = _call(_args())
FX["fx_results"] = f"""
SELECT task_id, intent_id, replicate, stratum, tool_name, kind, k, cents, arm_no, arm, decoding, size, family, catalog_id,
       catalog_key, request_key, h, fault,
       CASE WHEN h <= 6 THEN {_PLAIN}
            WHEN h = 7 THEN 'Sure, here it is: ' || {_PLAIN} || ' as asked.'
            WHEN h = 8 THEN '{{"tool":"' || tool_name || '","arguments":"' || replace({_args()}, '"', chr(92) || '"') || '"}}'
            WHEN h = 9 THEN {_call(_args(), tk='name', ak='parameters')}
            WHEN h = 10 THEN {_call(_args(tags="'[\"u\",\"t' || cast(k % 3 AS string) || '\"]'"))}
            WHEN h = 11 THEN {_call(_args(kind='upper(kind)'))}
            WHEN h = 12 THEN {_call(_args(k="'\"' || cast(k AS string) || '\"'"))}
            WHEN h = 13 THEN {_call(_args(with_k=False))}
            WHEN h = 14 THEN {_call(_args(k="cast(k + CASE WHEN kind = 'click' THEN 1000 ELSE 1 END AS string)"))}
            WHEN h = 15 THEN {_call(_args(), tool="(CASE WHEN task_id % 2 = 0 THEN 'ghost_tool' WHEN tool_name = 'view' THEN 'click' ELSE 'view' END)")}
            WHEN h = 16 THEN 'I would call the tool ' || tool_name || ' for you.'
            WHEN h = 17 THEN '<think>' || chr(10) || 'hm' || chr(10) || '</think>' || chr(10) || '```json' || chr(10) || {_PLAIN} || chr(10) || '```'
            WHEN h = 18 THEN {_call(_args(extra="',\"color\":\"red\"'"))}
            ELSE '{{"tool":"' || tool_name || '","arguments":{{"k":' || cast(k AS string) || ',"kind":"' || substr(kind, 1, 3) END
         AS raw_content,
       h = 19 AS truncated,
       CASE fault WHEN 0 THEN 400 WHEN 1 THEN 0 WHEN 2 THEN 422 WHEN 3 THEN 500 ELSE 200 END AS http_status,
       CASE fault WHEN 0 THEN 'Request exceeds the available context size' WHEN 1 THEN 'refused'
                  WHEN 2 THEN 'Failed to parse grammar' WHEN 3 THEN 'boom' END AS error_message,
       cast(NULL AS string) AS error_code,
       size * (100 + arm_no * 40) + task_id % 37 AS prompt_tokens, 20 + h AS completion_tokens,
       cast(1000 + (task_id * 13 + size) % 997 AS double) AS wall_latency_ms
FROM fx_results_key"""

# outputs that must be labelled, never dropped or taken as valid: deep and broken text, refused requests, tools without
# rules (view), tasks that nobody knows
FX["fx_hostile"] = f"""
SELECT CASE WHEN task_id % 10 = 7 THEN -1 - task_id ELSE task_id END AS task_id, task_id AS request_key, task_id % 10 AS h, tool_name,
       'single:' || tool_name AS catalog_key, task_id % 10 = 5 AS context_error, task_id % 20 = 4 AS ghost,
       CASE task_id % 10 WHEN 0 THEN repeat('[', 48) WHEN 1 THEN repeat('[', 5000) WHEN 2 THEN {_call("'{\"k\":NaN}'")}
            WHEN 3 THEN replace({_PLAIN}, ',"arguments"', ',"tool":"' || tool_name || '","arguments"')
            WHEN 4 THEN {_call(_args(), tool="(CASE WHEN task_id % 20 = 4 THEN 'ghost' ELSE tool_name END)")} || ' then ' || {_PLAIN}
            WHEN 8 THEN repeat('[', 500) || repeat(']', 500) ELSE {_PLAIN} END AS raw_content
FROM fx_tasks"""

FX["fx_expected"] = """
SELECT task_id, intent_id, replicate, stratum, tool_name, arm_no, arm, decoding, size, family, catalog_id, catalog_key, request_key,
       h, fault, truncated, http_status, prompt_tokens, completion_tokens, wall_latency_ms, json_valid, json_strict,
       tool_correct, schema_valid, semantic_correct, arg_exact_match,
       CASE WHEN NOT tool_correct THEN 0.0 WHEN h IN (13, 14) THEN 0.8 ELSE 1.0 END AS field_acc,
       CASE WHEN NOT tool_correct THEN 0.0 WHEN h IN (11, 12, 13, 14) THEN 0.8 ELSE 1.0 END AS field_exact_acc,
       schema_valid AND semantic_correct AS e2e_success,
       schema_valid AND semantic_correct AND h <> 18 AS e2e_strict,
       CASE WHEN NOT json_valid THEN 'malformed output' WHEN h = 15 THEN 'wrong tool'
            WHEN h = 11 THEN 'invalid enum/value' WHEN h = 12 THEN 'invalid argument type'
            WHEN h = 13 THEN 'missing required argument'
            WHEN h = 14 AND tool_name = 'click' THEN 'ignored schema constraint'
            WHEN h = 14 THEN 'correct tool, wrong argument'
            WHEN h = 18 AND tool_name <> 'view' THEN 'hallucinated field' END AS failure_primary,
       CASE WHEN h = 13 OR (h = 14 AND tool_name = 'click') THEN 'correct tool, wrong argument'
            WHEN h = 18 AND tool_name = 'view' THEN 'hallucinated field' ELSE '' END AS failure_secondary
FROM (SELECT *, tool_correct AND h NOT IN (11, 12, 13) AND NOT (h = 14 AND tool_name = 'click')
                AND NOT (h = 18 AND tool_name <> 'view') AS schema_valid,
             tool_correct AND h NOT IN (13, 14) AS semantic_correct,
             tool_correct AND h NOT IN (11, 12, 13, 14, 18) AS arg_exact_match
      FROM (SELECT *, h NOT IN (16, 19) AS json_valid, h NOT IN (7, 16, 19) AS json_strict,
                   h NOT IN (15, 16, 19) AS tool_correct, h = 19 AS truncated,
                   CASE fault WHEN 0 THEN 400 WHEN 1 THEN 0 WHEN 2 THEN 422 WHEN 3 THEN 500 ELSE 200 END AS http_status,
                   size * (100 + arm_no * 40) + task_id % 37 AS prompt_tokens, 20 + h AS completion_tokens,
                   cast(1000 + (task_id * 13 + size) % 997 AS double) AS wall_latency_ms
            FROM fx_results_key) a) b"""

_ENUM = ",".join(f'"{k}"' for k in KINDS)
FX["fx_tool_schemas"] = f"""
SELECT tool_name, tool_name AS schema_id, n_tasks,
       '{{"type":"object","properties":{{"k":{{"type":"integer","minimum":0,"maximum":999}},"cents":{{"type":"integer"}},' ||
       '"kind":{{"type":"string","enum":[{_ENUM}]}},"tags":{{"type":"array","items":{{"type":"string"}},"minItems":1}}}},' ||
       '"required":["k","kind"]' || CASE WHEN tool_name = 'view' THEN '' ELSE ',"additionalProperties":false' END || '}}' AS body
FROM (SELECT event_type AS tool_name, count(*) AS n_tasks FROM events GROUP BY event_type) t"""

# one schema for each family of rule keywords, by number, and a call for each event against one of them
_NEW = '"$schema":"https://json-schema.org/draft/2020-12/schema"'
KEYWORD_SCHEMAS = [
    '{"patternProperties":{"^x_":{"type":"integer"},"_y$":{"maxLength":5}},"additionalProperties":{"type":"string"}}',
    '{"propertyNames":{"maxLength":5,"pattern":"^[a-t]"}}',
    '{"dependencies":{"kind":["k"],"k":{"required":["cents"]}}}',
    '{' + _NEW + ',"dependentRequired":{"kind":["k","cents"]},"dependentSchemas":{"k":{"properties":{"cents":{"minimum":10000}}}}}',
    '{' + _NEW + ',"properties":{"t":{"prefixItems":[{"type":"integer"},{"enum":["click","view"]}],"items":{"minimum":500}}}}',
    '{"properties":{"t":{"items":[{"type":"integer"},{"type":"string"}],"additionalItems":false}}}',
    '{' + _NEW + ',"properties":{"t":{"contains":{"const":1},"minContains":2,"maxContains":2}}}',
    '{"properties":{"t":{"contains":{"maximum":300}}}}',
    '{' + _NEW + ',"properties":{"kind":{}},"allOf":[{"$ref":"#/$defs/base"}],"if":{"properties":{"kind":{"const":"click"}},"required":["kind"]},'
    '"then":{"properties":{"k":{}}},"anyOf":[{"properties":{"cents":{"minimum":10000}},"required":["cents"]},true],"unevaluatedProperties":false,'
    '"$defs":{"base":{"properties":{"tags":{}}}}}',
    '{' + _NEW + ',"properties":{"t":{"prefixItems":[{}],"contains":{"type":"string"},"unevaluatedItems":{"maximum":500}}}}',
    '{"$ref":"#/definitions/node","definitions":{"node":{"type":"object","properties":{"next":{"$ref":"#/definitions/node"},"v":{"maximum":500}},"required":["v"]}}}',
    '{"properties":{"ghost":false,"kind":{"not":{"enum":["view"]}},"k":{"oneOf":[{"maximum":300},{"minimum":200}]}}}',
]
FX["fx_keyword_schemas"] = ("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b}')" for i, b in enumerate(KEYWORD_SCHEMAS)) + ") AS t(n, body)")

_S = lambda e: f"cast({e} AS string)"
_SOME = ("'{\"kind\":\"' || kind || '\"' || CASE WHEN k % 2 = 0 THEN ',\"k\":' || " + _S("k") + " ELSE '' END"
         " || CASE WHEN k % 3 = 0 THEN ',\"cents\":' || " + _S("cents") + " ELSE '' END || '}'")
FX["fx_keyword_calls"] = f"""
SELECT task_id, kind, k, cents, task_id % 12 AS n, CASE task_id % 12
    WHEN 0 THEN '{{"x_a":' || CASE WHEN k % 2 = 0 THEN {_S('k')} ELSE '"k"' END || ',"kind_y":"' || kind || '","other":' || CASE WHEN k % 3 = 0 THEN '1' ELSE '"s"' END || '}}'
    WHEN 1 THEN '{{"' || kind || '":1,"k":2}}'
    WHEN 2 THEN {_SOME}
    WHEN 3 THEN {_SOME}
    WHEN 4 THEN '{{"t":[' || CASE WHEN k % 5 = 0 THEN '"k"' ELSE {_S('k')} END || ',"' || kind || '",' || {_S('k')} || ']}}'
    WHEN 5 THEN '{{"t":[' || {_S('k')} || ',"s"' || CASE WHEN k % 2 = 0 THEN ',1' ELSE '' END || ']}}'
    WHEN 6 THEN '{{"t":[' || {_S('k % 2')} || ',' || {_S('abs(cents) % 2')} || ',1,' || CASE WHEN k % 3 = 1 THEN '1' ELSE '0' END || ']}}'
    WHEN 7 THEN '{{"t":[' || {_S('k')} || ',' || {_S('k + 100')} || ']}}'
    WHEN 8 THEN '{{"kind":"' || kind || '","tags":[]' || CASE WHEN k % 2 = 0 THEN ',"k":1' ELSE '' END || ',"cents":' || {_S('cents')} || '}}'
    WHEN 9 THEN '{{"t":[9999,"s",' || {_S('k')} || ']}}'
    WHEN 10 THEN '{{"v":' || {_S('k')} || ',"next":{{"v":' || {_S('k + 100')} || ',"next":{{"' || CASE WHEN k % 2 = 0 THEN 'v' ELSE 'w' END || '":' || {_S('k + 200')} || '}}}}}}'
    ELSE '{{"kind":"' || kind || '","k":' || {_S('k')} || CASE WHEN k % 2 = 0 THEN ',"ghost":1' ELSE '' END || '}}' END AS args
FROM fx_tasks"""

FX["fx_conf"] = """
SELECT request_key, arm, ((task_id * 37 + arm_no * 11 + size) % 1000) / 1000.0 AS p,
       CASE WHEN e2e_success THEN 1 ELSE 0 END AS y, task_id * 100 + arm_no * 50 + size AS seq,
       task_id % 7 AS z0, (task_id * 3 + arm_no) % 7 AS z1, (task_id * 5 + size) % 7 AS z2, (task_id + size) % 3 AS gold
FROM fx_expected"""

# ------------------------------------------------------------------ schema corpus from part
def words_sql() -> str:
    return ",".join(WORDS)


def _word(i: str) -> str:
    return f"split_part('{','.join(WORDS)}', ',', cast(({i}) % 40 + 1 AS int))"


FX["fx_schema_key"] = f"""
SELECT p_partkey, subset, name, subset || '/' || name AS schema_id, eff, n_props, first_prop,
       CASE WHEN eff % 31 = 0 THEN 'missing' WHEN eff % 29 = 0 THEN 'cyclic' WHEN eff % 7 = 0 THEN 'ref'
            WHEN eff % 11 = 0 THEN 'nested' WHEN eff % 13 = 0 THEN 'objects' WHEN eff % 17 = 0 THEN 'tuple'
            WHEN eff % 5 = 0 THEN 'enum'
            ELSE 'plain' END AS shape,
       eff % 37 = 0 AS unsat, eff % 43 = 0 AS bad_required, eff % 47 = 0 AS bad_root
FROM (SELECT *, {_word('eff * 7')} AS first_prop, 1 + eff % 17 AS n_props,
             'fn' || cast(eff % 500 AS string) || '_' || substr(md5(cast(p_partkey AS string)), 1, 8) AS name
      FROM (SELECT p_partkey, p_brand AS subset,
                   CASE WHEN p_partkey % 41 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS eff
            FROM part) x) y"""

_FIRST = """CASE shape WHEN 'missing' THEN '{"$ref":"#/definitions/nope"}' WHEN 'cyclic' THEN '{"$ref":"#/definitions/c"}'
    WHEN 'ref' THEN '{"$ref":"#/definitions/d"}'
    WHEN 'nested' THEN '{"type":"object","properties":{"inner":{"type":"integer"}}}'
    WHEN 'objects' THEN '{"type":"array","items":{"type":"object","properties":{"leaf":{"type":"string"}}}}'
    WHEN 'tuple' THEN '{"type":"array","items":[{"type":"string"},{"type":"integer"}]}'
    WHEN 'enum' THEN '{"type":"string","enum":["a","b"]}' ELSE '{"type":"string"}' END"""
_REST = " || ".join(
    f"CASE WHEN n_props > {i} THEN ',\"' || {_word(f'eff * 7 + {3 * i}')} || '\":{{\"type\":\"string\",\"minLength\":1}}' ELSE '' END"
    for i in range(1, 17))

FX["fx_schemas"] = f"""
SELECT p_partkey, subset, name, schema_id, eff, n_props, first_prop, shape, unsat, bad_required, bad_root,
       '{{"description":"Handles item ' || cast(eff AS string) || '","type":"' || CASE WHEN bad_root THEN 'array' ELSE 'object' END ||
       '","properties":{{"' || first_prop || '":' || {_FIRST} || {_REST} || '}},"required":' ||
       CASE WHEN bad_required THEN '"bad"' ELSE '["' || first_prop || '"]' END ||
       CASE WHEN unsat THEN ',"oneOf":[{{"required":["' || first_prop || '"]}},{{"required":["' || first_prop || '"]}}]' ELSE '' END ||
       CASE shape WHEN 'cyclic' THEN ',"definitions":{{"c":{{"type":"object","properties":{{"next":{{"$ref":"#/definitions/c"}}}}}}}}'
                  WHEN 'ref' THEN ',"definitions":{{"d":{{"type":"string","description":"shared d"}}}}' ELSE '' END || '}}' AS body
FROM fx_schema_key"""

FX["fx_schema_reasons"] = """
SELECT *, (CASE WHEN subset IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'subset_excluded;' ELSE '' END) ||
          (CASE WHEN bad_root THEN 'root_not_object_with_properties;'
                WHEN n_props > 15 THEN 'top_level_property_count_out_of_range;' ELSE '' END) ||
          (CASE WHEN shape = 'cyclic' THEN 'cyclic_ref;' ELSE '' END) ||
          (CASE WHEN shape = 'missing' THEN 'nonlocal_or_unresolvable_ref;' ELSE '' END) ||
          (CASE WHEN bad_required THEN 'rules_violated;' ELSE '' END) ||
          (CASE WHEN unsat AND NOT bad_required THEN 'known_unsatisfiable_pattern;' ELSE '' END) AS reasons,
       CASE WHEN shape IN ('missing', 'cyclic', 'ref', 'nested', 'objects', 'tuple') THEN 'structured' ELSE 'flat' END AS stratum
FROM fx_schema_key"""

FX["fx_pool"] = """
SELECT schema_id, subset, stratum, 'tool_' || cast(p_partkey AS string) AS tool_id,
       'do_' || first_prop || '_' || cast(p_partkey AS string) AS tool_name, first_prop, n_props, shape,
       'f' || cast(p_partkey % 97 AS string) AS family, p_partkey % 10 <> 0 AS task_suitable, p_partkey
FROM (SELECT *, row_number() OVER (PARTITION BY eff ORDER BY schema_id) AS copy_no
      FROM fx_schema_reasons WHERE reasons = '') q WHERE copy_no = 1"""

# ------------------------------------------------------------------ ledgers, patches, telemetry
FX["fx_ledger"] = """
SELECT event_id AS seq, CASE WHEN event_type IN ('error', 'signup') THEN 'readiness' ELSE 'benchmark' END AS category,
       cast(user_id AS string) || ':' || regexp_extract(props, '([0-9]+)', 1) AS key
FROM events"""

FX["fx_telemetry"] = """
SELECT user_id, event_id, ts, cast(round(value * 100) AS bigint) AS cents,
       1 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS pressure
FROM events"""

# a monitor's event log with stops that may be resumed and final ones
FX["fx_event_log"] = """
SELECT user_id, event_id, ts AS happened,
       CASE WHEN event_type IN ('error', 'view') THEN 'pause' WHEN event_type = 'click' THEN 'continue' WHEN event_type = 'signup' THEN 'stop' ELSE 'resume' END AS event,
       event_id % 23 <> 0 AS resumable
FROM events"""

DEPENDS = {"fx_task_rows": ["fx_tasks"], "fx_keyword_calls": ["fx_tasks"], "fx_hostile": ["fx_tasks"], "fx_results_key": ["fx_tasks"], "fx_results": ["fx_results_key"],
           "fx_expected": ["fx_results_key"], "fx_conf": ["fx_expected"], "fx_schemas": ["fx_schema_key"],
           "fx_schema_reasons": ["fx_schema_key"], "fx_pool": ["fx_schema_reasons"]}


def chain(*names: str) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in chain(*DEPENDS.get(n, [])) + [n]:
            if d not in out:
                out.append(d)
    return out


def _each(sql: str, form: str) -> str:
    """Spell the row generator ``$each(a, b)`` for one engine."""
    return re.sub(r"\$each\(([^)]*)\)", lambda m: form.format(m.group(1)), sql)


def prelude(*names: str) -> str:
    """CTE list that defines the named derived tables over the base views."""
    return _each("WITH " + ",\n".join(f"{n} AS ({FX[n]})" for n in chain(*names)), "unnest([{}])")


def with_fx(names: str, sql: str) -> str:
    """A check query: derived tables first, then ``sql`` (which may open more CTEs with a leading comma)."""
    text = prelude(*names.split())
    return f"{text}{sql}" if sql.lstrip().startswith(",") else f"{text}\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as one lazy plan over the given parquet files."""
    names = chain(name)
    used = [b for b in BASE if any(f"FROM {b}" in FX[n] for n in names)]
    ctes = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in used]
    ctes += [f"{n} AS ({FX[n]})" for n in names]
    return spark.sql(_each("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}", "explode(array({}))"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a tiny single-split input over the cores; inputs with enough splits pass through."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
