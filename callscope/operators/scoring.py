"""Scoring of stored model outputs against gold arguments and schema rules.

The fact table is joined once with tasks, catalogs and rule rows; every later step is a
projection over node arrays inside the row, so the job has no shuffle of its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.jsontext import salvage_json
from callscope.functions.jsontree import ARR, OBJ, SEP, leaves_of, once, strict_variant, tree_nodes
from callscope.functions.text import NUMERIC_TEXT, clean_sql, norm_sql
from callscope.operators.lookup import dealt_lookup
from callscope.operators.schemarules import rule_errors_sql

# fixed values: accepted member names of a call, by priority
TOOL_KEYS = ("tool", "name", "function", "tool_name")
ARG_KEYS = ("arguments", "args", "parameters", "input")

# fixed values: validator keyword -> failure label, everything else is an ignored constraint
ERROR_LABELS = (("required", "missing required argument"), ("type", "invalid argument type"),
                ("enum", "invalid enum/value"), ("const", "invalid enum/value"),
                ("additionalProperties", "hallucinated field"))
LABEL_ORDER = ("missing required argument", "invalid argument type", "invalid enum/value", "hallucinated field",
               "ignored schema constraint")

NODE = ("array<struct<path:string,pos:string,ptr:string,key:string,pkey:string,lvl:int,kind:string,"
        "keys:array<string>,n:int,txt:string,num:double,json:string>>")


# ---------------------------------------------------------------- parsing
def strict_json(df: DataFrame, col: str, out: str = "strict") -> DataFrame:
    """VARIANT of a single clean document: no duplicate keys, wrappers, NaN or overflow to infinity."""
    bare = f"regexp_replace(regexp_replace({col}, '(?s)\\\\\\\\.', ''), '\"[^\"]*\"', '')"
    # only a long exponent or digit run can overflow; strings are taken out before the numerals are read
    huge = (f"({col} RLIKE '[eE][+]?[0-9]{{3}}|[0-9]{{309}}' AND exists(regexp_extract_all({bare}, "
            f"'-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?', 0), x -> abs(cast(x as double)) = double('Infinity')))")
    return df.withColumn(out, once(f"CASE WHEN NOT coalesce({huge}, false) THEN {strict_variant(col)} END"))


def extract_json(df: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Lenient extraction: whole text, else the first readable balanced object.

    Adds call (VARIANT object or NULL), json_valid, json_strict, n_json_objects, multiple_calls.
    The Arrow salvage sees a value only where the JVM parser refused the whole text.
    """
    df = df.withColumn("_body", once(clean_sql(raw)))
    df = df.withColumn("_fast", once(strict_variant("_body")))
    df = df.withColumn("_slow", salvage_json(F.expr("CASE WHEN _fast IS NULL THEN _body END")))
    df = df.withColumn("_doc", F.expr("coalesce(_fast, try_parse_json(_slow.body))"))
    df = df.withColumn("_list", F.expr(f"try_cast(_doc as {ARR})"))
    return (df
            .withColumn("call", once(f"""CASE
                WHEN _list IS NOT NULL THEN CASE WHEN try_cast(try_element_at(_list, 1) as {OBJ}) IS NOT NULL
                                                 THEN try_element_at(_list, 1) END
                WHEN try_cast(_doc as {OBJ}) IS NOT NULL THEN _doc END"""))
            .withColumn("json_strict", F.expr("_fast IS NOT NULL OR coalesce(_slow.strict, false)"))
            .withColumn("json_valid", F.expr("call IS NOT NULL"))
            .withColumn("n_json_objects", F.expr(
                "greatest(coalesce(_slow.found, 0), if(call IS NOT NULL, 1, 0))"))
            .withColumn("multiple_calls", F.expr(
                "CASE WHEN _list IS NOT NULL THEN cardinality(_list) > 1 ELSE coalesce(_slow.found, 0) > 1 END"))
            .drop("_body", "_fast", "_slow", "_doc", "_list"))


def project_call(df: DataFrame) -> DataFrame:
    """Call projection with aliases: adds pred_tool, args, format_ok, format_alias_used."""
    pick = lambda keys: "CASE " + " ".join(
        f"WHEN try_variant_get(call, '$.{k}', 'variant') IS NOT NULL THEN '{k}'" for k in keys) + " END"
    value = lambda keys: "coalesce(" + ", ".join(
        f"try_variant_get(call, '$.{k}', 'variant')" for k in keys) + ")"
    df = (df.withColumn("_tk", F.expr(pick(TOOL_KEYS))).withColumn("_ak", F.expr(pick(ARG_KEYS)))
          .withColumn("_tv", F.expr(value(TOOL_KEYS))))
    df = df.withColumn("_nested", F.expr("try_variant_get(_tv, '$.name', 'variant') IS NOT NULL"))
    df = df.withColumn("_name", F.expr("CASE WHEN _nested THEN try_variant_get(_tv, '$.name', 'variant') ELSE _tv END"))
    df = df.withColumn("_args", F.expr(f"""CASE WHEN _nested THEN
        coalesce(try_variant_get(_tv, '$.arguments', 'variant'), try_variant_get(_tv, '$.parameters', 'variant'))
        ELSE {value(ARG_KEYS)} END"""))
    df = df.withColumn("arguments_was_string", F.expr(
        "coalesce(schema_of_variant(_args) = 'STRING' AND "
        f"{strict_variant('cast(_args as string)')} IS NOT NULL, false)"))
    df = df.withColumn("args", once(
        f"CASE WHEN arguments_was_string THEN {strict_variant('cast(_args as string)')} ELSE _args END"))
    return (df
            .withColumn("pred_tool", F.expr("CASE WHEN schema_of_variant(_name) = 'STRING' THEN cast(_name as string) END"))
            .withColumn("format_alias_used", F.expr(
                "call IS NOT NULL AND (_nested OR coalesce(_tk <> 'tool', false) OR coalesce(_ak <> 'arguments', false))"))
            .withColumn("format_ok", F.expr(f"pred_tool IS NOT NULL AND try_cast(args as {OBJ}) IS NOT NULL"))
            .drop("_tk", "_ak", "_tv", "_nested", "_name", "_args"))


# ---------------------------------------------------------------- value comparison
def exact_sql(p: str, g: str) -> str:
    return f"""(CASE WHEN {p}.kind = 'BOO' OR {g}.kind = 'BOO' THEN {p}.kind = {g}.kind AND {p}.txt = {g}.txt
        WHEN {p}.num IS NOT NULL AND {g}.num IS NOT NULL THEN {p}.num = {g}.num
        WHEN {p}.kind <> {g}.kind THEN false
        WHEN {p}.kind = 'STR' THEN {p}.txt = {g}.txt
        WHEN {p}.kind = 'VOI' THEN true
        ELSE coalesce({p}.json = {g}.json, false) END)"""


def semantic_sql(p: str, g: str) -> str:
    scalar = "('STR', 'BIG', 'DEC', 'DOU', 'BOO')"
    as_num = lambda x: f"CASE WHEN {x}.txt RLIKE '{NUMERIC_TEXT}' THEN try_cast({x}.txt as double) END"
    same_text = f"{norm_sql(p + '.txt')} = {norm_sql(g + '.txt')}"
    return f"""(CASE WHEN {exact_sql(p, g)} THEN true
        WHEN {p}.kind = 'STR' AND {g}.kind = 'STR' THEN {same_text}
        WHEN {p}.kind IN {scalar} AND {g}.kind IN {scalar} THEN
          coalesce(({as_num(p)}) = ({as_num(g)}), {same_text})
        ELSE false END)"""


def scalar_exact(p: str, g: str) -> Column:
    """Equality of two node structs (kind, txt, num, json)."""
    return F.expr(exact_sql(p, g))


def scalar_semantic(p: str, g: str) -> Column:
    return F.expr(semantic_sql(p, g))


def align_sql(pred: str, gold: str, paths: str) -> str:
    """SQL: predicted nodes with arrays at unordered paths reordered greedily towards gold."""
    leaf = leaves_of(gold)
    rest = lambda n: f"substr({n}.path, char_length(q) + 1)"
    slot = lambda n: f"cast(regexp_extract({rest(n)}, '^\\\\[([0-9]+)\\\\]', 1) as int)"
    tail = lambda n: f"regexp_replace({rest(n)}, '^\\\\[[0-9]+\\\\]', '')"
    inside = lambda n: f"(startswith({n}.path, concat(q, '[')))"
    points = (f"size(filter(want, l -> {slot('l')} = i AND exists(have, h -> h.path = concat(q, '[', j, ']', {tail('l')}) "
              f"AND {semantic_sql('h', 'l')})))")
    greedy = f"""aggregate(sequence(0, least(gn, pn) - 1),
        named_struct('left', cast(sequence(0, pn - 1) as array<int>), 'done', cast(array() as array<int>)),
        (s, i) -> transform(array(-(array_max(transform(s.left, j -> named_struct('w', {points}, 'm', -j))).m)), b ->
            named_struct('left', cast(array_except(s.left, array(b)) as array<int>),
                         'done', cast(concat(s.done, array(b)) as array<int>)))[0],
        s -> concat(s.done, s.left))"""
    moved = f"""transform(have, h -> named_struct(
        'path', CASE WHEN {inside('h')} THEN concat(q, '[', array_position(o, {slot('h')}) - 1, ']', {tail('h')})
                     ELSE h.path END,
        'pos', h.pos, 'ptr', h.ptr, 'key', h.key, 'pkey', h.pkey, 'lvl', h.lvl, 'kind', h.kind, 'keys', h.keys, 'n', h.n,
        'txt', h.txt, 'num', h.num, 'json', h.json))"""
    at = lambda nodes: f"get(filter({nodes}, h -> h.path = q AND h.kind = 'ARR'), 0)"
    size_at = lambda nodes: f"coalesce(get(filter({nodes}, h -> h.path = q AND h.kind = 'ARR'), 0).n, 0)"
    return f"""aggregate(coalesce({paths}, cast(array() as array<string>)), cast({pred} as {NODE}), (have, q) ->
        CASE WHEN {size_at('have')} < 2 OR {size_at(gold)} < 1 OR {at('have')}.json = {at(gold)}.json THEN have ELSE
          transform(array(named_struct('pn', {size_at('have')}, 'gn', {size_at(gold)},
                                       'want', filter({leaf}, l -> {inside('l')}))), z ->
            transform(array({greedy.replace('gn', 'z.gn').replace('pn', 'z.pn').replace('want', 'z.want')}), o ->
              cast({moved} as {NODE}))[0])[0] END)"""


def compare_fields(df: DataFrame) -> DataFrame:
    """Per-field comparison of args_nodes with gold_nodes; adds fields and the derived outcomes."""
    # of equal trees every field is met by itself; a name that looks like a path could stand for another field
    df = df.withColumn("_same", once("coalesce(arg_nodes = gold_nodes, false) AND NOT exists(gold_nodes, n -> coalesce(n.key = '' OR n.key RLIKE '[.\\\\[\\\\]]', false))"))
    df = df.withColumn("aligned", once(f"CASE WHEN arg_nodes IS NULL OR _same THEN cast(arg_nodes as {NODE}) ELSE {align_sql('arg_nodes', 'gold_nodes', 'unordered_paths')} END"))
    df = df.withColumn("_gl", once(leaves_of("gold_nodes")))
    known = lambda yes, scalar: f"transform(_gl, g -> named_struct('path', g.path, 'present', {yes}, 'semantic', {yes}, 'exact', {yes}, 'scalar_ok', {scalar}))"
    alt = "concat(array(named_struct('kind', g.kind, 'txt', g.txt, 'num', g.num, 'json', g.json)), " \
          "coalesce(variants[g.path], cast(array() as array<struct<kind:string,txt:string,num:double,json:string>>)))"
    found = "filter(aligned, n -> n.path = g.path AND (n.key IS NULL OR NOT n.key RLIKE '[.\\\\[\\\\]]'))"
    verdict = f"""transform({alt}, a -> named_struct('list', a.kind = 'ARR',
        'same', p.kind = 'ARR' AND a.kind = 'ARR' AND p.json = a.json,
        'sem', a.kind <> 'ARR' AND {semantic_sql('p', 'a')}, 'exact', a.kind <> 'ARR' AND {exact_sql('p', 'a')}))"""
    df = df.withColumn("fields", once(f"""CASE WHEN _same THEN {known('true', "g.kind <> 'ARR'")} WHEN aligned IS NULL THEN {known('false', 'false')}
        ELSE transform(_gl, g -> transform(array(get({found}, 0)), p ->
        transform(array(CASE WHEN p IS NOT NULL THEN {verdict} END), m -> named_struct(
          'path', g.path, 'present', p IS NOT NULL,
          'semantic', coalesce(exists(m, z -> z.sem OR z.same), false),
          'exact', coalesce(exists(m, z -> z.exact OR z.same), false),
          'scalar_ok', coalesce(exists(m, z -> z.sem), false)))[0])[0]) END"""))
    df = df.withColumn("extra_paths", once(f"""CASE WHEN _same THEN cast(array() as array<string>) ELSE array_sort(array_distinct(transform(filter({leaves_of('aligned')}, p -> NOT exists(_gl, g ->
        p.path = g.path OR startswith(p.path, concat(g.path, '[')) OR startswith(p.path, concat(g.path, '.')))), p -> p.path))) END"""))
    shape = lambda n: (f"array_sort(transform({n}, n -> concat(n.path, CASE n.kind WHEN 'OBJ' THEN "  # noqa: E731
                       f"concat(':O', to_json(n.keys)) WHEN 'ARR' THEN concat(':A', n.n) ELSE ':S' END)))")
    df = df.withColumn("unrequested", F.expr(
        f"CASE WHEN size(extra_paths) = 0 THEN extra_paths ELSE transform(filter({leaves_of('aligned')}, p -> array_contains(extra_paths, p.path) "
        f"AND p.kind NOT IN ('VOI', 'ARR') AND p.txt <> ''), p -> p.path) END"))
    return (df
            .withColumn("field_acc", F.expr("CASE WHEN size(fields) = 0 THEN 1.0D ELSE size(filter(fields, f -> f.semantic)) / cast(size(fields) as double) END"))
            .withColumn("field_exact_acc", F.expr("CASE WHEN size(fields) = 0 THEN 1.0D ELSE size(filter(fields, f -> f.exact)) / cast(size(fields) as double) END"))
            .withColumn("semantic_correct", F.expr("forall(fields, f -> f.semantic)"))
            .withColumn("arg_exact_match", F.expr(
                f"_same OR (forall(fields, f -> f.exact) AND size(extra_paths) = 0 AND {shape('aligned')} = {shape('gold_nodes')})"))
            .drop("_gl", "_same"))


def receipt_check(df: DataFrame) -> DataFrame:
    """Hash of gold values with accepted predictions mapped onto them, against the gold hash.

    A list-valued alternative never maps; the receipt keeps what was sent there.
    """
    line = lambda v: f"array_join(array_sort({v}), '\\u0002')"
    gold = f"{leaves_of('gold_nodes')}"
    value = lambda n: f"CASE WHEN {n}.num IS NOT NULL THEN cast({n}.num as string) WHEN {n}.kind = 'STR' THEN concat('s', {norm_sql(n + '.txt')}) ELSE coalesce({n}.json, {n}.txt, 'null') END"
    sent = f"""transform({gold}, g -> transform(array(get(filter(fields, f -> f.path = g.path), 0)), f -> concat(g.path, '=',
        CASE WHEN NOT f.present THEN 's__missing__' WHEN f.scalar_ok THEN {value('g')}
             ELSE {value("get(filter(aligned, n -> n.path = g.path), 0)")} END))[0])"""
    want = f"transform({gold}, g -> concat(g.path, '=', {value('g')}))"
    # where every field is met by an accepted value, the gold value stands in both; equal lines have equal hashes
    return (df.withColumn("receipt", F.expr(f"sha2({line(sent)}, 256)"))
            .withColumn("expected_receipt", F.expr(f"sha2({line(want)}, 256)"))
            .withColumn("receipt_ok", F.expr(f"CASE WHEN forall(fields, f -> f.scalar_ok) THEN true ELSE {line(sent)} = {line(want)} END")))


# ---------------------------------------------------------------- classes
def classify_failure(df: DataFrame) -> DataFrame:
    """Primary failure label and ordered secondary labels."""
    label = "CASE e.validator " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ERROR_LABELS) + \
            " ELSE 'ignored schema constraint' END"
    order = ", ".join(f"'{x}'" for x in LABEL_ORDER)
    df = df.withColumn("_cats", F.expr(
        f"filter(array({order}), c -> exists(schema_errors, e -> {label} = c))"))
    df = df.withColumn("_wrong", F.expr("NOT semantic_correct"))
    multi = "CASE WHEN multiple_calls THEN array('multiple-tool confusion') ELSE cast(array() as array<string>) END"
    return (df
            .withColumn("failure_primary", F.expr("""CASE
                WHEN unknown_task THEN 'unknown task'
                WHEN context_error THEN 'context-length failure'
                WHEN NOT json_valid OR NOT format_ok THEN 'malformed output'
                WHEN NOT tool_correct THEN CASE WHEN multiple_calls THEN 'multiple-tool confusion' ELSE 'wrong tool' END
                WHEN size(_cats) > 0 THEN _cats[0]
                WHEN _wrong THEN 'correct tool, wrong argument'
                WHEN execution_status <> 'ok' THEN 'execution failure'
                WHEN NOT receipt_ok THEN 'semantic/task failure' END"""))
            .withColumn("failure_secondary", F.expr(f"""CASE
                WHEN context_error OR NOT json_valid OR NOT format_ok OR NOT tool_correct THEN cast(array() as array<string>)
                ELSE concat({multi},
                  CASE WHEN size(hallucinated_keys) > 0 AND NOT array_contains(_cats, 'hallucinated field')
                       THEN array('hallucinated field') ELSE cast(array() as array<string>) END,
                  CASE WHEN size(_cats) > 1 THEN slice(_cats, 2, size(_cats) - 1) ELSE cast(array() as array<string>) END,
                  CASE WHEN _wrong AND size(_cats) > 0 THEN array('correct tool, wrong argument')
                       ELSE cast(array() as array<string>) END) END"""))
            .drop("_cats", "_wrong"))


def ceiling_class() -> Column:
    return F.expr("""CASE WHEN e2e_success THEN 'success' WHEN NOT json_valid OR NOT format_ok THEN 'malformed'
        WHEN NOT tool_correct THEN 'wrong_tool'
        WHEN NOT schema_valid THEN CASE WHEN semantic_correct THEN 'invalid_only' ELSE 'invalid_wrong' END
        ELSE 'valid_wrong' END""")


def failure_class() -> Column:
    """First present flag wins; columns engine_refusal, cd_truncated, invalid, wrong_tool, lookalike_key, e2e_success."""
    return F.expr("""CASE WHEN engine_refusal THEN 'engine_refusal' WHEN cd_truncated THEN 'cd_truncated'
        WHEN invalid THEN 'invalid' WHEN wrong_tool THEN 'wrong_tool' WHEN lookalike_key THEN 'lookalike_key'
        WHEN NOT e2e_success THEN 'valid_wrong_value' ELSE 'correct' END""")


def error_kind(status: str = "http_status", code: str = "error_code", message: str = "error_message",
               decoding: str = "decoding") -> Column:
    """Request errors kept apart from model failures."""
    # fixed values: codes and phrases of context and constraint refusals
    ctx = ("context (?:length|window|size)?\\\\s*(?:too (?:large|long)|exceeded|exceeds)"
           "|exceeds? (?:the )?(?:available )?context (?:size|length|window)")
    eng = ("(?:grammar|schema|constraint) (?:refused|rejected|unsupported|invalid)"
           "|(?:invalid|unsupported|failed to (?:parse|compile)) (?:json )?(?:schema|grammar)"
           "|(?:parse|compile) (?:error|failure).*?(?:schema|grammar)")
    return F.expr(f"""CASE WHEN {status} = 200 THEN NULL
        WHEN {status} IN (400, 413) AND (coalesce({code}, '') IN ('context_length_exceeded', 'exceed_context_size_error')
             OR lower(coalesce({message}, '')) RLIKE '{ctx}') THEN 'context_error'
        WHEN {status} IN (400, 422) AND {decoding} = 'constrained'
             AND (coalesce({code}, '') IN ('invalid_json_schema', 'invalid_grammar', 'unsupported_json_schema')
             OR lower(coalesce({message}, '')) RLIKE '{eng}') THEN 'engine_error'
        WHEN {status} = 0 THEN 'transport_error' ELSE 'http_error' END""")


def apply_faults(scored: DataFrame) -> DataFrame:
    """A request or engine fault forces failure; the evaluator's verdict stays in raw_evaluator_e2e."""
    return (scored.withColumn("raw_evaluator_e2e", F.col("e2e_success"))
            .withColumn("engine_error", F.expr("http_status <> 200 OR coalesce(request_error, '') <> ''"))
            .withColumn("e2e_success", F.expr("e2e_success AND NOT engine_error"))
            .withColumn("e2e_strict", F.expr("e2e_strict AND NOT engine_error")))


# ---------------------------------------------------------------- whole jobs
def parse_outputs(results: DataFrame, raw: str = "raw_content") -> DataFrame:
    """extract_json + project_call + argument node arrays (arg_nodes)."""
    df = project_call(extract_json(results, raw))
    return df.withColumn("arg_nodes", once(f"CASE WHEN format_ok THEN {tree_nodes('args')} END"))


def prepare_tasks(tasks: DataFrame, gold: str = "gold_args", variants: str | None = "acceptable_variants") -> DataFrame:
    """Add gold_nodes and variants (path -> comparable values) to the task table, once per task."""
    item = ("named_struct('kind', left(schema_of_variant(e), 3), 'txt', cast(e as string), 'num', "
            "CASE WHEN left(schema_of_variant(e), 3) IN ('BIG', 'DEC', 'DOU') THEN try_cast(e as double) END, "
            "'json', CASE WHEN left(schema_of_variant(e), 3) IN ('OBJ', 'ARR') THEN to_json(e) END)")
    source = f"try_cast(try_parse_json({variants}) as map<string,array<variant>>)" if variants else \
        "cast(null as map<string,array<variant>>)"
    return (tasks.withColumn("_g", F.expr(f"try_parse_json({gold})"))
            .withColumn("gold_nodes", once(tree_nodes("_g")))
            .withColumn("variants", F.expr(f"transform_values({source}, (k, v) -> transform(v, e -> {item}))"))
            .drop("_g"))


def schema_errors(calls: DataFrame, rules: DataFrame, on: str = "tool_name") -> DataFrame:
    """Add schema_errors (validator, path) for arg_nodes, unchecked keywords from the rule row."""
    return _with_errors(dealt_lookup(calls, rules, on))


def _with_errors(calls: DataFrame) -> DataFrame:
    return (calls
            .withColumn("schema_errors", once(f"CASE WHEN arg_nodes IS NOT NULL THEN {rule_errors_sql()} END")))


def score(results: DataFrame, tasks: DataFrame, rules: DataFrame, catalogs: DataFrame,
          properties: DataFrame, fault_free: bool = True) -> DataFrame:
    """Full evaluation of results.

    results: request_key, task_id, catalog_key, raw_content (+ any columns); tasks: task_id, tool_name,
    gold_nodes, variants, unordered_paths; rules: tool_name, rules; catalogs: catalog_key,
    catalog_tools; properties: tool_name, known_names.

    Every row of results comes out. A task that isn't known (``unknown_task``) is labelled so and succeeds in nothing; a
    tool without a rule row (``no_rules``) is never valid.
    """
    # merged: gold nodes are many times the bytes that their tasks take in a file
    df = dealt_lookup(results, catalogs, "catalog_key").join(tasks.hint("merge"), "task_id", "left")
    if "context_error" not in df.columns:
        df = df.withColumn("context_error", F.lit(False))
    # a refused request has no output: its text is empty, whatever the log holds
    df = df.withColumn("_said", F.expr("CASE WHEN coalesce(context_error, false) THEN '' ELSE coalesce(raw_content, '') END"))
    df = project_call(extract_json(df, "_said")).drop("_said")
    df = df.withColumn("unknown_task", F.expr("tool_name IS NULL"))
    df = df.withColumn("tool_correct", once("coalesce(format_ok AND pred_tool = tool_name AND NOT context_error, false)"))
    # only calls of the right tool have a tree; arguments of one text with the gold ones have theirs
    df = df.withColumn("arg_nodes", once(f"CASE WHEN NOT tool_correct THEN NULL WHEN to_json(args) = gold_nodes[0].json THEN gold_nodes ELSE {tree_nodes('args')} END"))
    # what is known of a tool comes in one join
    df = receipt_check(compare_fields(_with_errors(dealt_lookup(df, rules.join(properties, "tool_name", "full"), "tool_name"))))
    df = (df
          .withColumn("no_rules", F.expr("rules IS NULL"))
          .withColumn("schema_errors", F.expr("coalesce(schema_errors, cast(array() as array<struct<validator:string,path:string>>))"))
          .withColumn("schema_valid", F.expr("tool_correct AND NOT no_rules AND size(schema_errors) = 0"))
          .withColumn("semantic_correct", F.expr("tool_correct AND coalesce(semantic_correct, false)"))
          .withColumn("arg_exact_match", F.expr("tool_correct AND coalesce(arg_exact_match, false)"))
          .withColumn("field_acc", F.expr("if(tool_correct, field_acc, 0.0D)"))
          .withColumn("field_exact_acc", F.expr("if(tool_correct, field_exact_acc, 0.0D)"))
          .withColumn("receipt_ok", F.expr("tool_correct AND coalesce(receipt_ok, false)"))
          .withColumn("pred_tool_in_catalog", F.expr("coalesce(array_contains(catalog_tools, pred_tool), false)"))
          .withColumn("hallucinated_keys", F.expr(f"""CASE WHEN tool_correct THEN array_sort(array_except(array_distinct(
              transform({leaves_of('arg_nodes')}, n -> substring_index(substring_index(n.path, '.', -1), '[', 1))),
              concat(coalesce(known_names, cast(array() as array<string>)), array('')))) ELSE cast(array() as array<string>) END"""))
          .withColumn("execution_status", F.expr("""CASE WHEN NOT format_ok THEN 'not_executed'
              WHEN NOT pred_tool_in_catalog THEN 'error' WHEN NOT tool_correct THEN 'wrong_tool_executed'
              WHEN NOT schema_valid THEN 'error' ELSE 'ok' END"""))
          .withColumn("execution_success", F.expr("execution_status = 'ok'"))
          .withColumn("e2e_success", F.expr("schema_valid AND execution_success AND receipt_ok"))
          .withColumn("unrequested", F.expr("CASE WHEN tool_correct THEN unrequested ELSE cast(array() as array<string>) END"))
          .withColumn("e2e_strict", F.expr("e2e_success AND size(unrequested) = 0")))
    return classify_failure(df)


def route(outputs: DataFrame, rules: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Strict routing decision. Reads the text, catalog_tools and truncated only: no gold column."""
    df = strict_json(outputs, raw, "_c")
    df = (df.withColumn("_keys", F.expr(f"array_sort(map_keys(try_cast(_c as {OBJ})))"))
          .withColumn("_shape", F.expr("_keys = array('arguments', 'tool') AND "
                                       "schema_of_variant(try_variant_get(_c, '$.tool', 'variant')) = 'STRING'"))
          .withColumn("_tool", F.expr("CASE WHEN _shape THEN try_variant_get(_c, '$.tool', 'string') END"))
          .withColumn("_member", F.expr("coalesce(array_contains(catalog_tools, _tool), false)"))
          .withColumn("_a", once("CASE WHEN _member THEN try_variant_get(_c, '$.arguments', 'variant') END"))
          .withColumn("arg_nodes", once(f"CASE WHEN _a IS NOT NULL THEN {tree_nodes('_a')} END")))
    r = rules.select(F.col(rules.columns[0]).alias("_tool"), "rules")
    df = dealt_lookup(df, r, "_tool").withColumn("_errs", once(f"CASE WHEN rules IS NOT NULL THEN size({rule_errors_sql()}) END"))
    return (df.withColumn("route_reason", F.expr("""CASE WHEN truncated THEN 'truncated'
                WHEN _c IS NULL THEN 'strict_json' WHEN NOT coalesce(_shape, false) THEN 'envelope'
                WHEN NOT _member THEN 'tool_not_in_catalog' WHEN rules IS NULL THEN 'no_rules'
                WHEN _errs > 0 THEN 'raw_schema' WHEN _errs = 0 THEN 'valid' ELSE 'envelope' END"""))
            .withColumn("retry", F.expr("route_reason <> 'valid'"))
            .drop("_c", "_a", "_keys", "_shape", "_member", "_errs", "rules")
            .withColumnRenamed("_tool", "routed_tool"))


def rescore(old: DataFrame, new: DataFrame, key: str = "request_key", field: str = "e2e_success") -> DataFrame:
    """How many stored verdicts change under a recomputation."""
    j = old.select(key, F.col(field).alias("o")).join(new.select(key, F.col(field).alias("n")), key, "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("o").eqNullSafe(F.col("n"))).alias("changed"))
