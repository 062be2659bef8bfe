"""Scoring of the derived outputs; the checks use the closed form and never read the JSON."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.jsontree import leaf_table, with_nodes
from callscope.operators import scoring as sc
from callscope.operators.lookup import salted_join
from callscope.operators.schemarules import schema_rules
from callscope.plans.fixtures import fixture, spread, with_fx
from callscope.plans.flagship import catalogs, flagship, outputs, scored, tasks, tool_inputs
from callscope.plans.queries_stats import _plan_sql
from callscope.plans.registry import query, rounded


def fx(sql: str, names: str = "fx_expected") -> str:
    return with_fx(names, sql)


OUT = ("json_valid", "json_strict", "tool_correct", "schema_valid", "semantic_correct", "arg_exact_match", "field_acc",
       "field_exact_acc", "e2e_success", "e2e_strict", "failure_primary")


@query("score_outcomes", fx(f"""SELECT request_key, {', '.join(c + '::double AS ' + c if c.startswith('field_') else c for c in OUT)},
  failure_secondary FROM fx_expected"""))
def score_outcomes(spark, sf):
    return rounded(scored(spark, sf).withColumn("failure_secondary", F.concat_ws(",", "failure_secondary"))
                   .select("request_key", *OUT, "failure_secondary"))


@query("flagship_comparison", _plan_sql("""SELECT CASE seq WHEN 0 THEN 'min vs raw, end to end' WHEN 1 THEN 'min vs raw, tool choice'
    ELSE 'min vs raw, schema' END AS name, n_pairs, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b,
  round(100 * (acc_b - acc_a), 6) AS diff_pp, round(100 * ci_low, 6) AS ci_low, round(100 * ci_high, 6) AS ci_high,
  discordant_a_only, discordant_b_only, round(p, 6) AS mcnemar_p FROM w JOIN q_ci USING (name) WHERE seq < 3"""))
def flagship_comparison(spark, sf):
    return rounded(flagship(spark, sf).select("name", "n_pairs", "acc_a", "acc_b", "diff_pp", "ci_low", "ci_high",
                                              "discordant_a_only", "discordant_b_only", "mcnemar_p"))


@query("score_parse", fx("""SELECT request_key, json_valid, json_strict, json_valid AS format_ok, h = 9 AS format_alias_used,
  h = 8 AS arguments_was_string, json_valid::int AS n_json_objects, false AS multiple_calls,
  CASE WHEN NOT json_valid THEN NULL WHEN h <> 15 THEN tool_name WHEN task_id % 2 = 0 THEN 'ghost_tool'
       WHEN tool_name = 'view' THEN 'click' ELSE 'view' END AS pred_tool FROM fx_expected"""))
def score_parse(spark, sf):
    p = sc.project_call(sc.extract_json(outputs(spark, sf)))
    return p.select("request_key", "json_valid", "json_strict", "format_ok", "format_alias_used", "arguments_was_string",
                    "n_json_objects", "multiple_calls", "pred_tool")


@query("score_strict_json", fx("SELECT request_key, h NOT IN (7, 16, 17, 19) AS strict_ok FROM fx_expected"))
def score_strict_json(spark, sf):
    return sc.strict_json(outputs(spark, sf), "raw_content").selectExpr("request_key", "strict IS NOT NULL AS strict_ok")


@query("score_clean_output", fx("""SELECT request_key, CASE WHEN h = 17 THEN split_part(replace(raw_content, chr(10), ''), '```', 2)[5:]
  ELSE raw_content END AS clean FROM fx_results""", "fx_results"))
def score_clean_output(spark, sf):
    from callscope.functions.text import clean_output
    return outputs(spark, sf).select("request_key", clean_output("raw_content").alias("clean"))


@query("score_leaves", fx("""SELECT task_id, 'k' AS path, 'number' AS type, cast(k AS string) AS value FROM fx_task_rows
 UNION ALL SELECT task_id, 'cents', 'number', cast(cents AS string) FROM fx_task_rows
 UNION ALL SELECT task_id, 'kind', 'string', kind FROM fx_task_rows
 UNION ALL SELECT task_id, 'tags[0]', 'string', 't' || cast(k % 3 AS string) FROM fx_task_rows
 UNION ALL SELECT task_id, 'tags[1]', 'string', 'u' FROM fx_task_rows""", "fx_task_rows"))
def score_leaves(spark, sf):
    return leaf_table(fixture(spark, sf, "fx_task_rows"), "task_id", "gold_args").drop("tokens")


@query("score_fields", fx(""", p AS (SELECT request_key, h, unnest(['k', 'cents', 'kind', 'tags[0]', 'tags[1]']) AS path
   FROM fx_expected WHERE tool_correct)
SELECT request_key, path, NOT (path = 'k' AND h = 13) AS present, NOT (path = 'k' AND h IN (13, 14)) AS semantic,
  NOT (path = 'k' AND h IN (12, 13, 14) OR path = 'kind' AND h = 11) AS exact FROM p"""))
def score_fields(spark, sf):
    return (scored(spark, sf).where("tool_correct").select("request_key", F.explode("fields").alias("f"))
            .select("request_key", "f.path", "f.present", "f.semantic", "f.exact"))


@query("score_variants", fx(""", p AS (SELECT request_key, h, tool_name, unnest(['k', 'cents', 'kind', 'tags[0]', 'tags[1]']) AS path
   FROM fx_expected WHERE tool_correct)
SELECT request_key, path, NOT (path = 'k' AND (h = 13 OR h = 14 AND tool_name = 'click')) AS semantic,
  NOT (path = 'k' AND (h IN (12, 13) OR h = 14 AND tool_name = 'click') OR path = 'kind' AND h = 11) AS exact FROM p"""))
def score_variants(spark, sf):
    """The next number is accepted in place of k."""
    t = (spread(fixture(spark, sf, "fx_task_rows").select("task_id", "tool_name", "gold_args", "k"))
         .withColumn("unordered_paths", F.array(F.lit("tags"))).withColumn("acceptable_variants", F.expr("concat('{\"k\":[', k + 1, ']}')")).drop("k"))
    rules, names = tool_inputs(spark, sf)
    s = sc.score(outputs(spark, sf), sc.prepare_tasks(t), rules, catalogs(spark, sf), names)
    return s.where("tool_correct").select("request_key", F.explode("fields").alias("f")).select("request_key", "f.path", "f.semantic", "f.exact")


@query("score_extra_and_hallucinated", fx("""SELECT request_key, CASE WHEN tool_correct AND h = 18 THEN 'color' ELSE '' END AS extra,
  CASE WHEN tool_correct AND h = 18 THEN 'color' ELSE '' END AS hallucinated, arg_exact_match FROM fx_expected WHERE json_valid"""))
def score_extra(spark, sf):
    return scored(spark, sf).where("json_valid").select(
        "request_key", F.coalesce(F.concat_ws(",", "extra_paths"), F.lit("")).alias("extra"),
        F.concat_ws(",", "hallucinated_keys").alias("hallucinated"), "arg_exact_match")


@query("score_schema_errors", fx("""SELECT request_key, CASE h WHEN 11 THEN 'enum' WHEN 12 THEN 'type' WHEN 13 THEN 'required'
  WHEN 14 THEN 'maximum' ELSE 'additionalProperties' END AS validator, CASE h WHEN 11 THEN 'kind' WHEN 12 THEN 'k' WHEN 14 THEN 'k' ELSE '' END AS path
 FROM fx_expected WHERE tool_correct AND NOT schema_valid"""))
def score_schema_errors(spark, sf):
    rules, _ = tool_inputs(spark, sf)
    calls = sc.parse_outputs(outputs(spark, sf).join(tasks(spark, sf).select("task_id", "tool_name").hint("merge"), "task_id"))
    e = sc.schema_errors(calls.where("format_ok AND pred_tool = tool_name"), rules)
    return e.select("request_key", F.explode("schema_errors").alias("e")).select("request_key", "e.validator", "e.path")


@query("score_receipt", fx("""SELECT request_key, CASE WHEN NOT json_valid THEN 'not_executed'
   WHEN h = 15 THEN CASE WHEN task_id % 2 = 0 OR family = 'arggen' THEN 'error' ELSE 'wrong_tool_executed' END
   WHEN schema_valid THEN 'ok' ELSE 'error' END AS execution_status, semantic_correct AS receipt_ok FROM fx_expected"""))
def score_receipt(spark, sf):
    return scored(spark, sf).select("request_key", "execution_status", "receipt_ok")


ROUTE = """CASE WHEN h = 19 THEN 'truncated' WHEN h IN (7, 16, 17) THEN 'strict_json' WHEN h = 9 THEN 'envelope'
  WHEN h = 15 THEN CASE WHEN task_id % 2 = 0 OR family = 'arggen' THEN 'tool_not_in_catalog' ELSE 'valid' END
  WHEN h IN (8, 11, 12, 13) OR (h = 14 AND tool_name = 'click') OR (h = 18 AND tool_name <> 'view') THEN 'raw_schema'
  ELSE 'valid' END"""


def routed(spark, sf):
    rules, _ = tool_inputs(spark, sf)
    return sc.route(salted_join(outputs(spark, sf), catalogs(spark, sf), ["catalog_key"], "request_key"), rules)


@query("score_route", fx(f"SELECT request_key, {ROUTE} AS route_reason, {ROUTE} <> 'valid' AS retry FROM fx_expected"))
def score_route(spark, sf):
    return routed(spark, sf).select("request_key", "route_reason", "retry")


@query("score_failure_class", fx(f""", r AS (SELECT *, fault <= 3 AS refused, {ROUTE} <> 'valid' AS retry FROM fx_expected)
SELECT request_key, CASE WHEN refused THEN 'engine_refusal' WHEN truncated AND decoding = 'constrained' THEN 'cd_truncated'
  WHEN retry THEN 'invalid' WHEN NOT tool_correct THEN 'wrong_tool' WHEN h = 18 THEN 'lookalike_key'
  WHEN NOT e2e_success THEN 'valid_wrong_value' ELSE 'correct' END AS failure_class FROM r"""))
def score_failure_class(spark, sf):
    s = scored(spark, sf).select("request_key", "tool_correct", "e2e_success", "http_status", "decoding", "h")
    r = routed(spark, sf).select("request_key", "retry", "truncated")
    j = s.join(r, "request_key").selectExpr(
        "request_key", "http_status <> 200 AS engine_refusal", "truncated AND decoding = 'constrained' AS cd_truncated",
        "retry AS invalid", "NOT tool_correct AS wrong_tool", "h = 18 AS lookalike_key", "e2e_success")
    return j.select("request_key", sc.failure_class().alias("failure_class"))


@query("score_ceiling", fx("""SELECT request_key, CASE WHEN e2e_success THEN 'success' WHEN NOT json_valid THEN 'malformed'
  WHEN NOT tool_correct THEN 'wrong_tool' WHEN NOT schema_valid THEN CASE WHEN semantic_correct THEN 'invalid_only' ELSE 'invalid_wrong' END
  ELSE 'valid_wrong' END AS ceiling FROM fx_expected"""))
def score_ceiling(spark, sf):
    return scored(spark, sf).select("request_key", sc.ceiling_class().alias("ceiling"))


@query("score_faults", fx("""SELECT request_key, e2e_success AS raw_evaluator_e2e, fault <= 3 AS engine_error,
  e2e_success AND fault > 3 AS e2e_success FROM fx_expected"""))
def score_faults(spark, sf):
    s = scored(spark, sf).withColumn("request_error", sc.error_kind())
    return sc.apply_faults(s).select("request_key", "raw_evaluator_e2e", "engine_error", "e2e_success")


@query("score_rescore", fx("SELECT count(*) AS n, count_if(h = 17)::bigint AS changed FROM fx_expected"))
def score_rescore(spark, sf):
    """A stored verdict table that had missed fenced outputs, recomputed."""
    old = fixture(spark, sf, "fx_expected").selectExpr("request_key", "e2e_success AND h <> 17 AS e2e_success")
    return sc.rescore(old, scored(spark, sf))


@query("score_unchecked_keywords", fx("SELECT schema_id, CASE shape WHEN 'missing' THEN '$ref' ELSE '' END AS unchecked FROM fx_schema_key", "fx_schema_key"))
def score_unchecked(spark, sf):
    """References that lead nowhere are all that is left unchecked."""
    rules = schema_rules(spread(fixture(spark, sf, "fx_schemas").select("schema_id", "body")), "schema_id")
    return rules.select("schema_id", F.concat_ws(",", "unchecked").alias("unchecked"))


BROKEN = (
    (0, "k % 2 = 1", "type", "x_a"), (0, "length(kind) > 5", "maxLength", "kind_y"), (0, "k % 3 = 0", "type", "other"),
    (1, "length(kind) > 5", "maxLength", ""), (1, "kind = 'view'", "pattern", ""),
    (2, "k % 2 = 1", "dependencies", ""), (2, "k % 2 = 0 AND k % 3 <> 0", "required", ""),
    (3, "k % 2 = 1", "dependentRequired", ""), (3, "k % 3 <> 0", "dependentRequired", ""), (3, "k % 6 = 0 AND cents < 10000", "minimum", "cents"),
    (4, "k % 5 = 0", "type", "t/0"), (4, "kind NOT IN ('click', 'view')", "enum", "t/1"), (4, "k < 500", "minimum", "t/2"),
    (5, "k % 2 = 0", "additionalItems", "t"),
    (6, "ones = 1", "minContains", "t"), (6, "ones > 2", "maxContains", "t"), (7, "k > 300", "contains", "t"),
    (8, "(k % 2 = 0 AND kind <> 'click') OR cents < 10000", "unevaluatedProperties", ""), (9, "k > 500", "unevaluatedItems", "t"),
    (10, "k > 500", "maximum", "v"), (10, "k > 400", "maximum", "next/v"), (10, "k % 2 = 1", "required", "next/next"),
    (10, "k % 2 = 0 AND k > 300", "maximum", "next/next/v"),
    (11, "k % 2 = 0", "false", "ghost"), (11, "kind = 'view'", "not", "kind"), (11, "k BETWEEN 200 AND 300", "oneOf", "k"),
)


@query("score_rule_keywords", fx(", c AS (SELECT *, k % 2 + abs(cents) % 2 + 1 + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS ones FROM fx_keyword_calls)\n" + " UNION ALL ".join(
    f"SELECT task_id, {n}::bigint AS n, '{validator}' AS validator, '{path}' AS path FROM c WHERE n = {n} AND ({when})" for n, when, validator, path in BROKEN), "fx_keyword_calls"))
def score_rule_keywords(spark, sf):
    """Rules by key pattern, array slot, dependency, reference and evaluated members, each broken by some calls."""
    schemas = fixture(spark, sf, "fx_keyword_schemas").selectExpr("cast(n as bigint) AS n", "body")
    calls = with_nodes(spread(fixture(spark, sf, "fx_keyword_calls").selectExpr("task_id", "cast(n as bigint) AS n", "args")), "args", "arg_nodes")
    broken = sc.schema_errors(calls, schema_rules(schemas, "n"), "n").select("task_id", "n", F.explode("schema_errors").alias("e"))
    return broken.select("task_id", "n", "e.validator", "e.path")


@query("score_hostile", fx("""SELECT request_key, h IN (3, 4, 6, 7, 9) AS json_valid, h IN (3, 6, 9) OR (h = 4 AND NOT ghost) AS tool_correct,
  (h IN (3, 6, 9) OR (h = 4 AND NOT ghost)) AND tool_name <> 'view' AS e2e_success, h = 7 AS unknown_task,
  CASE WHEN h = 7 THEN 'unknown task' WHEN h = 5 THEN 'context-length failure' WHEN h IN (0, 1, 2, 8) THEN 'malformed output'
       WHEN h = 4 AND ghost THEN 'multiple-tool confusion' WHEN tool_name = 'view' THEN 'execution failure' END AS failure_primary
 FROM fx_hostile""", "fx_hostile"))
def score_hostile(spark, sf):
    rules, names = tool_inputs(spark, sf)
    out = fixture(spark, sf, "fx_hostile").drop("tool_name")
    s = sc.score(out, tasks(spark, sf), rules.where("tool_name <> 'view'"), catalogs(spark, sf), names)
    return s.select("request_key", "json_valid", "tool_correct", "e2e_success", "unknown_task", "failure_primary")
