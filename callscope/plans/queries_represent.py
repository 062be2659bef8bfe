"""Representations, information loss, sizes and catalog prompts of the pool tools."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import corpus as co
from callscope.operators import represent as rp
from callscope.plans.fixtures import fixture, spread, with_fx, words_sql
from callscope.plans.queries_selection import CATALOGS, members
from callscope.plans.registry import query, rounded


def fx(sql: str, names: str = "fx_pool") -> str:
    return with_fx(names, sql)


def tools(spark, sf):
    s = fixture(spark, sf, "fx_schemas").select("schema_id", "body", "eff")
    p = fixture(spark, sf, "fx_pool").select("tool_id", "tool_name", "schema_id", "stratum", "p_partkey")
    # merged: a body is many times the bytes of its part in the file, so the estimate would let all of them be broadcast
    return spread(p.join(s.hint("merge"), "schema_id")).withColumn("description", F.expr("concat('Handles item ', eff)"))


JOINED = "t AS (SELECT p.tool_id, p.tool_name, p.stratum, p.p_partkey, s.* EXCLUDE (p_partkey) FROM fx_pool p JOIN fx_schemas s USING (schema_id, p_partkey))"
CARD = """'{"type":"function","function":{"name":"' || tool_name || '","description":"Handles item ' || eff || '","parameters":' || %s || '}}'"""
REST = f"""list_transform(range(1, n_props), lambda i: '"' || split_part('{words_sql()}', ',', ((eff * 7 + 3 * i) % 40 + 1)::int) || '":{{"type":"string"}}')"""
INFO = f"""'{{"type":"object","properties":{{' || array_to_string(['"' || first_prop || '":' || CASE shape WHEN 'nested' THEN '{{"type":"object"}}' WHEN 'objects' THEN '{{"type":"array"}}'
  WHEN 'tuple' THEN '{{"type":"array"}}' WHEN 'enum' THEN '{{"type":"string","enum":["a","b"]}}' ELSE '{{"type":"string"}}' END] || {REST}, ',') || '}},"required":["' || first_prop || '"]}}'"""


@query("repr_minified", fx(", " + JOINED + " SELECT tool_id, " + CARD % "body" + " AS text FROM t", "fx_pool fx_schemas"))
def repr_minified(spark, sf):
    return rp.representations(tools(spark, sf)).where("arm = 'minified'").select("tool_id", "text")


@query("repr_printed_sizes")
def repr_printed_sizes(spark, sf):
    return rp.representations(tools(spark, sf)).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("repr_info_subset", fx(", " + JOINED + f" SELECT tool_id, {INFO} AS info FROM t", "fx_pool fx_schemas"))
def repr_info_subset(spark, sf):
    return rp.info_subset(tools(spark, sf)).select("tool_id", "info")


def info(spark, sf):
    t = tools(spark, sf)
    n = co.normalize_schemas(t, ("tool_id",)).selectExpr("tool_id", "normalized AS norm")
    f = co.schema_features(t, ("tool_id",))
    i = rp.info_subset(t).selectExpr("tool_id", "stratum", "description", "body AS raw", "info AS shown",
                                     "CASE WHEN p_partkey % 3 = 0 THEN 'short' ELSE description END AS shown_description")
    return rp.information_audit(i.join(n.hint("merge"), "tool_id").join(f.hint("merge"), "tool_id"))


DROPPED = """array_to_string(list_sort(CASE WHEN n_props > 1 THEN ['has_constraints'] ELSE [] END || CASE WHEN shape = 'ref' THEN ['has_ref'] ELSE [] END
  || CASE WHEN shape IN ('nested', 'objects') THEN ['has_nested_object'] ELSE [] END || CASE WHEN shape = 'objects' THEN ['has_array_of_objects'] ELSE [] END), ',')"""


@query("info_audit", fx(f"""SELECT tool_id, '' AS type_changes, CASE WHEN shape IN ('nested', 'objects', 'tuple') THEN first_prop ELSE '' END AS dropped_substructure,
  {DROPPED} AS dropped_keywords, p_partkey % 3 = 0 AS tool_description_rewritten, true AS root_text_dropped,
  shape IN ('plain', 'enum') AND n_props = 1 AS lossless_except_text FROM fx_pool"""))
def info_audit(spark, sf):
    j = lambda c: F.array_join(c, ",").alias(c)
    return info(spark, sf).select("tool_id", j("type_changes"), j("dropped_substructure"), j("dropped_keywords"),
                                  "tool_description_rewritten", "root_text_dropped", "lossless_except_text")


@query("info_summary", fx("""SELECT coalesce(stratum, 'all') AS stratum, count(*) AS n, count_if(shape IN ('plain', 'enum') AND n_props = 1)::bigint AS lossless_except_text,
  count_if(shape IN ('nested', 'objects', 'tuple'))::bigint AS with_dropped_substructure, count_if(n_props > 1)::bigint AS with_dropped_constraints,
  count_if(p_partkey % 3 = 0)::bigint AS with_tool_description_rewritten FROM fx_pool GROUP BY ROLLUP (stratum)"""))
def info_summary(spark, sf):
    return rp.information_summary(info(spark, sf)).select("stratum", "n", "lossless_except_text", "with_dropped_substructure",
                                                          "with_dropped_constraints", "with_tool_description_rewritten")


def catalog_texts(spark, sf):
    t = rp.representations(tools(spark, sf)).where("arm = 'minified'")
    return rp.render_catalogs(members(spark, sf), t)


RENDER = CATALOGS + ", " + JOINED + ", rt AS (SELECT catalog_id, ct.replicate, ct.size, '[' || string_agg(" + CARD % "body" + \
    ", ',' ORDER BY presentation_pos) || ']' AS tools_text FROM ct JOIN t USING (tool_id) GROUP BY 1, 2, 3)"


@query("repr_catalog_text", fx(RENDER + " SELECT catalog_id, 'minified' AS arm, length(tools_text) AS chars, md5(tools_text) AS digest FROM rt", "fx_pool fx_schemas"))
def repr_catalog_text(spark, sf):
    return catalog_texts(spark, sf).selectExpr("catalog_id", "arm", "cast(length(tools_text) as bigint) AS chars", "md5(tools_text) AS digest")


@query("repr_catalog_check", fx(RENDER + " SELECT catalog_id, 'minified' AS arm, size <> 10 AS equal_to_join FROM rt", "fx_pool fx_schemas"))
def repr_catalog_check(spark, sf):
    c = catalog_texts(spark, sf)
    whole = c.selectExpr("catalog_id", "arm", "CASE WHEN size = 10 THEN concat(tools_text, ' ') ELSE tools_text END AS whole_text")
    return rp.catalog_text_check(c, whole)


N_TEMPLATE = len(rp.SYSTEM_TEMPLATE.replace("{tools}", ""))
PROMPTS = RENDER + """, k AS (SELECT task_id, replicate, kind, 'U' || intent_id || ' ' || kind || ' at ' || cents || ' cents' AS prompt FROM fx_tasks)"""


@query("repr_prompts", fx(PROMPTS + f""" SELECT task_id, catalog_id, {N_TEMPLATE} + length(tools_text) AS system_chars,
  prompt || chr(10) || chr(10) || 'Use the tool "' || kind || '".' AS user_message FROM rt JOIN k USING (replicate)""", "fx_pool fx_schemas fx_tasks"))
def repr_prompts(spark, sf):
    t = fixture(spark, sf, "fx_task_rows").select("task_id", "replicate", "tool_name", "prompt")
    c = catalog_texts(spark, sf).withColumn("replicate", F.col("replicate").cast("bigint"))
    return rp.render_prompts(c, t, fixed_tool=True).selectExpr("task_id", "catalog_id", "cast(length(system_prompt) as bigint) AS system_chars", "user_message")


def texts(spark, sf):
    """Token counts arrive as a column; here a third of the characters."""
    t = tools(spark, sf)
    m = rp.representations(t).where("arm <> 'normalized'")
    return m.join(t.select("tool_id", "stratum"), "tool_id").withColumn("n_tokens", F.expr("cast(floor(length(text) / 3) as bigint)"))


# The printed arms have two blanks per level: their length is counted from the nodes of the text.
BOTH = ", " + JOINED + f""", card AS (SELECT tool_id, stratum, 'raw' AS arm, {CARD % 'body'} AS body FROM t UNION ALL SELECT tool_id, stratum, 'info', {CARD % INFO} FROM t),
 node AS (SELECT tool_id, stratum, arm, length(c.body) AS n, j.type AS kind, j.value::varchar AS value, len(regexp_extract_all(j.fullkey[2:], '[.]|\\[')) AS lvl, j.fullkey
   FROM card c, json_tree(c.body) j),
 x AS (SELECT tool_id, any_value(stratum) AS stratum, arm, (any_value(n) + sum(CASE WHEN lvl > 0 THEN 1 + 2 * lvl ELSE 0 END) + count_if(lvl > 0 AND NOT ends_with(fullkey, ']'))
     + sum(CASE WHEN kind IN ('OBJECT', 'ARRAY') AND value NOT IN ('{{}}', '[]') THEN 1 + 2 * lvl ELSE 0 END))::bigint AS chars FROM node GROUP BY tool_id, arm
   UNION ALL SELECT tool_id, stratum, 'minified', length({CARD % 'body'}) FROM t),
 y AS (SELECT *, chars // 3 AS tokens FROM x),
 z AS (SELECT y.*, r.tokens - y.tokens AS token_reduction, round_even(100.0::double * (r.tokens - y.tokens) / r.tokens, 2) AS compression_pct
   FROM y JOIN y r ON r.tool_id = y.tool_id AND r.arm = 'raw')"""


@query("size_metrics", fx(BOTH + " SELECT tool_id, arm, chars, tokens, token_reduction, compression_pct FROM z WHERE arm = 'minified'", "fx_pool fx_schemas"))
def size_metrics(spark, sf):
    """What leaving out the blanks alone saves against the printed text."""
    return rp.size_metrics(texts(spark, sf), "n_tokens").where("arm = 'minified'").select("tool_id", "arm", "chars", "tokens", "token_reduction", "compression_pct")


@query("size_summary", fx(BOTH + """, w AS (SELECT *, unnest(['all', stratum]) AS s FROM z WHERE arm = 'minified')
SELECT arm, s AS stratum, round_even(avg(tokens), 1) AS mean_tokens, median(compression_pct) AS median_compression_pct FROM w GROUP BY 1, 2""", "fx_pool fx_schemas"))
def size_summary(spark, sf):
    return rp.size_summary(rp.size_metrics(texts(spark, sf), "n_tokens")).where("arm = 'minified'").select("arm", "stratum", "mean_tokens", "median_compression_pct")


@query("size_metrics_arms", fx(BOTH + " SELECT tool_id, arm, chars, tokens, token_reduction, compression_pct FROM z WHERE arm <> 'minified'", "fx_pool fx_schemas"))
def size_metrics_arms(spark, sf):
    return rp.size_metrics(texts(spark, sf), "n_tokens").where("arm <> 'minified'").select("tool_id", "arm", "chars", "tokens", "token_reduction", "compression_pct")


@query("size_summary_arms", fx(BOTH + """, w AS (SELECT *, unnest(['all', stratum]) AS s FROM z WHERE arm <> 'minified')
SELECT arm, s AS stratum, round_even(avg(tokens), 1) AS mean_tokens, median(compression_pct) AS median_compression_pct FROM w GROUP BY 1, 2""", "fx_pool fx_schemas"))
def size_summary_arms(spark, sf):
    return rp.size_summary(rp.size_metrics(texts(spark, sf), "n_tokens")).where("arm <> 'minified'").select("arm", "stratum", "mean_tokens", "median_compression_pct")


@query("size_catalog_summary", fx("SELECT size, arm, round_even(avg(prompt_tokens), 1) AS mean, max(prompt_tokens) AS max FROM fx_expected GROUP BY 1, 2", "fx_expected"))
def size_catalog_summary(spark, sf):
    return rp.catalog_size_summary(fixture(spark, sf, "fx_expected").withColumnRenamed("prompt_tokens", "system_prompt_tokens"))


def prompts(spark, sf):
    return fixture(spark, sf, "fx_expected").where("family = 'select'").selectExpr(
        "catalog_id", "size", "arm", "prompt_tokens", "prompt_tokens * 4 + task_id % 3 AS prompt_chars")


CTX = """, p AS (SELECT catalog_id, size, arm, max_by(prompt_tokens, (prompt_tokens * 4 + task_id % 3) * 100000 + prompt_tokens) + 64 AS plus_reserve
  FROM fx_expected WHERE family = 'select' GROUP BY 1, 2, 3)"""


@query("context_check", fx(CTX + " SELECT catalog_id, size, arm, plus_reserve, plus_reserve > 2100 AS exceeds FROM p", "fx_expected"))
def context_check(spark, sf):
    return rp.context_check(prompts(spark, sf), 2100, 64)[0]


@query("context_worst_case", fx(CTX + " SELECT size, arm, max(plus_reserve) AS worst_case, count_if(plus_reserve > 2100)::bigint AS exceeding FROM p GROUP BY 1, 2", "fx_expected"))
def context_worst_case(spark, sf):
    return rp.context_check(prompts(spark, sf), 2100, 64)[1]


@query("catalog_contracts", fx(CATALOGS + """ SELECT catalog_id, count(*) AS branches, string_agg(p.tool_name, ',' ORDER BY presentation_pos) AS names
 FROM ct JOIN fx_pool p USING (tool_id) GROUP BY 1"""))
def catalog_contracts(spark, sf):
    c = rp.catalog_contracts(members(spark, sf), tools(spark, sf))
    return c.selectExpr("catalog_id", "cast(size(branches) as bigint) AS branches", "array_join(transform(branches, b -> b.tool_name), ',') AS names")


VERDICTS = """SELECT 'engine' || e AS engine, tool_id, stratum, p_partkey % 4 = 0 AS is_target, (p_partkey + e) % 9 <> 0 AS compile_ok,
  CASE WHEN (p_partkey + e) % 9 = 0 THEN 'bad schema ' || tool_id END AS compile_error, (p_partkey + e) % 5 = 0 AS warned,
  (p_partkey + e) % 7 <> 0 AS accept_compact, (p_partkey * e) % 3 = 0 AS accept_spaced FROM (SELECT *, $each(1, 2, 3) AS e FROM fx_pool) v"""


def verdicts(spark, sf):
    v = fixture(spark, sf, "fx_pool").withColumn("e", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return v.selectExpr("concat('engine', e) AS engine", "tool_id", "stratum", "p_partkey % 4 = 0 AS is_target", "(p_partkey + e) % 9 <> 0 AS compile_ok",
                        "CASE WHEN (p_partkey + e) % 9 = 0 THEN concat('bad schema ', tool_id) END AS compile_error",
                        "CASE WHEN (p_partkey + e) % 5 = 0 THEN array(concat('keyword not enforced: ', shape)) ELSE cast(array() as array<string>) END AS warnings",
                        "(p_partkey + e) % 7 <> 0 AS accept_compact", "(p_partkey * e) % 3 = 0 AS accept_spaced")


V = ", v AS (" + VERDICTS.replace("$each(1, 2, 3)", "unnest([1, 2, 3])").replace("tool_id, stratum,", "tool_id, stratum, shape,") + ")"


@query("verdict_summary", fx(V + """ SELECT engine, count(*) AS tools, count_if(compile_ok)::bigint AS compile_ok, count_if(compile_ok AND warned)::bigint AS compile_ok_with_warnings,
  count_if(is_target)::bigint AS targets, count_if(is_target AND compile_ok)::bigint AS targets_compile_ok,
  count_if(is_target AND (accept_compact OR accept_spaced))::bigint AS gold_accept_either, count_if(is_target AND accept_compact)::bigint AS gold_accept_compact,
  count_if(is_target AND accept_spaced)::bigint AS gold_accept_spaced FROM v GROUP BY 1"""))
def verdict_summary(spark, sf):
    return rp.verdict_summary(verdicts(spark, sf))[0]


@query("verdict_problems", fx(V + """ SELECT engine, tool_id, stratum, CASE WHEN NOT compile_ok THEN 'compile: ' || compile_error ELSE 'gold call rejected' END AS problem
 FROM v WHERE is_target AND (NOT compile_ok OR NOT (accept_compact OR accept_spaced))"""))
def verdict_problems(spark, sf):
    return rp.verdict_summary(verdicts(spark, sf))[1]


@query("verdict_warnings", fx(V + """ SELECT engine, 'keyword not enforced: ' || shape AS warning, count(*) AS n FROM v WHERE warned GROUP BY 1, 2"""))
def verdict_warnings(spark, sf):
    return rp.verdict_summary(verdicts(spark, sf))[2]


@query("coverage_summary", fx("""SELECT catalog_key AS catalog_id, count_if(h <= 6)::bigint AS gold_checked, count_if(h <= 6 AND fault > 3)::bigint AS gold_accepted,
  count_if(h <= 6 AND fault <= 3)::bigint AS gold_rejected, count_if(h = 10)::bigint AS original_checked, count_if(h = 10 AND fault > 3)::bigint AS original_accepted,
  count_if(h > 6 AND h <> 10)::bigint AS invalid_checked, count_if(h > 6 AND h <> 10 AND fault > 3)::bigint AS invalid_accepted FROM fx_results_key GROUP BY 1""", "fx_results_key"))
def coverage_summary(spark, sf):
    k = fixture(spark, sf, "fx_results_key").selectExpr("catalog_key AS catalog_id", "CASE WHEN h <= 6 THEN 'gold' WHEN h = 10 THEN 'original' ELSE 'invalid' END AS kind", "fault > 3 AS accepted")
    return rp.coverage_summary(k)

