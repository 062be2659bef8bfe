"""Experiment statistics over the outcome table derived from events."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import calibration as cal
from callscope.operators import stats as st
from callscope.operators.glm import token_glm
from callscope.operators.ranking import exact_quantiles
from callscope.operators.scoring import apply_faults, ceiling_class, error_kind
from callscope.plans.fixtures import fixture, with_fx
from callscope.plans.registry import query, rounded

ARMS = ["raw", "min"]
SIZES = [5, 20]


def expected(spark, sf, family=None):
    df = fixture(spark, sf, "fx_expected").withColumn("format_ok", F.col("json_valid"))
    df = (df.withColumn("field_acc", F.col("field_acc").cast("double"))
          .withColumn("failure_secondary", F.expr("filter(array(failure_secondary), s -> s <> '')")))
    df = df.withColumn("ceiling", ceiling_class())
    return df.where(F.col("family") == family) if family else df


def fx(sql: str, names: str = "fx_expected") -> str:
    return with_fx(names, sql)


def boot(src: str, group: str, cluster: str, total: str, n: str, draws: int, seed: int, tag: str) -> str:
    g, gc = (group + ",", f"{group},") if group else ("", "")
    on = f"USING ({group}, i)" if group else "USING (i)"
    part = f"PARTITION BY {group} " if group else ""
    grp = f"GROUP BY {group}" if group else ""
    return f"""
  {tag}_i AS (SELECT {g} {total} AS s, {n} AS m, row_number() OVER ({part}ORDER BY {cluster}) - 1 AS i FROM {src}),
  {tag}_z AS (SELECT {g} count(*) AS r FROM {tag}_i {grp}),
  {tag}_b AS (SELECT {g} r, unnest(range({draws})) AS b FROM {tag}_z),
  {tag}_s AS (SELECT {g} r, b, unnest(range(r)) AS slot FROM {tag}_b),
  {tag}_d AS (SELECT {g} b, ('0x' || substr(md5('{seed}:' || b || ':' || slot), 1, 8))::BIGINT % r AS i FROM {tag}_s),
  {tag}_e AS (SELECT {gc} b, sum(s) / sum(m) AS e FROM {tag}_d JOIN {tag}_i {on} GROUP BY {gc} b),
  {tag}_k AS (SELECT {gc} e, row_number() OVER ({part}ORDER BY e) AS k FROM {tag}_e),
  {tag}_ci AS (SELECT {gc} min(e) AS ci_low, max(e) AS ci_high FROM {tag}_k
               WHERE k IN ({int(0.025 * draws) + 1}, {int(0.975 * draws)}) {grp})"""


def p_exact(a: str, b: str) -> str:
    n = f"({a} + {b})"
    return (f"CASE WHEN {a} = {b} THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, (least({a}, {b}) + 1)::BIGINT), "
            f"lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0))))) END")


CELL_SQL = fx("""SELECT size, arm, count(*) AS n, count(DISTINCT replicate) AS n_replicates,
  round(avg(tool_correct::int), 6) AS selection, round(avg(arg_exact_match::int), 6) AS arg_em,
  round(avg(field_acc::double), 6) AS field_acc, round(avg(schema_valid::int), 6) AS schema_valid,
  round(avg(json_valid::int), 6) AS json_valid, round(avg(e2e_success::int), 6) AS e2e,
  round(avg(e2e_strict::int), 6) AS e2e_strict, round(avg(prompt_tokens), 6) AS input_tokens,
  round(avg(completion_tokens), 6) AS output_tokens, 0::bigint AS context_failures,
  count_if(truncated)::bigint AS truncated, round(median(wall_latency_ms), 6) AS latency_ms_cached,
  round(median(wall_latency_ms) FILTER (WHERE http_status = 200), 6) AS latency_ms_uncached
FROM fx_expected WHERE family = 'select' GROUP BY size, arm""")


@query("stats_cell_table", CELL_SQL)
def stats_cell_table(spark, sf):
    r = expected(spark, sf, "select")
    return rounded(st.cell_table(r, latency=r))


@query("stats_arggen_table", fx("""SELECT arm, count(*) AS n, round(avg(json_valid::int), 6) AS json_valid,
  round(avg(tool_correct::int), 6) AS tool_echo_correct, round(avg(arg_exact_match::int), 6) AS arg_em,
  round(avg(field_acc::double), 6) AS field_acc, round(avg(schema_valid::int), 6) AS schema_valid,
  round(avg(semantic_correct::int), 6) AS semantic_correct, round(avg(e2e_success::int), 6) AS e2e,
  round(avg(e2e_strict::int), 6) AS e2e_strict, round(avg(prompt_tokens), 6) AS input_tokens
FROM fx_expected WHERE family = 'arggen' GROUP BY arm"""))
def stats_arggen_table(spark, sf):
    return rounded(st.arggen_table(expected(spark, sf, "arggen")))


CEIL = """CASE WHEN e2e_success THEN 'success' WHEN NOT json_valid THEN 'malformed' WHEN NOT tool_correct THEN 'wrong_tool'
  WHEN NOT schema_valid AND semantic_correct THEN 'invalid_only' WHEN NOT schema_valid THEN 'invalid_wrong'
  ELSE 'valid_wrong' END"""


def _decomp_sql(group: str, where: str = "true") -> str:
    return fx(f""", c AS (SELECT *, {CEIL} AS k FROM fx_expected WHERE {where})
SELECT {group}, count(*) AS n, count_if(k = 'success')::bigint AS success, count_if(k = 'malformed')::bigint AS malformed,
  count_if(k = 'wrong_tool')::bigint AS wrong_tool, count_if(k = 'invalid_only')::bigint AS invalid_only,
  count_if(k = 'invalid_wrong')::bigint AS invalid_wrong, count_if(k = 'valid_wrong')::bigint AS valid_wrong,
  count_if(k IN ('malformed', 'invalid_only', 'invalid_wrong'))::bigint AS structural,
  round(100.0::double * count_if(k = 'success') / count(*), 6) AS success_pct,
  round(100.0::double * count_if(k IN ('success', 'malformed', 'invalid_only', 'invalid_wrong')) / count(*), 6) AS cd_upper_bound_pct,
  round(100.0::double * count_if(k IN ('success', 'invalid_only')) / count(*), 6) AS cd_conservative_pct,
  round(100.0::double * count_if(k IN ('valid_wrong', 'wrong_tool')) / count(*), 6) AS semantic_floor_pct
FROM c GROUP BY {group}""")


@query("stats_ceiling_pooled", _decomp_sql("family, arm"))
def stats_ceiling_pooled(spark, sf):
    return rounded(st.decompose(expected(spark, sf), ["family", "arm"]))


@query("stats_ceiling_by_size", _decomp_sql("arm, size", "family = 'select'"))
def stats_ceiling_by_size(spark, sf):
    return rounded(st.decompose(expected(spark, sf, "select"), ["arm", "size"]))


@query("stats_ceiling_by_stratum", _decomp_sql("arm, stratum", "family = 'select'"))
def stats_ceiling_by_stratum(spark, sf):
    return rounded(st.decompose(expected(spark, sf, "select"), ["arm", "stratum"]))


ERR = """CASE fault WHEN 0 THEN 'context_error' WHEN 1 THEN 'transport_error'
  WHEN 2 THEN CASE WHEN decoding = 'constrained' THEN 'engine_error' ELSE 'http_error' END WHEN 3 THEN 'http_error' END"""


def faulted(spark, sf):
    """Outcomes with request faults applied, as the run report reads them."""
    r = fixture(spark, sf, "fx_results").select("request_key", "error_code", "error_message")
    e = expected(spark, sf).join(r, "request_key").withColumn("request_error", error_kind())
    e = apply_faults(e).withColumn("lookalike", F.expr("h = 18"))
    return e.withColumn("ceiling", ceiling_class())


@query("stats_error_kinds", fx(f"""SELECT decoding, http_status, {ERR} AS request_error, count(*) AS n FROM fx_expected
GROUP BY 1, 2, 3"""))
def stats_error_kinds(spark, sf):
    r = fixture(spark, sf, "fx_results").withColumn("request_error", error_kind())
    return r.groupBy("decoding", "http_status", "request_error").agg(F.count(F.lit(1)).alias("n"))


def _rank_sql(q: float) -> str:
    return f"list_sort(list(wall_latency_ms) FILTER (WHERE ok))[round_even({q} * (count_if(ok) - 1), 0)::int + 1]"


@query("stats_run_cells", fx(f""", e AS (SELECT *, fault > 3 AS ok, {ERR} AS request_error FROM fx_expected),
 f AS (SELECT * REPLACE (e2e_success AND ok AS e2e_success, e2e_strict AND ok AS e2e_strict) FROM e),
 c AS (SELECT *, {CEIL} AS k, ok AND decoding = 'constrained' AND truncated AS cut FROM f)
SELECT family, size, arm, count(*) AS n, count_if(NOT ok)::bigint AS engine_errors, count_if(h = 18)::bigint AS lookalike_key,
  count_if(request_error = 'context_error')::bigint AS err_context, count_if(request_error = 'engine_error')::bigint AS err_engine,
  count_if(truncated)::bigint AS truncated, round(100 * avg(tool_correct::int), 6) AS tool,
  round(100 * avg(e2e_success::int), 6) AS e2e, round(100 * avg(e2e_success::int) FILTER (WHERE ok), 6) AS e2e_engine_ok,
  count_if(ok AND NOT cut AND k = 'malformed')::bigint AS class_malformed,
  count_if(ok AND NOT cut AND k = 'wrong_tool')::bigint AS class_wrong_tool,
  count_if(ok AND NOT cut AND k = 'invalid_only')::bigint AS class_invalid_only,
  count_if(ok AND NOT cut AND k = 'invalid_wrong')::bigint AS class_invalid_wrong,
  count_if(ok AND NOT cut AND k = 'valid_wrong')::bigint AS class_valid_wrong, count_if(cut)::bigint AS cd_truncated,
  round(avg(prompt_tokens), 6) AS in_tokens, {_rank_sql(0.5)} AS lat_p50, {_rank_sql(0.95)} AS lat_p95,
  CASE WHEN count_if(ok) >= 200 THEN {_rank_sql(0.99)} END AS lat_p99
FROM c GROUP BY family, size, arm"""))
def stats_run_cells(spark, sf):
    c = st.run_cells(faulted(spark, sf))
    return rounded(c.select(
        "family", "size", "arm", "n", "engine_errors", "lookalike_key",
        F.expr("request_errors['context_error']").alias("err_context"),
        F.expr("request_errors['engine_error']").alias("err_engine"), "truncated", "tool", "e2e", "e2e_engine_ok",
        "class_malformed", "class_wrong_tool", "class_invalid_only", "class_invalid_wrong", "class_valid_wrong",
        "cd_truncated", "in_tokens", "lat_p50", "lat_p95", "lat_p99"))


@query("stats_nearest_rank", fx("""SELECT arm, list_sort(list(wall_latency_ms))[round_even(0.5 * (count(*) - 1), 0)::int + 1] AS p50,
  list_sort(list(wall_latency_ms))[round_even(0.95 * (count(*) - 1), 0)::int + 1] AS p95 FROM fx_expected GROUP BY arm"""))
def stats_nearest_rank(spark, sf):
    return exact_quantiles(expected(spark, sf), ["arm"], "wall_latency_ms", {"p50": 0.5, "p95": 0.95}, "nearest")


@query("boot_cell_ci", fx(""", s AS (SELECT size, arm, replicate, sum(e2e_success::int) AS t, count(*) AS c FROM fx_expected
  WHERE family = 'select' GROUP BY 1, 2, 3),""" + boot("s", "size, arm", "replicate", "t", "c", 5000, 0, "q") + """
SELECT size, arm, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM q_ci"""))
def boot_cell_ci(spark, sf):
    s = expected(spark, sf, "select").groupBy("size", "arm", "replicate").agg(
        F.sum(F.col("e2e_success").cast("int")).alias("t"), F.count(F.lit(1)).alias("c"))
    return rounded(st.cluster_bootstrap(s, ["size", "arm"], "replicate", "t", "c", 5000, 0))


PLAN = [
    dict(name="PRIMARY: min vs raw, e2e", a="raw", b="min", metric="e2e_success", primary=True),
    dict(name="selection", a="raw", b="min", metric="tool_correct"),
    dict(name="schema", a="raw", b="min", metric="schema_valid"),
    dict(name="strict", a="raw", b="min", metric="e2e_strict"),
    dict(name="size 5", a="raw", b="min", metric="e2e_success", where="size = 5"),
    dict(name="size 20", a="raw", b="min", metric="e2e_success", where="size = 20"),
    dict(name="flat", a="raw", b="min", metric="e2e_success", where="stratum = 'flat'"),
    dict(name="structured", a="raw", b="min", metric="e2e_success", where="stratum = 'structured'"),
]


def _plan_sql(tail: str, draws: int = 5000) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c['name']}' AS name, {i} AS seq, replicate, a.{c['metric']}::int AS x, b.{c['metric']}::int AS y "
        f"FROM a JOIN b USING (catalog_id, task_id, replicate, size, stratum) WHERE {c.get('where', 'true')}"
        for i, c in enumerate(PLAN))
    return fx(f""", a AS (SELECT * FROM fx_expected WHERE family = 'select' AND arm = 'raw'),
 b AS (SELECT * FROM fx_expected WHERE family = 'select' AND arm = 'min'), l AS ({rows}),
 s AS (SELECT name, replicate, sum(y - x) AS t, count(*) AS c FROM l GROUP BY 1, 2),
 {boot("s", "name", "replicate", "t", "c", draws, 1, "q")},
 t AS (SELECT name, seq, count(*) AS n_pairs, avg(x) AS acc_a, avg(y) AS acc_b,
   count_if(x = 1 AND y = 0)::bigint AS discordant_a_only, count_if(x = 0 AND y = 1)::bigint AS discordant_b_only FROM l GROUP BY 1, 2),
 u AS (SELECT *, {p_exact('discordant_b_only', 'discordant_a_only')} AS p, seq = 0 AS is_primary FROM t),
 v AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY is_primary) - row_number() OVER (PARTITION BY is_primary ORDER BY p, seq) + 1) * p) AS step,
   row_number() OVER (PARTITION BY is_primary ORDER BY p, seq) AS rk FROM u),
 w AS (SELECT *, max(step) OVER (PARTITION BY is_primary ORDER BY rk) AS holm_p FROM v)
 {tail}""")


@query("stats_comparisons", _plan_sql("""SELECT name, n_pairs, round(acc_a, 6) AS acc_a, round(acc_b, 6) AS acc_b,
  round(100 * (acc_b - acc_a), 6) AS diff_pp, round(100 * ci_low, 6) AS ci_low, round(100 * ci_high, 6) AS ci_high,
  discordant_a_only, discordant_b_only, round(p, 6) AS mcnemar_p, round(holm_p, 6) AS holm_p,
  round((discordant_b_only + 0.5::double) / (discordant_a_only + 0.5::double), 6) AS odds_ratio,
  round(exp(ln((discordant_b_only + 0.5::double) / (discordant_a_only + 0.5::double)) - 1.96::double * sqrt(1 / (discordant_b_only + 0.5::double) + 1 / (discordant_a_only + 0.5::double))), 6) AS or_low,
  (100 * (acc_b - acc_a) >= 8 AND ci_low > 0) AS rule_met
FROM w JOIN q_ci USING (name)"""))
def stats_comparisons(spark, sf):
    out = st.decision_rule(st.run_comparisons(expected(spark, sf, "select"), PLAN))
    return rounded(out.select("name", "n_pairs", "acc_a", "acc_b", "diff_pp", "ci_low", "ci_high", "discordant_a_only",
                              "discordant_b_only", "mcnemar_p", "holm_p", "odds_ratio", "or_low", "rule_met"))


@query("stats_labels_mcnemar", f"""WITH t AS (SELECT count_if(quality = 1 AND toxic = 0)::bigint AS a_only,
  count_if(quality = 0 AND toxic = 1)::bigint AS b_only, count(*) AS n FROM labels)
SELECT n, a_only, b_only, round({p_exact('b_only', 'a_only')}, 6) AS p FROM t""")
def stats_labels_mcnemar(spark, sf):
    t = spark.read.parquet(f"{sf}/labels.parquet").agg(
        F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("a_only"),
        F.count_if(F.expr("quality = 0 AND toxic = 1")).alias("b_only"), F.count(F.lit(1)).alias("n"))
    return rounded(t.select("n", "a_only", "b_only", st.mcnemar_exact("b_only", "a_only").alias("p")))


@query("stats_did_by_size", fx(""", w AS (SELECT replicate, task_id,
   max(e2e_success::int) FILTER (WHERE arm = 'min' AND size = 5) - max(e2e_success::int) FILTER (WHERE arm = 'raw' AND size = 5) AS e5,
   max(e2e_success::int) FILTER (WHERE arm = 'min' AND size = 20) - max(e2e_success::int) FILTER (WHERE arm = 'raw' AND size = 20) AS e20
   FROM fx_expected WHERE family = 'select' GROUP BY 1, 2),
 s AS (SELECT replicate, sum(e20 - e5) AS t, count(*) AS c FROM w GROUP BY 1),""" + boot("s", "", "replicate", "t", "c", 5000, 2, "q") + f""",
 z AS (SELECT count(*) AS n_tasks, 100 * avg(e20) AS es, 100 * avg(e5) AS eb, 100 * avg(e20 - e5) AS d,
   count_if(e20 < e5)::bigint AS neg, count_if(e20 > e5)::bigint AS pos FROM w)
SELECT 20 AS size, 5 AS vs_size, n_tasks, round(es, 6) AS effect_at_size_pp, round(eb, 6) AS effect_at_base_pp,
  round(d, 6) AS did_pp, round(100 * ci_low, 6) AS ci_low, round(100 * ci_high, 6) AS ci_high, neg AS n_more_negative,
  pos AS n_more_positive, round({p_exact('pos', 'neg')}, 6) AS sign_test_p, round({p_exact('pos', 'neg')}, 6) AS holm_p
FROM z, q_ci"""))
def stats_did_by_size(spark, sf):
    return rounded(st.did_by_size(expected(spark, sf, "select"), "raw", "min", SIZES))


@query("stats_degradation", fx(f""", w AS (SELECT arm, task_id, max(e2e_success::int) FILTER (WHERE size = 5) AS a,
   max(e2e_success::int) FILTER (WHERE size = 20) AS b FROM fx_expected WHERE family = 'select' GROUP BY 1, 2),
 t AS (SELECT arm, count(*) AS n, 100 * avg(b - a) AS d, count_if(a = 1 AND b = 0)::bigint AS n10,
   count_if(a = 0 AND b = 1)::bigint AS n01 FROM w GROUP BY 1), u AS (SELECT *, {p_exact('n01', 'n10')} AS p FROM t)
SELECT arm, 20 AS size, n, round(d, 6) AS diff_pp, n10, n01, round(p, 6) AS p, round(p, 6) AS holm_p,
  CASE WHEN d < 0 AND p < 0.05 THEN 20 END AS first_significant_drop_size FROM u"""))
def stats_degradation(spark, sf):
    return rounded(st.degradation(expected(spark, sf, "select"), SIZES))


@query("stats_failure_counts", fx("""SELECT 'primary' AS level, arm, coalesce(cast(size AS string), 'all') AS size,
   failure_primary AS failure, count(*) AS n FROM fx_expected WHERE failure_primary IS NOT NULL AND family = 'select'
   GROUP BY GROUPING SETS ((arm, size, failure_primary), (arm, failure_primary))
 UNION ALL SELECT 'secondary', arm, 'all', failure_secondary, count(*) FROM fx_expected
   WHERE failure_primary IS NOT NULL AND failure_secondary <> '' AND family = 'select' GROUP BY arm, failure_secondary"""))
def stats_failure_counts(spark, sf):
    return st.failure_counts(expected(spark, sf, "select"))


@query("stats_latency_cells", fx("""SELECT size, arm, count(*) AS n, median(wall_latency_ms) AS median_ms,
  round(median(prompt_tokens), 6) AS median_prompt_tokens FROM fx_expected WHERE http_status = 200 GROUP BY size, arm"""))
def stats_latency_cells(spark, sf):
    return rounded(st.latency_cells(expected(spark, sf)).withColumn("median_prompt_tokens", F.col("median_prompt_tokens").cast("double")))


@query("stats_latency_observations", fx("""SELECT size, arm, request_key, round_even(wall_latency_ms, 0)::bigint AS observation_ms,
  prompt_tokens FROM fx_expected WHERE http_status = 200"""))
def stats_latency_observations(spark, sf):
    return st.latency_observations(expected(spark, sf))


@query("stats_cell_scatter", fx("""SELECT catalog_id, arm, round(avg(prompt_tokens), 6) AS mean_tokens,
  round(avg(e2e_success::int), 6) AS success FROM fx_expected WHERE family = 'select' GROUP BY 1, 2"""))
def stats_cell_scatter(spark, sf):
    return rounded(st.cell_scatter(expected(spark, sf, "select")))


DESIGN = """, c AS (SELECT arm, intent_id, count(*) AS m, sum(e2e_success::int) AS s FROM fx_expected WHERE family = 'select' GROUP BY 1, 2),
 k AS (SELECT arm, sum(f) AS tf FROM (SELECT arm, m - s AS f, row_number() OVER (PARTITION BY arm ORDER BY m - s DESC, intent_id) AS r FROM c) WHERE r <= 5 GROUP BY 1),
 g AS (SELECT arm, sum(s) / sum(m) AS grand, sum(m) AS n, count(*) AS kk, sum(m * m) AS mm, sum(m - s) AS fails,
        count_if(s < m) AS bad FROM c GROUP BY 1),
 a AS (SELECT arm, sum(m * (s / m - grand) * (s / m - grand)) AS ssb, sum(s * (1 - s / m) * (1 - s / m) + (m - s) * (s / m) * (s / m)) AS ssw
       FROM c JOIN g USING (arm) GROUP BY 1),
 i AS (SELECT *, ssb / (kk - 1) AS msb, ssw / (n - kk) AS msw, (n - mm / n) / (kk - 1) AS m0 FROM g JOIN a USING (arm) JOIN k USING (arm)),
 d AS (SELECT *, greatest(0.0, (msb - msw) / (msb + (m0 - 1) * msw)) AS icc FROM i),
 e AS (SELECT *, 1 + (n / kk - 1) * icc AS deff FROM d)"""


@query("stats_design_effect", fx(DESIGN + """ SELECT arm, kk AS clusters, n::bigint AS n, round(n / kk, 6) AS mean_cluster_size,
  round(icc, 6) AS icc, round(deff, 6) AS design_effect, round(n / deff, 6) AS effective_n,
  bad::bigint AS clusters_with_any_failure, round(tf / fails, 6) AS top_share FROM e"""))
def stats_design_effect(spark, sf):
    return rounded(st.design_effect(expected(spark, sf, "select"), ["arm"], "intent_id"))


@query("stats_power_table", fx(DESIGN + """, p AS (SELECT d, s FROM (VALUES (0.03), (0.05), (0.08), (0.10)) x(d), (VALUES (0.10), (0.20)) y(s)),
 q AS (SELECT d, s, (1.96 * sqrt(s::double) + 0.84 * sqrt(s::double - d::double * d::double)) AS r FROM p)
SELECT round(100 * d::double, 6) AS delta_pp, s::double AS discordant_share, ceil(r * r / (d::double * d::double))::bigint AS pairs_needed,
  ceil(r * r / (d::double * d::double) * deff)::bigint AS pairs_at_design_effect FROM q, e WHERE arm = 'raw'"""))
def stats_power_table(spark, sf):
    d = st.design_effect(expected(spark, sf, "select"), ["arm"], "intent_id").where("arm = 'raw'")
    return rounded(st.power_table(d))


@query("stats_truncation_sensitivity", fx(""", p AS (SELECT a.truncated AS ta, b.truncated AS tb, a.e2e_success AS ea, b.e2e_success AS eb
  FROM fx_expected a JOIN fx_expected b ON a.task_id = b.task_id AND a.size = b.size WHERE a.arm = 'raw' AND b.arm = 'min')
SELECT count(*) AS pairs, count_if(ta)::bigint AS a_truncated, count_if(tb)::bigint AS b_truncated,
  count_if(NOT ta AND NOT tb)::bigint AS both_complete_n, round(100 * avg(ea::int) FILTER (WHERE NOT ta AND NOT tb), 6) AS both_complete_a_pct,
  round(100 * avg(eb::int) FILTER (WHERE NOT ta AND NOT tb), 6) AS both_complete_b_pct FROM p"""))
def stats_truncation_sensitivity(spark, sf):
    return rounded(st.truncation_sensitivity(expected(spark, sf), "raw", "min"))


def replay_units(spark, sf):
    """Free and constrained rows of one request side by side; routed when the free text fails the strict gate."""
    e = expected(spark, sf).withColumn("retry", F.expr("""CASE WHEN h <= 6 OR h = 10 THEN false
        WHEN h = 14 THEN tool_name = 'click' WHEN h = 18 THEN tool_name <> 'view'
        WHEN h = 15 THEN task_id % 2 = 0 OR family = 'arggen' AND tool_name <> 'view' OR family = 'arggen' ELSE true END"""))
    return e.groupBy("family", "task_id", "size").agg(
        F.max(F.when(F.col("arm") == "raw", F.col("retry"))).alias("retry"),
        *[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{x}_{n}") for x, a in (("f", "raw"), ("c", "min"))
          for n, c in (("e2e", "e2e_success"), ("tokens", "prompt_tokens"), ("ms", "wall_latency_ms"))])


RETRY = """CASE WHEN h <= 6 OR h = 10 THEN false WHEN h = 14 THEN tool_name = 'click' WHEN h = 18 THEN tool_name <> 'view'
  WHEN h = 15 THEN task_id % 2 = 0 OR family = 'arggen' ELSE true END"""


@query("stats_router_replay", fx(f""", f AS (SELECT *, {RETRY} AS retry FROM fx_expected WHERE arm = 'raw'),
 j AS (SELECT f.family, f.retry, f.e2e_success AS fe, c.e2e_success AS ce, f.prompt_tokens AS ft, c.prompt_tokens AS ct,
   f.wall_latency_ms AS fm, c.wall_latency_ms AS cm FROM f JOIN fx_expected c ON c.arm = 'min' AND c.task_id = f.task_id AND c.size = f.size)
SELECT family, count(*) AS n, count_if(retry)::bigint AS routed, round(100 * avg(fe::int), 6) AS free_e2e_pct,
  round(100 * avg((CASE WHEN retry THEN ce ELSE fe END)::int), 6) AS projected_e2e_pct,
  round(1 + sum(CASE WHEN retry THEN ct ELSE 0 END) / sum(ft), 6) AS token_ratio,
  round(1 + sum(CASE WHEN retry THEN cm ELSE 0 END) / sum(fm), 6) AS latency_ratio FROM j GROUP BY family"""))
def stats_router_replay(spark, sf):
    return rounded(st.router_replay(replay_units(spark, sf)))


@query("stats_aggregate_retry", fx("""SELECT a.task_id * 100 + a.size AS unit, b.wall_latency_ms AS retry_wall_latency_ms,
  a.wall_latency_ms + b.wall_latency_ms AS wall_latency_ms, a.prompt_tokens + b.prompt_tokens AS prompt_tokens,
  a.completion_tokens + b.completion_tokens AS completion_tokens
FROM fx_expected a JOIN fx_expected b ON a.task_id = b.task_id AND a.size = b.size WHERE a.arm = 'raw' AND b.arm = 'min'"""))
def stats_aggregate_retry(spark, sf):
    e = expected(spark, sf).withColumn("unit", F.expr("task_id * 100 + size"))
    cols = ["unit", "wall_latency_ms", "prompt_tokens", "completion_tokens"]
    return st.aggregate_retry(e.where("arm = 'raw'").select(cols), e.where("arm = 'min'").select(cols), "unit")


@query("stats_token_glm")
def stats_token_glm(spark, sf):
    return token_glm(expected(spark, sf, "select"), ARMS)


# ---------------------------------------------------------------- calibration
def conf(spark, sf):
    return fixture(spark, sf, "fx_conf").withColumn("p", F.col("p").cast("double"))


@query("calib_reliability", fx(""", b AS (SELECT greatest(1, ceil(p * 10))::int AS bin, p::double AS p, y FROM fx_conf)
SELECT r.bin::int AS bin, (r.bin - 1) / 10 AS lo, r.bin / 10 AS hi, count(b.p) AS n, round(avg(b.p), 6) AS confidence,
  round(avg(b.y), 6) AS accuracy FROM range(1, 11) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin""", "fx_conf"))
def calib_reliability(spark, sf):
    return rounded(cal.reliability(conf(spark, sf)))


@query("calib_ece", fx(""", b AS (SELECT greatest(1, ceil(p * 10)) AS bin, p::double AS p, y FROM fx_conf),
 g AS (SELECT count(*) AS n, avg(p) AS c, avg(y) AS a FROM b GROUP BY bin) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM g""", "fx_conf"))
def calib_ece(spark, sf):
    return rounded(cal.ece(conf(spark, sf)))


@query("calib_scores", fx("""SELECT round(avg((p::double - y) * (p::double - y)), 6) AS brier,
  round(-avg(ln(greatest(CASE WHEN y = 1 THEN p::double ELSE 1 - p::double END, 0.0001))), 6) AS log_score FROM fx_conf""", "fx_conf"))
def calib_scores(spark, sf):
    return rounded(cal.scores(conf(spark, sf)))


@query("calib_brier_multiclass", fx(""", q AS (SELECT exp(z0) + exp(z1) + exp(z2) AS s, * FROM fx_conf)
SELECT round(avg(pow(exp(z0) / s - (gold = 0)::int, 2) + pow(exp(z1) / s - (gold = 1)::int, 2) + pow(exp(z2) / s - (gold = 2)::int, 2)), 6)
  AS brier_multiclass FROM q""", "fx_conf"))
def calib_brier_multiclass(spark, sf):
    c = conf(spark, sf).selectExpr("gold", "exp(z0) + exp(z1) + exp(z2) AS s", "z0", "z1", "z2")
    return rounded(cal.brier_multiclass(c.selectExpr("gold", "array(exp(z0) / s, exp(z1) / s, exp(z2) / s) AS probs"), "probs", "gold"))


CURVE = """, c AS (SELECT seq, row_number() OVER (ORDER BY p DESC, seq) AS k, sum(1 - y) OVER (ORDER BY p DESC, seq) AS wrong,
  count(*) OVER () AS n FROM fx_conf)"""


@query("calib_risk_coverage", fx(CURVE + " SELECT seq, k, round(k / n, 6) AS coverage, round(wrong / k, 6) AS risk FROM c", "fx_conf"))
def calib_risk_coverage(spark, sf):
    return rounded(cal.risk_coverage(conf(spark, sf)))


@query("calib_aurc", fx(CURVE + " SELECT round(avg(wrong / k), 6) AS aurc FROM c", "fx_conf"))
def calib_aurc(spark, sf):
    return rounded(cal.aurc(cal.risk_coverage(conf(spark, sf))))


@query("calib_coverage_at_risk", fx(CURVE + " SELECT round(coalesce(max(k / n) FILTER (WHERE wrong / k <= 0.4), 0), 6) AS coverage_at_risk FROM c", "fx_conf"))
def calib_coverage_at_risk(spark, sf):
    return rounded(cal.coverage_at_risk(cal.risk_coverage(conf(spark, sf)), 0.4))


@query("calib_temperature", fx(""", d AS (SELECT z0::double AS z0, z1::double AS z1, z2::double AS z2, gold, count(*) AS w FROM fx_conf GROUP BY ALL),
 r(pass, a, b) AS (SELECT 0, ln(0.05), ln(20.0) UNION ALL
  SELECT pass + 1, g[greatest(best - 1, 1)], g[least(best + 1, 33)] FROM (
   SELECT pass, list(gv ORDER BY i) AS g, arg_min(i, {'l': round(loss, 12), 'i': i}) AS best FROM (
    SELECT pass, i, any_value(gv) AS gv, sum(w * (ln(exp(z0 / exp(gv)) + exp(z1 / exp(gv)) + exp(z2 / exp(gv)))
       - CASE gold WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END / exp(gv))) / sum(w) AS loss
    FROM (SELECT r.pass, t.i, a + (b - a) * (t.i - 1) / 32.0 AS gv FROM r, range(1, 34) t(i) WHERE pass < 9) q, d GROUP BY pass, i) x GROUP BY pass) y)
 SELECT round(exp((a + b) / 2), 6) AS temperature, exp((a + b) / 2) NOT BETWEEN 0.0505 AND 20 / 1.01 AS at_bound FROM r WHERE pass = 9""", "fx_conf").replace("WITH ", "WITH RECURSIVE ", 1))
def calib_temperature(spark, sf):
    c = conf(spark, sf).selectExpr("array(cast(z0 as double), cast(z1 as double), cast(z2 as double)) AS z", "gold")
    return rounded(cal.fit_temperature(c, "z", "gold"))
