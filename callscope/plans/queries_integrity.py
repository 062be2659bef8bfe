"""Planning, completeness, overlays and ledgers over the derived results."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import integrity as ig
from callscope.plans.fixtures import fixture, with_fx
from callscope.plans.registry import query, rounded

ARMS, SIZES, REPS = ["raw", "min"], [5, 20], list(range(10))


def fx(sql: str, names: str = "fx_expected") -> str:
    return with_fx(names, sql)


def plan(spark, sf):
    t = fixture(spark, sf, "fx_tasks").selectExpr("task_id", "replicate", "cast(task_id % 2 as int) AS paraphrase_index")
    c = fixture(spark, sf, "fx_results_key").where("catalog_id IS NOT NULL").select("catalog_id", "replicate", "size").distinct()
    return ig.request_plan(t, c, ARMS, SIZES, REPS)


@query("plan_requests", fx("SELECT request_key, family, arm, catalog_id, size, task_id FROM fx_results_key", "fx_results_key"))
def plan_requests(spark, sf):
    return plan(spark, sf).select("request_key", "family", "arm", "catalog_id", "size", "task_id")


@query("plan_request_counts", fx("SELECT family, arm, count(*) AS n FROM fx_results_key GROUP BY 1, 2", "fx_results_key"))
def plan_request_counts(spark, sf):
    return ig.request_counts(plan(spark, sf), "family", "arm")


def flawed(spark, sf):
    """A plan with a key issued twice per hundred tasks, a catalog lacking a tool, and a doubled name."""
    p = plan(spark, sf)
    p = p.unionByName(p.where("family = 'arggen' AND task_id % 100 = 0"))
    k = fixture(spark, sf, "fx_results_key").where("catalog_id IS NOT NULL")
    m = k.selectExpr("catalog_id", "tool_name AS tool_id", "CASE WHEN tool_name = 'view' AND catalog_id = 'C5_R3' THEN 'click' ELSE tool_name END AS tool_name").distinct()
    m = m.where("NOT (catalog_id = 'C20_R1' AND tool_id = 'error')")
    t = fixture(spark, sf, "fx_tasks").selectExpr("task_id", "tool_name AS tool_id")
    return p, m, t


@query("plan_violations", fx(""" SELECT 'config_list' AS problem, 'sizes' AS detail
 UNION ALL SELECT 'duplicate_key', request_key FROM fx_results_key WHERE family = 'arggen' AND task_id % 100 = 0
 UNION ALL SELECT DISTINCT 'tool_name_twice', 'C5_R3|click' FROM fx_results_key WHERE catalog_id = 'C5_R3' AND tool_name = 'view'
   AND EXISTS (SELECT 1 FROM fx_results_key WHERE catalog_id = 'C5_R3' AND tool_name = 'click')
 UNION ALL SELECT DISTINCT 'target_not_in_catalog', 'C20_R1|error' FROM fx_results_key WHERE catalog_id = 'C20_R1' AND tool_name = 'error'""", "fx_results_key"))
def plan_violations(spark, sf):
    p, m, t = flawed(spark, sf)
    return ig.plan_violations(p, m, t, {"arms": ARMS, "sizes": [5, 5], "replicates": REPS})


def stored(spark, sf):
    """Stored rows: some keys lost, some twice, some nobody planned."""
    r = fixture(spark, sf, "fx_results_key").select("request_key", "task_id", "arm_no", "size")
    keep = r.where("(task_id + arm_no + size) % 50 <> 0")
    return keep.unionByName(keep.where("task_id % 70 = 3")).unionByName(
        r.where("task_id % 90 = 5").withColumn("request_key", F.concat("request_key", F.lit("|x")))).select("request_key")


STORED = """, s AS (SELECT request_key, task_id FROM fx_results_key WHERE (task_id + arm_no + size) % 50 <> 0)"""


@query("integrity_validate_rows", fx(STORED + """ SELECT request_key, 'missing' AS problem FROM fx_results_key WHERE (task_id + arm_no + size) % 50 = 0
 UNION ALL SELECT request_key, 'duplicate' FROM s WHERE task_id % 70 = 3
 UNION ALL SELECT request_key || '|x', 'unexpected' FROM fx_results_key WHERE task_id % 90 = 5""", "fx_results_key"))
def integrity_validate_rows(spark, sf):
    return ig.validate_rows(stored(spark, sf), plan(spark, sf))


@query("integrity_completeness", fx(STORED + """ SELECT (SELECT count(*) FROM s WHERE task_id % 70 = 3) AS duplicate, (SELECT count(*) FROM fx_results_key WHERE task_id % 90 = 5) AS unexpected,
  (SELECT count(*) FROM fx_results_key WHERE (task_id + arm_no + size) % 50 = 0) AS missing, false AS complete""", "fx_results_key"))
def integrity_completeness(spark, sf):
    return ig.completeness(stored(spark, sf), plan(spark, sf))


@query("integrity_todo", fx("SELECT request_key FROM fx_results_key WHERE (task_id + arm_no + size) % 50 = 0", "fx_results_key"))
def integrity_todo(spark, sf):
    return ig.todo(plan(spark, sf), stored(spark, sf)).select("request_key")


@query("integrity_drift", fx(""" SELECT request_key AS artefact, CASE task_id % 40 WHEN 0 THEN 'changed' WHEN 1 THEN 'gone' ELSE 'new' END AS state
 FROM fx_results_key WHERE task_id % 40 IN (0, 1, 2)""", "fx_results_key"))
def integrity_drift(spark, sf):
    r = fixture(spark, sf, "fx_results").selectExpr("request_key AS artefact", "raw_content", "task_id")
    old = r.where("task_id % 40 <> 2").select("artefact", F.sha2("raw_content", 256).alias("sha256"))
    new = r.where("task_id % 40 <> 1").select("artefact", F.sha2(F.expr("concat(raw_content, CASE WHEN task_id % 40 = 0 THEN ' ' ELSE '' END)"), 256).alias("sha256"))
    return ig.drift(old, new)


@query("integrity_determinism", fx("""SELECT arm, count(*) AS replayed, count_if(task_id % 200 = 7)::bigint AS different, min(request_key) FILTER (WHERE task_id % 200 = 7) AS first_mismatch
 FROM fx_results_key GROUP BY 1""", "fx_results_key"))
def integrity_determinism(spark, sf):
    r = fixture(spark, sf, "fx_results").select("arm", "request_key", "raw_content", "task_id")
    again = r.select("request_key", F.expr("CASE WHEN task_id % 200 = 7 THEN concat(raw_content, '.') ELSE raw_content END AS raw_content"))
    return ig.determinism_check(r, again, ["arm"])


def overlay(spark, sf):
    """Truncated constrained rows wait for a verdict; a few patches are malformed on purpose."""
    r = fixture(spark, sf, "fx_expected").selectExpr(
        "request_key", "task_id", "h", "CASE WHEN h = 19 THEN 'pending' END AS prefix_check", "false AS engine_error", "cast(null as string) AS request_error",
        "CASE WHEN h = 19 THEN NULL ELSE 'correct' END AS failure_class", "prompt_tokens")
    r = r.withColumn("fingerprint", ig.fingerprint("request_key", "prompt_tokens"))
    base = r.where("h = 19").select((F.col("task_id") * 10).alias("patch_id"), "request_key", "task_id", "fingerprint")
    p = base.selectExpr("patch_id", "CASE WHEN task_id % 11 = 5 THEN concat(request_key, '?') ELSE request_key END AS request_key",
                        "CASE WHEN task_id % 13 = 1 THEN 'stale' ELSE fingerprint END AS source_sha256",
                        "CASE WHEN task_id % 17 = 2 THEN 'maybe' WHEN task_id % 4 = 0 THEN 'true' ELSE 'false' END AS legal_prefix")
    late = r.where("h = 3 AND task_id % 7 = 0").selectExpr("task_id * 10 + 1 AS patch_id", "request_key", "fingerprint AS source_sha256", "'true' AS legal_prefix")
    twice = base.where("task_id % 19 = 4 AND task_id % 11 <> 5").selectExpr("patch_id + 2 AS patch_id", "request_key", "fingerprint AS source_sha256", "'true' AS legal_prefix")
    return ig.effective_rows(r, p.unionByName(late).unionByName(twice))


OK = "h = 19 AND task_id % 11 <> 5 AND task_id % 13 <> 1 AND task_id % 17 <> 2"


@query("overlay_effective_rows", fx(f""" SELECT request_key, CASE WHEN {OK} THEN CASE WHEN task_id % 4 = 0 THEN 'verified' ELSE 'illegal' END WHEN h = 19 THEN 'pending' END AS prefix_check,
  ({OK}) AND task_id % 4 <> 0 AS engine_error, CASE WHEN {OK} THEN CASE WHEN task_id % 4 = 0 THEN 'cd_truncated' ELSE 'engine_refusal' END WHEN h = 19 THEN NULL ELSE 'correct' END AS failure_class
 FROM fx_expected"""))
def overlay_effective_rows(spark, sf):
    return overlay(spark, sf)[0].select("request_key", "prefix_check", "engine_error", "failure_class")


@query("overlay_violations", fx(""" SELECT task_id * 10 AS patch_id, CASE WHEN task_id % 11 = 5 THEN request_key || '?' ELSE request_key END AS request_key,
   CASE WHEN task_id % 11 = 5 THEN 'unknown_key' WHEN task_id % 13 = 1 THEN 'wrong_fingerprint' ELSE 'verdict_not_boolean' END AS problem
  FROM fx_expected WHERE h = 19 AND (task_id % 11 = 5 OR task_id % 13 = 1 OR task_id % 17 = 2)
 UNION ALL SELECT task_id * 10 + 1, request_key, 'not_pending' FROM fx_expected WHERE h = 3 AND task_id % 7 = 0
 UNION ALL SELECT task_id * 10 + 2, request_key, 'duplicate_patch' FROM fx_expected WHERE h = 19 AND task_id % 19 = 4 AND task_id % 11 <> 5"""))
def overlay_violations(spark, sf):
    return overlay(spark, sf)[1]


CAPS = {"readiness": 60, "benchmark": 700}


@query("ledger_check", fx(""", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k, row_number() OVER (PARTITION BY category ORDER BY seq) AS c FROM fx_ledger)
SELECT 'repeated_key' AS problem, seq, key FROM n WHERE k > 1 UNION ALL SELECT 'over_cap', seq, key FROM n WHERE c > CASE category WHEN 'readiness' THEN 60 ELSE 700 END
 UNION ALL SELECT 'carried_prefix_changed', seq, key || '!' FROM n WHERE seq < 11 AND seq % 5 = 0
 UNION ALL SELECT 'historical_count_changed', NULL, w.category FROM (VALUES ('readiness', 4), ('benchmark', 7)) w(category, want)
   WHERE want <> (SELECT count(*) FROM n WHERE n.category = w.category AND seq < 11)""", "fx_ledger"))
def ledger_check(spark, sf):
    led = fixture(spark, sf, "fx_ledger")
    carried = led.where("seq < 11").withColumn("key", F.expr("CASE WHEN seq % 5 = 0 THEN concat(key, '!') ELSE key END"))
    return ig.ledger_check(led, CAPS, carried, {"readiness": 4, "benchmark": 7})


@query("ledger_spent", fx("SELECT category, count(*) AS spent, CASE category WHEN 'readiness' THEN 60 ELSE 700 END AS cap FROM fx_ledger GROUP BY 1", "fx_ledger"))
def ledger_spent(spark, sf):
    return ig.ledger_spent(fixture(spark, sf, "fx_ledger"), CAPS)


@query("integrity_assemble_arms", fx(""" SELECT CASE arm WHEN 'raw' THEN 'F0' ELSE 'C0' END || '|' || size || '/' || task_id AS request_key, CASE arm WHEN 'raw' THEN 'F0' ELSE 'C0' END AS arm,
   request_key AS source_request_key, 'reused' AS evidence_kind FROM fx_expected WHERE family = 'select'
 UNION ALL SELECT 'C1|' || size || '/' || task_id, 'C1', NULL, 'fresh' FROM fx_expected WHERE family = 'select' AND arm = 'min'"""))
def integrity_assemble_arms(spark, sf):
    e = fixture(spark, sf, "fx_expected").where("family = 'select'").selectExpr("request_key", "arm", "concat(size, '/', task_id) AS unit", "e2e_success")
    fresh = e.where("arm = 'min'").selectExpr("concat('C1|', unit) AS request_key", "'C1' AS arm", "unit", "e2e_success")
    return ig.assemble_arms(e, fresh, {"raw": "F0", "min": "C0"}).select("request_key", "arm", "source_request_key", "evidence_kind")


@query("integrity_pair_by_arm", fx(""" SELECT a.task_id, a.size, a.e2e_success AS e2e_success_a, b.e2e_success AS e2e_success_b FROM fx_expected a JOIN fx_expected b
 ON a.task_id = b.task_id AND a.size = b.size WHERE a.arm = 'raw' AND b.arm = 'min'"""))
def integrity_pair_by_arm(spark, sf):
    e = fixture(spark, sf, "fx_expected").select("task_id", "size", "arm", "e2e_success")
    return ig.pair_by_arm(e, "raw", "min", ["task_id", "size"], ["e2e_success"])


@query("run_report", fx(""", g AS (SELECT (SELECT count(*) FROM fx_results_key WHERE (task_id + arm_no + size) % 50 = 0) = 0 AS complete)
SELECT arm, count(*) AS n, round(100 * avg(e2e_success::int), 6) AS e2e, (SELECT complete FROM g) AS complete, (SELECT complete FROM g) AS paired_inference
 FROM fx_expected WHERE (task_id + arm_no + size) % 50 <> 0 GROUP BY 1"""))
def run_report(spark, sf):
    """Descriptive cells always; paired inference only when the stored keys equal the plan."""
    from callscope.plans.reports import run_report as report
    e = fixture(spark, sf, "fx_expected").where("(task_id + arm_no + size) % 50 <> 0")
    return rounded(report(e, plan(spark, sf))["cells"])
