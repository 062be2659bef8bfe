"""Readers and writers: what is written equals what is read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callscope.operators import integrity as ig
from callscope.operators import stats as st
from callscope.plans.fixtures import fixture, table, with_fx
from callscope.plans.queries_stats import CELL_SQL, expected
from callscope.plans.registry import query
from callscope.session import shared_dir
from callscope.sources import files as fs

ROW = "request_key string, task_id bigint, h bigint, raw_content string, wall_latency_ms double"


def fx(sql: str, names: str = "fx_results") -> str:
    return with_fx(names, sql)


def place(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def rows(spark, sf):
    return fixture(spark, sf, "fx_results").select("request_key", "task_id", "h", "raw_content", "wall_latency_ms")


ROUND_TRIP = fx("SELECT request_key, task_id, h, md5(raw_content) AS digest, wall_latency_ms FROM fx_results")


def _digest(df):
    return df.selectExpr("request_key", "task_id", "h", "md5(raw_content) AS digest", "wall_latency_ms")


@query("io_jsonl", ROUND_TRIP)
def io_jsonl(spark, sf):
    p = place(spark, "jsonl")
    rows(spark, sf).write.json(p)
    return _digest(fs.read_jsonl(spark, p, ROW))


@query("io_jsonl_gzip", ROUND_TRIP)
def io_jsonl_gzip(spark, sf):
    p = place(spark, "gz")
    rows(spark, sf).write.option("compression", "gzip").json(p)
    return _digest(fs.read_jsonl(spark, p, ROW))


@query("io_append_results", ROUND_TRIP)
def io_append_results(spark, sf):
    """Two overlapping appends store every key once."""
    p = place(spark, "append")
    r = rows(spark, sf)
    fs.append_results(r.where("task_id % 3 <> 0"), p, ROW)
    fs.append_results(r, p, ROW)
    return _digest(fs.read_jsonl(spark, p, ROW))


@query("io_prompt_store", fx("SELECT sha256(raw_content) AS sha, length(raw_content) AS chars FROM fx_results WHERE raw_content NOT IN (SELECT raw_content FROM fx_results WHERE h = 16) GROUP BY raw_content"))
def io_prompt_store(spark, sf):
    r = rows(spark, sf)
    have = fs.prompt_store(r.where("h = 16"), text="raw_content")
    return fs.prompt_store(r, have, "raw_content").select("sha", F.length("text").cast("bigint").alias("chars"))


@query("io_write_splits", fx("SELECT request_key, h % 3 AS split FROM fx_results"))
def io_write_splits(spark, sf):
    p = place(spark, "splits")
    fs.write_splits(rows(spark, sf).selectExpr("request_key", "h % 3 AS split"), p, ["split"])
    return spark.read.schema("request_key string, split bigint").json(p)


@query("io_manifest", "SELECT true AS all_equal, 8::bigint AS files")
def io_manifest(spark, sf):
    """Digests of a written table, taken twice."""
    p = place(spark, "manifest")
    rows(spark, sf).repartition(8).write.json(p)
    a, b = (ig.manifest(spark, p).where("artefact LIKE '%.json'") for _ in range(2))
    return a.join(b.selectExpr("artefact", "sha256 AS again"), "artefact").agg(F.expr("bool_and(sha256 = again)").alias("all_equal"), F.count(F.lit(1)).alias("files"))


LINE = """CASE WHEN event_id % 50 = 0 THEN 'LLG error: bad grammar at ' || cast(event_id AS string) WHEN event_id % 50 = 1 THEN 'llguidance is Not enabled'
  WHEN event_id % 50 = 2 THEN 'llguidance ready' WHEN event_id % 50 = 3 THEN '  ' || cast(user_id * 1000 + event_id AS string) || '  maximum resident set size'
  ELSE 'served ' || cast(event_id AS string) END"""


def log(spark, sf):
    p = place(spark, "log")
    table(spark, sf, "events").select(F.expr(f"{LINE} AS value")).write.text(p)
    return spark.read.text(p)


@query("log_errors", f"WITH l AS (SELECT event_id, {LINE} AS value FROM events) SELECT value, count(*) AS n FROM l WHERE event_id % 50 IN (0, 1) GROUP BY 1")
def log_errors(spark, sf):
    return fs.log_errors(log(spark, sf)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("log_peak", "SELECT max(user_id * 1000 + event_id)::bigint AS peak FROM events WHERE event_id % 50 = 3")
def log_peak(spark, sf):
    return fs.log_peak(log(spark, sf), r"(\d+)\s+maximum resident set size")


@query("metric_lookup", f"""WITH c AS ({CELL_SQL}) SELECT 'main' AS kind, 'size=' || size || ',arm=' || arm AS selector, unnest(['e2e', 'n', 'latency_ms_cached']) AS field,
  unnest([e2e::double, n::double, latency_ms_cached::double]) AS value FROM c""")
def metric_lookup(spark, sf):
    """Three published numbers per cell resolved through their addresses."""
    r = expected(spark, sf, "select")
    m = fs.metric_table(("main", st.cell_table(r), ["size", "arm"]))
    keys = r.select("size", "arm").distinct().select(F.lit("main").alias("kind"), F.expr("concat('size=', size, ',arm=', arm)").alias("selector"),
                                                    F.explode(F.array(F.lit("e2e"), F.lit("n"), F.lit("latency_ms_cached"))).alias("field"))
    return fs.lookup(keys, m).select("kind", "selector", "field", F.round("value", 6).alias("value"))
