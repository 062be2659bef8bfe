"""Run planning, completeness, drift, overlays and ledgers."""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.operators.ranking import running_totals


# ---------------------------------------------------------------- plan
def request_plan(tasks: DataFrame, catalogs: DataFrame, arms: list[str], sizes: list[int], replicates: list[int],
                 families: tuple[str, ...] = ("select", "arggen"), paraphrases: list[int] | None = None,
                 task_ids: DataFrame | None = None) -> DataFrame:
    """Every planned request with its key family|arm|catalog|task.

    tasks: task_id, replicate, paraphrase_index; catalogs: catalog_id, replicate, size. The catalog side is
    matched on its replicate, arms are a short literal array.
    """
    t = tasks.where(F.col("replicate").isin(replicates))
    if paraphrases is not None:
        t = t.where(F.col("paraphrase_index").isin(paraphrases))
    if task_ids is not None:
        t = t.join(task_ids, "task_id", "left_semi")
    t = t.select("task_id", "replicate").withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    parts = []
    if "select" in families:
        c = catalogs.where(F.col("size").isin(sizes)).select("catalog_id", "replicate", "size")
        parts.append(t.join(c, "replicate").select(F.lit("select").alias("family"), "arm", "catalog_id", "size", "replicate", "task_id"))
    if "arggen" in families:
        parts.append(t.select(F.lit("arggen").alias("family"), "arm", F.lit(None).cast("string").alias("catalog_id"),
                              F.lit(1).alias("size"), "replicate", "task_id"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("request_key", F.concat_ws("|", "family", "arm", F.coalesce("catalog_id", F.lit("single")), F.col("task_id").cast("string")))


def plan_violations(plan: DataFrame, members: DataFrame, tasks: DataFrame, cfg: dict, invalid_gold: DataFrame | None = None) -> DataFrame:
    """(problem, detail) rows: config lists, duplicate keys, catalog membership, duplicate tool names, invalid gold.

    members: catalog_id, tool_id, tool_name; tasks: task_id, tool_id.
    """
    spark = plan.sparkSession
    bad = [("config_list", k) for k, v in cfg.items() if not v or len(v) != len(set(v))]
    out = spark.createDataFrame(bad, "problem string, detail string")
    parts = [
        plan.groupBy("request_key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.lit("duplicate_key").alias("problem"), F.col("request_key").alias("detail")),
        members.groupBy("catalog_id", "tool_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        .select(F.lit("tool_twice_in_catalog").alias("problem"), F.concat_ws("|", "catalog_id", "tool_id").alias("detail")),
        members.select("catalog_id", "tool_id", "tool_name").distinct().groupBy("catalog_id", "tool_name").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        .select(F.lit("tool_name_twice").alias("problem"), F.concat_ws("|", "catalog_id", "tool_name").alias("detail")),
        plan.where("catalog_id IS NOT NULL").join(tasks.select("task_id", "tool_id"), "task_id").select("catalog_id", "tool_id").distinct()
        .join(members.select("catalog_id", "tool_id"), ["catalog_id", "tool_id"], "left_anti")
        .select(F.lit("target_not_in_catalog").alias("problem"), F.concat_ws("|", "catalog_id", "tool_id").alias("detail")),
    ]
    if invalid_gold is not None:
        parts.append(invalid_gold.select(F.lit("gold_invalid").alias("problem"), F.col("task_id").cast("string").alias("detail")))
    for p in parts:
        out = out.unionByName(p)
    return out


def request_counts(plan: DataFrame, *by: str) -> DataFrame:
    return plan.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def validate_rows(rows: DataFrame, expected: DataFrame, key: str = "request_key") -> DataFrame:
    """(problem, key): stored twice, stored but not planned, planned but not stored.

    One aggregation over both sides; the counts combine map-side.
    """
    both = rows.select(key, F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(expected.select(key, F.lit(0).alias("s"), F.lit(1).alias("p")))
    c = both.groupBy(key).agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    return c.select(key, F.explode(F.expr("""filter(array(CASE WHEN s > 1 THEN 'duplicate' END, CASE WHEN p = 0 THEN 'unexpected' END,
        CASE WHEN s = 0 THEN 'missing' END), x -> x IS NOT NULL)""")).alias("problem"))


def completeness(rows: DataFrame, expected: DataFrame, key: str = "request_key") -> DataFrame:
    v = validate_rows(rows, expected, key)
    return v.agg(*[F.count_if(F.col("problem") == p).alias(p) for p in ("duplicate", "unexpected", "missing")]).withColumn(
        "complete", F.expr("duplicate = 0 AND unexpected = 0 AND missing = 0"))


def todo(plan: DataFrame, done: DataFrame, key: str = "request_key") -> DataFrame:
    return plan.join(done.select(key), key, "left_anti")


# ---------------------------------------------------------------- drift
@F.pandas_udf(T.StringType())
def _streamed_sha256(path: pd.Series) -> pd.Series:
    """Digest of each local file, read in pieces."""
    def one(p):
        with open(p.removeprefix("file:"), "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    return path.map(one)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256 per file below a folder. Files of a mounted folder are streamed, others are held one at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mounted = all(f.startswith("file:") for f in files.inputFiles())
    sha = _streamed_sha256("path") if mounted else F.sha2("content", 256)
    return files.select(F.col("path").alias("artefact"), sha.alias("sha256"), "length")


def drift(old: DataFrame, new: DataFrame, key: str = "artefact", sha: str = "sha256") -> DataFrame:
    """Artefacts whose digest changed, appeared or went away."""
    j = old.select(key, F.col(sha).alias("o")).join(new.select(key, F.col(sha).alias("n")), key, "full")
    return j.where(~F.col("o").eqNullSafe(F.col("n"))).select(
        key, F.expr("CASE WHEN o IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' ELSE 'changed' END").alias("state"))


def determinism_check(baseline: DataFrame, replay: DataFrame, group: list[str], key: str = "request_key", text: str = "raw_content") -> DataFrame:
    """Replayed rows that differ from the baseline byte for byte, with the first such key."""
    digest = F.unhex(F.sha2(text, 256))  # half the bytes of its hex in the shuffle
    j = baseline.select(*group, key, digest.alias("b")).join(replay.select(key, digest.alias("r")).hint("merge"), key)
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("replayed"), F.count_if(F.expr("b <> r")).alias("different"),
                                 F.min(F.when(F.expr("b <> r"), F.col(key))).alias("first_mismatch"))


# ---------------------------------------------------------------- overlay
def effective_rows(rows: DataFrame, patches: DataFrame, key: str = "request_key") -> tuple[DataFrame, DataFrame]:
    """Apply append-only verdicts to pending rows; returns (effective rows, violations).

    rows: key, prefix_check, fingerprint, engine_error, request_error, failure_class; patches: patch_id, key,
    source_sha256, legal_prefix (text). A patch that repeats, misses its row, hits a settled row, carries
    another fingerprint or no boolean verdict is reported and not applied. Originals stay as they are.
    The sides are merged: derived rows are many times the file that they are estimated by, too many to broadcast.
    """
    first = patches.groupBy(key).agg(F.min("patch_id").alias("_first"))
    p = patches.join(first.hint("merge"), key).join(rows.select(key, F.col("prefix_check").alias("_state"), F.col("fingerprint").alias("_fp"), F.lit(True).alias("_known")).hint("merge"), key, "left")
    p = p.withColumn("problem", F.expr("""CASE WHEN _known IS NULL THEN 'unknown_key' WHEN patch_id <> _first THEN 'duplicate_patch'
        WHEN NOT _state <=> 'pending' THEN 'not_pending' WHEN NOT _fp <=> source_sha256 THEN 'wrong_fingerprint'
        WHEN NOT coalesce(legal_prefix IN ('true', 'false'), false) THEN 'verdict_not_boolean' END"""))
    good = p.where("problem IS NULL").select(key, (F.col("legal_prefix") == "true").alias("_legal"))
    e = rows.join(good.hint("merge"), key, "left")
    set_ = lambda c, v: F.when(F.col("_legal").isNotNull(), v).otherwise(F.col(c)).alias(c)
    changed = {"prefix_check": F.expr("if(_legal, 'verified', 'illegal')"), "engine_error": ~F.col("_legal"),
               "request_error": F.expr("if(_legal, NULL, 'engine_or_request_fault')"),
               "failure_class": F.expr("if(_legal, 'cd_truncated', 'engine_refusal')")}
    return (e.select(*[set_(c, changed[c]) if c in changed else F.col(c) for c in rows.columns]),
            p.where("problem IS NOT NULL").select("patch_id", key, "problem"))


def fingerprint(*cols: str):
    """Digest of named values in column order."""
    return F.sha2(F.concat_ws("\u0001", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) for c in cols]), 256)


# ---------------------------------------------------------------- ledger
def ledger_check(ledger: DataFrame, caps: dict[str, int], carried: DataFrame | None = None, expected: dict[str, int] | None = None) -> DataFrame:
    """(problem, seq, key): repeated keys, rows over the cap of their category, changed carried-over prefix, and categories
    (as key, without seq) of which the prefix holds another number of rows than expected.

    ledger: seq, category, key. The running count per category never gathers a category in one task.
    """
    first = ledger.groupBy("key").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    rep = ledger.join(first, "key").where("seq <> _first").select(F.lit("repeated_key").alias("problem"), "seq", "key")
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    n = running_totals(ledger, ["category"], ["seq"], {"_n": "1"}).where(F.col("_n") > cap[F.col("category")])
    out = rep.unionByName(n.select(F.lit("over_cap").alias("problem"), "seq", "key"))
    if carried is not None:
        j = carried.select("seq", F.col("key").alias("_k"), F.col("category").alias("_c")).join(ledger, "seq", "left")
        out = out.unionByName(j.where("NOT (key <=> _k AND category <=> _c)").select(F.lit("carried_prefix_changed").alias("problem"), "seq", F.col("_k").alias("key")))
        if expected is not None:
            have = ledger.join(carried.select("seq"), "seq", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
            want = ledger.sparkSession.createDataFrame(list(expected.items()), "category string, _want bigint")
            off = want.join(have, "category", "full").where("coalesce(_n, 0) <> coalesce(_want, 0)")
            out = out.unionByName(off.select(F.lit("historical_count_changed").alias("problem"), F.lit(None).cast("bigint").alias("seq"), F.col("category").alias("key")))
    return out


def ledger_spent(ledger: DataFrame, caps: dict[str, int]) -> DataFrame:
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    return ledger.groupBy("category").agg(F.count(F.lit(1)).alias("spent")).withColumn("cap", cap[F.col("category")])


# ---------------------------------------------------------------- arms
def assemble_arms(baseline: DataFrame, fresh: DataFrame, relabel: dict[str, str], key: str = "request_key") -> DataFrame:
    """Baseline rows under their new arm names, with where they came from, unioned with fresh rows."""
    m = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])
    old = (baseline.where(F.col("arm").isin(list(relabel))).withColumn("source_request_key", F.col(key))
           .withColumn("arm", m[F.col("arm")]).withColumn("evidence_kind", F.lit("reused"))
           .withColumn(key, F.concat_ws("|", "arm", "unit")))
    return old.unionByName(fresh.withColumn("evidence_kind", F.lit("fresh")), allowMissingColumns=True)


def pair_by_arm(rows: DataFrame, a: str, b: str, on: list[str], cols: list[str]) -> DataFrame:
    """Rows of arm a beside arm b on the remaining key parts (one aggregation, no string surgery)."""
    aggs = [F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{c}_{n}") for n, arm in (("a", a), ("b", b)) for c in cols]
    return (rows.where(F.col("arm").isin(a, b)).groupBy(*on).agg(*aggs, F.count_distinct("arm").alias("_arms"))
            .where("_arms = 2").drop("_arms"))
