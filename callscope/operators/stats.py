"""Experiment statistics over a results table (one row per request and its outcome columns)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators.ranking import exact_quantiles, running_totals
from callscope.session import cut_lineage

OUTCOMES = ("tool_correct", "arg_exact_match", "schema_valid", "json_valid", "semantic_correct", "e2e_success",
            "e2e_strict")


def share(col: str, where: str | None = None) -> Column:
    """Mean of a boolean column."""
    c = F.col(col).cast("double")
    return F.avg(F.when(F.expr(where), c) if where else c)


# ---------------------------------------------------------------- exact tests and intervals
def _lnfact(x: str) -> str:
    return (f"(CASE WHEN {x} <= 20 THEN ln(cast(factorial(cast(least({x}, 20) as int)) as double)) "
            f"ELSE {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1.0D / (12.0D * {x}) "
            f"- 1.0D / (360.0D * pow({x}, 3)) + 1.0D / (1260.0D * pow({x}, 5)) END)")


def mcnemar_exact(n01: str, n10: str) -> Column:
    """Two-sided binomial(1/2) on the discordant counts; 1 when there are none.

    Sums the tail downwards from its largest term; terms more than 10*sqrt(n) below it are
    under e-80 of the sum and cannot change a double.
    """
    n, k = f"cast({n01} + {n10} as double)", f"cast(least({n01}, {n10}) as double)"
    top = f"({_lnfact('z.n')} - {_lnfact('z.k')} - {_lnfact('(z.n - z.k)')} - z.n * ln(2.0D))"
    tail = f"""aggregate(sequence(0, cast(least(z.k, 10 * sqrt(z.n) + 100) as int)),
        named_struct('t', {top}, 's', 0.0D),
        (a, i) -> named_struct('t', a.t + CASE WHEN z.k - i > 0 THEN ln((z.k - i) / (z.n - z.k + i + 1)) ELSE 0.0D END,
                               's', a.s + exp(a.t)), a -> a.s)"""
    return F.expr(f"""CASE WHEN {n01} + {n10} = 0 OR {n01} = {n10} THEN 1.0D ELSE
        least(1.0D, 2 * transform(array(named_struct('n', {n}, 'k', {k})), z -> {tail})[0]) END""")


def odds_ratio(df: DataFrame, b_only: str = "discordant_b_only", a_only: str = "discordant_a_only") -> DataFrame:
    """Discordant odds ratio with +0.5 correction and Wald interval on the log scale."""
    b, a = F.col(b_only) + 0.5, F.col(a_only) + 0.5
    se = F.sqrt(1 / b + 1 / a)
    return (df.withColumn("odds_ratio", b / a)
            .withColumn("or_low", F.exp(F.log(b / a) - 1.96 * se))
            .withColumn("or_high", F.exp(F.log(b / a) + 1.96 * se)))


def holm(df: DataFrame, p: str, family: list[str], seq: str, out: str = "holm_p") -> DataFrame:
    """Step-down adjustment with running maximum, capped at 1 (one row per test: small by nature)."""
    w = Window.partitionBy(*family).orderBy(p, seq)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    df = df.withColumn("_step", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return df.withColumn(out, F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


# ---------------------------------------------------------------- cluster bootstrap
def cluster_bootstrap(sums: DataFrame, group: list[str], cluster: str, total: str, n: str, draws: int = 5000,
                      seed: int = 0, out: tuple[str, str] = ("ci_low", "ci_high")) -> DataFrame:
    """Percentile interval of a mean, resampling clusters with replacement.

    ``sums`` already holds one (total, n) row per (group, cluster), so a draw costs clusters, not rows. Draws are dealt out
    before their slots are made: a task holds some draws of a group, never all of them.
    The draw for slot s of replicate b is md5("seed:b:s") modulo the number of clusters.
    """
    g = group or ["_all"]
    src = sums if group else sums.withColumn("_all", F.lit(1))
    idx = running_totals(src.select(*g, F.col(cluster).alias("_c"), F.col(total).alias("_s"), F.col(n).alias("_m")), g, ["_c"],
                         {"_i": "cast(1 as bigint)"}).withColumn("_i", F.col("_i") - 1)
    size = idx.groupBy(*g).agg(F.count(F.lit(1)).alias("_r"))
    slots = (size.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(*g, "_b")
             .withColumn("_slot", F.explode(F.expr("sequence(0, cast(_r as int) - 1)")))
             .withColumn("_i", F.expr(f"cast(conv(substr(md5(concat('{seed}:', _b, ':', _slot)), 1, 8), 16, 10) as bigint) % _r")))
    est = (slots.join(idx, g + ["_i"]).groupBy(*g, "_b")
           .agg((F.sum("_s") / F.sum("_m")).alias("_e")))
    rk = est.withColumn("_k", F.row_number().over(Window.partitionBy(*g).orderBy("_e")))
    lo, hi = int(0.025 * draws) + 1, int(0.975 * draws)
    return (rk.where(F.col("_k").isin(lo, hi)).groupBy(*g)
            .agg(F.min("_e").alias(out[0]), F.max("_e").alias(out[1])).drop("_all"))


# ---------------------------------------------------------------- tables
def cell_table(results: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """Main table by (size, arm); ``latency`` is the uncached sub-run whose median is joined."""
    key = ["size", "arm"]
    cells = results.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("replicate").alias("n_replicates"),
        share("tool_correct").alias("selection"), share("arg_exact_match").alias("arg_em"),
        F.avg(F.col("field_acc").cast("double")).alias("field_acc"), share("schema_valid").alias("schema_valid"),
        share("json_valid").alias("json_valid"), share("e2e_success").alias("e2e"),
        share("e2e_strict").alias("e2e_strict"),
        # one request without a token count makes the cell mean unknown
        F.when(F.count_if(F.col("prompt_tokens").isNull()) > 0, F.lit(float("nan")))
        .otherwise(F.avg("prompt_tokens")).alias("input_tokens"),
        F.when(F.count_if(F.col("completion_tokens").isNull()) > 0, F.lit(float("nan")))
        .otherwise(F.avg("completion_tokens")).alias("output_tokens"),
        F.count_if(F.col("failure_primary") == "context-length failure").alias("context_failures"),
        F.count_if(F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated"))
    cells = cells.join(exact_quantiles(results, key, "wall_latency_ms", {"latency_ms_cached": 0.5}), key, "left")
    if latency is not None:
        un = exact_quantiles(latency.where("http_status = 200"), key, "wall_latency_ms", {"latency_ms_uncached": 0.5})
        cells = cells.join(un, key, "left")
    return cells


def arggen_table(results: DataFrame) -> DataFrame:
    """Fixed-tool family by arm."""
    return results.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), share("json_valid").alias("json_valid"),
        share("tool_correct").alias("tool_echo_correct"), share("arg_exact_match").alias("arg_em"),
        F.avg(F.col("field_acc").cast("double")).alias("field_acc"), share("schema_valid").alias("schema_valid"),
        share("semantic_correct").alias("semantic_correct"), share("e2e_success").alias("e2e"),
        share("e2e_strict").alias("e2e_strict"), F.avg("prompt_tokens").alias("input_tokens"))


def decompose(results: DataFrame, group: list[str], klass: str = "ceiling") -> DataFrame:
    """Counts per ceiling class and the decoding-only bounds, for any grouping."""
    names = ("malformed", "wrong_tool", "invalid_only", "invalid_wrong", "valid_wrong")
    agg = results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(klass) == "success").alias("success"),
        *[F.count_if(F.col(klass) == c).alias(c) for c in names])
    pct = lambda e: F.expr(f"100.0D * ({e}) / n")
    return (agg.withColumn("structural", F.expr("malformed + invalid_only + invalid_wrong"))
            .withColumn("success_pct", pct("success"))
            .withColumn("cd_upper_bound_pct", pct("success + malformed + invalid_only + invalid_wrong"))
            .withColumn("cd_conservative_pct", pct("success + invalid_only"))
            .withColumn("semantic_floor_pct", pct("valid_wrong + wrong_tool")))


def run_cells(results: DataFrame) -> DataFrame:
    """Second cell form: engine-ok rate, request errors by kind, classes, nearest-rank latencies.

    Constrained truncations and non-200 rows stay out of the failure classes.
    """
    key = ["family", "size", "arm"]
    r = (results.withColumn("_ok", F.expr("http_status = 200 AND coalesce(request_error, '') = ''"))
         .withColumn("_cut", F.expr("_ok AND decoding = 'constrained' AND coalesce(truncated, false)")))
    kinds = ("context_error", "engine_error", "transport_error", "http_error")
    classes = ("malformed", "wrong_tool", "invalid_only", "invalid_wrong", "valid_wrong")
    cells = r.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("engine_error")).alias("engine_errors"),
        F.count_if(F.col("lookalike")).alias("lookalike_key"),
        F.expr("map_from_arrays(array({}), array({}))".format(
            ", ".join(f"'{k}'" for k in kinds),
            ", ".join(f"count_if(NOT _ok AND coalesce(request_error, 'http_error') = '{k}')" for k in kinds))
        ).alias("request_errors"),
        F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated"),
        (100 * share("tool_correct")).alias("tool"), (100 * share("schema_valid")).alias("schema_valid"),
        (100 * share("semantic_correct")).alias("semantic"), (100 * share("arg_exact_match")).alias("arg_em"),
        (100 * F.avg(F.col("field_acc").cast("double"))).alias("field_acc"),
        (100 * share("e2e_success")).alias("e2e"), (100 * share("e2e_strict")).alias("e2e_strict"),
        (100 * share("e2e_success", "NOT engine_error")).alias("e2e_engine_ok"),
        *[F.count_if(F.expr(f"_ok AND NOT _cut AND ceiling = '{c}'")).alias(f"class_{c}") for c in classes],
        F.count_if(F.col("_cut")).alias("cd_truncated"), F.count_if(F.col("_ok")).alias("responses"),
        F.avg(F.coalesce("prompt_tokens", F.lit(0))).alias("in_tokens"),
        F.avg(F.coalesce("completion_tokens", F.lit(0))).alias("out_tokens"))
    lat = exact_quantiles(r.where("_ok"), key, "wall_latency_ms",
                          {"lat_p50": 0.5, "lat_p95": 0.95, "lat_p99": 0.99}, "nearest")
    cells = cells.join(lat, key, "left")
    return cells.withColumn("lat_p99", F.expr("CASE WHEN responses >= 200 THEN lat_p99 END"))


def failure_counts(results: DataFrame) -> DataFrame:
    """Primary failures by (arm, size) and over all sizes, secondary labels over all sizes."""
    prim = (results.where("failure_primary IS NOT NULL")
            .selectExpr("arm", "cast(size as string) AS size", "failure_primary AS failure")
            .rollup("arm", "failure", "size").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
            .where("_g IN (0, 1)")
            .selectExpr("'primary' AS level", "arm", "coalesce(size, 'all') AS size", "failure", "n"))
    sec = (results.where("failure_primary IS NOT NULL").select("arm", F.explode("failure_secondary").alias("failure"))
           .groupBy("arm", "failure").agg(F.count(F.lit(1)).alias("n"))
           .selectExpr("'secondary' AS level", "arm", "'all' AS size", "failure", "n"))
    return prim.unionByName(sec)


def latency_observations(results: DataFrame) -> DataFrame:
    """Observations of answered requests as rows, milliseconds rounded half to even."""
    return (results.where("http_status = 200")
            .select("size", "arm", "request_key", F.bround("wall_latency_ms").cast("bigint").alias("observation_ms"),
                    "prompt_tokens"))


def latency_cells(results: DataFrame) -> DataFrame:
    ok, key = results.where("http_status = 200"), ["size", "arm"]
    return (ok.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .join(exact_quantiles(ok, key, "wall_latency_ms", {"median_ms": 0.5}), key)
            .join(exact_quantiles(ok, key, "prompt_tokens", {"median_prompt_tokens": 0.5}), key))


def cell_scatter(results: DataFrame) -> DataFrame:
    return results.groupBy("catalog_id", "arm").agg(F.avg("prompt_tokens").alias("mean_tokens"),
                                                    share("e2e_success").alias("success"))


# ---------------------------------------------------------------- paired comparisons
def pair_table(results: DataFrame, on: list[str], side: str, sides: list, values: list[str],
               carry: list[str]) -> DataFrame:
    """One row per pairing key with the outcomes of every side (one shuffle for all comparisons)."""
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in carry if c not in on]
    for s in sides:
        for v in values:
            aggs.append(F.max(F.when(F.col(side) == s, F.col(v).cast("int"))).alias(f"{v}@{s}"))
    return results.where(F.col(side).isin(list(sides))).groupBy(*on).agg(*aggs)


def paired_sums(pairs: DataFrame, plan: list[dict], cluster: str, extra: list[str] = ()) -> DataFrame:
    """Per (comparison, cluster) counts for a whole plan in one pass over the pair table.

    Each plan entry: name, a, b, metric, optional where (SQL over carried columns).
    """
    lit = lambda s: "'" + str(s).replace("'", "''") + "'"
    items = ", ".join(
        "CASE WHEN {w} AND {a} IS NOT NULL AND {b} IS NOT NULL THEN named_struct('name', {n}, 'seq', {i}, 'a', {a}, 'b', {b}) END"
        .format(w=f"({c.get('where') or 'true'})", a=f"`{c['metric']}@{c['a']}`", b=f"`{c['metric']}@{c['b']}`",
                n=lit(c["name"]), i=i) for i, c in enumerate(plan))
    long = pairs.select(cluster, *extra, F.explode(F.expr(f"filter(array({items}), c -> c IS NOT NULL)")).alias("c"))
    return long.groupBy("c.name", "c.seq", cluster, *extra).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c.a").alias("sa"), F.sum("c.b").alias("sb"),
        F.count_if(F.expr("c.a = 1 AND c.b = 0")).alias("n10"), F.count_if(F.expr("c.a = 0 AND c.b = 1")).alias("n01"),
        F.sum(F.expr("c.b - c.a")).alias("sd"))


def summarise_pairs(sums: DataFrame, cluster: str, draws: int = 5000, seed: int = 1) -> DataFrame:
    """Accuracy, difference with cluster-bootstrap interval, exact test and odds ratio per comparison."""
    sums = cut_lineage(sums)  # read by the totals and by every part of the bootstrap; outcomes are scored once
    tot = sums.groupBy("name", "seq").agg(
        F.sum("n").alias("n_pairs"), (F.sum("sa") / F.sum("n")).alias("acc_a"), (F.sum("sb") / F.sum("n")).alias("acc_b"),
        F.sum("n10").alias("discordant_a_only"), F.sum("n01").alias("discordant_b_only"))
    ci = cluster_bootstrap(sums, ["name"], cluster, "sd", "n", draws, seed)
    out = (tot.join(ci, "name")
           .withColumn("diff_pp", F.expr("100 * (acc_b - acc_a)"))
           .withColumn("rel_improvement_pct", F.expr("CASE WHEN acc_a > 0 THEN 100 * (acc_b - acc_a) / acc_a END"))
           .withColumn("ci_low", 100 * F.col("ci_low")).withColumn("ci_high", 100 * F.col("ci_high"))
           .withColumn("mcnemar_p", mcnemar_exact("discordant_b_only", "discordant_a_only")))
    return odds_ratio(out)


def run_comparisons(results: DataFrame, plan: list[dict], cluster: str = "replicate", draws: int = 5000,
                    on: tuple[str, ...] = ("catalog_id", "task_id")) -> DataFrame:
    """All planned comparisons; Holm over the non-primary ones, each primary keeps its own p."""
    sides = sorted({c["a"] for c in plan} | {c["b"] for c in plan})
    pairs = pair_table(results, list(on), "arm", sides, sorted({c["metric"] for c in plan}),
                       [cluster, "size", "stratum", "family"])
    out = summarise_pairs(paired_sums(pairs, plan, cluster), cluster, draws)
    prim = [c["name"] for c in plan if c.get("primary")]
    fam = F.create_map(*[F.lit(x) for c in plan for x in (c["name"], c.get("multiplicity", "secondary"))])
    out = (out.withColumn("primary", F.col("name").isin(prim) if prim else F.lit(False))
           .withColumn("multiplicity", F.when(F.col("primary"), F.concat(F.lit("primary:"), "name"))
                       .otherwise(fam[F.col("name")])))
    return holm(out, "mcnemar_p", ["multiplicity"], "seq")


def decision_rule(comparisons: DataFrame, min_pp: float = 8.0) -> DataFrame:
    """Effect is large enough and its interval excludes zero."""
    return comparisons.withColumn("rule_met", (F.col("diff_pp") >= min_pp) & (F.col("ci_low") > 0))


def did_by_size(results: DataFrame, a: str, b: str, sizes: list[int], metric: str = "e2e_success",
                draws: int = 5000, seed: int = 2) -> DataFrame:
    """Difference-in-differences of the paired effect against the smallest size."""
    base = min(sizes)
    aggs = [F.max(F.when((F.col("arm") == arm) & (F.col("size") == s), F.col(metric).cast("int"))).alias(f"{x}{s}")
            for x, arm in (("a", a), ("b", b)) for s in sizes]
    wide = results.groupBy("replicate", "task_id").agg(*aggs)
    for s in sizes:
        wide = wide.withColumn(f"e{s}", F.col(f"b{s}") - F.col(f"a{s}"))
    rows = ", ".join(f"named_struct('size', {s}, 'e', e{s}, 'd', e{s} - e{base})" for s in sizes)
    long = wide.select("replicate", F.expr(f"inline(array({rows}))"))
    sums = long.groupBy("size", "replicate").agg(
        F.sum("e").alias("se"), F.count("e").alias("ne"), F.sum("d").alias("sd"), F.count("d").alias("nd"),
        F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"))
    tot = sums.groupBy("size").agg(*[F.sum(c).alias(c) for c in ("se", "ne", "sd", "nd", "pos", "neg")])
    base_eff = tot.where(F.col("size") == base).select((100 * F.col("se") / F.col("ne")).alias("effect_at_base_pp"))
    later = sums.where((F.col("size") != base) & (F.col("nd") > 0))
    ci = cluster_bootstrap(later, ["size"], "replicate", "sd", "nd", draws, seed)
    out = (tot.where((F.col("size") != base) & (F.col("nd") > 0)).join(F.broadcast(base_eff)).join(ci, "size")
           .withColumn("effect_at_size_pp", F.expr("100 * se / ne")).withColumn("did_pp", F.expr("100 * sd / nd"))
           .withColumn("ci_low", 100 * F.col("ci_low")).withColumn("ci_high", 100 * F.col("ci_high"))
           .withColumn("sign_test_p", mcnemar_exact("pos", "neg")))
    return (holm(out.withColumn("_f", F.lit(1)), "sign_test_p", ["_f"], "size")
            .select("size", F.lit(base).alias("vs_size"), F.col("nd").alias("n_tasks"), "effect_at_size_pp",
                    "effect_at_base_pp", "did_pp", "ci_low", "ci_high", F.col("neg").alias("n_more_negative"),
                    F.col("pos").alias("n_more_positive"), "sign_test_p", "holm_p"))


def degradation(results: DataFrame, sizes: list[int], metric: str = "e2e_success") -> DataFrame:
    """Each size against the smallest on the same task, per arm; first significant drop marked."""
    base = min(sizes)
    wide = results.groupBy("arm", "task_id").agg(
        *[F.max(F.when(F.col("size") == s, F.col(metric).cast("int"))).alias(f"v{s}") for s in sizes])
    rows = ", ".join(f"named_struct('size', {s}, 'a', v{base}, 'b', v{s})" for s in sizes if s != base)
    long = wide.select("arm", F.expr(f"inline(array({rows}))")).where("a IS NOT NULL AND b IS NOT NULL")
    out = long.groupBy("arm", "size").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg(F.expr("b - a"))).alias("diff_pp"),
        F.count_if(F.expr("a = 1 AND b = 0")).alias("n10"), F.count_if(F.expr("a = 0 AND b = 1")).alias("n01"))
    out = holm(out.withColumn("p", mcnemar_exact("n01", "n10")), "p", ["arm"], "size")
    first = F.min(F.when((F.col("diff_pp") < 0) & (F.col("holm_p") < 0.05), F.col("size"))).over(Window.partitionBy("arm"))
    return out.withColumn("first_significant_drop_size", first)


def truncation_sensitivity(results: DataFrame, a: str, b: str) -> DataFrame:
    """Truncations per side and the rates over pairs both sides completed."""
    pairs = pair_table(results, ["family", "catalog_id", "task_id"], "arm", [a, b], ["truncated", "e2e_success"], [])
    ta, tb, ea, eb = (f"`{c}@{s}`" for c in ("truncated", "e2e_success") for s in (a, b))
    both = f"{ta} = 0 AND {tb} = 0"
    return pairs.where(f"{ta} IS NOT NULL AND {tb} IS NOT NULL").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.expr(ta)).alias("a_truncated"), F.sum(F.expr(tb)).alias("b_truncated"),
        F.count_if(F.expr(both)).alias("both_complete_n"),
        (100 * F.avg(F.expr(f"CASE WHEN {both} THEN {ea} END"))).alias("both_complete_a_pct"),
        (100 * F.avg(F.expr(f"CASE WHEN {both} THEN {eb} END"))).alias("both_complete_b_pct"))


# ---------------------------------------------------------------- clustering and power
def design_effect(results: DataFrame, group: list[str], cluster: str, metric: str = "e2e_success",
                  top: int = 5) -> DataFrame:
    """One-way ANOVA intra-cluster correlation from (n, sum) per cluster, plus share of the worst clusters."""
    c = results.groupBy(*group, cluster).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col(metric).cast("int")).alias("s"))
    tot = c.groupBy(*group).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("m").alias("n"), F.sum("s").alias("s"),
        F.sum(F.expr("cast(s as double) * s / m")).alias("ss"), F.sum(F.expr("cast(m as double) * m")).alias("mm"),
        F.count_if(F.expr("s < m")).alias("clusters_with_any_failure"),
        F.sum(F.expr("m - s")).alias("fails"))
    worst = (top_k(c.withColumn("_bad", F.expr("m - s")), group, [F.desc("_bad"), F.col(cluster)], top)
             .groupBy(*group).agg(F.sum("_bad").alias("top_fails")))
    t = tot.join(worst, group) if group else tot.join(F.broadcast(worst))
    t = (t.withColumn("msb", F.expr("(ss - cast(s as double) * s / n) / (clusters - 1)"))
         .withColumn("msw", F.expr("(s - ss) / (n - clusters)"))
         .withColumn("m0", F.expr("(n - mm / n) / (clusters - 1)"))
         .withColumn("icc", F.expr("CASE WHEN msb + (m0 - 1) * msw > 0 THEN greatest(0.0D, (msb - msw) / (msb + (m0 - 1) * msw)) ELSE 0.0D END"))
         .withColumn("mean_cluster_size", F.expr("n / clusters"))
         .withColumn("design_effect", F.expr("1 + (n / clusters - 1) * icc"))
         .withColumn("effective_n", F.expr("n / design_effect"))
         .withColumn("top_share", F.expr("CASE WHEN fails > 0 THEN top_fails / fails ELSE 0.0D END")))
    return t.select(*group, "clusters", "n", "mean_cluster_size", "icc", "design_effect", "effective_n",
                    "clusters_with_any_failure", "top_share")


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """First k rows per group; the rank filter lets Spark cut each partition to k rows before the shuffle."""
    if not group:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def power_table(design: DataFrame, deltas=(0.03, 0.05, 0.08, 0.10), shares=(0.10, 0.20)) -> DataFrame:
    """Pairs needed for McNemar (normal approximation), alone and at the measured design effect."""
    grid = ", ".join(f"named_struct('delta', {d}D, 'share', {s}D)" for d in deltas for s in shares if s > d * d)
    t = design.select("*", F.expr(f"inline(array({grid}))"))
    t = t.withColumn("_need", F.expr("pow(1.96D * sqrt(share) + 0.84D * sqrt(share - delta * delta), 2) / (delta * delta)"))
    return t.select(F.expr("100 * delta").alias("delta_pp"), F.col("share").alias("discordant_share"),
                    F.ceil("_need").alias("pairs_needed"),
                    F.ceil(F.col("_need") * F.col("design_effect")).alias("pairs_at_design_effect"))


# ---------------------------------------------------------------- routing economics
def router_replay(units: DataFrame) -> DataFrame:
    """Replace routed requests by the other arm: projected success, token and latency ratios.

    units: family, retry, f_e2e, c_e2e, f_tokens, c_tokens, f_ms, c_ms.
    """
    return units.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("retry").alias("routed"),
        (100 * F.avg(F.col("f_e2e").cast("double"))).alias("free_e2e_pct"),
        (100 * F.avg(F.when(F.col("retry"), F.col("c_e2e")).otherwise(F.col("f_e2e")).cast("double"))).alias("projected_e2e_pct"),
        (1 + F.sum(F.expr("CASE WHEN retry THEN coalesce(c_tokens, 0) ELSE 0 END")) / F.sum(F.expr("coalesce(f_tokens, 0)"))).alias("token_ratio"),
        (1 + F.sum(F.expr("CASE WHEN retry THEN c_ms ELSE 0.0D END")) / F.sum("f_ms")).alias("latency_ratio"))


def aggregate_retry(first: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Retry row with latency and token counts of both attempts added up."""
    f = first.select(key, *[F.col(c).alias(f"_f_{c}") for c in ("wall_latency_ms", "prompt_tokens", "completion_tokens")])
    j = retry.join(f, key).withColumn("retry_wall_latency_ms", F.col("wall_latency_ms"))
    j = j.withColumn("wall_latency_ms", F.col("wall_latency_ms") + F.col("_f_wall_latency_ms"))
    for c in ("prompt_tokens", "completion_tokens"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce(f"_f_{c}", F.lit(0)))
    return j.drop("_f_wall_latency_ms", "_f_prompt_tokens", "_f_completion_tokens")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
