"""Ranking, deduplication, balanced drawing and sampling."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.text import sha256_rank
from callscope.operators.ranking import running_totals
from callscope.operators.stats import top_k
from callscope.session import cut_lineage

# fixed values: words a reviewed name or description must not contain, review codes
REVIEW_CODES = ("OPAQUE", "TOY", "NO_USER_VALUES", "SEMANTIC_DUPLICATE", "PII")


def hash_rank(df: DataFrame, seed, key: str = "schema_id") -> DataFrame:
    return df.withColumn("rank_key", sha256_rank(seed, key))


def function_name(key: str = "schema_id"):
    """Last path part without its 8-hex suffix, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(key, "^[^/]*/", ""), "_[0-9a-f]{8}$", ""))


def dedup_by_key(df: DataFrame, key, order: str = "rank_key", only=None) -> DataFrame:
    """Lowest-ranked row per key (map-side combined); rows outside ``only`` pass through."""
    part = df.where(only) if only is not None else df
    best = part.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")
    return best.unionByName(df.where(~only)) if only is not None else best


def interleave(df: DataFrame, strata: list[str], stratum: str = "stratum", order: str = "rank_key",
               out: str = "rank") -> DataFrame:
    """Alternate strata in rank order, the longer tail appended; rank from 0."""
    idx = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col(stratum))
    n = running_totals(df, [stratum], [order], {"_n": "1"}).withColumn("_i", idx)
    n = running_totals(n, [], ["_n", "_i"], {out: "1"})
    return n.withColumn(out, F.col(out) - 1).drop("_n", "_i")


def compile_pool(reviews: DataFrame, candidates: DataFrame, forbidden: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviewed candidates -> (pool, violations, summary).

    reviews: rank, decision, code, tool_name, family, suitable, description, n_fields.
    """
    word = "|".join(forbidden)
    acc = reviews.where("decision = 'A'")
    twice = reviews.groupBy("rank").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rank", F.lit("rank_repeated").alias("problem"))
    prev = reviews.select((F.col("rank") + 1).alias("rank"))
    gap = reviews.where("rank > 0").join(prev, "rank", "left_anti").select("rank", F.lit("rank_gap").alias("problem"))
    names = acc.groupBy("tool_name").agg(F.count(F.lit(1)).alias("c"), F.min("rank").alias("first")).where("c > 1")
    dup = acc.join(names, "tool_name").where("rank <> first").select("rank", F.lit("tool_name_repeated").alias("problem"))
    rows = reviews.select("rank", F.explode(F.expr(f"""filter(array(
        CASE WHEN decision NOT IN ('A', 'R') THEN 'decision_unknown' END,
        CASE WHEN decision = 'R' AND code NOT IN ({', '.join(f"'{c}'" for c in REVIEW_CODES)}) THEN 'code_unknown' END,
        CASE WHEN decision = 'A' AND n_fields <> 6 THEN 'field_count' END,
        CASE WHEN decision = 'A' AND NOT coalesce(tool_name RLIKE '^[a-z][a-z0-9_]*$', false) THEN 'tool_name_form' END,
        CASE WHEN decision = 'A' AND size(regexp_extract_all(description, '[^ \\t\\n]+', 0)) > 25 THEN 'description_long' END,
        CASE WHEN decision = 'A' AND lower(concat(tool_name, ' ', description)) RLIKE '{word}' THEN 'forbidden_word' END),
        p -> p IS NOT NULL)""")).alias("problem"))
    violations = rows.unionByName(twice).unionByName(gap).unionByName(dup)
    numbered = running_totals(acc.select("rank", "tool_name", "family", "suitable", "description"), [], ["rank"], {"_n": "1"})
    pool = (numbered.join(candidates, "rank")
            .withColumn("tool_id", F.concat(F.lit("T"), F.expr("lpad(cast(_n - 1 as string), greatest(3, length(cast(_n - 1 as string))), '0')")))
            .withColumn("task_suitable", F.col("suitable") == "1").withColumnRenamed("rank", "candidate_rank").drop("_n", "suitable"))
    summary = reviews.groupBy(F.expr("CASE decision WHEN 'A' THEN 'accept' ELSE concat('reject:', code) END").alias("decision")).agg(
        F.count(F.lit(1)).alias("n"))
    return pool, violations, summary


def draw_targets(pool: DataFrame, replicates: int, seed, per_replicate: int = 5) -> DataFrame:
    """Disjoint targets with stratum quota alternating 3/2 and 2/3, families unique over the whole draw."""
    one = dedup_by_key(pool.where("task_suitable").withColumn("_h", sha256_rank(f"{seed}:targets", "tool_id")), F.col("family"), "_h")
    need = (replicates + 1) // 2 * per_replicate
    ranked = top_k_numbered(one, ["stratum"], ["_h"], need)
    s = F.col("_n") - 1
    late = F.when(F.col("stratum") == "flat", s % 5 >= 3).otherwise(s % 5 >= 2)
    out = ranked.withColumn("replicate", (2 * F.floor(s / 5) + late.cast("int")).cast("int")).where(F.col("replicate") < replicates)
    w = Window.partitionBy("replicate").orderBy(F.col("stratum"), "_h")
    return out.withColumn("slot", F.row_number().over(w) - 1).select("replicate", "slot", "tool_id", "family", "stratum")


def top_k_numbered(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)


#: Families that a first cut by hash leaves for each place of a catalog, on average.
MARGIN = 4


def _first_families(pool: DataFrame, targets: DataFrame, replicates: int, seed, top: int, share: float, only: list[int] | None = None) -> DataFrame:
    """The ``top`` families of least hash per replicate and stratum, of the tools whose hash lies in the first ``share`` of all.

    A family's first tool has its least hash, so what lies below the cut is exact. The cut is made before rows are copied.
    """
    draw = f"sha2(concat_ws(':', '{seed}:replicate', cast(r as string), cast(tool_id as string)), 256)"
    keep = [f"substr({draw}, 1, 8) < '{int(share * 2**32):08x}'"] if share < 1 else []
    keep += [f"array_contains(array({', '.join(map(str, only))}), r)"] if only is not None else []
    r = f"filter(sequence(0, {replicates - 1}), r -> {' AND '.join(keep) or 'true'})"
    # targets are replicates x quota rows by construction
    cand = pool.select("tool_id", "family", "stratum", F.explode(F.expr(r)).alias("replicate")).join(F.broadcast(targets.select("replicate", "family")), ["replicate", "family"], "left_anti")
    cand = cand.withColumn("_h", sha256_rank(f"{seed}:replicate", "replicate", "tool_id"))
    best = (cand.groupBy("replicate", "family").agg(F.min_by(F.struct("tool_id", "stratum", "_h"), "_h").alias("r"))
            .select("replicate", "r.*"))
    return top_k_numbered(best, ["replicate", "stratum"], ["_h"], top)


def build_catalogs(pool: DataFrame, targets: DataFrame, replicates: int, sizes: list[int], seed) -> DataFrame:
    """Nested catalogs as members (catalog_id, replicate, size, tool_id, pos, presentation_pos).

    Distractors never share a family with a member; the next pick is flat while flat <= structured,
    which is the order (count so far in its stratum, flat first). Catalog k is the first k members,
    shown in a seeded order of its own.

    A first cut by hash leaves about ``MARGIN`` families for each place; replicates to which it leaves too few of a stratum are
    drawn again from the whole pool, so rows grow with the catalogs and the draw is exact.
    """
    top = max(sizes)
    strata = {r["stratum"]: r["n"] for r in pool.groupBy("stratum").agg(F.count_distinct("family").alias("n")).collect()}  # one row a stratum
    share = min(1.0, MARGIN * top / max(1, min(strata.values(), default=1)))
    best = cut_lineage(_first_families(pool, targets, replicates, seed, top, share))
    if share < 1:
        full = best.groupBy("replicate", "stratum").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {top}").groupBy("replicate").agg(F.count(F.lit(1)).alias("n"))
        done = {r["replicate"] for r in full.where(f"n = {len(strata)}").collect()}  # one row a replicate
        short = [r for r in range(replicates) if r not in done]
        if short:
            best = best.where(~F.col("replicate").isin(short)).unionByName(_first_families(pool, targets, replicates, seed, top, 1.0, short))
    have = targets.groupBy("replicate", "stratum").agg(F.count(F.lit(1)).alias("c"))
    total = targets.groupBy("replicate").agg(F.count(F.lit(1)).alias("k"))
    fill = (best.join(have, ["replicate", "stratum"], "left").join(total, "replicate")
            .withColumn("_key", F.col("_n") + F.coalesce("c", F.lit(0)))
            .withColumn("pos", F.col("k") + F.row_number().over(
                Window.partitionBy("replicate").orderBy("_key", F.col("stratum") != "flat", "_h")) - 1)
            .select("replicate", "tool_id", F.col("pos").cast("int")))
    members = targets.select("replicate", "tool_id", F.col("slot").alias("pos")).unionByName(fill)
    nested = (members.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("pos < size")
              .withColumn("catalog_id", F.format_string("C%03d_R%02d", "size", "replicate")))
    order = sha256_rank(f"{seed}:order", "replicate", "size", "tool_id")
    w = Window.partitionBy("catalog_id").orderBy("_o")
    return (nested.withColumn("_o", order).withColumn("presentation_pos", F.row_number().over(w) - 1)
            .select("catalog_id", "replicate", "size", "tool_id", "pos", "presentation_pos"))


def catalog_stats(members: DataFrame, pool: DataFrame, targets: DataFrame, measures: list[str]) -> DataFrame:
    """Strata and subset maps, means of the given measures, target positions (a catalog is bounded by its size)."""
    m = members.join(pool.select("tool_id", "stratum", "subset", *measures), "tool_id")
    cnt = lambda c, o: (m.groupBy("catalog_id", c).agg(F.count(F.lit(1)).alias("n")).groupBy("catalog_id")
                        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(o)))
    base = m.groupBy("catalog_id", "replicate", "size").agg(*[F.avg(x).alias(f"mean_{x}") for x in measures])
    pos = (members.join(targets.select("replicate", "tool_id"), ["replicate", "tool_id"]).groupBy("catalog_id")
           .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_id", "presentation_pos")))).alias("target_positions")))
    return base.join(cnt("stratum", "strata"), "catalog_id").join(cnt("subset", "subsets"), "catalog_id").join(pos, "catalog_id", "left")


def hash_sample(df: DataFrame, k: int, by: str, key: str, seed: str) -> DataFrame:
    """k lowest sha256(seed NUL key) rows per group."""
    return top_k(df.withColumn("_h", F.sha2(F.concat(F.lit(seed + "\0"), F.col(key)), 256)), [by], ["_h"], k).drop("_h")


def first_per_stratum(df: DataFrame, group: list[str], seq: str) -> DataFrame:
    """First row per group in input order, combined map-side."""
    return df.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min_by(F.struct(*df.columns), seq).alias("r")).select("r.*")


def failure_examples(df: DataFrame, k: int = 3) -> DataFrame:
    """First k failing outputs per (arm, size, label): whole text, labels, gold arguments and all errors."""
    d = top_k(df.where("failure_primary IS NOT NULL"), ["arm", "size", "failure_primary"], ["request_key"], k)
    return d.select("arm", "size", "failure_primary", "request_key", F.col("raw_content").alias("output"), "failure_secondary",
                    "gold_args", F.col("schema_errors").alias("errors"))
