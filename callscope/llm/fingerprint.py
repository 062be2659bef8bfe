"""Document fingerprints: bottom-k sketches of shingle hashes, in SQL functions throughout.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles, ascending. Sketches of parts merge into the
sketch of the whole, and two of them estimate resemblance, containment and the number of distinct shingles.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.shared import ascii_lower, let, parts, shingle_hashes, words

#: Hashes kept; the standard error of a resemblance is about sqrt(r * (1 - r) / K).
K = 256
#: Words of a shingle.
SHINGLE = 5


def empty() -> Column:
    return F.array().cast("array<bigint>")


def sketch(text: Column, size: int = SHINGLE, k: int = K) -> Column:
    """Bottom-k sketch of a whole text, A-Z lower-cased; a null or blank text has an empty one."""
    return F.slice(F.sort_array(shingle_hashes(words(ascii_lower(text)), size)), 1, k)


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: of the k smallest hashes of either, the share that both have. Two empty ones are alike."""
    share = lambda either: F.when(F.size(either) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(either, a), b)) / F.size(either))
    return let(union_sketch(a, b, k), share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else from the k-th smallest hash's place in the hash range."""
    place = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: likeness times the union's size over a's; 1 for an empty a."""
    got = resemblance(a, b, k) * distinct_shingles(union_sketch(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), got))


def fingerprint_text(a: Column) -> Column:
    """Sketch as lowercase hexadecimal, 16 digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Hashes are made distinct and ranked per key with a limit that holds before the shuffle too, so a key with a third of
    all parts sends k hashes per task. Keys whose sketches are all null or empty get an empty one.
    """
    each = df.select(*keys, F.explode(sketch).alias("h")).distinct()
    low = each.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("at") <= k)
    merged = low.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias("m"))
    all_keys = df.select(*keys).distinct()
    same = [all_keys[c].eqNullSafe(merged[c]) for c in keys]
    return all_keys.join(merged, same, "left").select(*[all_keys[c] for c in keys], F.coalesce(merged["m"], empty()).alias(sketch))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``next_text``: the text of the next document by id, after the last that of the first.

    Ids are cut into ranges by their quantiles; inside a range the next row is a lead over the range's sorted rows. The
    first document of each range is repeated behind the range before, so a lead never leaves its range and the table is
    shuffled once, a range to a partition. Rows of equal id follow by text; null ids come first.
    """
    n = parts(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]).cast("array<bigint>")
    rows = docs.withColumn("_range", F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    # the first row of each range, found by a limit per range that holds before the shuffle; as many rows as ranges
    heads = rows.select("_range", "doc_id").groupBy("_range").agg(F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_null"))
    ranks = Window.orderBy("_range")
    linked = heads.select("_first", "_null", "_range", F.coalesce(F.lag("_range").over(ranks), F.max("_range").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    found = rows.join(F.broadcast(linked), "_range").where(F.when(F.col("_null"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("_first")))
    least = found.groupBy("_before").agg(F.min_by("text", F.coalesce("text", F.lit(""))).alias("text"))
    behind = least.select(F.col("_before").alias("_range"), F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("_behind"))
    every = rows.select("_range", "doc_id", "text", F.lit(False).alias("_behind")).unionByName(behind).repartitionById(n, "_range")
    w = Window.partitionBy("_range").orderBy("_behind", *order)
    return every.withColumn("next_text", F.lead("text").over(w))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Fingerprint of every text and of its edited form, with their likeness and the likeness to the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct (estimated
    shingles). A null text counts as empty; a table of one row is its own next document; repeated rows stay.
    """
    plain = docs.select(docs[id].cast("bigint").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    w = Window.partitionBy("_range").orderBy("_behind", F.col("doc_id").asc_nulls_first(), "text")
    rows = with_next(plain).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    drawn = rows.select("_range", "_behind", "doc_id", "text", F.length("text").cast("bigint").alias("n_chars"),
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed"))
    near = drawn.withColumn("following", F.lead("own").over(w)).where("NOT _behind")
    return near.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("own")).alias("fingerprint"),
                       fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
                       resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
                       resemblance(F.col("own"), F.col("following")).alias("near_next"),
                       distinct_shingles(F.col("own")).alias("n_distinct"))
