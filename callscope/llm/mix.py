"""Mixing sources to target weights by weighted sampling with exponential keys.

Every document gets the key -ln(u) / quality, with u from a hash of its id, so a small key is likelier for a better
document. Targets are words. A source's target is met by complete epochs of all its documents first; the fraction of an
epoch that is left takes documents in key order until their running size meets it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.shared import comparable, unused
from callscope.operators.ranking import running_totals
from callscope.session import cut_lineage

#: Copies that each source's row is dealt out to, so that a source with a third of all documents is no hot join key.
SALTS = 16
#: Most times that a document is taken.
MOST = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def letter_share(text: Column) -> Column:
    """A quality weight in (0, 1]: the share of letters among a text's characters."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(F.regexp_replace(t, "[^\\p{L}]", "")) + 1) / (F.length(t) + 1)


def source_key(source: Column) -> Column:
    """A name that is never null, so that documents without a source are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("!"))


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the given ones in turn, over sources by code point with null last."""
    order = [F.expr("src = '!'"), F.col("src")]
    ranked = running_totals(sizes.select("src", "source_size"), [], order, {"at": "cast(1 as bigint)"})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.select("src", "source_size", F.get(turn, ((F.col("at") - 1) % len(weights)).cast("int")).alias("weight"))


def level_targets(sizes: DataFrame, budget: float, most: int = MOST) -> DataFrame:
    """Adds ``target``: weight times one level, but ``most`` times the source's size at most, so that they add to ``budget``.

    Resharing what sources over their limit can't hold, by weight, until none is above, ends at that level. With the
    sources in order of limit / weight, it is the first that leaves the next source below its limit; the prefix sums are
    spread over tasks, and only the level itself reaches the driver.
    """
    rows = sizes.withColumn("cap", (F.col("source_size") * most).cast("bigint")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = rows.agg(F.sum("weight").alias("w")).first()["w"] or 0.0
    run = running_totals(rows, [], ["ratio", "src"], {"caps": "cap", "ws": "weight"})
    left = (F.lit(float(budget)) - (F.col("caps") - F.col("cap"))) / (F.lit(whole) - (F.col("ws") - F.col("weight")))
    first = run.where(F.col("ws") - F.col("weight") < whole).withColumn("level", left).where("level <= ratio").agg(
        F.min_by("level", F.struct("ratio", "src")).alias("level")).first()["level"]
    target = F.col("cap").cast("double") if first is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(first))
    return rows.select("src", "source_size", "weight", target.alias("target"))


def measured(docs: DataFrame, quality: Column | None = None, text: str = "text", id: str = "doc_id", source: str = "source", seed: str = "mix", **more: Column) -> DataFrame:
    """One narrow row per document: doc_id, src, size in words, and its sampling key."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id].cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)
    key = -F.log(u) / (letter_share(docs[text]) if quality is None else quality)
    return cut_lineage(docs.select(docs[id].cast("bigint").alias("doc_id"), source_key(docs[source]).alias("src"),
                                   word_count(docs[text]).alias("size"), key.alias("key"), *[c.alias(n) for n, c in more.items()]))


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src").agg(F.sum("size").alias("source_size"))


def take(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds source_size, target, copies and taken (words) to the rows of ``measured``.

    A document is in the fractional epoch if the middle of its words, counted in key order (ties by id, then size), lies
    within what complete epochs leave of the target: the words taken miss the target by half a document at most. No task
    holds a source: running sizes come from range partitions and their totals.
    """
    run = running_totals(rows, ["src"], ["key", "doc_id", "size"], {"upto": "size"})
    salted = targets.select("src", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    j = run.withColumn("salt", F.pmod(F.hash("doc_id", "key"), F.lit(SALTS))).join(salted, ["src", "salt"]).drop("salt")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    part = (F.col("size") > 0) & (F.col("upto") - F.col("size") / 2 <= rest)
    j = j.withColumn("epochs", epochs).withColumn("copies", F.col("epochs") + part.cast("bigint"))
    return j.withColumn("taken", F.col("copies") * F.col("size")).drop("upto", "epochs")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; all words are shared out among the sources.

    A null or blank text has size 0 and takes nothing; null sources are one source, the last; repeated rows are taken
    each for itself. Reruns agree: keys depend on the id alone. Sources whose words are none have target 0.
    """
    rows = measured(docs)
    sizes = source_sizes(rows)
    total = sizes.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    targets = level_targets(cyclic_weights(sizes, weights), total)
    return take(rows, targets).select("doc_id", "size", "source_size", "target", "taken")


def mix_rows(docs: DataFrame, power: float = 0.7) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, all columns kept.

    Sources weigh their words to ``power``, which lifts small ones, and the budget is the least that gives every source a
    complete epoch, so no document is lost and none comes more than ``MOST`` times. Blank texts come with each complete
    epoch; sources without any word are left out.
    Rows that are equal in every column are interchangeable: their copies are counted together. Columns may have any name and
    type; an empty table stays empty.
    """
    row = F.xxhash64(*comparable(docs))
    at, many, copy = unused(docs, "_row", "_copies", "_copy")
    rows = measured(docs, row=row)
    sizes = source_sizes(rows).where("source_size > 0").withColumn("weight", F.pow("source_size", F.lit(power)))
    level = F.max(F.col("source_size") / F.col("weight"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(level.alias("level"))))  # one row
    budget = sizes.agg(F.sum(F.least(F.col("source_size") * MOST, F.col("weight") * F.col("level"))).alias("b")).first()["b"] or 0.0
    copies = take(rows, level_targets(sizes.drop("level"), budget)).groupBy("row").agg(F.sum("copies").alias(many))
    once = docs.withColumn(at, row).dropDuplicates([at])
    return (once.join(copies.withColumnRenamed("row", at), at).where(F.col(many) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns]))
