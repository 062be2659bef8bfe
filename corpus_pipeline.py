"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Quality first, then recurring lines, near copies, the mix of sources, and token ids. Every stage works on all rows that the
one before kept; all but the last return the columns of ``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, jaccard, linetree, mix, quality
from callscope.llm.shared import BLANKS, comparable, public_vocabulary, unused
from callscope.session import shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from ``labels``, is 0.7 or more; empty texts go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template recurs across documents; a document of such lines alone goes."""
    cut = linetree.drop_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at a resemblance of 0.8 or more over five-word shingles: of the least id, then the longest.

    Rows are known by a hash of id and text, so that every text is judged for itself where an id repeats, and rows without
    an id take part; they come last in the choice. Equal rows are one, blank texts are linked with nothing.
    """
    name, row = unused(docs, "_name", "_row")
    named = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    classes = jaccard.near_components(named, size=5, num=4, den=5, id=name).select(F.col("doc_id").alias(name), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", -F.length(F.coalesce("text", F.lit(""))), name).alias("order")
    first = named.select(name, order).distinct().join(classes, name).groupBy("component_id").agg(F.min("order").alias("order"))
    all_columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = named.groupBy(name).agg(F.min_by(all_columns, F.struct(*comparable(docs))).alias(row))
    return rows.join(first.select(f"order.{name}"), name, "left_semi").select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their words to the power 0.7: every document comes once at least, those of small sources more often."""
    return mix.mix_rows(docs, power=0.7)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.round_trip(docs, public_vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: No SQL: the classifier is learned. tests/llm/test_pipeline.py holds it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the folder that the executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
