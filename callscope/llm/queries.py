"""Registered queries of the operators: each applies one to its whole table with production parameters."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, chat, contamination, convtrie, fingerprint, jaccard, lexical, linetree, mix, pii, quality, tokenfile, topk
from callscope.llm.shared import public_vocabulary, table
from callscope.session import cut_lineage, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def folder(spark: SparkSession, name: str) -> str:
    """A new folder among those that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("op1_mix")
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(table(spark, sf_dir, "documents"), weights=(1, 2, 3))


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    tokenfile.write_shards(table(spark, sf_dir, "documents"), path, public_vocabulary("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_tokens(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op4_top_k")
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op5_pseudonyms")
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key="pseudonyms of the registered query")


@query("op6_line_templates")
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetree.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op7_near_components")
def op7_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents"), size=3, num=9, den=10)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_chat", chat.ORACLE)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op10_byte_pairs")
def op10_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


@query("op11_lexical", lexical.ORACLE)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op12_contamination", contamination.ORACLE)
def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_prefix_trie", convtrie.ORACLE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = convtrie.rebuilt(cut_lineage(convtrie.ordered(table(spark, sf_dir, "conversations"))))
    return convtrie.trie_nodes(cut_lineage(rows), members)
