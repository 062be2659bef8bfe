"""Lexical ranking, overlap and leakage checks, look-alike keys."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.jsontree import once
from callscope.functions.keyorder import caseless_keys
from callscope.functions.text import ngrams_sql, tokens_sql, words_sql
from callscope.operators.schematree import sql_list


def tool_documents(tools: DataFrame, fields: str = "all", text: str = "schema_text") -> DataFrame:
    """Index documents: name and description, with the schema text when fields is 'all'."""
    src = "concat_ws(' ', tool_name, description)" if fields == "card" else f"concat_ws(' ', tool_name, description, {text})"
    return tools.withColumn("toks", F.expr(tokens_sql(src)))


def rank_metrics(ranks: DataFrame, group: list[str], ks=(1, 3, 5, 10)) -> DataFrame:
    return ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in ks],
                                     F.avg(1 / F.col("rank")).alias("mrr"))


# ---------------------------------------------------------------- overlap and leakage
def ngram_overlap(a: DataFrame, b: DataFrame, n: int = 6) -> DataFrame:
    """(a_id, b_id, shared): distinct verbatim n-grams two texts share; a, b: id, text, whole texts."""
    grams = lambda d, o: (d.select(F.col("id").alias(o), F.expr(words_sql("text")).alias("w"))
                          .select(o, F.explode(F.expr(ngrams_sql("w", n))).alias("gram")))
    return (grams(a, "a_id").join(grams(b, "b_id"), "gram").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared")))


# fixed values: identifiers a request must not contain
DATASET_WORDS = ("glaive", "github", "snowplow", "washington post", "jsonschemabench", "kubernetes", "schemastore")
REPRESENTATION_NAMES = ("raw", "minified", "normalized", "tscg", "tscg_info", "json schema", "representation")


def leakage_issues(tasks: DataFrame, n: int = 6, keep: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Ordered issue list per task. tasks: prompt, tool_name, tool_id, schema_id, description, texts (array)."""
    p = "lower(prompt)"
    g = lambda t: ngrams_sql(words_sql(t), n)
    d = tasks.withColumn("_g", once(g("prompt")))
    return d.select(*keep, F.expr(f"""filter(concat(array(
        CASE WHEN contains({p}, tool_name) THEN 'tool_name' END,
        CASE WHEN contains({p}, replace(tool_name, '_', ' ')) THEN 'spaced_tool_name' END,
        CASE WHEN contains({p}, lower(schema_id)) OR contains({p}, lower(split_part(schema_id, '/', 2))) THEN 'schema_id' END,
        CASE WHEN array_contains(regexp_extract_all({p}, '\\\\S+', 0), lower(tool_id)) THEN 'tool_id' END),
        transform(filter(array({sql_list(DATASET_WORDS)}), w -> contains({p}, w)), w -> concat('dataset_identifier:', w)),
        transform(filter(array({sql_list(REPRESENTATION_NAMES)}), w -> {p} RLIKE concat('\\\\b', w, '\\\\b')), w -> concat('representation_name:', w)),
        array(CASE WHEN arrays_overlap(_g, {g('description')}) THEN 'copies_tool_description' END,
              CASE WHEN exists(texts, t -> arrays_overlap(_g, {g('t')})) THEN 'copies_schema_text' END)), x -> x IS NOT NULL)""").alias("issues"))


def leaks_name(request: str, name: str):
    return F.expr(f"contains(lower({request}), lower({name})) OR contains(lower({request}), replace(lower({name}), '_', ' '))")


def whitespace_runs(outputs: DataFrame, group: list[str], n: int = 128, intent: str = "intent_id") -> DataFrame:
    """Outputs that end in at least n whitespace characters, and the intents they come from."""
    run = F.length(F.regexp_extract("raw_content", r"(\s*+)\z", 1)) >= n
    return outputs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(run).alias("runs"),
                                       F.count_distinct(F.when(run, F.col(intent))).alias("intents"))


def lookalike_keys(calls: DataFrame, keep: tuple[str, ...] = ("request_key",)) -> DataFrame:
    """Undeclared keys that resemble a declared one: (keep, pointer, key, candidate).

    calls carry arg_nodes and the rule row of their tool; only undeclared keys leave the row, and only
    those are normalised in Python.
    """
    plain = "filter(rules, r -> r.pos = n.pos AND NOT r.scope RLIKE '~(not|if|then|else)')"
    d = calls.select(*keep, F.explode(once(f"""flatten(transform(filter(arg_nodes, n -> n.kind = 'OBJ'), n ->
        transform(array(array_distinct(flatten(transform({plain}, r -> r.declared)))), known ->
          transform(array_except(n.keys, known), k -> named_struct(
            'pointer', concat(replace(n.ptr, '\\u0001', '/'), '/', replace(replace(k, '~', '~0'), '/', '~1')),
            'key', k, 'known', known)))[0]))""")).alias("u"))
    d = d.select(*keep, "u.*").withColumn("_k", caseless_keys(F.array("key"))).withColumn("_n", caseless_keys("known"))
    d = d.withColumn("candidate", F.expr("""coalesce(
        CASE WHEN array_position(_n, _k[0]) > 0 THEN element_at(known, cast(array_position(_n, _k[0]) as int)) END,
        get(filter(known, w -> w <> '' AND startswith(key, w) AND char_length(key) > char_length(w)
            AND NOT substr(key, char_length(w) + 1, 1) RLIKE '(?U)^[\\\\p{L}\\\\p{N}]$'), 0))"""))
    # fixed values: typographic quotes
    return d.where("candidate IS NOT NULL OR key RLIKE '[“”‘’„‟«»]'").select(*keep, "pointer", "key", "candidate")


def lookalike_counts(flags: DataFrame, *group: str) -> DataFrame:
    return flags.groupBy(*group, "key", "candidate").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- key order
def key_order_split(free: DataFrame) -> DataFrame:
    """Order category x paired outcome, pooled, by arm and by family:size.

    free: arm, family, size, accepted_original, accepted_schema, cd_truncated, cd_e2e.
    """
    d = free.select(
        F.expr("CASE WHEN accepted_original THEN 'accepted_original_order' WHEN accepted_schema THEN 'order_only_rejection' ELSE 'other_rejection' END").alias("category"),
        F.expr("CASE WHEN cd_truncated THEN 'truncated' WHEN cd_e2e THEN 'correct' ELSE 'wrong' END").alias("outcome"),
        F.explode(F.expr("array('pooled', arm, concat(family, ':', size))")).alias("scope"))
    return d.groupBy("scope", "category", "outcome").agg(F.count(F.lit(1)).alias("n"))


def key_order_disagreement(df: DataFrame, elements: str, out: str = "oracle_incomplete") -> DataFrame:
    """Whether elements (array<string> of JSON texts) of one array differ in nested key order."""
    sig = "transform({e}, x -> array_join(regexp_extract_all(x, '\"((?:[^\"\\\\\\\\]|\\\\\\\\.)*+)\"[ \\t\\n\\r]*:', 1), '\\u0001'))"
    return df.withColumn(out, F.expr(f"size(array_distinct({sig.format(e=elements)})) > 1"))
