"""Ranking, overlap, leakage, key spelling and key order over the given texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.functions.keyorder import key_sequence, observed_property_order, order_like_schema
from callscope.functions.text import norm_str, tokens, truncation_location, words_sql
from callscope.operators import bm25
from callscope.operators import corpus as co
from callscope.operators import scoring as sc
from callscope.operators import textsearch as tx
from callscope.plans.fixtures import fixture, spread, table, with_fx
from callscope.plans.flagship import outputs, tool_inputs
from callscope.plans.queries_corpus import PROPS
from callscope.plans.registry import query, rounded


def fx(sql: str, names: str) -> str:
    return with_fx(names, sql)


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))


SPLIT_TOKENS = r"regexp_extract_all(replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '_', ' '), '[a-z0-9]+')"


@query("tokens", f"SELECT doc_id, len({SPLIT_TOKENS.format('text')}) AS n, md5(array_to_string({SPLIT_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def tokens_query(spark, sf):
    t = docs(spark, sf).select("doc_id", tokens("text").alias("t"))
    return t.selectExpr("doc_id", "cast(size(t) as bigint) AS n", "md5(array_join(t, ' ')) AS digest")


@query("norm_str", r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), 'ß', 'ss'), '\s+', ' ', 'g'), '[.]+$', '')) AS digest
FROM conversations""")
def norm_str_query(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(norm_str("text")).alias("digest"))


GRAMS = """WITH dw AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
 bw AS (SELECT item_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
 dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM dw WHERE len(w) >= 6),
 bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM bw WHERE len(w) >= 6),
 ov AS (SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY 1, 2)"""


def overlap(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return tx.ngram_overlap(b, docs(spark, sf).select(F.col("doc_id").alias("id"), "text"))


@query("ngram_overlap", GRAMS + " SELECT item_id, doc_id, shared FROM ov")
def ngram_overlap(spark, sf):
    return overlap(spark, sf).selectExpr("a_id AS item_id", "b_id AS doc_id", "shared")


def retrieval(spark, sf):
    """Documents by language as catalogs; each benchmark text asks for the document it overlaps most."""
    d = docs(spark, sf).select("doc_id", "lang", tokens("text").alias("toks"))
    best = overlap(spark, sf).groupBy("a_id").agg(F.max_by("b_id", F.struct("shared", -F.col("b_id"))).alias("gold_doc"))
    q = (table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tokens("text").alias("qtoks"))
         .join(best, F.col("query_id") == F.col("a_id")).drop("a_id")
         .join(d.select(F.col("doc_id").alias("gold_doc"), F.col("lang").alias("catalog_id")), "gold_doc"))
    return d.select("doc_id", "toks"), d.select(F.col("lang").alias("catalog_id"), "doc_id"), q


BM25 = GRAMS + f""", gd AS (SELECT item_id, doc_id AS gold, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM ov),
 q AS (SELECT b.item_id AS query_id, d.lang AS cat, gold, unnest(list_distinct({SPLIT_TOKENS.format('b.text')})) AS term
   FROM bw b JOIN gd ON gd.item_id = b.item_id AND k = 1 JOIN dw d ON d.doc_id = gold),
 qs AS (SELECT DISTINCT query_id, cat, gold FROM q),
 dt AS (SELECT doc_id, lang, {SPLIT_TOKENS.format('text')} AS t FROM documents),
 st AS (SELECT lang, count(*) AS n, avg(len(t)) AS av FROM dt GROUP BY 1),
 tf AS (SELECT doc_id, lang, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY 1, 2, 3, 4),
 df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY 1, 2),
 sc AS (SELECT query_id, cat, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 9) AS score
   FROM q JOIN tf ON tf.lang = q.cat AND tf.term = q.term JOIN df ON df.lang = q.cat AND df.term = q.term JOIN st ON st.lang = q.cat GROUP BY 1, 2, 3),
 al AS (SELECT qs.query_id, qs.cat, qs.gold, dt.doc_id, coalesce(score, 0) AS score FROM qs JOIN dt ON dt.lang = qs.cat
   LEFT JOIN sc ON sc.query_id = qs.query_id AND sc.doc_id = dt.doc_id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al)"""


@query("bm25_gold_rank", BM25 + " SELECT query_id, cat AS catalog_id, gold AS gold_doc, round(score, 5) AS score, rank FROM rk WHERE doc_id = gold")
def bm25_gold_rank(spark, sf):
    return rounded(bm25.gold_rank(*retrieval(spark, sf)), 5)


@query("bm25_scores", BM25 + " SELECT query_id, cat AS catalog_id, doc_id, round(score, 4) AS score FROM sc")
def bm25_scores(spark, sf):
    return rounded(bm25.scores(*retrieval(spark, sf)).withColumn("score", F.round("score", 9)), 4)


@query("bm25_rank_metrics", BM25 + """ SELECT cat AS catalog_id, count(*) AS n, round(avg((rank <= 1)::int), 6) AS recall_at_1, round(avg((rank <= 3)::int), 6) AS recall_at_3,
  round(avg((rank <= 5)::int), 6) AS recall_at_5, round(avg((rank <= 10)::int), 6) AS recall_at_10, round(avg(1 / rank), 6) AS mrr FROM rk WHERE doc_id = gold GROUP BY 1""")
def bm25_rank_metrics(spark, sf):
    return rounded(tx.rank_metrics(bm25.gold_rank(*retrieval(spark, sf)), ["catalog_id"]))


@query("bm25_shortlist", BM25 + """, ps AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS shown_at FROM dt)
SELECT query_id, cat AS catalog_id, rk.doc_id, shown_at FROM rk JOIN ps ON ps.lang = cat AND ps.doc_id = rk.doc_id WHERE rank <= 5""")
def bm25_shortlist(spark, sf):
    return bm25.shortlist(*retrieval(spark, sf), 5).drop("score")


@query("tool_documents", fx(f"""SELECT tool_id, list_aggregate(list_sort(['do'] || [first_prop] || [cast(p_partkey AS string)] || ['handles', 'item', cast(s.eff AS string)]
  || list_transform({PROPS.replace('n_props', 's.n_props').replace('eff *', 's.eff *')}, lambda w: w) || ['handles', 'item', cast(s.eff AS string)] || CASE s.shape WHEN 'nested' THEN ['inner']
  WHEN 'objects' THEN ['leaf'] WHEN 'ref' THEN ['shared', 'd'] ELSE [] END), 'string_agg', ' ') AS words
 FROM (SELECT tool_id, schema_id, p_partkey FROM fx_pool) p JOIN fx_schema_key s USING (schema_id, p_partkey)""", "fx_pool fx_schema_key"))
def tool_documents(spark, sf):
    """Search documents over the self-contained schema of every pool tool."""
    s = fixture(spark, sf, "fx_schemas").select("schema_id", "body", "eff")
    t = spread(fixture(spark, sf, "fx_pool").select("tool_id", "tool_name", "schema_id").join(s, "schema_id"))
    t = t.withColumn("description", F.expr("concat('Handles item ', eff)"))
    n = co.normalize_schemas(t, ("tool_id", "tool_name", "description")).withColumnRenamed("normalized", "body")
    x = co.schema_text(n, ("tool_id", "tool_name", "description"))
    return tx.tool_documents(x, "all").selectExpr("tool_id", "array_join(array_sort(toks), ' ') AS words")


@query("tool_documents_card", fx("""SELECT tool_id, list_aggregate(list_sort(['do', first_prop, cast(p_partkey AS string), 'handles', 'item', cast(s.eff AS string)]), 'string_agg', ' ') AS words
 FROM (SELECT tool_id, schema_id, p_partkey FROM fx_pool) p JOIN fx_schema_key s USING (schema_id, p_partkey)""", "fx_pool fx_schema_key"))
def tool_documents_card(spark, sf):
    """Search documents of name and description alone."""
    s = fixture(spark, sf, "fx_schemas").select("schema_id", "eff")
    t = spread(fixture(spark, sf, "fx_pool").select("tool_id", "tool_name", "schema_id").join(s, "schema_id"))
    d = tx.tool_documents(t.withColumn("description", F.expr("concat('Handles item ', eff)")), "card")
    return d.selectExpr("tool_id", "array_join(array_sort(toks), ' ') AS words")


PROMPT = """CASE p_partkey % 6 WHEN 0 THEN 'Use ' || tool_name WHEN 1 THEN 'please ' || replace(tool_name, '_', ' ') WHEN 2 THEN 'see ' || schema_id
  WHEN 3 THEN 'call ' || tool_id || ' now' WHEN 4 THEN 'a GitHub raw thing' ELSE 'It handles item ' || cast(p_partkey AS string) || ' with care and patience' END"""


@query("leak_issues", fx("""SELECT tool_id, CASE p_partkey % 6 WHEN 0 THEN 'tool_name' WHEN 1 THEN 'spaced_tool_name' WHEN 2 THEN 'schema_id' WHEN 3 THEN 'tool_id'
  WHEN 4 THEN 'dataset_identifier:github,representation_name:raw' ELSE 'copies_tool_description' END AS issues FROM fx_pool""", "fx_pool"))
def leak_issues(spark, sf):
    s = fixture(spark, sf, "fx_schemas").select("schema_id", "body")
    texts = co.schema_texts(spread(s)).groupBy("schema_id").agg(F.collect_list("text").alias("texts"))
    t = (fixture(spark, sf, "fx_pool").withColumn("prompt", F.expr(PROMPT))
         .withColumn("description", F.expr("concat('Handles item ', p_partkey, ' with care and some patience')")).join(texts, "schema_id", "left"))
    t = t.withColumn("description", F.expr("concat('This handles item ', p_partkey, ' with care and patience')"))
    return tx.leakage_issues(t, keep=("tool_id",)).selectExpr("tool_id", "array_join(issues, ',') AS issues")


@query("leak_names", fx("SELECT task_id, task_id % 9 = 0 AS leaks FROM fx_tasks", "fx_tasks"))
def leak_names(spark, sf):
    t = fixture(spark, sf, "fx_tasks").withColumn("request", F.expr("concat('Please handle ', CASE WHEN task_id % 9 = 0 THEN upper(tool_name) ELSE 'this' END)"))
    return t.select("task_id", tx.leaks_name("request", "tool_name").alias("leaks"))


@query("trunc_loc", fx("SELECT request_key, CASE WHEN h = 19 THEN 'in_string' ELSE 'between_tokens' END AS location FROM fx_results_key", "fx_results_key"))
def trunc_loc(spark, sf):
    return outputs(spark, sf).select("request_key", truncation_location("raw_content").alias("location"))


@query("whitespace_runs", fx("""SELECT arm, size, count(*) AS n, count_if(h = 19)::bigint AS runs, count(DISTINCT CASE WHEN h = 19 THEN intent_id END) AS intents
 FROM fx_results_key GROUP BY 1, 2""", "fx_results_key"))
def whitespace_runs(spark, sf):
    r = outputs(spark, sf).withColumn("raw_content", F.expr("concat(raw_content, repeat(' ', CASE WHEN h = 19 THEN 120 ELSE 20 END), repeat('\\n', 10))"))
    return tx.whitespace_runs(r, ["arm", "size"])


KEYS = """CASE task_id % 6 WHEN 0 THEN ' Kind' WHEN 1 THEN 'ｋind' WHEN 2 THEN 'kind-x' WHEN 3 THEN 'kindx' WHEN 4 THEN 'no“te' ELSE 'cents' END"""


def lookalikes(spark, sf):
    rules, _ = tool_inputs(spark, sf)
    t = spread(fixture(spark, sf, "fx_tasks")).withColumn("raw_content", F.expr(
        f"concat('{{\"tool\":\"', tool_name, '\",\"arguments\":{{\"k\":1,\"', {KEYS}, '\":2}}}}')"))
    calls = sc.parse_outputs(t.select("task_id", "tool_name", "raw_content")).join(rules, "tool_name")
    return tx.lookalike_keys(calls, ("task_id",))


@query("lookalike_keys", fx(f"""SELECT task_id, '/' || {KEYS} AS pointer, {KEYS} AS key, CASE WHEN task_id % 6 IN (0, 1, 2) THEN 'kind' END AS candidate
 FROM fx_tasks WHERE task_id % 6 IN (0, 1, 2, 4)""", "fx_tasks"))
def lookalike_keys(spark, sf):
    return lookalikes(spark, sf)


@query("lookalike_counts", fx(f"""SELECT {KEYS} AS key, CASE WHEN task_id % 6 IN (0, 1, 2) THEN 'kind' END AS candidate, count(*) AS n
 FROM fx_tasks WHERE task_id % 6 IN (0, 1, 2, 4) GROUP BY 1, 2""", "fx_tasks"))
def lookalike_counts(spark, sf):
    return tx.lookalike_counts(lookalikes(spark, sf))


# ---------------------------------------------------------------- key order
SCHEMA_ORDER = ["k", "cents", "kind", "tags"]
ORDERED = """CASE task_id % 3 WHEN 0 THEN '{"k":1,"cents":2,"kind":"x"}' WHEN 1 THEN '{"kind":"x","k":1,"cents":2}' ELSE '{"zz":0,"cents":2,"k":1}' END"""


def permuted(spark, sf):
    t = fixture(spark, sf, "fx_tasks").withColumn("args_text", F.expr(ORDERED))
    t = t.withColumn("observed", F.expr("json_object_keys(args_text)"))
    return t.withColumn("declared", F.array(*[F.lit(k) for k in SCHEMA_ORDER]))


@query("key_order_witness", fx("""SELECT task_id, CASE task_id % 3 WHEN 0 THEN 'k,cents,kind,tags' WHEN 1 THEN 'kind,k,cents,tags' ELSE 'cents,k,kind,tags' END AS witness,
  CASE task_id % 3 WHEN 0 THEN 'k,cents,kind' WHEN 1 THEN 'kind,k,cents' ELSE 'zz,cents,k' END AS sequence FROM fx_tasks""", "fx_tasks"))
def key_order_witness(spark, sf):
    return permuted(spark, sf).select("task_id", F.array_join(observed_property_order("observed", "declared"), ",").alias("witness"),
                                      F.array_join(key_sequence("args_text"), ",").alias("sequence"))


@query("key_order_normalised", fx("""SELECT task_id, CASE task_id % 3 WHEN 2 THEN '{"k":1,"cents":2,"zz":0}' ELSE '{"k":1,"cents":2,"kind":"x"}' END AS arranged FROM fx_tasks""", "fx_tasks"))
def key_order_normalised(spark, sf):
    s = fixture(spark, sf, "fx_tool_schemas").select("tool_name", "body")
    return spread(permuted(spark, sf)).join(s, "tool_name").select("task_id", order_like_schema("args_text", "body").alias("arranged"))


@query("key_order_split", fx(""", f AS (SELECT a.task_id, a.size, a.family, a.arm, b.truncated AS ct, b.e2e_success AS ce FROM fx_expected a JOIN fx_expected b
   ON a.task_id = b.task_id AND a.size = b.size WHERE a.arm = 'raw' AND b.arm = 'min'),
 g AS (SELECT *, CASE WHEN task_id % 3 = 0 THEN 'accepted_original_order' WHEN task_id % 3 = 1 THEN 'order_only_rejection' ELSE 'other_rejection' END AS category,
   CASE WHEN ct THEN 'truncated' WHEN ce THEN 'correct' ELSE 'wrong' END AS outcome FROM f)
SELECT unnest(['pooled', arm, family || ':' || size]) AS scope, category, outcome, count(*) AS n FROM g GROUP BY 1, 2, 3""", "fx_expected"))
def key_order_split(spark, sf):
    """Accepted means the observed order is the schema order; undeclared keys are refused in any order."""
    e = fixture(spark, sf, "fx_expected").select("task_id", "size", "family", "arm", "truncated", "e2e_success")
    from callscope.operators.integrity import pair_by_arm
    pairs = pair_by_arm(e, "raw", "min", ["task_id", "size", "family"], ["truncated", "e2e_success"])
    p = permuted(spark, sf).selectExpr("task_id", "array_intersect(declared, observed) = observed AS accepted_original",
                                       "size(array_except(observed, declared)) = 0 AS accepted_schema")
    f = pairs.join(p, "task_id").selectExpr("'raw' AS arm", "family", "size", "accepted_original", "accepted_schema",
                                            "truncated_b AS cd_truncated", "e2e_success_b AS cd_e2e")
    return tx.key_order_split(f)


@query("key_order_disagreement", fx("SELECT task_id, task_id % 2 = 1 AS oracle_incomplete FROM fx_tasks", "fx_tasks"))
def key_order_disagreement(spark, sf):
    t = fixture(spark, sf, "fx_tasks").withColumn("elements", F.expr(
        """array('{"a":1,"b":{"c":"x: y","d":2}}', CASE WHEN task_id % 2 = 1 THEN '{"a":1,"b":{"d":2,"c":1}}' ELSE '{"a":3,"b":{"c":4,"d":"z"}}' END)"""))
    return tx.key_order_disagreement(t, "elements").select("task_id", "oracle_incomplete")


@query("align_unordered", fx("""SELECT request_key, h = 10 AS reordered FROM fx_expected WHERE tool_correct""", "fx_expected"))
def align_unordered(spark, sf):
    """Whether alignment moved array elements of a call."""
    from callscope.plans.flagship import scored
    s = scored(spark, sf).where("tool_correct")
    return s.select("request_key", F.expr("transform(filter(aligned, n -> n.path LIKE 'tags[%'), n -> n.path) <> "
                                          "transform(filter(arg_nodes, n -> n.path LIKE 'tags[%'), n -> n.path)").alias("reordered"))


__all__ = ["words_sql"]
