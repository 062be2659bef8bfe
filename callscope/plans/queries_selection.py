"""Ranking, near-duplicates, catalogs, families and training rows."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from callscope.operators import corpus as co
from callscope.operators import scoring as sc
from callscope.operators import selection as se
from callscope.operators import similarity as si
from callscope.operators import splits as sp
from callscope.operators.textsearch import leaks_name
from callscope.plans.fixtures import words_sql, fixture, spread, table, with_fx
from callscope.plans.flagship import catalogs, outputs, scored, tool_inputs
from callscope.plans.queries_corpus import PROPS
from callscope.plans.registry import query, rounded
from callscope.session import shared_dir
from callscope.sources.files import read_review_log


def fx(sql: str, names: str = "fx_pool") -> str:
    return with_fx(names, sql)


def sha(seed, col: str) -> str:
    return f"sha256('{seed}:' || {col})"


def pool(spark, sf):
    return fixture(spark, sf, "fx_pool")


@query("rank_hash", fx(f"SELECT schema_id, {sha(20261004, 'schema_id')} AS rank_key FROM fx_schema_key", "fx_schema_key"))
def rank_hash(spark, sf):
    return se.hash_rank(fixture(spark, sf, "fx_schema_key"), 20261004).select("schema_id", "rank_key")


NAMED = "('Brand#10', 'Brand#11', 'Brand#12')"


@query("rank_dedup_by_name", fx(f""", r AS (SELECT schema_id, subset, row_number() OVER (PARTITION BY eff % 500 ORDER BY {sha(20261004, 'schema_id')}) AS k
   FROM fx_schema_key WHERE subset IN {NAMED})
SELECT schema_id FROM r WHERE k = 1 UNION ALL SELECT schema_id FROM fx_schema_key WHERE subset NOT IN {NAMED}""", "fx_schema_key"))
def rank_dedup_by_name(spark, sf):
    d = se.hash_rank(fixture(spark, sf, "fx_schema_key"), 20261004)
    return se.dedup_by_key(d, se.function_name(), only=F.expr(f"subset IN {NAMED}")).select("schema_id")


INTER = f""", r AS (SELECT schema_id, tool_name, family, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {sha(20261004, 'schema_id')}) AS k FROM fx_pool),
 i AS (SELECT *, row_number() OVER (ORDER BY k, stratum) - 1 AS rank FROM r)"""


def ranked_pool(spark, sf):
    return se.interleave(se.hash_rank(pool(spark, sf), 20261004), ["flat", "structured"])


@query("interleave", fx(INTER + " SELECT rank, schema_id, stratum FROM i"))
def interleave(spark, sf):
    return ranked_pool(spark, sf).select("rank", "schema_id", "stratum")


# ---------------------------------------------------------------- near duplicates
def doc_sets(spark, sf):
    from callscope.functions.text import words_sql
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select(F.col("doc_id").alias("id"), F.expr(f"array_distinct({words_sql('text')})").alias("toks"),
                    F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256).alias("rank_key"))


def schema_sets(spark, sf):
    s = spread(fixture(spark, sf, "fx_schemas").select("schema_id", "body"))
    return s.select(F.col("schema_id").alias("id"), F.expr("""array_distinct(transform(map_keys(try_variant_get(try_parse_json(body),
        '$.properties', 'map<string,variant>')), k -> lower(k)))""").alias("toks"),
        F.sha2(F.concat(F.lit("7:"), F.col("schema_id")), 256).alias("rank_key"))


# Sets (id, toks, rank_key) to pairs of positions in rank order, overlaps counted token by token.
_PAIRS = """, s AS MATERIALIZED (SELECT id, toks, row_number() OVER (ORDER BY rank_key, id) AS pos FROM {sets} WHERE len(toks) > 0),
 tk AS (SELECT pos, len(toks) AS n, unnest(toks) AS tok FROM s),
 near AS MATERIALIZED (SELECT a.pos AS lo, b.pos AS hi FROM tk a JOIN tk b ON a.tok = b.tok AND a.pos < b.pos
          GROUP BY a.pos, b.pos, a.n, b.n HAVING count(*) >= {t} * (a.n + b.n - count(*)))"""
_GREEDY = """, c AS MATERIALIZED (SELECT hi, list(lo) AS before, row_number() OVER (ORDER BY hi) AS step FROM near GROUP BY hi),
 g(step, kept) AS (SELECT 0::bigint, coalesce((SELECT list(DISTINCT lo) FROM near WHERE lo NOT IN (SELECT hi FROM c)), []::bigint[]) UNION ALL
   SELECT c.step, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, c.hi) END FROM g JOIN c ON c.step = g.step + 1),
 k AS MATERIALIZED (SELECT unnest(kept) AS pos FROM (SELECT kept FROM g ORDER BY step DESC LIMIT 1))
SELECT id FROM s WHERE pos IN (SELECT pos FROM k) OR pos NOT IN (SELECT hi FROM c) UNION ALL SELECT id FROM {sets} WHERE len(toks) = 0"""
_FAMILIES = """, e AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM near JOIN s a ON a.pos = near.lo JOIN s b ON b.pos = near.hi {named}),
 cc(id, label) USING KEY (id) AS (SELECT id, id FROM {sets} UNION SELECT e.y, min(cc.label) FROM cc JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) e ON e.x = cc.id
   JOIN recurring.cc old ON old.id = e.y WHERE cc.label < old.label GROUP BY e.y)"""
DOC_SETS = """, docsets AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks,
   sha256('7:' || cast(doc_id AS varchar)) AS rank_key FROM documents)"""
SCHEMA_PROPS = f"list_transform(range(n_props), lambda i: split_part('{words_sql()}', ',', ((eff * 7 + 3 * i) % 40 + 1)::int))"
SCHEMA_SETS = f""", schemasets AS (SELECT schema_id AS id, list_distinct({SCHEMA_PROPS}) AS toks, sha256('7:' || schema_id) AS rank_key FROM fx_schema_key)"""
POOL_SETS = f""", poolsets AS (SELECT schema_id AS id, list_distinct({SCHEMA_PROPS}) AS toks, schema_id AS rank_key, CASE WHEN subset IN {NAMED} THEN eff % 500 END AS fn
   FROM fx_schema_key JOIN (SELECT schema_id FROM fx_pool) p USING (schema_id))"""


def recursive(sql: str, names: str) -> str:
    return fx(sql, names).replace("WITH ", "WITH RECURSIVE ", 1)


@query("near_dup_greedy_documents", "WITH RECURSIVE " + (DOC_SETS + _PAIRS.format(sets="docsets", t=0.8) + _GREEDY.format(sets="docsets")).lstrip(", "))
def near_dup_greedy_documents(spark, sf):
    return si.near_dup_greedy(doc_sets(spark, sf), 0.8)


@query("near_dup_greedy_schemas", recursive(SCHEMA_SETS + _PAIRS.format(sets="schemasets", t=0.8) + _GREEDY.format(sets="schemasets"), "fx_schema_key"))
def near_dup_greedy_schemas(spark, sf):
    return si.near_dup_greedy(schema_sets(spark, sf), 0.8, first_batch=256)


@query("families_documents", "WITH RECURSIVE " + (DOC_SETS + _PAIRS.format(sets="docsets", t=0.5) + _FAMILIES.format(sets="docsets", named="")
       + " SELECT id AS doc_id, label AS root FROM cc").lstrip(", "))
def families_documents(spark, sf):
    kept = doc_sets(spark, sf).select(F.col("id").alias("schema_id"), F.lit(None).cast("string").alias("fn"), "toks")
    return sp.families(kept, 0.5).select(F.col("schema_id").alias("doc_id"), "root")


@query("families_schemas", recursive(POOL_SETS + _PAIRS.format(sets="poolsets", t=0.5) + _FAMILIES.format(sets="poolsets", named="""UNION ALL
     SELECT a.id, b.id FROM poolsets a JOIN poolsets b ON a.fn = b.fn AND a.id < b.id""") + """,
 f AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS n FROM (SELECT DISTINCT label FROM cc) x)
SELECT cc.id AS schema_id, 'F' || lpad(cast(n AS varchar), greatest(5, length(cast(n AS varchar)))::int, '0') AS family, cc.label AS root
FROM cc JOIN f USING (label)""", "fx_schema_key fx_pool"))
def families_schemas(spark, sf):
    """Families over property sets and function names of the eligible documents."""
    s = schema_sets(spark, sf).select(F.col("id").alias("schema_id"), "toks")
    p = pool(spark, sf).select("schema_id", "subset").join(s, "schema_id")
    kept = p.withColumn("fn", F.when(F.expr(f"subset IN {NAMED}"), se.function_name()))
    return sp.families(kept, 0.5)


# ---------------------------------------------------------------- targets and catalogs
R, SIZES = 10, [5, 10, 20]


def targets(spark, sf):
    return se.draw_targets(pool(spark, sf), R, 20261005)


TARGETS = f""", one AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {sha('20261005:targets', 'tool_id')}) AS fk FROM fx_pool WHERE task_suitable),
 tr AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {sha('20261005:targets', 'tool_id')}) - 1 AS s FROM one WHERE fk = 1),
 tt AS (SELECT *, 2 * (s // 5) + CASE WHEN stratum = 'flat' AND s % 5 >= 3 OR stratum <> 'flat' AND s % 5 >= 2 THEN 1 ELSE 0 END AS replicate FROM tr),
 tg AS (SELECT replicate::int AS replicate, tool_id, family, stratum, schema_id, row_number() OVER (PARTITION BY replicate ORDER BY stratum, {sha('20261005:targets', 'tool_id')}) - 1 AS slot
   FROM tt WHERE replicate < {R})"""


@query("targets", fx(TARGETS + " SELECT replicate, slot, tool_id, family, stratum FROM tg"))
def targets_query(spark, sf):
    return targets(spark, sf)


CATALOGS = TARGETS + f""", cd AS (SELECT p.tool_id, p.family, p.stratum, r AS replicate, sha256('20261005:replicate:' || r || ':' || p.tool_id) AS h
   FROM fx_pool p, range({R}) x(r) WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.replicate = r AND tg.family = p.family)),
 cb AS (SELECT *, row_number() OVER (PARTITION BY replicate, family ORDER BY h) AS fk FROM cd),
 cn AS (SELECT *, row_number() OVER (PARTITION BY replicate, stratum ORDER BY h) AS n FROM cb WHERE fk = 1),
 cc AS (SELECT replicate, stratum, count(*) AS c FROM tg GROUP BY 1, 2), ck AS (SELECT replicate, count(*) AS k FROM tg GROUP BY 1),
 cf AS (SELECT cn.replicate, tool_id, k + row_number() OVER (PARTITION BY cn.replicate ORDER BY n + coalesce(c, 0), cn.stratum <> 'flat', h) - 1 AS pos
   FROM cn JOIN ck USING (replicate) LEFT JOIN cc ON cc.replicate = cn.replicate AND cc.stratum = cn.stratum WHERE n <= {max(SIZES)}),
 cm AS (SELECT replicate, tool_id, slot AS pos FROM tg UNION ALL SELECT * FROM cf),
 cs AS (SELECT *, 'C' || lpad(size::string, 3, '0') || '_R' || lpad(replicate::string, 2, '0') AS catalog_id FROM (SELECT *, unnest({SIZES}) AS size FROM cm) WHERE pos < size),
 ct AS (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY sha256('20261005:order:' || replicate || ':' || size || ':' || tool_id)) - 1 AS presentation_pos FROM cs)"""


def members(spark, sf):
    return se.build_catalogs(pool(spark, sf), targets(spark, sf), R, SIZES, 20261005)


@query("catalogs", fx(CATALOGS + " SELECT catalog_id, tool_id, pos::bigint AS pos, presentation_pos FROM ct"))
def catalogs_query(spark, sf):
    return members(spark, sf).select("catalog_id", "tool_id", F.col("pos").cast("bigint").alias("pos"), "presentation_pos")


@query("catalog_stats", fx(CATALOGS + """, j AS (SELECT ct.*, p.stratum, p.n_props, tg.tool_id IS NOT NULL AS is_target FROM ct JOIN fx_pool p USING (tool_id)
   LEFT JOIN tg ON tg.replicate = ct.replicate AND tg.tool_id = ct.tool_id)
SELECT catalog_id, round(avg(n_props), 6) AS mean_n_props, count_if(stratum = 'flat')::bigint AS flat, count_if(stratum <> 'flat')::bigint AS structured,
  sum(CASE WHEN is_target THEN presentation_pos END)::bigint AS target_position_sum FROM j GROUP BY 1"""))
def catalog_stats(spark, sf):
    c = se.catalog_stats(members(spark, sf), pool(spark, sf), targets(spark, sf), ["n_props"])
    return rounded(c.selectExpr("catalog_id", "mean_n_props", "coalesce(strata['flat'], 0) AS flat", "coalesce(strata['structured'], 0) AS structured",
                                "cast(aggregate(map_values(target_positions), 0, (a, x) -> a + x) as bigint) AS target_position_sum"))


# ---------------------------------------------------------------- review log
REVIEW_LINE = """CASE WHEN rank % 4 = 3 THEN cast(rank AS string) || '|R|' || CASE WHEN rank % 60 = 11 THEN 'WEIRD' ELSE 'TOY' END
  ELSE cast(rank AS string) || '|A|' || CASE WHEN rank % 50 = 6 THEN 'Bad-Name' ELSE tool_name END || '|' || family || '|' ||
  CASE WHEN rank % 2 = 0 THEN '1' ELSE '0' END || '|does the thing' || CASE WHEN rank % 70 = 12 THEN ' on GitHub' ELSE '' END END"""
FORBIDDEN = ["glaive", "github", "snowplow", "washingtonpost", "jsonschemabench", "schemastore", "kubernetes"]


def reviews(spark, sf):
    """Review text written out and read back as a log, comments included."""
    path = f"{shared_dir(spark)}/reviews-{uuid.uuid4().hex}"
    c = ranked_pool(spark, sf)
    lines = c.select(F.expr(REVIEW_LINE).alias("value"))
    notes = c.where("rank % 10 = 0").select(F.expr("'# reviewed up to ' || cast(rank AS string)").alias("value"))
    lines.unionByName(notes).write.text(path)
    return read_review_log(spark, path), c.select("rank", "schema_id", "subset", "stratum")


@query("compile_pool", fx(INTER + """, a AS (SELECT *, row_number() OVER (ORDER BY rank) - 1 AS n FROM i WHERE rank % 4 <> 3)
SELECT 'T' || lpad(n::string, greatest(3, length(n::string))::int, '0') AS tool_id, rank AS candidate_rank, schema_id,
  CASE WHEN rank % 50 = 6 THEN 'Bad-Name' ELSE tool_name END AS tool_name, rank % 2 = 0 AS task_suitable FROM a"""))
def compile_pool(spark, sf):
    p, _, _ = se.compile_pool(*reviews(spark, sf), FORBIDDEN)
    return p.selectExpr("tool_id", "cast(candidate_rank as bigint) candidate_rank", "schema_id", "tool_name", "task_suitable")


@query("compile_pool_violations", fx(INTER + """ SELECT rank, 'code_unknown' AS problem FROM i WHERE rank % 4 = 3 AND rank % 60 = 11
 UNION ALL SELECT rank, 'tool_name_form' FROM i WHERE rank % 4 <> 3 AND rank % 50 = 6
 UNION ALL SELECT rank, 'forbidden_word' FROM i WHERE rank % 4 <> 3 AND rank % 70 = 12
 UNION ALL SELECT rank, 'tool_name_repeated' FROM i WHERE rank % 4 <> 3 AND rank % 50 = 6 AND rank > 6"""))
def compile_pool_violations(spark, sf):
    _, v, _ = se.compile_pool(*reviews(spark, sf), FORBIDDEN)
    return v.selectExpr("cast(rank as bigint) AS rank", "problem")


@query("compile_pool_summary", fx(INTER + """ SELECT CASE WHEN rank % 4 <> 3 THEN 'accept' WHEN rank % 60 = 11 THEN 'reject:WEIRD' ELSE 'reject:TOY' END AS decision,
  count(*) AS n FROM i GROUP BY 1"""))
def compile_pool_summary(spark, sf):
    _, _, s = se.compile_pool(*reviews(spark, sf), FORBIDDEN)
    return s


# ---------------------------------------------------------------- leakage and splits
def corpus_keys(spark, sf):
    """Documents with eligibility, digest, function name and property set."""
    full = fixture(spark, sf, "fx_schemas").select("schema_id", "subset", "name", "body")
    k = fixture(spark, sf, "fx_schema_reasons").select("schema_id", (F.col("reasons") == "").alias("eligible"))
    d = co.normalize_schemas(spread(full), ("schema_id", "subset")).select("schema_id", "subset", F.col("normalized_sha256").alias("sha"))
    s = schema_sets(spark, sf).select(F.col("id").alias("schema_id"), "toks")
    return (d.join(k.hint("merge"), "schema_id").join(s.hint("merge"), "schema_id").withColumn("fn", F.when(F.expr(f"subset IN {NAMED}"), se.function_name())))


KEYS = f"""SELECT schema_id, subset, eff, reasons = '' AS eligible, CASE WHEN subset IN {NAMED} THEN eff % 500 END AS fn, {PROPS} AS toks FROM fx_schema_reasons"""


LEAKS = f""", k AS ({KEYS}), t AS (SELECT k.* FROM k JOIN tg USING (schema_id)),
 near AS (SELECT DISTINCT k.schema_id FROM k, t WHERE len(list_intersect(k.toks, t.toks)) / len(list_distinct(k.toks || t.toks)) >= 0.5)
SELECT schema_id, CASE WHEN NOT eligible THEN 'not_eligible' WHEN schema_id IN (SELECT schema_id FROM t) THEN 'is_test_tool'
  WHEN eff IN (SELECT eff FROM t) THEN 'same_schema_as_test_tool' WHEN fn IN (SELECT fn FROM t WHERE fn IS NOT NULL) THEN 'same_function_as_test_tool'
  WHEN schema_id IN (SELECT schema_id FROM near) THEN 'near_duplicate_of_test_tool' ELSE 'kept' END AS reason FROM k"""


@query("leakage_filter", fx(TARGETS + LEAKS, "fx_pool"))
def leakage_filter(spark, sf):
    c = corpus_keys(spark, sf)
    t = c.join(pool(spark, sf).join(targets(spark, sf).select("tool_id"), "tool_id").select("schema_id"), "schema_id", "left_semi")
    return sp.leakage_filter(c, t).select("schema_id", "reason")


SPLIT = """, fm AS (SELECT family, max((subset = 'Brand#10')::int) AS o, ('0x' || substr(sha256('20261112:split:' || family), 1, 13))::bigint / pow(16, 13) AS u FROM fx_pool GROUP BY 1),
 fs AS (SELECT p.*, CASE WHEN o = 1 THEN 'holdout_family' WHEN u < 0.3 THEN 'valid' ELSE 'train' END AS split FROM fx_pool p JOIN fm USING (family))"""


def split_rows(spark, sf):
    return sp.family_split(pool(spark, sf), ["Brand#10"], 20261112, 0.3)


@query("family_split", fx(SPLIT + " SELECT schema_id, family, split FROM fs"))
def family_split(spark, sf):
    return split_rows(spark, sf).select("schema_id", "family", "split")


@query("split_violations", fx(TARGETS + """, w AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'valid' END AS split FROM fx_pool)
SELECT schema_id AS key, 'test_tool_in_pool' AS problem FROM tg UNION ALL
SELECT family, 'family_in_two_splits' FROM w GROUP BY family HAVING count(DISTINCT split) > 1"""))
def split_violations(spark, sf):
    """A split made by row instead of by family, test tools left in: everything wrong must show."""
    rows = pool(spark, sf).withColumn("split", F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'train' ELSE 'valid' END"))
    t = pool(spark, sf).join(targets(spark, sf).select("tool_id"), "tool_id").select("schema_id")
    return sp.split_violations(rows, t)


@query("pool_summary", fx(TARGETS + LEAKS.replace("\nSELECT schema_id, CASE WHEN NOT", ", lk AS (SELECT schema_id, CASE WHEN NOT") + ")" + SPLIT + """ SELECT 'leakage_reason' AS kind, '' AS split, reason AS item, count(*) AS n FROM lk GROUP BY reason
 UNION ALL SELECT 'split' AS kind, split, '' AS item, count(*) AS n FROM fs GROUP BY split
 UNION ALL SELECT 'split_stratum', split, stratum, count(*) FROM fs GROUP BY split, stratum
 UNION ALL SELECT 'train_keyword', split, unnest(['type', 'properties', 'required'] || CASE WHEN shape = 'enum' THEN ['enum'] ELSE [] END
   || CASE WHEN n_props > 1 THEN ['minLength'] ELSE [] END || CASE WHEN shape IN ('objects', 'tuple') THEN ['items'] ELSE [] END) AS item, count(*)
   FROM fs WHERE split = 'train' GROUP BY split, item""", "fx_pool"))
def pool_summary(spark, sf):
    k = co.keyword_audit(spread(fixture(spark, sf, "fx_schemas").select("schema_id", "body"))).select("schema_id", F.col("assertion_keywords").alias("keywords"))
    # merged: what is derived from a small file may be large
    return sp.trainpool_summary(split_rows(spark, sf).join(k.hint("merge"), "schema_id"), leakage_filter(spark, sf))


# ---------------------------------------------------------------- samples
@query("sample_hash", fx(""", r AS (SELECT arm, request_key, row_number() OVER (PARTITION BY arm ORDER BY sha256('s1' || chr(1) || request_key)) AS k FROM fx_expected)
SELECT arm, request_key FROM r WHERE k <= 15""".replace("chr(1)", "chr(0)"), "fx_expected"))
def sample_hash(spark, sf):
    return se.hash_sample(fixture(spark, sf, "fx_expected").select("arm", "request_key"), 15, "arm", "request_key", "s1")


@query("sample_first_per_stratum", fx("""SELECT arm, size, truncated, min(task_id) AS task_id FROM fx_expected GROUP BY 1, 2, 3""", "fx_expected"))
def sample_first_per_stratum(spark, sf):
    e = fixture(spark, sf, "fx_expected").select("arm", "size", "truncated", "task_id")
    return se.first_per_stratum(e, ["arm", "size", "truncated"], "task_id")


@query("sample_failure_examples", fx(""", r AS (SELECT e.arm, e.size, e.failure_primary, e.request_key, f.raw_content,
   e.failure_secondary, g.gold_args, CASE WHEN NOT e.tool_correct OR e.schema_valid THEN '' WHEN e.h = 11 THEN 'enum' WHEN e.h = 12 THEN 'type' WHEN e.h = 13 THEN 'required'
     WHEN e.h = 14 THEN 'maximum' ELSE 'additionalProperties' END AS validators,
   row_number() OVER (PARTITION BY e.arm, e.size, e.failure_primary ORDER BY e.request_key) AS k
   FROM fx_expected e JOIN fx_results f USING (request_key) JOIN fx_task_rows g ON g.task_id = e.task_id WHERE failure_primary IS NOT NULL)
SELECT arm, size, failure_primary, request_key, raw_content AS output, failure_secondary, gold_args, validators FROM r WHERE k <= 3""", "fx_expected fx_results fx_task_rows"))
def sample_failure_examples(spark, sf):
    return (se.failure_examples(scored(spark, sf)).withColumn("validators", F.array_join("errors.validator", ","))
            .withColumn("failure_secondary", F.array_join("failure_secondary", ",")).drop("errors"))


# ---------------------------------------------------------------- training rows
SFT_SIZES = [1, 3, 5]
TEMPLATE = "Tools: {tools}\nAnswer with JSON."
SUFFIX = "\n\nUse the tool \"{tool_name}\"."


def examples(spark, sf):
    s = split_rows(spark, sf).where("split <> 'holdout_family'")
    t = fixture(spark, sf, "fx_schemas").select("schema_id", "body")
    return s.join(t, "schema_id").selectExpr(
        "schema_id AS example_id", "split", "family", "concat('do_', first_prop) AS tool_name",
        "concat('{\"name\":\"do_', first_prop, '\",\"parameters\":', body, '}') AS tool", "concat('Please set ', first_prop) AS request",
        "concat('{\"', first_prop, '\": \"v\"}') AS gold_args")


def _h(tag: str, more: str = "") -> str:
    return f"('0x' || substr(sha256('20261112:{tag}:' || example_id{more}), 1, 12))::bigint"


@query("sft_rows", fx(SPLIT + f""", x AS (SELECT schema_id AS example_id, split, family, 'do_' || first_prop AS tool_name FROM fs WHERE split <> 'holdout_family'),
 f AS (SELECT split, family, row_number() OVER (PARTITION BY split ORDER BY sha256('20261112:' || split || ':' || family)) - 1 AS num FROM (SELECT DISTINCT split, family FROM x)),
 n AS (SELECT split, count(*) AS fams FROM f GROUP BY 1),
 e AS (SELECT x.*, num, fams, {SFT_SIZES}[({_h('size')} % 3 + 1)::int] AS k FROM x JOIN f USING (split, family) JOIN n USING (split)),
 m AS (SELECT split, family, tool_name, row_number() OVER (PARTITION BY split, family ORDER BY sha256('20261112:' || example_id)) - 1 AS mno, count(*) OVER (PARTITION BY split, family) AS ms FROM x),
 w AS (SELECT *, unnest(range(1, least(k - 1, fams - 1)::bigint + 1)) AS j FROM e WHERE k > 1),
 p AS (SELECT w.example_id, w.tool_name AS own, w.j, m.tool_name AS pname FROM w JOIN f ON f.split = w.split AND f.num = (w.num + 1 + ({_h('start')} + j) % (fams - 1)) % fams
   JOIN m ON m.split = w.split AND m.family = f.family AND m.mno = {_h('member', " || ':' || j")} % m.ms),
 q AS (SELECT example_id, count(DISTINCT pname) AS c FROM p WHERE pname <> own GROUP BY 1)
SELECT e.example_id, e.split, 1 + coalesce(q.c, 0) AS catalog_size, 'Please set ' || substr(tool_name, 4) || CASE WHEN coalesce(q.c, 0) = 0 THEN chr(10) || chr(10) || 'Use the tool "' || tool_name || '".' ELSE '' END AS user_message,
  '{{"tool": "' || tool_name || '", "arguments": {{"' || substr(tool_name, 4) || '": "v"}}}}' AS answer FROM e LEFT JOIN q USING (example_id)"""))
def sft_rows(spark, sf):
    r = sp.build_sft(examples(spark, sf), SFT_SIZES, 20261112, TEMPLATE, SUFFIX)
    return r.selectExpr("example_id", "split", "cast(catalog_size as bigint) AS catalog_size", "messages[1].content AS user_message", "messages[2].content AS answer")


def cards(spark, sf):
    """Teacher cards: the free answer is the card, the constrained answer the round trip."""
    s = scored(spark, sf, "arggen").withColumn("request", F.expr("concat('Please handle ', CASE WHEN task_id % 9 = 0 THEN tool_name ELSE 'this' END)"))
    a = s.where("arm = 'raw'").select("task_id", "http_status", F.col("json_valid").alias("card_ok"), F.col("tool_correct").alias("has_arguments"),
                                      F.size("schema_errors").alias("n_schema_errors"), leaks_name("request", "tool_name").alias("leaks_name"))
    b = s.where("arm = 'min'").select("task_id", F.col("format_ok").alias("trip_format_ok"), F.col("semantic_correct").alias("trip_semantic"),
                                      F.coalesce(F.size("extra_paths"), F.lit(0)).alias("trip_extra"))
    return sp.synth_filter(a.join(b, "task_id"))


SYNTH = """, r AS (SELECT a.task_id, CASE WHEN a.fault <= 3 THEN 'teacher_http_error' WHEN NOT a.json_valid THEN 'unparseable_card'
   WHEN NOT a.tool_correct THEN 'empty_arguments' WHEN NOT a.schema_valid THEN 'arguments_invalid_against_raw_schema'
   WHEN a.task_id % 9 = 0 THEN 'request_leaks_tool_name' WHEN NOT b.json_valid THEN 'round_trip_unparseable'
   WHEN NOT b.semantic_correct OR b.h = 18 THEN 'round_trip_disagrees' ELSE 'kept' END AS reason
  FROM fx_expected a JOIN fx_expected b ON a.task_id = b.task_id WHERE a.family = 'arggen' AND b.family = 'arggen' AND a.arm = 'raw' AND b.arm = 'min')"""


@query("synth_filter", fx(SYNTH + " SELECT task_id, reason FROM r", "fx_expected"))
def synth_filter(spark, sf):
    return cards(spark, sf).select("task_id", "reason")


@query("synth_pass_rate", fx(SYNTH + " SELECT count(*) AS n, count_if(reason = 'kept')::bigint AS kept, round(100 * avg((reason = 'kept')::int), 6) AS pass_rate FROM r", "fx_expected"))
def synth_pass_rate(spark, sf):
    return rounded(sp.pass_rate(cards(spark, sf), []))


@query("mutations", "SELECT event_id AS unit, 27::bigint AS n_invalid, 2::bigint AS n_envelope, 1::bigint AS n_not_in_catalog FROM events")
def mutations(spark, sf):
    rules, _ = tool_inputs(spark, sf)
    kinds = "array('signup', 'error', 'click', 'view', 'purchase')"
    u = spread(fixture(spark, sf, "fx_task_rows")).selectExpr(
        "task_id AS unit", "concat('{\"tool\": \"', tool_name, '\", \"arguments\": ', gold_args, '}') AS gold_call", f"{kinds} AS catalog_tools")
    return sp.invalid_calls(u, rules).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n_invalid"), F.count_if(F.col("route_reason") == "envelope").alias("n_envelope"),
        F.count_if(F.col("route_reason") == "tool_not_in_catalog").alias("n_not_in_catalog"))


__all__ = ["catalogs", "outputs", "sc"]
