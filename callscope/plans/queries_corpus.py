"""Audit of the schema corpus derived from part; checks use the closed form of each document."""
from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import corpus as co
from callscope.plans.fixtures import fixture, spread, with_fx, words_sql
from callscope.plans.registry import query

INCLUDED = [f"Brand#{i}" for i in range(4, 60)]


def fx(sql: str, names: str = "fx_schema_key") -> str:
    return with_fx(names, sql)


def schemas(spark, sf):
    return spread(fixture(spark, sf, "fx_schemas").select("schema_id", "subset", "name", "body"))


FLAGS = """shape IN ('missing', 'cyclic', 'ref') AS has_ref, shape = 'enum' AS has_enum, unsat AS has_oneOf,
  n_props > 1 AS has_constraints, bad_root OR shape IN ('objects', 'tuple') AS has_array, shape = 'objects' AS has_array_of_objects,
  shape IN ('nested', 'objects') AS has_nested_object, CASE shape WHEN 'nested' THEN 2 WHEN 'objects' THEN 3 ELSE 1 END AS max_depth,
  1 + n_props + CASE shape WHEN 'nested' THEN 1 WHEN 'objects' THEN 2 WHEN 'cyclic' THEN 2 WHEN 'ref' THEN 1 ELSE 0 END
    + CASE WHEN unsat THEN 2 ELSE 0 END AS n_schema_nodes"""


@query("schema_features", fx(f"SELECT schema_id, {FLAGS}, false AS has_anyOf, false AS has_default, false AS has_conditional FROM fx_schema_key"))
def schema_features(spark, sf):
    return co.schema_features(schemas(spark, sf)).selectExpr(
        "schema_id", "has_ref", "has_enum", "has_oneOf", "has_constraints", "has_array", "has_array_of_objects",
        "has_nested_object", "max_depth", "cast(n_schema_nodes as bigint) AS n_schema_nodes", "has_anyOf", "has_default", "has_conditional")


@query("schema_node_counts", fx("""SELECT schema_id, 1 + n_props + CASE shape WHEN 'nested' THEN 1 WHEN 'objects' THEN 2 WHEN 'cyclic' THEN 2
  WHEN 'ref' THEN 1 WHEN 'tuple' THEN 2 ELSE 0 END + CASE WHEN unsat THEN 2 ELSE 0 END AS n_keyword_nodes FROM fx_schema_key"""))
def schema_node_counts(spark, sf):
    return co.schema_nodes(schemas(spark, sf)).groupBy("schema_id").agg(F.count(F.lit(1)).alias("n_keyword_nodes"))


STRUCT = "shape IN ('missing', 'cyclic', 'ref', 'nested', 'objects', 'tuple')"


@query("schema_top_level", fx(f"""SELECT schema_id, n_props AS n_top_props, CASE WHEN bad_required THEN 0 ELSE 1 END AS n_required,
  CASE WHEN {STRUCT} THEN first_prop ELSE '' END AS structured, CASE WHEN {STRUCT} THEN 'structured' ELSE 'flat' END AS stratum,
  true AS has_title_or_description, NOT bad_root AS root_object_with_properties FROM fx_schema_key"""))
def schema_top_level(spark, sf):
    return co.top_level_info(schemas(spark, sf)).selectExpr(
        "schema_id", "cast(n_top_props as bigint) n_top_props", "n_required", "array_join(structured_top_props, ',') AS structured",
        "stratum", "has_title_or_description", "root_object_with_properties")


@query("schema_text_sizes", fx("SELECT schema_id, length(body) AS chars_min, length(body) AS bytes_min FROM fx_schemas", "fx_schemas"))
def schema_text_sizes(spark, sf):
    return co.doc_sizes(schemas(spark, sf)).selectExpr("schema_id", "cast(chars_min as bigint) chars_min", "cast(bytes_min as bigint) bytes_min")


@query("schema_ref_edges", fx("""SELECT schema_id, '/properties/' || first_prop AS at_path,
    CASE shape WHEN 'missing' THEN '#/definitions/nope' WHEN 'cyclic' THEN '#/definitions/c' ELSE '#/definitions/d' END AS target_ref
  FROM fx_schema_key WHERE shape IN ('missing', 'cyclic', 'ref')
  UNION ALL SELECT schema_id, '/definitions/c/properties/next', '#/definitions/c' FROM fx_schema_key WHERE shape = 'cyclic'"""))
def schema_ref_edges(spark, sf):
    return co.ref_edges(schemas(spark, sf))


STATUS = """CASE shape WHEN 'missing' THEN 'nonlocal_or_unresolvable' WHEN 'cyclic' THEN 'cyclic' WHEN 'ref' THEN 'local_ok' ELSE 'none' END"""


@query("schema_ref_status", fx(f"""SELECT schema_id, CASE shape WHEN 'missing' THEN 1 WHEN 'ref' THEN 1 WHEN 'cyclic' THEN 2 ELSE 0 END AS n_refs,
  {STATUS} AS ref_status FROM fx_schema_key"""))
def schema_ref_status(spark, sf):
    return co.ref_status(schemas(spark, sf))


NORM = """CASE WHEN shape NOT IN ('missing', 'cyclic') THEN replace(replace(body, '{"$ref":"#/definitions/d"}',
  '{"type":"string","description":"shared d"}'), ',"definitions":{"d":{"type":"string","description":"shared d"}}', '') END"""


@query("schema_text_normalized", fx(f"SELECT schema_id, {NORM} AS normalized FROM fx_schemas", "fx_schemas"))
def schema_text_normalized(spark, sf):
    return co.normalize_schemas(schemas(spark, sf)).select("schema_id", "normalized")


@query("schema_text_digest_classes", fx("SELECT schema_id, c.copies FROM fx_schema_key JOIN (SELECT eff, count(*) AS copies FROM fx_schema_key GROUP BY 1) c USING (eff)"))
def schema_text_digest_classes(spark, sf):
    d = co.canonical_sha(schemas(spark, sf))
    return d.join(d.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")), "sha256").select("schema_id", "copies")


@query("schema_rule_violations", fx("SELECT schema_id, '' AS ptr, 'required_array' AS rule FROM fx_schema_key WHERE bad_required"))
def schema_rule_violations(spark, sf):
    return co.schema_rule_violations(schemas(spark, sf))


@query("schema_unsat_nodes", fx("SELECT schema_id, unsat AND NOT bad_required AS known_unsatisfiable FROM fx_schema_key"))
def schema_unsat_nodes(spark, sf):
    return co.unsat_nodes(schemas(spark, sf))


# Length of a text printed with two blanks per level: a line break and the level's blanks before each child and before the
# end of each container that isn't empty, and a blank after each member's colon.
PRINTED = """, t AS (SELECT s.schema_id, length(s.body) AS n, j.type AS kind, j.value::varchar AS value, len(regexp_extract_all(j.fullkey[2:], '[.]|\\[')) AS lvl, j.fullkey
     FROM fx_schemas s, json_tree(s.body) j),
 printed AS (SELECT schema_id, any_value(n) + sum(CASE WHEN lvl > 0 THEN 1 + 2 * lvl ELSE 0 END) + count_if(lvl > 0 AND NOT ends_with(fullkey, ']'))
     + sum(CASE WHEN kind IN ('OBJECT', 'ARRAY') AND value NOT IN ('{}', '[]') THEN 1 + 2 * lvl ELSE 0 END) AS chars_pretty FROM t GROUP BY 1),
 judged AS (SELECT r.* REPLACE (reasons || CASE WHEN chars_pretty > 1500 THEN 'too_large;' ELSE '' END AS reasons), chars_pretty
     FROM fx_schema_reasons r JOIN printed USING (schema_id))"""


def judged(spark, sf):
    """Audit with reasons under the default limits."""
    return co.eligibility(co.audit(schemas(spark, sf)), INCLUDED)


@query("schema_eligibility", fx(PRINTED + """ SELECT schema_id, rtrim(reasons, ';') AS reasons, reasons = '' AS eligible, stratum FROM judged""", "fx_schemas fx_schema_reasons"))
def schema_eligibility(spark, sf):
    return judged(spark, sf).selectExpr("schema_id", "array_join(exclusion_reasons, ';') AS reasons", "eligible", "stratum")


DUP = PRINTED + """, d AS (SELECT *, CASE WHEN reasons = '' THEN first_value(schema_id) OVER (PARTITION BY eff, reasons ORDER BY schema_id) END AS holder FROM judged),
 e AS (SELECT *, CASE WHEN reasons = '' AND holder <> schema_id THEN 'exact_duplicate_of:' || holder || ';' ELSE reasons END AS all_reasons FROM d)"""


@query("schema_exact_duplicates", fx(DUP + " SELECT schema_id, rtrim(all_reasons, ';') AS reasons, all_reasons = '' AS eligible FROM e", "fx_schemas fx_schema_reasons"))
def schema_exact_duplicates(spark, sf):
    return co.mark_exact_duplicates(judged(spark, sf)).selectExpr("schema_id", "array_join(exclusion_reasons, ';') AS reasons", "eligible")


@query("schema_audit_summary", fx(DUP + f""", f AS (SELECT *, {FLAGS}, {STATUS} AS ref_status FROM e)
SELECT coalesce(subset, 'TOTAL') AS subset, count(*) AS n, count_if(has_ref)::bigint AS has_ref, count_if(has_enum)::bigint AS has_enum,
  count_if(has_array)::bigint AS has_array, count_if(has_nested_object)::bigint AS has_nested_object,
  count_if(ref_status = 'none')::bigint AS ref_none, count_if(ref_status = 'local_ok')::bigint AS ref_local_ok,
  count_if(ref_status = 'cyclic')::bigint AS ref_cyclic, count_if(shape = 'missing')::bigint AS ref_nonlocal_or_unresolvable,
  count_if(all_reasons = '')::bigint AS eligible, count_if(all_reasons = '' AND stratum = 'flat')::bigint AS eligible_flat,
  count_if(all_reasons = '' AND stratum = 'structured')::bigint AS eligible_structured FROM f GROUP BY ROLLUP (subset)""", "fx_schemas fx_schema_reasons"))
def schema_audit_summary(spark, sf):
    return co.audit_summary(co.mark_exact_duplicates(judged(spark, sf)), ["has_ref", "has_enum", "has_array", "has_nested_object"])


@query("schema_reason_counts", fx(DUP + """, r AS (SELECT unnest(string_split(rtrim(all_reasons, ';'), ';')) AS r, 1 AS a, 0 AS f FROM e WHERE all_reasons <> ''
  UNION ALL SELECT split_part(all_reasons, ';', 1), 0, 1 FROM e WHERE all_reasons <> '')
SELECT split_part(r, ':', 1) AS reason, sum(a)::bigint AS n_all, sum(f)::bigint AS n_first FROM r GROUP BY 1""", "fx_schemas fx_schema_reasons"))
def schema_reason_counts(spark, sf):
    return co.reason_counts(co.mark_exact_duplicates(judged(spark, sf)))


@query("schema_keyword_presence", fx(""", k AS (SELECT subset, unnest(['documents'] || CASE WHEN shape IN ('missing', 'cyclic', 'ref') THEN ['$ref'] ELSE [] END
   || CASE WHEN shape IN ('cyclic', 'ref') THEN ['definitions'] ELSE [] END || CASE WHEN unsat THEN ['oneOf'] ELSE [] END
   || CASE WHEN shape = 'enum' THEN ['enum'] ELSE [] END || CASE WHEN n_props > 1 THEN ['minLength'] ELSE [] END
   || CASE WHEN bad_root OR shape IN ('objects', 'tuple') THEN ['array'] ELSE [] END
   || CASE WHEN shape IN ('nested', 'objects') THEN ['nested'] ELSE [] END) AS keyword FROM fx_schema_key)
SELECT subset, keyword, count(*) AS n FROM k GROUP BY 1, 2"""))
def schema_keyword_presence(spark, sf):
    return co.keyword_presence(schemas(spark, sf))


@query("schema_keyword_audit", fx("""SELECT schema_id, list_aggregate(list_sort(['type', 'properties', 'required'] || CASE WHEN shape = 'enum' THEN ['enum'] ELSE [] END
   || CASE WHEN unsat THEN ['oneOf'] ELSE [] END || CASE WHEN n_props > 1 THEN ['minLength'] ELSE [] END
   || CASE WHEN shape IN ('objects', 'tuple') THEN ['items'] ELSE [] END), 'string_agg', ',') AS assertion_keywords, '' AS legacy_keywords,
  false AS has_format FROM fx_schema_key"""))
def schema_keyword_audit(spark, sf):
    return co.keyword_audit(schemas(spark, sf)).selectExpr(
        "schema_id", "array_join(assertion_keywords, ',') AS assertion_keywords", "array_join(legacy_keywords, ',') AS legacy_keywords", "has_format")


PROPS = f"""list_transform(range(n_props), lambda i: split_part('{words_sql()}', ',', ((eff * 7 + 3 * i) % 40 + 1)::int))"""


@query("schema_property_names", fx(f"""SELECT schema_id, list_aggregate(list_sort(list_distinct({PROPS} || CASE shape WHEN 'nested' THEN ['inner']
   WHEN 'objects' THEN ['leaf'] WHEN 'cyclic' THEN ['next'] ELSE [] END)), 'string_agg', ',') AS known_names FROM fx_schema_key"""))
def schema_property_names(spark, sf):
    return co.schema_property_names(schemas(spark, sf)).selectExpr("schema_id", "array_join(known_names, ',') AS known_names")


@query("schema_texts", fx("""SELECT schema_id, '/description' AS ptr, 'Handles item ' || cast(eff AS string) AS text FROM fx_schema_key
  UNION ALL SELECT schema_id, '/definitions/d/description', 'shared d' FROM fx_schema_key WHERE shape = 'ref'"""))
def schema_texts(spark, sf):
    return co.schema_texts(schemas(spark, sf))


@query("schema_search_text", fx(f"""SELECT schema_id, list_aggregate(list_sort({PROPS} || ['Handles', 'item', cast(eff AS string)] ||
  CASE shape WHEN 'nested' THEN ['inner'] WHEN 'objects' THEN ['leaf'] ELSE [] END), 'string_agg', ' ') AS words FROM fx_schema_key"""))
def schema_search_text(spark, sf):
    return co.schema_text(schemas(spark, sf)).selectExpr("schema_id", "array_join(array_sort(split(schema_text, ' ')), ' ') AS words")


@query("schema_tuple_paths", fx("SELECT schema_id, '/properties/' || first_prop AS path FROM fx_schema_key WHERE shape = 'tuple'"))
def schema_tuple_paths(spark, sf):
    return co.tuple_array_paths(schemas(spark, sf))


@query("schema_printed_sizes", fx(PRINTED + """ SELECT stratum, sum(chars_pretty)::bigint AS chars_pretty, count_if(chars_pretty > 1500)::bigint AS too_large
 FROM judged GROUP BY 1""", "fx_schemas fx_schema_reasons"))
def schema_printed_sizes(spark, sf):
    """Printed size and the too-large reason under the default limits."""
    e = co.eligibility(co.audit(schemas(spark, sf)), INCLUDED)
    return e.groupBy("stratum").agg(F.sum("chars_pretty").alias("chars_pretty"), F.count_if(F.array_contains("exclusion_reasons", "too_large")).alias("too_large"))
