"""Audit of a corpus of JSON Schema documents (schema_id, subset, body)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.jsontext import normalized_forms, text_forms
from callscope.functions.jsontree import ARR, OBJ, SEP, once, strict_variant, tree_nodes, with_nodes
from callscope.operators.lookup import left_lookup
from callscope.operators.schematree import schema_nodes, schema_tree, sql_list, with_schema_tree
from callscope.session import cut_lineage

# fixed values: keyword groups of the audit
CONSTRAINTS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength",
               "pattern", "format", "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties")
CONDITIONALS = ("if", "then", "else", "dependencies", "dependentSchemas", "dependentRequired")
ASSERTIONS = ("type", "enum", "const", "required", "properties", "additionalProperties", "patternProperties",
              "propertyNames", "minProperties", "maxProperties", "dependencies", "dependentRequired",
              "dependentSchemas", "items", "prefixItems", "additionalItems", "contains", "minItems", "maxItems",
              "uniqueItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength",
              "maxLength", "pattern", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
              "unevaluatedProperties", "unevaluatedItems")
LEGACY = ("dependencies", "additionalItems", "id", "extends", "divisibleBy", "disallow")
PRESENCE = ("$ref", "oneOf", "anyOf", "allOf", "if", "not", "enum", "const", "pattern", "format", "patternProperties",
            "additionalProperties", "dependencies", "dependentRequired", "dependentSchemas", "minimum", "maximum",
            "minLength", "maxLength", "minItems", "maxItems", "uniqueItems", "$defs", "definitions")
TYPE_NAMES = ("array", "boolean", "integer", "null", "number", "object", "string")


def _types(v: str) -> str:
    t = f"try_variant_get({v}, '$.type', 'variant')"
    return (f"CASE WHEN schema_of_variant({t}) = 'STRING' THEN array(cast({t} as string)) "
            f"ELSE coalesce(transform(filter(try_cast({t} as {ARR}), e -> schema_of_variant(e) = 'STRING'), "
            f"e -> cast(e as string)), cast(array() as array<string>)) END")


def _obj(v: str, k: str) -> str:
    return f"try_variant_get({v}, '$[\"{k}\"]', '{OBJ}')"


def _feature_columns() -> list[Column]:
    """Flag columns over _w (feature-walker nodes) and _k (their member names)."""
    has = lambda *ks: F.expr(f"arrays_overlap(_k, array({sql_list(ks)}))")
    items = "try_variant_get(n.v, '$.items', 'variant')"
    arrayish = f"(array_contains({_types('n.v')}, 'array') OR array_contains(n.keys, 'items'))"
    return [
        has("$ref").alias("has_ref"), has("enum").alias("has_enum"), has("oneOf").alias("has_oneOf"),
        has("anyOf").alias("has_anyOf"), has("allOf").alias("has_allOf"), has("not").alias("has_not"),
        has(*CONDITIONALS).alias("has_conditional"), has("patternProperties").alias("has_patternProperties"),
        has(*CONSTRAINTS).alias("has_constraints"), F.expr(f"exists(_w, n -> {arrayish})").alias("has_array"),
        F.expr(f"""exists(_w, n -> try_cast({items} as {OBJ}) IS NOT NULL AND (array_contains(map_keys(try_cast({items} as {OBJ})), 'properties')
               OR array_contains({_types(items)}, 'object')))""").alias("has_array_of_objects"),
        F.expr(f"exists(_w, n -> n.depth >= 1 AND coalesce(cardinality({_obj('n.v', 'properties')}), 0) > 0)").alias("has_nested_object"),
        has("format").alias("has_format"), has("pattern").alias("has_pattern"), has("const").alias("has_const"),
        F.expr("exists(_w, n -> coalesce(schema_of_variant(try_variant_get(n.v, '$.additionalProperties', 'variant')) = 'BOOLEAN' "
               "AND NOT try_variant_get(n.v, '$.additionalProperties', 'boolean'), false))").alias("has_additionalProperties_false"),
        has("default").alias("has_default"),
        F.expr(f"coalesce(array_max(transform(filter(_w, n -> {_obj('n.v', 'properties')} IS NOT NULL), n -> n.depth + 1)), 0)").alias("max_depth"),
        F.expr("size(_w)").alias("n_schema_nodes")]


def _with_walk(d: DataFrame) -> DataFrame:
    d = d.withColumn("_w", once("filter(tree, n -> n.feat AND n.keys IS NOT NULL)"))
    return d.withColumn("_k", once("array_distinct(flatten(transform(_w, n -> n.keys)))"))


def schema_features(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id", "subset")) -> DataFrame:
    """17 flags, depth and node count per document, all from the node array inside the row."""
    return _with_walk(with_schema_tree(schemas)).select(*keep, *_feature_columns())


def _with_root(d: DataFrame) -> DataFrame:
    d = d.withColumn("_p", F.expr(f"coalesce({_obj('_v', 'properties')}, cast(map() as {OBJ}))"))
    struct = (f"try_cast(e.value as {OBJ}) IS NOT NULL AND (arrays_overlap({_types('e.value')}, array('object', 'array')) OR "
              f"arrays_overlap(map_keys(try_cast(e.value as {OBJ})), array('properties', 'items', '$ref', 'oneOf', 'anyOf', 'allOf')))")
    return d.withColumn("structured_top_props", F.expr(f"transform(filter(map_entries(_p), e -> {struct}), e -> e.key)"))


def _top_columns() -> list[Column]:
    return [
        F.expr("cardinality(_p)").alias("n_top_props"),
        F.expr("coalesce(size(filter(try_variant_get(_v, '$.required', 'array<string>'), r -> array_contains(map_keys(_p), r))), 0)").alias("n_required"),
        F.col("structured_top_props"),
        F.expr("CASE WHEN size(structured_top_props) > 0 THEN 'structured' ELSE 'flat' END").alias("stratum"),
        F.expr("coalesce(try_variant_get(_v, '$.title', 'string'), '') <> '' OR "
               "coalesce(try_variant_get(_v, '$.description', 'string'), '') <> ''").alias("has_title_or_description"),
        F.expr(f"""cardinality(_p) > 0 AND (try_variant_get(_v, '$.type', 'variant') IS NULL
               OR coalesce(to_json(try_variant_get(_v, '$.type', 'variant')) IN ('"object"', '["object"]'), false))""").alias("root_object_with_properties")]


def top_level_info(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Property counts, structured properties and stratum of the root object."""
    return _with_root(schemas.withColumn("_v", once(strict_variant("body")))).select(*keep, *_top_columns())


def doc_sizes(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Characters printed with indent 2 and minified, bytes of the minified text."""
    return schemas.select(*keep, text_forms("body").alias("t")).select(*keep, "t.chars_pretty", "t.chars_min", "t.bytes_min")


def canonical_sha(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    return schemas.select(*keep, F.sha2(text_forms("body")["canonical"], 256).alias("sha256"))


def normalize_schemas(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Self-contained documents and the digest of their canonical text."""
    return (schemas.select(*keep, normalized_forms("body").alias("t"))
            .select(*keep, F.col("t.status").alias("normalize_status"), "t.normalized",
                    F.sha2("t.canonical", 256).alias("normalized_sha256")))


# ---------------------------------------------------------------- references
_TARGET = f"""CASE WHEN r = '#' THEN '' WHEN startswith(r, '#/') THEN concat('{SEP}', array_join(transform(split(substr(r, 3), '/'),
    k -> try_url_decode(replace(replace(replace(k, '~1', '/'), '~0', '~'), '+', '%2B'))), '{SEP}')) END"""


def _refs(d: DataFrame) -> DataFrame:
    """References of a frame that already holds nodes."""
    return d.withColumn("refs", once(f"""transform(filter(nodes, n -> n.key = '$ref' AND n.kind = 'STR'), n -> transform(array(n.txt), r ->
        named_struct('at', substring_index(n.ptr, '{SEP}', size(split(n.ptr, '{SEP}')) - 1), 'ref', r, 'target', {_TARGET}))[0])"""))


def ref_edges(schemas: DataFrame) -> DataFrame:
    """Every $ref string anywhere, literal positions included."""
    return (_refs(with_nodes(schemas.select("schema_id", "body"), "body")).select("schema_id", F.explode("refs").alias("r"))
            .select("schema_id", F.expr(f"replace(r.at, '{SEP}', '/')").alias("at_path"), F.col("r.ref").alias("target_ref")))


def _with_ref_graph(d: DataFrame) -> DataFrame:
    d = _refs(d)
    d = d.withColumn("_known", once("transform(nodes, n -> n.ptr)"))
    d = d.withColumn("_graph", once(f"""transform(filter(array_distinct(transform(refs, x -> named_struct('ref', x.ref, 'target', x.target))),
        x -> x.target IS NOT NULL), x -> named_struct('ref', x.ref, 'next', array_distinct(transform(filter(refs, y ->
          x.target = '' OR y.at = x.target OR startswith(y.at, concat(x.target, '{SEP}'))), y -> y.ref))))"""))
    d = d.withColumn("_left", once("""aggregate(sequence(1, size(_graph) + 1),
        named_struct('go', true, 'g', transform(_graph, x -> x.ref)),
        (s, i) -> CASE WHEN NOT s.go THEN s ELSE transform(array(transform(filter(_graph, x -> array_contains(s.g, x.ref)
              AND exists(x.next, y -> array_contains(s.g, y))), x -> x.ref)),
            z -> named_struct('go', size(z) < size(s.g), 'g', z))[0] END, s -> size(s.g))"""))
    return d


def _ref_columns() -> list[Column]:
    return [F.expr("coalesce(size(refs), 0)").alias("n_refs"), F.expr("""CASE WHEN nodes IS NULL OR size(refs) = 0 THEN 'none'
        WHEN _left > 0 THEN 'cyclic'
        WHEN exists(refs, x -> x.target IS NULL OR NOT array_contains(_known, x.target)) THEN 'nonlocal_or_unresolvable'
        ELSE 'local_ok' END""").alias("ref_status")]


def ref_status(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """none / local_ok / cyclic / nonlocal_or_unresolvable.

    A reference leads to every reference inside its target. References without successors are
    removed until nothing changes; whatever is left sits on or behind a cycle. Cycles are
    reported before unresolved references.
    """
    return _with_ref_graph(with_nodes(schemas.select(*keep, "body"), "body")).select(*keep, *_ref_columns())


# ---------------------------------------------------------------- rule checks
def _broken_rules(node: str, keys: str) -> str:
    """SQL: names of the keyword rules one schema node breaks."""
    kind = lambda k: f"schema_of_variant(try_variant_get({node}, '$[\"{k}\"]', 'variant'))"
    strings = lambda k: f"forall(try_variant_get({node}, '$[\"{k}\"]', '{ARR}'), e -> schema_of_variant(e) = 'STRING')"
    number = lambda k: f"left({kind(k)}, 3) NOT IN ('BIG', 'DEC', 'DOU')"
    rules = [
        ("type_name", f"""array_contains({keys}, 'type') AND NOT coalesce(CASE WHEN {kind('type')} = 'STRING'
            THEN try_variant_get({node}, '$.type', 'string') IN ({sql_list(TYPE_NAMES)})
            ELSE {strings('type')} AND size(array_except(try_variant_get({node}, '$.type', 'array<string>'), array({sql_list(TYPE_NAMES)}))) = 0 END, false)"""),
        ("required_array", f"array_contains({keys}, 'required') AND NOT coalesce({strings('required')}, false)"),
        ("enum_array", f"array_contains({keys}, 'enum') AND NOT startswith({kind('enum')}, 'ARRAY')"),
        ("pattern_string", f"array_contains({keys}, 'pattern') AND {kind('pattern')} <> 'STRING'"),
        ("properties_object", f"array_contains({keys}, 'properties') AND NOT startswith({kind('properties')}, 'OBJECT')"),
    ] + [(f"{k}_number", f"array_contains({keys}, '{k}') AND {number(k)}")
         for k in ("minimum", "maximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems",
                   "minProperties", "maxProperties")]
    arr = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in rules)
    return f"filter(array({arr}), r -> r IS NOT NULL)"


def schema_rule_violations(schemas: DataFrame) -> DataFrame:
    """Malformed keyword values at schema positions, one row per (node, rule)."""
    return (schema_nodes(schemas).select("schema_id", "ptr", F.explode(once(_broken_rules("node", "keys"))).alias("rule"))
            .withColumn("ptr", F.expr(f"replace(ptr, '{SEP}', '/')")))


def unsat_column() -> Column:
    """Any object whose required list covers every oneOf branch, so that two branches always match."""
    keys = f"array_distinct(concat(coalesce(try_variant_get(b, '$.required', 'array<string>'), cast(array() as array<string>)), " \
           f"coalesce(map_keys(try_variant_get(b, '$.properties', '{OBJ}')), cast(array() as array<string>))))"
    return F.expr(f"""exists(filter(nodes, n -> array_contains(n.keys, 'oneOf') AND array_contains(n.keys, 'required')), n ->
        exists(array(try_parse_json(n.json)), v -> transform(array(named_struct('req', try_variant_get(v, '$.required', 'array<string>'),
            'br', filter(coalesce(try_variant_get(v, '$.oneOf', '{ARR}'), cast(array() as {ARR})), b -> try_cast(b as {OBJ}) IS NOT NULL))), z ->
          z.req IS NOT NULL AND size(z.br) >= 2 AND forall(z.br, b -> size({keys}) > 0 AND size(array_except({keys}, z.req)) = 0))[0]))""")


def unsat_nodes(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    d = with_nodes(schemas.select(*keep, "body"), "body")
    return d.select(*keep, F.coalesce(unsat_column(), F.lit(False)).alias("known_unsatisfiable"))


# ---------------------------------------------------------------- audit
def audit(schemas: DataFrame) -> DataFrame:
    """One row per document with everything eligibility needs: one parse, one pass, no join."""
    d = schemas.withColumn("_v", once(strict_variant("body")))
    d = (d.withColumn("tree", once(f"CASE WHEN _v IS NOT NULL THEN {schema_tree('_v')} END"))
         .withColumn("nodes", once(f"CASE WHEN _v IS NOT NULL THEN {tree_nodes('_v')} END"))
         .withColumn("_text", text_forms("body")).withColumn("_norm", normalized_forms("body")))
    d = _with_ref_graph(_with_root(_with_walk(d)))
    return d.select(
        "schema_id", "subset", *_feature_columns(), *_top_columns(), "_text.chars_pretty", "_text.chars_min",
        "_text.bytes_min", *_ref_columns(), F.coalesce(unsat_column(), F.lit(False)).alias("known_unsatisfiable"),
        F.col("_norm.status").alias("normalize_status"), F.sha2("_norm.canonical", 256).alias("normalized_sha256"),
        F.expr(f"""NOT exists(filter(tree, n -> n.keys IS NOT NULL), n -> size({_broken_rules('n.v', 'n.keys')}) > 0)""").alias("rules_valid"))


def eligibility(audited: DataFrame, included: list[str], min_props: int = 1, max_props: int = 15,
                max_chars: int = 1500) -> DataFrame:
    """All exclusion reasons in fixed order."""
    tests = [
        (f"subset NOT IN ({sql_list(included)})", "subset_excluded"),
        ("NOT root_object_with_properties", "root_not_object_with_properties"),
        (f"root_object_with_properties AND (n_top_props < {min_props} OR n_top_props > {max_props})",
         "top_level_property_count_out_of_range"),
        ("ref_status = 'cyclic'", "cyclic_ref"),
        ("ref_status = 'nonlocal_or_unresolvable'", "nonlocal_or_unresolvable_ref"),
        ("NOT rules_valid", "rules_violated"),
        ("known_unsatisfiable", "known_unsatisfiable_pattern"),
        ("has_patternProperties AND root_object_with_properties AND n_top_props = 0", "only_pattern_properties"),
        (f"chars_pretty > {max_chars}", "too_large"),
    ]
    arr = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for c, r in tests)
    return (audited.withColumn("exclusion_reasons", F.expr(f"filter(array({arr}), r -> r IS NOT NULL)"))
            .withColumn("eligible", F.expr("size(exclusion_reasons) = 0")))


def mark_exact_duplicates(df: DataFrame, order: list[str] = ("schema_id",), sha: str = "normalized_sha256",
                          key: str = "schema_id") -> DataFrame:
    """Among eligible rows, later copies of a digest point at its first holder.

    The first holder comes from a map-side combined minimum, so a digest shared by a third of the
    corpus costs one row in the lookup, not one giant group. Rows are fixed before: what leads to them, an audit of every
    document, would be done again for the lookup.
    """
    df = cut_lineage(df)
    first = (df.where("eligible").groupBy(sha)
             .agg(F.min(F.struct(*order, F.col(key).alias("_first"))).alias("_f")).select(sha, F.col("_f._first").alias("_first")))
    j = left_lookup(df, first, sha, key)
    dup = F.col("eligible") & (F.col("_first") != F.col(key))
    return (j.withColumn("exclusion_reasons", F.when(dup, F.array_append(
                "exclusion_reasons", F.concat(F.lit("exact_duplicate_of:"), "_first"))).otherwise(F.col("exclusion_reasons")))
            .withColumn("eligible", F.expr("size(exclusion_reasons) = 0")).drop("_first"))


def audit_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """Counts per subset and in total."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(f)).alias(f) for f in flags]
    aggs += [F.count_if(F.col("ref_status") == s).alias(f"ref_{s}") for s in ("none", "local_ok", "cyclic", "nonlocal_or_unresolvable")]
    aggs += [F.count_if("eligible").alias("eligible")]
    aggs += [F.count_if(F.col("eligible") & (F.col("stratum") == s)).alias(f"eligible_{s}") for s in ("flat", "structured")]
    return df.rollup("subset").agg(*aggs).withColumn("subset", F.coalesce("subset", F.lit("TOTAL")))


def reason_counts(df: DataFrame) -> DataFrame:
    """Histogram over all reasons and over first reasons (text after ':' dropped)."""
    every = df.select(F.posexplode("exclusion_reasons").alias("at", "r"))  # one pass, so the audit behind it is made once
    return (every.groupBy(F.expr("split(r, ':')[0]").alias("reason"))
            .agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("at") == 0).alias("n_first")))


# ---------------------------------------------------------------- keywords and texts
def keyword_presence(schemas: DataFrame) -> DataFrame:
    """Documents per subset holding each keyword in any object; property names are not keywords."""
    d = with_nodes(schemas.select("schema_id", "subset", "body"), "body")
    arr = ("exists(nodes, n -> n.key = 'type' AND NOT n.pkey <=> 'properties' AND (n.txt = 'array' OR (n.kind = 'ARR' AND "
           "coalesce(array_contains(try_cast(try_parse_json(n.json) as array<string>), 'array'), false))))")
    nest = (f"exists(nodes, n -> n.key = 'properties' AND n.kind = 'OBJ' AND size(filter(split(n.ptr, '{SEP}'), k -> k = 'properties')) >= 2)")
    d = d.withColumn("hits", F.expr(f"""concat(array_intersect(array({sql_list(PRESENCE)}),
        transform(filter(nodes, n -> NOT n.pkey <=> 'properties'), n -> n.key)),
        CASE WHEN {arr} THEN array('array') ELSE cast(array() as array<string>) END,
        CASE WHEN {nest} THEN array('nested') ELSE cast(array() as array<string>) END, array('documents'))"""))
    return d.select("subset", F.explode("hits").alias("keyword")).groupBy("subset", "keyword").agg(F.count(F.lit(1)).alias("n"))


def keyword_audit(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Assertion and legacy keywords in use at schema positions of self-contained documents."""
    t = with_schema_tree(schemas.select(*keep, "body"))
    t = t.withColumn("_k", F.expr("array_distinct(flatten(transform(filter(tree, n -> n.keys IS NOT NULL), n -> n.keys)))"))
    return t.select(
        *keep, F.expr("try_variant_get(tree[0].v, '$[\"$schema\"]', 'string')").alias("dialect"),
        F.expr(f"array_sort(array_intersect(_k, array({sql_list(ASSERTIONS)})))").alias("assertion_keywords"),
        F.expr(f"array_sort(array_intersect(_k, array({sql_list(LEGACY)})))").alias("legacy_keywords"),
        F.expr("array_contains(_k, 'format')").alias("has_format"))


def schema_property_names(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Names under ``properties`` at any depth, data positions included."""
    d = with_nodes(schemas.select(*keep, "body"), "body")
    return d.select(*keep, F.expr("""array_sort(array_distinct(transform(
        filter(nodes, n -> n.pkey = 'properties' AND n.key IS NOT NULL), n -> n.key)))""").alias("known_names"))


def schema_texts(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Title and description strings anywhere, one row each."""
    d = with_nodes(schemas.select(*keep, "body"), "body")
    return (d.select(*keep, F.expr("explode(filter(nodes, n -> n.key IN ('title', 'description') AND n.kind = 'STR'))").alias("n"))
            .select(*keep, F.expr(f"replace(n.ptr, '{SEP}', '/')").alias("ptr"), F.col("n.txt").alias("text")))


def schema_text(schemas: DataFrame, keep: tuple[str, ...] = ("schema_id",), max_depth: int = 4) -> DataFrame:
    """Titles, descriptions and property names down to a nesting depth, as one search text in key order."""
    t = with_schema_tree(schemas.select(*keep, "body"))
    walk = f"""filter(tree, n -> n.keys IS NOT NULL AND
        forall(split(regexp_replace(n.ptr, '{SEP}(properties){SEP}[^{SEP}]*|{SEP}(items)|{SEP}(anyOf|oneOf|allOf){SEP}[0-9]+', ''), '{SEP}'), k -> k = '')
        AND size(regexp_extract_all(n.ptr, '{SEP}properties{SEP}[^{SEP}]*|{SEP}items|{SEP}(?:anyOf|oneOf|allOf){SEP}[0-9]+', 0)) <= {max_depth + 1})"""
    depth = f"size(regexp_extract_all(n.ptr, '{SEP}properties{SEP}[^{SEP}]*|{SEP}items|{SEP}(?:anyOf|oneOf|allOf){SEP}[0-9]+', 0))"
    return t.select(*keep, F.expr(f"""array_join(filter(flatten(transform({walk}, n -> array(
        CASE WHEN n.via = 'properties' THEN n.name END,
        CASE WHEN {depth} <= {max_depth} THEN try_variant_get(n.v, '$.title', 'string') END,
        CASE WHEN {depth} <= {max_depth} THEN try_variant_get(n.v, '$.description', 'string') END))),
        x -> x IS NOT NULL AND x <> ''), ' ')""").alias("schema_text"))


def tuple_array_paths(schemas: DataFrame) -> DataFrame:
    """Schema positions whose items or prefixItems is a list."""
    return (schema_nodes(schemas).where(f"try_variant_get(node, '$.items', '{ARR}') IS NOT NULL OR try_variant_get(node, '$.prefixItems', '{ARR}') IS NOT NULL")
            .select("schema_id", F.expr(f"replace(ptr, '{SEP}', '/')").alias("path")))
