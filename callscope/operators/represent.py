"""Representations of tools, what they keep, how large they are, and catalog prompts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.jsontext import normalized_forms, printed_cards
from callscope.functions.jsontree import ARR, OBJ, once, strict_variant
from callscope.operators.ranking import exact_quantiles

# fixed values: prompt wording shared by every representation
SYSTEM_TEMPLATE = (
    "You are an assistant that completes a user's request by calling exactly one tool.\n"
    "Available tools:\n\n{tools}\n\n"
    "Respond with only a JSON object of the form {\"tool\": \"<tool name>\", \"arguments\": {...}}. "
    "The arguments must follow the selected tool's input parameters. Do not include any other text.")
FIXED_TOOL_SUFFIX = "\n\nUse the tool \"{tool_name}\"."


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _card_head() -> str:
    """SQL: the text of a card up to its parameters."""
    name = lambda c: f"substr(to_json(array({c})), 2, char_length(to_json(array({c}))) - 2)"
    return (f"concat('{{\"type\":\"function\",\"function\":{{\"name\":', {name('tool_name')}, ',\"description\":', "
            f"{name('description')}, ',\"parameters\":')")


def info_subset(schemas: DataFrame, body: str = "body", out: str = "info") -> DataFrame:
    """Per top-level property: type (missing -> string), non-empty description, enum; required that exist."""
    d = schemas.withColumn("_v", once(strict_variant(body)))
    # property order is read from the text: VARIANT keeps keys sorted
    d = d.withColumn("_order", F.expr(f"coalesce(json_object_keys(get_json_object({body}, '$.properties')), cast(array() as array<string>))"))
    d = d.withColumn("_props", F.expr(f"coalesce(try_variant_get(_v, '$.properties', '{OBJ}'), cast(map() as {OBJ}))"))
    q = lambda k: f"substr(to_json(array({k})), 2, char_length(to_json(array({k}))) - 2)"
    at = lambda k: f"to_json(try_variant_get(_props[x], '$.{k}', 'variant'))"
    prop = f"""concat({q('x')}, ':{{"type":', CASE WHEN {_truthy('_props[x]', 'type')} THEN {at('type')} ELSE '"string"' END,
        CASE WHEN {_truthy('_props[x]', 'description')} THEN concat(',"description":', {at('description')}) ELSE '' END,
        CASE WHEN coalesce({at('enum')} <> 'null', false) THEN concat(',"enum":', {at('enum')}) ELSE '' END, '}}')"""
    req = ("filter(coalesce(try_variant_get(_v, '$.required', 'array<string>'), cast(array() as array<string>)), "
           "r -> array_contains(_order, r))")
    return d.withColumn(out, F.expr(f"""concat('{{"type":"object","properties":{{', array_join(transform(_order, x -> {prop}), ','), '}}',
        CASE WHEN size({req}) > 0 THEN concat(',"required":', to_json({req})) ELSE '' END, '}}')""")).drop("_v", "_order", "_props")


def _truthy(v: str, k: str) -> str:
    return f"coalesce(to_json(try_variant_get({v}, '$.{k}', 'variant')) NOT IN ('null', '\"\"', '[]', '{{}}', 'false', '0'), false)"


def representations(tools: DataFrame) -> DataFrame:
    """(arm, tool_id, text): raw printed with indent 2, minified, normalised, info subset.

    tools: tool_id, tool_name, description, body.
    """
    d = info_subset(tools).select("tool_id", F.expr(_card_head()).alias("head"), "body", "info")
    row = T.StructType([d.schema["tool_id"], T.StructField("arm", T.StringType()), T.StructField("text", T.StringType())])
    return d.mapInArrow(printed_cards, row)


def information_audit(tools: DataFrame) -> DataFrame:
    """What a shown subset loses against the raw contract, per tool.

    tools: tool_id, stratum, description, raw, norm (JSON texts), shown_description, shown (JSON text of
    parameters), and the feature flags of the raw schema.
    """
    d = tools
    for c in ("raw", "norm", "shown"):
        d = d.withColumn(f"_{c}", once(strict_variant(c)))
        d = d.withColumn(f"_{c}p", F.expr(f"coalesce(try_variant_get(_{c}, '$.properties', '{OBJ}'), cast(map() as {OBJ}))"))
    n = "_normp[k]"
    typ = lambda v: f"try_variant_get({v}, '$.type', 'variant')"
    listed = lambda v: (f"CASE WHEN schema_of_variant({typ(v)}) = 'STRING' THEN array(cast({typ(v)} as string)) "  # noqa: E731
                        f"ELSE try_cast({typ(v)} as array<string>) END")
    shown = f"coalesce(CASE WHEN {_truthy('_rawp[k]', 'type')} THEN {listed('_rawp[k]')} END, array('string'))"
    enum_type = ("CASE left(schema_of_variant(z), 3) WHEN 'BOO' THEN 'boolean' WHEN 'BIG' THEN 'integer' WHEN 'DEC' THEN 'number' "
                 "WHEN 'DOU' THEN 'number' WHEN 'STR' THEN 'string' WHEN 'VOI' THEN 'null' ELSE 'object' END")
    actual = f"""CASE WHEN {listed(n)} IS NOT NULL THEN {listed(n)}
        WHEN try_variant_get({n}, '$.enum', '{ARR}') IS NOT NULL THEN array_distinct(transform(try_variant_get({n}, '$.enum', '{ARR}'), z -> {enum_type}))
        WHEN try_variant_get({n}, '$.properties', 'variant') IS NOT NULL THEN array('object')
        WHEN try_variant_get({n}, '$.items', 'variant') IS NOT NULL THEN array('array') ELSE cast(array() as array<string>) END"""
    keys = lambda v: f"coalesce(map_keys(try_cast({v} as {OBJ})), cast(array() as array<string>))"
    drop = ("has_ref", "has_oneOf", "has_anyOf", "has_allOf", "has_conditional", "has_constraints", "has_format", "has_pattern",
            "has_default", "has_additionalProperties_false", "has_nested_object", "has_array_of_objects")
    names = "map_keys(_rawp)"
    out = (d
           .withColumn("required_not_in_properties", F.expr(f"array_except(coalesce(try_variant_get(_raw, '$.required', 'array<string>'), cast(array() as array<string>)), {names})"))
           .withColumn("type_changes", F.expr(f"filter({names}, k -> size({actual}) > 0 AND array_sort({actual}) <> array_sort({shown}))"))
           .withColumn("lost_enums_behind_ref", F.expr(f"filter({names}, k -> NOT array_contains({keys('_rawp[k]')}, 'enum') AND array_contains({keys(n)}, 'enum'))"))
           .withColumn("dropped_substructure", F.expr(f"filter({names}, k -> arrays_overlap({keys(n)}, array('properties', 'items', 'oneOf', 'anyOf', 'allOf', 'patternProperties', 'additionalProperties')))"))
           .withColumn("dropped_keywords", F.array_sort(F.expr("filter(array({}), x -> x IS NOT NULL)".format(
               ", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in drop)))))
           .withColumn("title_only", F.expr(f"filter({names}, k -> {_truthy('_rawp[k]', 'title')} AND NOT {_truthy('_rawp[k]', 'description')})"))
           .withColumn("descriptions_rewritten", F.expr(f"""array_sort(filter({names}, k -> {_truthy('_rawp[k]', 'description')} AND NOT
               to_json(try_variant_get(_rawp[k], '$.description', 'variant')) <=> to_json(try_variant_get(_shownp[k], '$.description', 'variant'))))"""))
           .withColumn("tool_description_rewritten", F.expr("NOT description <=> shown_description"))
           .withColumn("root_text_dropped", F.expr(f"{_truthy('_raw', 'description')} OR {_truthy('_raw', 'title')}"))
           .withColumn("lossless_except_text", F.expr("""size(type_changes) = 0 AND size(lost_enums_behind_ref) = 0 AND size(dropped_substructure) = 0
               AND size(required_not_in_properties) = 0 AND size(array_remove(dropped_keywords, 'has_format')) = 0 AND size(title_only) = 0""")))
    return out.drop("_raw", "_norm", "_shown", "_rawp", "_normp", "_shownp")


def information_summary(audits: DataFrame) -> DataFrame:
    any_ = lambda c: F.count_if(F.size(c) > 0)
    return audits.rollup("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("lossless_except_text").alias("lossless_except_text"),
        any_("type_changes").alias("with_type_changes"), any_("lost_enums_behind_ref").alias("with_lost_enums_behind_ref"),
        any_("dropped_substructure").alias("with_dropped_substructure"),
        any_("required_not_in_properties").alias("with_required_not_in_properties"),
        F.count_if(F.array_contains("dropped_keywords", "has_constraints")).alias("with_dropped_constraints"),
        F.count_if(F.array_contains("dropped_keywords", "has_default")).alias("with_dropped_defaults"),
        any_("title_only").alias("with_title_only_text_dropped"),
        any_("descriptions_rewritten").alias("with_param_descriptions_rewritten"),
        F.count_if("tool_description_rewritten").alias("with_tool_description_rewritten"),
        F.count_if("root_text_dropped").alias("with_root_text_dropped")).withColumn("stratum", F.coalesce("stratum", F.lit("all")))


def render_catalogs(members: DataFrame, texts: DataFrame, sep: str = ",", opener: str = "[", closer: str = "]") -> DataFrame:
    """One text per (catalog, arm) in presentation order; a catalog is bounded by its size."""
    j = members.join(texts, "tool_id")
    return j.groupBy("catalog_id", "replicate", "size", "arm").agg(F.concat(
        F.lit(opener), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("presentation_pos", "text"))), lambda x: x["text"]), sep),
        F.lit(closer)).alias("tools_text"))


def catalog_text_check(rendered: DataFrame, whole: DataFrame) -> DataFrame:
    """Whether a catalog text supplied as a whole equals the per-tool join."""
    return (rendered.join(whole, ["catalog_id", "arm"], "full")
            .select("catalog_id", "arm", F.col("tools_text").eqNullSafe(F.col("whole_text")).alias("equal_to_join")))


def render_prompts(catalog_texts: DataFrame, tasks: DataFrame, fixed_tool: bool = False) -> DataFrame:
    """System and user message per (task, catalog, arm); the fixed-tool family names its tool."""
    suffix = f"replace({sql_text(FIXED_TOOL_SUFFIX)}, '{{tool_name}}', tool_name)" if fixed_tool else "''"
    return catalog_texts.join(tasks, "replicate").select(
        "task_id", "catalog_id", "arm", F.expr(f"replace({sql_text(SYSTEM_TEMPLATE)}, '{{tools}}', tools_text)").alias("system_prompt"),
        F.expr(f"concat(prompt, {suffix})").alias("user_message"))


def size_metrics(texts: DataFrame, tokens: str | None = None) -> DataFrame:
    """Tokens, characters, bytes and reduction against arm raw, per tool and arm."""
    tok = F.col(tokens) if tokens else F.expr("cast(size(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\n]', 0)) as bigint)")
    d = texts.select("tool_id", "arm", *[c for c in texts.columns if c == "stratum"], tok.alias("tokens"),
                     F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"))
    base = d.where("arm = 'raw'").select("tool_id", F.col("tokens").alias("raw_tokens"))
    return d.join(base, "tool_id").withColumn("token_reduction", F.expr("raw_tokens - tokens")).withColumn(
        "compression_pct", F.bround(F.expr("100.0D * (raw_tokens - tokens) / raw_tokens"), 2))


def size_summary(metrics: DataFrame) -> DataFrame:
    """Mean tokens, mean and median compression by arm over all tools and per stratum."""
    d = metrics.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("stratum"))))
    m = d.groupBy("arm", "stratum").agg(F.bround(F.avg("tokens"), 1).alias("mean_tokens"),
                                        F.bround(F.avg("compression_pct"), 1).alias("mean_compression_pct"))
    q = exact_quantiles(d, ["arm", "stratum"], "compression_pct", {"median_compression_pct": 0.5})
    return m.join(q, ["arm", "stratum"])


def catalog_size_summary(catalog_tokens: DataFrame) -> DataFrame:
    return catalog_tokens.groupBy("size", "arm").agg(F.bround(F.avg("system_prompt_tokens"), 1).alias("mean"),
                                                     F.max("system_prompt_tokens").alias("max"))


def context_check(prompts: DataFrame, n_ctx: int, reserve: int) -> tuple[DataFrame, DataFrame]:
    """Longest prompt per (catalog, arm) plus reserve against the limit; worst case per (size, arm).

    prompts: catalog_id, size, arm, prompt_tokens, prompt_chars.
    """
    longest = prompts.groupBy("catalog_id", "size", "arm").agg(
        (F.max_by("prompt_tokens", F.struct("prompt_chars", "prompt_tokens")) + reserve).alias("plus_reserve"))
    rows = longest.withColumn("exceeds", F.col("plus_reserve") > n_ctx)
    worst = rows.groupBy("size", "arm").agg(F.max("plus_reserve").alias("worst_case"), F.count_if("exceeds").alias("exceeding"))
    return rows, worst


def catalog_contracts(members: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per catalog: (tool_name, self-contained argument schema) branches in presentation order."""
    n = tools.select("tool_id", "tool_name", normalized_forms("body")["normalized"].alias("schema"))
    return (members.join(n, "tool_id").groupBy("catalog_id")
            .agg(F.array_sort(F.collect_list(F.struct("presentation_pos", "tool_name", "schema"))).alias("branches")))


def verdict_summary(verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per-engine counts, problem rows of target tools, and how often each warning came.

    verdicts: engine, tool_id, stratum, is_target, compile_ok, compile_error, warnings, accept_compact, accept_spaced.
    """
    t, ok = F.col("is_target"), F.col("compile_ok")
    either = F.coalesce("accept_compact", F.lit(False)) | F.coalesce("accept_spaced", F.lit(False))
    summary = verdicts.groupBy("engine").agg(
        F.count(F.lit(1)).alias("tools"), F.count_if(ok).alias("compile_ok"),
        F.count_if(ok & (F.size("warnings") > 0)).alias("compile_ok_with_warnings"), F.count_if(t).alias("targets"),
        F.count_if(t & ok).alias("targets_compile_ok"), F.count_if(t & either).alias("gold_accept_either"),
        F.count_if(t & F.coalesce("accept_compact", F.lit(False))).alias("gold_accept_compact"),
        F.count_if(t & F.coalesce("accept_spaced", F.lit(False))).alias("gold_accept_spaced"))
    problem = F.when(~ok, F.concat(F.lit("compile: "), F.coalesce("compile_error", F.lit("")))).when(~either, F.lit("gold call rejected"))
    problems = verdicts.where(t).select("engine", "tool_id", "stratum", problem.alias("problem")).where("problem IS NOT NULL")
    warn = verdicts.select("engine", F.explode("warnings").alias("warning")).groupBy("engine", "warning").agg(F.count(F.lit(1)).alias("n"))
    return summary, problems, warn


def coverage_summary(labels: DataFrame) -> DataFrame:
    """Per catalog: gold, original-order and invalid witnesses checked and accepted. labels: catalog_id, kind, accepted."""
    k = lambda kind, c: F.count_if((F.col("kind") == kind) & c)
    acc, any_ = F.coalesce("accepted", F.lit(False)), F.lit(True)
    return labels.groupBy("catalog_id").agg(
        k("gold", any_).alias("gold_checked"), k("gold", acc).alias("gold_accepted"), k("gold", ~acc).alias("gold_rejected"),
        k("original", any_).alias("original_checked"), k("original", acc).alias("original_accepted"),
        k("invalid", any_).alias("invalid_checked"), k("invalid", acc).alias("invalid_accepted"))
