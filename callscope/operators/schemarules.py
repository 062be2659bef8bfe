"""JSON Schema rules as rows, and their check against a call inside the row.

``schema_rules`` turns a schema into one array of positions with their assertions and links to the positions below. A call
is checked in two loops inside a projection, so neither a shuffle nor a Python worker is needed:

* down: the root rule is applied to the root value; every applied rule applies the rules it links to, each to the same value
  (combinators, references, dependencies) or to members picked by name, key pattern or array slot;
* up: every applied rule takes the outcomes of those it has applied, which come back in order, and hands on its errors and
  the members that it has evaluated.

The draft is read from ``$schema``; without one it is draft 7, in which ``$ref`` stands alone.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.jsontree import ARR, OBJ, SEP, once
from callscope.operators.schematree import sql_list, with_schema_tree

# fixed values: references that can't be followed inside a document
DYNAMIC = ("$dynamicRef", "$recursiveRef")

#: Positions 0 and 1 are the schemas true and false.
TRUE, FALSE = 0, 1
#: Links whose outcomes count as the position's own errors.
HANDED_ON = ("properties", "patternProperties", "additionalProperties", "propertyNames", "prefix", "rest", "allOf", "dependentSchemas", "$ref")
#: Links to the same value whose evaluated members count where it holds.
IN_PLACE = ("allOf", "anyOf", "oneOf", "dependentSchemas", "$ref", "if", "then", "else")

_LINK = "struct<via:string,key:string,at:int,to:int>"
_NEED = "array<struct<key:string,need:array<string>>>"


def _let(value: str, name: str, then: str) -> str:
    """SQL: ``then`` with ``value`` computed once under a name."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _mixed(key: str) -> str:
    """SQL: a member name that makes a place like that of another value."""
    return f"coalesce({key} = '' OR contains({key}, '.') OR contains({key}, '['), false)"


def canon_sql(kind: str, txt: str, num: str, js: str) -> str:
    """SQL: comparable text of a JSON value; 1 and 1.0 agree, true and 1 do not."""
    return (f"CASE {kind} WHEN 'STR' THEN concat('s:', {txt}) WHEN 'BOO' THEN concat('b:', {txt}) "
            f"WHEN 'VOI' THEN 'z' WHEN 'OBJ' THEN concat('j:', {js}) WHEN 'ARR' THEN concat('j:', {js}) "
            f"ELSE concat('n:', cast({num} as string)) END")


def _canon_v(v: str) -> str:
    return canon_sql(f"left(schema_of_variant({v}), 3)", f"cast({v} as string)",
                     f"try_cast(if(left(schema_of_variant({v}), 3) IN ('BIG', 'DEC', 'DOU'), {v}, null) as double)",
                     f"to_json({v})")


def schema_rules(schemas: DataFrame, key: str = "tool_name", body: str = "body") -> DataFrame:
    """(key, rules, unchecked) per schema: its positions, and the references that lead nowhere inside the document.

    ``unchecked`` names keywords that the check can't follow; a call is checked against all others. A text that is no JSON
    document has no rules.
    """
    g = lambda k, t: f"try_variant_get(n.v, '$[\"{k}\"]', '{t}')"
    has = lambda k: f"array_contains(n.keys, '{k}')"
    num = lambda k: f"CASE WHEN left(schema_of_variant({g(k, 'variant')}), 3) IN ('BIG','DEC','DOU') THEN {g(k, 'double')} END"
    kind = lambda k: f"left(schema_of_variant({g(k, 'variant')}), 3)"
    false = lambda k: f"({kind(k)} = 'BOO' AND NOT {g(k, 'boolean')})"
    # the number of a schema at a pointer; values that are no schema bind nothing
    to = lambda ptr, v: (f"CASE WHEN schema_of_variant({v}) = 'BOOLEAN' THEN if(cast({v} as boolean), {TRUE}, {FALSE}) "  # noqa: E731
                         f"ELSE coalesce(nullif(cast(array_position(ptrs, {ptr}) as int), 0) + 1, {TRUE}) END")
    link = lambda via, k, at, target: f"named_struct('via', {via}, 'key', {k}, 'at', {at}, 'to', {target})"
    none, no_int = "cast(null as string)", "cast(null as int)"
    empty = f"cast(array() as array<{_LINK}>)"

    def mapped(k: str, via: str, when: str = "true") -> str:
        ptr = f"concat(n.ptr, '{SEP}{k}{SEP}', e.key)"
        return (f"CASE WHEN {has(k)} AND {when} THEN transform(filter(ifnull(map_entries({g(k, OBJ)}), array()), e -> {kind_of('e.value')} IN ('OBJ', 'BOO')), "
                f"e -> {link(via, 'e.key', no_int, to(ptr, 'e.value'))}) ELSE {empty} END")

    def listed(k: str, via: str, when: str = "true") -> str:
        ptr = f"concat(n.ptr, '{SEP}{k}{SEP}', i)"
        return f"CASE WHEN {has(k)} AND {when} THEN transform(ifnull({g(k, ARR)}, array()), (e, i) -> {link(via, none, 'i', to(ptr, 'e'))}) ELSE {empty} END"

    def single(k: str, via: str | None = None, at: str = no_int, when: str = "true") -> str:
        target = to(f"concat(n.ptr, '{SEP}{k}')", g(k, "variant"))
        return f"CASE WHEN {has(k)} AND {when} THEN array({link(repr(via or k), none, at, target)}) ELSE {empty} END"

    def kind_of(v: str) -> str:
        return f"left(schema_of_variant({v}), 3)"

    tuple_items = f"({kind('items')} = 'ARR')"
    ref = (f"coalesce(nullif(cast(array_position(ptrs, array_join(transform(split(try_url_decode(replace(substr({g('$ref', 'string')}, 2), '+', '%2B')), '/'), "
           f"t -> replace(replace(t, '~1', '/'), '~0', '~')), '{SEP}')) as int), 0) + 1, CASE WHEN {g('$ref', 'string')} = '#' THEN 2 END)")
    ref = f"CASE WHEN startswith({g('$ref', 'string')}, '#') THEN {ref} END"
    tracked = "tracked"
    links = f"""flatten(array(
      {mapped('properties', "'properties'")}, {mapped('patternProperties', "'patternProperties'")},
      {mapped('dependentSchemas', "'dependentSchemas'", 'draft >= 2019')}, {mapped('dependencies', "'dependentSchemas'", 'draft < 2019')},
      {listed('allOf', "'allOf'")}, {listed('anyOf', "'anyOf'")}, {listed('oneOf', "'oneOf'")},
      {listed('prefixItems', "'prefix'", 'draft >= 2020')}, {listed('items', "'prefix'", f'draft < 2020 AND {tuple_items}')},
      {single('items', 'rest', f"CASE WHEN draft >= 2020 THEN ifnull(cast(size({g('prefixItems', ARR)}) as int), 0) ELSE 0 END",
              f"NOT {tuple_items} AND NOT (draft >= 2020 AND {false('items')})")},
      {single('additionalItems', 'rest', f"cast(size({g('items', ARR)}) as int)", f"draft < 2020 AND coalesce({tuple_items}, false) AND NOT {false('additionalItems')}")},
      {single('additionalProperties', when=f"({kind('additionalProperties')} = 'OBJ' OR ({tracked} AND NOT {false('additionalProperties')}))")},
      {single('propertyNames')}, {single('contains')}, {single('not')}, {single('if')}, {single('then', when=has('if'))}, {single('else', when=has('if'))},
      {single('unevaluatedProperties', when='draft >= 2019')}, {single('unevaluatedItems', when='draft >= 2019')},
      CASE WHEN {ref} IS NOT NULL THEN array({link("'$ref'", none, no_int, ref)}) ELSE {empty} END))"""
    needs = (f"CASE WHEN draft >= 2019 THEN transform(ifnull(map_entries({g('dependentRequired', 'map<string,array<string>>')}), array()), e -> named_struct('key', e.key, 'need', e.value)) "
             f"ELSE transform(filter(ifnull(map_entries({g('dependencies', OBJ)}), array()), e -> {kind_of('e.value')} = 'ARR'), "
             f"e -> named_struct('key', e.key, 'need', try_cast(e.value as array<string>))) END")
    # without: assertions of a position that a draft 7 reference stands alone in
    own = lambda v, when: f"CASE WHEN {when} THEN {v} END"
    own_links = lambda v, when: f"CASE WHEN {when} THEN {v} ELSE array() END"
    live = f"n.keys IS NOT NULL AND NOT (draft < 2019 AND {has('$ref')})"
    fields = f"""'types', {own(f"CASE WHEN schema_of_variant({g('type', 'variant')}) = 'STRING' THEN array({g('type', 'string')}) ELSE {g('type', 'array<string>')} END", live)},
      'required', {own(g('required', 'array<string>'), live)},
      'declared', ifnull({own(f"map_keys({g('properties', OBJ)})", live)}, cast(array() as array<string>)),
      'patterns', ifnull({own(f"map_keys({g('patternProperties', OBJ)})", live)}, cast(array() as array<string>)),
      'closed', coalesce({live} AND {false('additionalProperties')}, false),
      'slots', {own(f'''CASE WHEN draft >= 2020 AND {false('items')} THEN ifnull(size({g('prefixItems', ARR)}), 0)
                 WHEN draft < 2020 AND {tuple_items} AND {false('additionalItems')} THEN size({g('items', ARR)}) END''', live)},
      'needs', {own(needs, live)}, 'draft', draft, 'tracked', {tracked},
      'enum', {own(f"transform({g('enum', ARR)}, e -> {_canon_v('e')})", live)},
      'const', {own(f"CASE WHEN {has('const')} THEN {_canon_v(g('const', 'variant'))} END", live)},
      'minimum', {own(num('minimum'), live)}, 'maximum', {own(num('maximum'), live)},
      'xmin', {own(num('exclusiveMinimum'), live)}, 'xmax', {own(num('exclusiveMaximum'), live)}, 'multiple', {own(num('multipleOf'), live)},
      'minlen', {own(num('minLength'), live)}, 'maxlen', {own(num('maxLength'), live)}, 'pattern', {own(g('pattern', 'string'), live)},
      'minitems', {own(num('minItems'), live)}, 'maxitems', {own(num('maxItems'), live)},
      'uniq', coalesce({live} AND {kind('uniqueItems')} = 'BOO' AND {g('uniqueItems', 'boolean')}, false),
      'minprops', {own(num('minProperties'), live)}, 'maxprops', {own(num('maxProperties'), live)},
      'mincont', {own(num('minContains'), live + ' AND draft >= 2019')}, 'maxcont', {own(num('maxContains'), live + ' AND draft >= 2019')},
      'contains', coalesce({live} AND {has('contains')}, false),
      'links', cast({own_links(f"CASE WHEN draft < 2019 AND {has('$ref')} THEN filter({links}, l -> l.via = '$ref') ELSE {links} END", 'n.keys IS NOT NULL')} as array<{_LINK}>)"""
    rule = f"named_struct('pos', n.ipos, 'scope', n.scope, 'never', n.ptr = 'never' OR coalesce(schema_of_variant(n.v) = 'BOOLEAN' AND NOT cast(n.v as boolean), false), {fields})"
    blank = "named_struct('ptr', {ptr}, 'ipos', cast(null as string), 'scope', '', 'keys', cast(null as array<string>), 'v', cast(null as variant))"
    t = with_schema_tree(schemas.select(key, body), body)
    draft = f"try_variant_get(try_parse_json({body}), '$[\"$schema\"]', 'string')"
    t = (t.withColumn("draft", F.expr(f"CASE WHEN {draft} LIKE '%2020-12%' THEN 2020 WHEN {draft} LIKE '%2019-09%' THEN 2019 ELSE 7 END"))
         .withColumn("ptrs", F.expr("transform(tree, n -> n.ptr)"))
         .withColumn("tracked", F.expr("exists(tree, n -> arrays_overlap(n.keys, array('unevaluatedProperties', 'unevaluatedItems')) AND n.keys IS NOT NULL)"))
         .withColumn("tree", F.expr(f"concat(array({blank.format(ptr="'always'")}, {blank.format(ptr="'never'")}), transform(tree, n -> named_struct('ptr', n.ptr, 'ipos', n.ipos, 'scope', n.scope, 'keys', n.keys, 'v', n.v)))")))
    lost = f"array_contains(n.keys, '$ref') AND {ref} IS NULL"
    # a schema of members and elements alone binds a value by its place; position 0 holds the places of all positions
    t = t.withColumn("rules", once(f"transform(tree, n -> {rule})")).withColumn("places", F.expr("filter(tree.ipos, p -> p IS NOT NULL)"))
    plain = (f"size(places) = size(array_distinct(places)) AND forall(rules, r -> forall(r.links, l -> l.via = 'properties' OR (l.via = 'rest' AND l.at = 0 AND l.to <> {FALSE})) "
             f"AND NOT exists(r.declared, k -> {_mixed('k')}))")
    places = F.expr(f"CASE WHEN {plain} THEN transform(tree, n -> n.ipos) END")
    first = F.transform("rules", lambda r, i: r.withField("places", F.when(i == TRUE, places)))
    return t.select(key, first.alias("rules"),
                    F.expr(f"array_sort(array_distinct(flatten(transform(filter(tree, n -> n.keys IS NOT NULL), n -> concat("
                           f"CASE WHEN {lost} THEN array('$ref') ELSE cast(array() as array<string>) END, "
                           f"array_intersect(n.keys, array({sql_list(DYNAMIC)})))))))").alias("unchecked"))


_APP = "array<struct<via:string,key:string,to:int,on:int,name:string,seen:array<int>>>"
_ERR = "array<struct<validator:string,path:string>>"
_OUT = f"array<struct<via:string,key:string,ok:boolean,errors:{_ERR},members:array<string>>>"


def _assertions() -> str:
    """SQL: names of the assertions of rule r that value n breaks, one for each missing member."""
    t = {"integer": "(n.kind = 'BIG' OR (n.num IS NOT NULL AND n.num = floor(n.num)))",
         "number": "n.num IS NOT NULL", "string": "n.kind = 'STR'", "boolean": "n.kind = 'BOO'",
         "null": "n.kind = 'VOI'", "object": "n.kind = 'OBJ'", "array": "n.kind = 'ARR'"}
    typed = "CASE y " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE false END"
    nothing = "cast(array() as array<string>)"
    # of every value, and of one kind of value each; num is null where a value is no number
    every = [
        ("false", "r.never"),
        ("type", f"r.types IS NOT NULL AND NOT exists(r.types, y -> {typed})"),
        ("enum", f"r.enum IS NOT NULL AND NOT array_contains(r.enum, {canon_sql('n.kind', 'n.txt', 'n.num', 'n.json')})"),
        ("const", f"r.const IS NOT NULL AND r.const <> {canon_sql('n.kind', 'n.txt', 'n.num', 'n.json')}"),
    ]
    of_kind = {"OBJ": [
        ("additionalProperties", "r.closed AND exists(n.keys, k -> NOT array_contains(r.declared, k) AND NOT exists(r.patterns, p -> k RLIKE p))"),
        ("minProperties", "n.n < r.minprops"), ("maxProperties", "n.n > r.maxprops"),
    ], "ARR": [
        ("minItems", "n.n < r.minitems"), ("maxItems", "n.n > r.maxitems"),
        ("uniqueItems", f"r.uniq AND n.n > size(array_distinct(transform(try_cast(parse_json(n.json) as {ARR}), e -> to_json(e))))"),
    ], "STR": [
        ("minLength", "char_length(n.txt) < r.minlen"), ("maxLength", "char_length(n.txt) > r.maxlen"),
        ("pattern", "r.pattern IS NOT NULL AND NOT n.txt RLIKE r.pattern"),
    ], "number": [
        ("minimum", "n.num < r.minimum"), ("maximum", "n.num > r.maximum"),
        ("exclusiveMinimum", "n.num <= r.xmin"), ("exclusiveMaximum", "n.num >= r.xmax"),
        ("multipleOf", "abs(n.num / r.multiple - round(n.num / r.multiple)) > 1e-9"),
    ]}
    # names are listed only where one of the conditions holds
    broken = lambda these: (f"CASE WHEN {' OR '.join(f'({c})' for _, c in these)} THEN filter(array("
                            + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in these) + f"), q -> q IS NOT NULL) ELSE {nothing} END")
    lacking = "transform(array_except(r.required, n.keys), q -> 'required')"
    depends = ("flatten(transform(filter(r.needs, d -> array_contains(n.keys, d.key)), d -> transform(array_except(d.need, n.keys), "
               "q -> if(r.draft >= 2019, 'dependentRequired', 'dependencies'))))")
    return (f"CASE n.kind WHEN 'STR' THEN {broken(every + of_kind['STR'])} "
            f"WHEN 'OBJ' THEN concat(CASE WHEN r.required IS NOT NULL THEN {lacking} ELSE {nothing} END, "
            f"CASE WHEN size(r.needs) > 0 THEN {depends} ELSE {nothing} END, {broken(every + of_kind['OBJ'])}) "
            f"WHEN 'ARR' THEN concat(CASE WHEN n.n > r.slots THEN array(if(r.draft >= 2020, 'items', 'additionalItems')) ELSE {nothing} END, "
            f"{broken(every + of_kind['ARR'])}) ELSE {broken(every + of_kind['number'])} END")


def rule_errors_sql(nodes: str = "arg_nodes", rules: str = "rules") -> str:
    """SQL: array<struct<validator, path>> of the rules that one call breaks.

    A schema false breaks with the validator ``false``; a failed anyOf, oneOf, not, contains or unevaluated member counts
    once, at the value it is about. A rule that leads back to itself on the same value is not applied twice.
    """
    none = "cast(null as string)"
    # values with their members' places; ``ptrs`` is searched once per member
    member = f"named_struct('key', k, 'at', cast(array_position(ptrs, concat(n.ptr, '{SEP}', k)) as int))"
    kids = (f"CASE WHEN n.kind = 'OBJ' THEN transform(n.keys, k -> {member}) "
            f"WHEN n.kind = 'ARR' AND n.n > 0 THEN transform(transform(sequence(0, n.n - 1), i -> cast(i as string)), k -> {member}) "
            f"ELSE cast(array() as array<struct<key:string,at:int>>) END")
    values = _let(f"transform({nodes}, n -> n.ptr)", "ptrs", (
        f"transform({nodes}, n -> named_struct('kind', n.kind, 'keys', n.keys, 'n', n.n, 'txt', n.txt, 'num', n.num, 'json', n.json, "
        f"'path', substr(replace(n.ptr, '{SEP}', '/'), 2), 'kids', {kids}))"))
    app = lambda via, key, to, on, name="cast(null as string)", seen="cast(array() as array<int>)": (
        f"named_struct('via', {via}, 'key', {key}, 'to', {to}, 'on', {on}, 'name', {name}, 'seen', {seen})")
    below = lambda which, via="l.via": f"transform(filter(n.kids, (k, i) -> {which}), k -> {app(via, 'k.key', 'l.to', 'k.at')})"
    others = "n.kind = 'OBJ' AND NOT array_contains(r.declared, k.key) AND NOT exists(r.patterns, p -> k.key RLIKE p)"
    here = f"array({app('l.via', 'l.key', 'l.to', 'x.on', 'x.name', 'array_append(x.seen, x.to)')})"
    applied = f"""cast(CASE
        WHEN x.name IS NOT NULL AND l.via NOT IN ({sql_list(IN_PLACE)}, 'not') THEN array()
        WHEN l.via = 'properties' THEN {below("n.kind = 'OBJ' AND k.key = l.key")}
        WHEN l.via = 'patternProperties' THEN {below("n.kind = 'OBJ' AND k.key RLIKE l.key")}
        WHEN l.via = 'additionalProperties' THEN {below(others)}
        WHEN l.via = 'propertyNames' THEN CASE WHEN n.kind = 'OBJ' THEN transform(n.kids, k -> {app('l.via', 'k.key', 'l.to', 'x.on', 'k.key')}) ELSE array() END
        WHEN l.via = 'prefix' THEN {below("n.kind = 'ARR' AND i = l.at")}
        WHEN l.via = 'rest' THEN {below("n.kind = 'ARR' AND i >= l.at")}
        WHEN l.via IN ('contains', 'unevaluatedItems') THEN {below("n.kind = 'ARR'")}
        WHEN l.via = 'unevaluatedProperties' THEN {below("n.kind = 'OBJ'")}
        WHEN l.to = x.to OR array_contains(x.seen, l.to) THEN array()
        WHEN l.via = 'dependentSchemas' AND NOT coalesce(n.kind = 'OBJ' AND array_contains(n.keys, l.key), false) THEN array()
        ELSE {here} END as {_APP})"""
    value = f"""CASE WHEN x.name IS NULL THEN vals[x.on - 1] ELSE named_struct('kind', 'STR', 'keys', cast(null as array<string>), 'n', cast(null as int), 'txt', x.name,
        'num', cast(null as double), 'json', {none}, 'path', vals[x.on - 1].path, 'kids', cast(array() as array<struct<key:string,at:int>>)) END"""
    made = _let(f"{rules}[x.to]", "r", _let(value, "n", f"cast(flatten(transform(r.links, l -> {applied})) as {_APP})"))
    state = f"struct<apps:{_APP},done:int,counts:array<int>>"
    grown = _let(f"transform(slice(a.apps, a.done + 1, size(a.apps) - a.done), x -> {made})", "w",
                 "named_struct('apps', concat(a.apps, flatten(w)), 'done', size(a.apps), 'counts', concat(a.counts, transform(w, k -> size(k))))")
    start = f"cast(named_struct('apps', array({app(none, none, '2', '1')}), 'done', 0, 'counts', array()) as {state})"
    # spells of 1, 2, 4, ... rounds, so that few are counted behind the last one needed
    bound = f"size({rules}) * (2 + array_max(transform({nodes}, n -> n.lvl)))"
    spell = f"aggregate(sequence(1, shiftleft(1, j)), a0, (a, i) -> CASE WHEN a.done = size(a.apps) THEN a ELSE cast({grown} as {state}) END)"
    down = f"aggregate(sequence(0, cast(floor(log2({bound})) as int)), {start}, (a0, j) -> CASE WHEN a0.done = size(a0.apps) THEN a0 ELSE {spell} END)"

    at = "named_struct('validator', q, 'path', n.path)"
    holds = lambda via: f"exists(k, y -> y.via = '{via}' AND y.ok)"
    any_of = lambda via: f"exists(k, y -> y.via = '{via}')"
    handed = lambda which: f"flatten(transform(filter(k, y -> {which}), y -> y.errors))"
    hits = "size(filter(k, y -> y.via = 'contains' AND y.ok))"
    chosen = f"(y.via NOT IN ('then', 'else') OR (y.via = 'then') = {holds('if')})"
    listed_via = "'properties', 'patternProperties', 'additionalProperties', 'prefix', 'rest'"
    seen = (f"concat(transform(filter(k, y -> y.via IN ({listed_via}) OR (y.via = 'contains' AND y.ok AND r.draft >= 2020)), y -> y.key), "
            f"flatten(transform(filter(k, y -> y.ok AND y.via IN ({sql_list(IN_PLACE)}) AND {chosen}), y -> y.members)))")
    members = f"CASE WHEN r.tracked AND exists(k, y -> true) THEN {seen} ELSE cast(array() as array<string>) END"
    left = lambda via: f"exists(k, y -> y.via = '{via}' AND NOT y.ok AND NOT array_contains(m, y.key))"
    combined = f"""filter(array(
        CASE WHEN {any_of('anyOf')} AND NOT {holds('anyOf')} THEN 'anyOf' END,
        CASE WHEN {any_of('oneOf')} AND size(filter(k, y -> y.via = 'oneOf' AND y.ok)) <> 1 THEN 'oneOf' END,
        CASE WHEN {holds('not')} THEN 'not' END,
        CASE WHEN r.contains AND n.kind = 'ARR' THEN CASE WHEN {hits} = 0 AND coalesce(r.mincont, 1) > 0 THEN 'contains'
             WHEN {hits} < r.mincont THEN 'minContains' WHEN {hits} > r.maxcont THEN 'maxContains' END END,
        CASE WHEN {left('unevaluatedProperties')} THEN 'unevaluatedProperties' END,
        CASE WHEN {left('unevaluatedItems')} THEN 'unevaluatedItems' END), q -> q IS NOT NULL)"""
    inner = f"""concat({handed(f"y.via IN ({sql_list(HANDED_ON)})")},
        CASE WHEN {any_of('if')} THEN {handed(f"y.via = if({holds('if')}, 'then', 'else')")} ELSE cast(array() as {_ERR}) END,
        transform({combined}, q -> {at}))"""
    all_seen = "concat(m, transform(filter(k, y -> y.via IN ('unevaluatedProperties', 'unevaluatedItems')), y -> y.key))"
    leaf = f"cast(transform({_assertions()}, q -> {at}) as {_ERR})"
    full = _let(members, "m", _let(f"cast(concat({leaf}, {inner}) as {_ERR})", "e", f"named_struct('via', x.via, 'key', x.key, 'ok', size(e) = 0, 'errors', e, 'members', {all_seen})"))
    bare = _let(leaf, "e", "named_struct('via', x.via, 'key', x.key, 'ok', size(e) = 0, 'errors', e, 'members', cast(array() as array<string>))")
    # without links to look at, only a rule's own assertions can fail
    outcome = f"CASE WHEN size(k) = 0 AND NOT r.contains THEN {bare} ELSE {full} END"
    with_all = _let("a.apps[i - 1]", "x", _let(f"{rules}[x.to]", "r", _let(value, "n", _let("slice(q0, 1, a.counts[i - 1])", "k", outcome))))
    up = f"""aggregate(reverse(sequence(1, size(a.apps))), cast(array() as {_OUT}), (q0, i) ->
        cast(array_append(slice(q0, a.counts[i - 1] + 1, size(q0)), {with_all}) as {_OUT}))"""
    general = _let(values, "vals", _let(down, "a", f"{up}[0].errors"))
    # without other links each value is bound by one position at most; errors come in the order of the nodes
    own = _let(f"{rules}[i - 1]", "r", _assertions())
    found = _let(f"{rules}[{TRUE}].places", "places", f"filter(transform({nodes}, n -> transform(array(cast(array_position(places, n.pos) as int)), i -> "
                 f"named_struct('ptr', n.ptr, 'names', CASE WHEN i > 0 THEN {own} END))[0]), e -> size(e.names) > 0)")
    direct = f"cast(flatten(transform({found}, e -> transform(e.names, q -> named_struct('validator', q, 'path', substr(replace(e.ptr, '{SEP}', '/'), 2))))) as {_ERR})"
    return f"CASE WHEN {rules}[{TRUE}].places IS NOT NULL AND NOT exists({nodes}, n -> {_mixed('n.key')}) THEN {direct} ELSE {general} END"
