"""String column helpers (JVM side)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_TEXT = r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"


#: Printable ASCII in words one space apart, no period at the end: such a text is normalised by lower case alone.
PLAIN_TEXT = "^(?:[!-~]++(?: (?=[!-~]))?+)*+(?<![.])\\\\z"


def strip_ws(s: str) -> str:
    """SQL: strip all leading and trailing whitespace (not only spaces). A text between two printable ASCII characters is left as it is."""
    bare = "ascii(w) BETWEEN 33 AND 126 AND ascii(right(w, 1)) BETWEEN 33 AND 126"
    return f"transform(array({s}), w -> CASE WHEN {bare} THEN w ELSE regexp_replace(w, '(?U)^\\\\s+|\\\\s+$', '') END)[0]"


def norm_sql(s: str) -> str:
    """SQL: caseless text with collapsed whitespace and no trailing periods."""
    return (f"(CASE WHEN {s} RLIKE '{PLAIN_TEXT}' THEN lower({s}) ELSE "
            f"regexp_replace(regexp_replace(replace(lower({strip_ws(s)}), 'ß', 'ss'), '(?U)\\\\s+', ' '), '[.]+$', '') END)")


def norm_str(col: str) -> Column:
    return F.expr(norm_sql(col))


def tokens_sql(s: str) -> str:
    """SQL: camelCase and snake_case aware lower-case tokens."""
    return (f"regexp_extract_all(replace(lower(regexp_replace({s}, '([a-z0-9])([A-Z])', '$1 $2')), '_', ' '), "
            f"'[a-z0-9]+', 0)")


def tokens(col: str) -> Column:
    return F.expr(tokens_sql(col))


def words_sql(s: str) -> str:
    """SQL: plain lower-case alphanumeric words (no camelCase split)."""
    return f"regexp_extract_all(lower({s}), '[a-z0-9]+', 0)"


def ngrams_sql(words: str, n: int) -> str:
    return (f"CASE WHEN size({words}) >= {n} THEN array_distinct(transform(sequence(1, size({words}) - {n - 1}), "
            f"i -> concat_ws(' ', slice({words}, i, {n})))) ELSE cast(array() as array<string>) END")


def clean_sql(raw: str) -> str:
    """SQL: drop think blocks, strip, unwrap one whole-text code fence."""
    body = strip_ws(f"CASE WHEN contains({raw}, '<think>') THEN regexp_replace({raw}, '(?s)<think>.*?</think>', '') ELSE coalesce({raw}, '') END")
    fence = "'(?s)^```(?:json)?\\\\s*(.*?)\\\\s*```$'"
    return (f"transform(array({body}), b -> CASE WHEN startswith(b, '```') AND b RLIKE {fence} "
            f"THEN {strip_ws(f'regexp_extract(b, {fence}, 1)')} ELSE b END)[0]")


def clean_output(col: str) -> Column:
    return F.expr(clean_sql(col))


def truncation_location(col: str) -> Column:
    """Whether a cut text ends inside a string literal: a quote is left where the complete literals are taken out."""
    rest = F.regexp_replace(col, r'(?s)"(?:[^"\\]|\\.)*+"', "")
    return F.when(F.contains(rest, F.lit('"')), "in_string").otherwise("between_tokens")


def sha256_rank(seed, *cols: str) -> Column:
    """Seeded hash order: hex of sha256("seed:a:b")."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)
