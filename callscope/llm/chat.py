"""Chat formatting with collapse of cumulative snapshots.

A logged conversation that is a prefix of a longer one is dropped, and of equal ones the smallest id stays. Every turn
gets a hash of its position, role and text; running sums of two such hashes are rolling hashes of the conversation's
prefixes. An anti-join of whole conversations with proper prefixes leaves the maximal ones, which are rendered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.operators.ranking import running_totals
from callscope.session import cut_lineage

#: Turns in one row of rendered text; a longer conversation goes on in further rows.
CHUNK = 512


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, at, role, text, n): turns numbered from 1 by turn, null first, ties by role and text.

    Null roles and texts count as empty; rows without a conversation id form one conversation. Running counts come from
    range partitions, so a conversation with a third of all turns is not held by one task.
    """
    rows = turns.select(F.coalesce(turns["conv_id"].cast("string"), F.lit("none")).alias("conv"), turns["conv_id"].cast("bigint").alias("conv_id"),
                        turns["turn"].cast("bigint").alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"),
                        F.coalesce(turns["text"], F.lit("")).alias("text"))
    return running_totals(rows, ["conv"], ["turn", "role", "text"], {"at": "cast(1 as bigint)"}).drop("turn")


def _hash(salt: int) -> str:
    # 40 bits, so that sums of millions of turns stay within a long
    return f"xxhash64({salt}, at, role, text) & 1099511627775L"


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds rolling hashes h1, h2 of the prefix that ends with each turn, and n, the conversation's turns."""
    slim = rows.select("conv", "conv_id", "at", F.expr(_hash(1)).alias("x1"), F.expr(_hash(2)).alias("x2"))
    return running_totals(slim, ["conv"], ["at"], {"h1": "x1", "h2": "x2"}).select("conv", "conv_id", "at", "h1", "h2")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, at, role, text) of conversations that are no prefix of a longer one and have no equal with a smaller id."""
    rows = cut_lineage(numbered(turns))
    size = rows.groupBy("conv").agg(F.max("at").alias("n"))
    p = prefixes(rows).join(size, "conv")
    ends = p.where("at = n").groupBy("at", "h1", "h2").agg(F.min_by("conv", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("conv"))
    proper = p.where("at < n").select("at", "h1", "h2").distinct()
    kept = ends.join(proper, ["at", "h1", "h2"], "left_anti").select("conv")
    return rows.join(kept, "conv", "left_semi")


def chat_markup(role: Column, text: Column) -> Column:
    """One turn between the usual markers; markers inside a text are broken up so that they can't end a turn."""
    safe = F.regexp_replace(text, "<\\|(im_start|im_end)\\|>", "<| $1 |>")
    return F.concat(F.lit("<|im_start|>"), F.regexp_replace(role, "[^A-Za-z0-9_-]", ""), F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def render(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations in chat markup, ``chunk`` turns to a row from part 0 on.

    An empty table gives no row; conversations of empty turns are rendered like others.
    """
    rows = maximal(turns).withColumn("part", F.floor((F.col("at") - 1) / chunk))
    said = F.struct("at", chat_markup(F.col("role"), F.col("text")).alias("said"))
    grouped = rows.groupBy("conv", "conv_id", "part").agg(F.sort_array(F.collect_list(said)).alias("said"))  # ``chunk`` turns at most
    return grouped.select("conv_id", "part", F.size("said").alias("n_turns"), F.array_join(F.col("said.said"), "").alias("text"))


ORACLE = """
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said
           FROM conversations GROUP BY conv_id),
u AS (SELECT said, min(conv_id) AS conv_id FROM t GROUP BY said),
p AS (SELECT DISTINCT list_slice(said, 1, k) AS said FROM (SELECT said, unnest(range(1, len(said))) AS k FROM u)),
m AS (SELECT u.* FROM u ANTI JOIN p ON u.said = p.said),
r AS (SELECT conv_id, unnest(said) AS x, unnest(range(1, len(said) + 1)) AS place FROM m)
SELECT conv_id, CAST(floor((place - 1) / 512) AS BIGINT) AS part, CAST(count(*) AS INT) AS n_turns,
       string_agg('<|im_start|>' || regexp_replace(x.r, '[^A-Za-z0-9_-]', '', 'g') || chr(10)
                  || regexp_replace(x.t, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM r GROUP BY 1, 2
"""
