"""Conversation prefix trie as a burst trie: heads over containers of suffixes.

Every distinct beginning of a conversation is a node. A container holds the suffixes below a node; one that holds more
than ``BURST`` turns bursts into a container for each next turn, and its node becomes a head. What a container holds is
known from one sum per prefix, so all bursts are found at once and no container is ever gathered before it is small.
Containers are dealt to shards, sorted by their turns and swept into nodes with a stack; heads are summed from the
prefixes of their members, which needs no walk from level to level:

* a node's subtree repeats a member's turn wherever that member is not the node's smallest, so saved bytes add up from the
  turns of each member before the depth at which it becomes the smallest;
* leaves and children are counted at the smallest member of each.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.chat import numbered
from callscope.llm.shared import batch, parts, salted_join
from callscope.operators.ranking import running_totals
from callscope.session import cut_lineage

#: Turns and conversations that a container holds before it bursts.
BURST = 512
#: Ids of one piece of a long list of members.
PIECE = 4096

_KEY = ["at", "h1", "h2", "h3"]
_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
         ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NOBODY = hashlib.sha256(b"").hexdigest()


class _Open:
    """A node of the path that the sweep is on. Children wait here until the smallest member is known."""
    __slots__ = ("size", "n", "low", "leaves", "saved", "ends", "children")

    def __init__(self, size: int):
        self.size, self.n, self.low, self.leaves, self.saved, self.ends, self.children = size, 0, None, 0, 0, [], []

    def close(self, depth: int) -> tuple[list, list[tuple]]:
        """The node's row but for its parent, and its children's rows."""
        ends = ",".join(map(str, sorted(self.ends)))
        n = self.n + len(self.ends)
        low = min([*self.ends, *([] if self.low is None else [self.low])])
        row = [low, depth, None, n, len(self.children), self.leaves or 1, self.saved + (n - 1) * self.size, hashlib.sha256(ends.encode()).hexdigest()]
        for child in self.children:
            child[2] = low
        return row, self.children


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows (at, h1, h2, h3, parent, conv_id, t1, t2, size) come sorted by container, turns and id."""
    schema = pa.schema([*_NODE, ("top", pa.bool_())])
    key, parent, path, stack, out = None, None, [], [], []

    def fold() -> None:
        row, rows = stack[-1].close(key[0] + len(stack) - 1)
        out.extend((*r, False) for r in rows)
        stack.pop()
        if stack:
            above = stack[-1]
            above.n += row[3]
            above.low = row[0] if above.low is None else min(above.low, row[0])
            above.leaves += row[5]
            above.saved += row[6]
            above.children.append(row)
        else:
            row[2] = parent
            out.append((*row, True))

    def rows() -> pa.RecordBatch:
        made = batch(schema, **{f.name: [r[i] for r in out] for i, f in enumerate(schema)})
        out.clear()
        return made

    for b in batches:
        for at, h1, h2, h3, above, conv, t1, t2, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            turns = list(zip(t1, t2))
            if (at, h1, h2, h3) != key:
                while stack:
                    fold()
                key, parent, path = (at, h1, h2, h3), above, []
                stack.append(_Open(size[0] if at else 0))
            own, sizes = (turns[1:], size[1:]) if at else (turns, size)
            same = 0
            while same < len(path) and same < len(own) and path[same] == own[same]:
                same += 1
            while len(stack) > same + 1:
                fold()
            stack.extend(_Open(s) for s in sizes[same:])
            stack[-1].ends.append(conv)
            path = own
            if len(out) >= 8192:
                yield rows()
    while stack:
        fold()
    yield rows()


def _digests(ends: DataFrame) -> DataFrame:
    """(at, h1, h2, h3, ends_sha256): of the members' ids in order; a long list is written in pieces, then streamed by one task."""
    n = parts(ends.sparkSession)
    schema = pa.schema([("at", pa.int64()), *((h, pa.int64()) for h in _KEY[1:]), ("first", pa.int64()), ("ids", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def piece() -> pa.RecordBatch:
            return batch(schema, **{c: [v] for c, v in zip(_KEY, key, strict=True)}, first=[held[0]], ids=[",".join(map(str, held))])

        for b in batches:
            for *new, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (new != key or len(held) == PIECE):
                    yield piece()
                    held.clear()
                key = new
                held.append(conv)
        if held:
            yield piece()

    done = pa.schema([*[(c, pa.int64()) for c in _KEY], ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            for *new, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if new == key:
                    state.update(b",")
                else:
                    if key is not None:
                        yield batch(done, **{c: [v] for c, v in zip(_KEY, key, strict=True)}, ends_sha256=[state.hexdigest()])
                    key, state = new, hashlib.sha256()
                state.update(ids.encode())
        if key is not None:
            yield batch(done, **{c: [v] for c, v in zip(_KEY, key, strict=True)}, ends_sha256=[state.hexdigest()])

    dealt = ends.select(*_KEY, "conv_id").repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    told = cut_lineage(dealt.mapInArrow(pieces, "at bigint, h1 bigint, h2 bigint, h3 bigint, first bigint, ids string"))
    return told.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "at bigint, h1 bigint, h2 bigint, h3 bigint, ends_sha256 string")


def trie_nodes(rows: DataFrame, members: DataFrame, burst: int = BURST) -> DataFrame:
    """Nodes of conversations given as rows (conv_id, at, role, text), at = 1, 2, ... without gaps, and members (conv_id).

    Returned per node: conv_id, its smallest member; depth; parent_conv_id, null for the root; n_convs; n_children; n_leaves;
    saved_tokens; ends_sha256. Members without rows are members of the root alone. Ids are unique among members and not null.
    Turns are known by 128-bit hashes of role and text, prefixes by three running sums of 40 bits.
    """
    n = parts(rows.sparkSession)
    slim = rows.select("conv_id", "at", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(7), "text", "role").alias("t2"),
                       F.octet_length("text").cast("bigint").alias("size"))
    sums = {f"h{k}": f"xxhash64({k}, at, t1, t2) & 1099511627775L" for k in (1, 2, 3)}  # 40 bits: a sum of millions stays a long
    known = running_totals(slim, ["conv_id"], ["at"], {**sums, "upto": "size"})
    length = slim.groupBy("conv_id").agg(F.max("at").alias("n"))
    members = cut_lineage(members.select("conv_id").join(length, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))
    full = cut_lineage(salted_join(known, members, ["conv_id"], "at"))
    whole = members.agg(F.sum(F.col("n") + 1).alias("weight"), F.min("conv_id").alias("low"), F.max("n").alias("longest")).first()

    # a prefix whose suffixes outgrow a container is a head; the root counts all
    x = [F.expr(sums[f"h{k}"]) for k in (1, 2, 3)]
    above = [(F.col(f"h{k}") - x[k - 1]).alias(f"p{k}") for k in (1, 2, 3)]
    heads = full.select(*_KEY, "conv_id", "n", "size", *above).groupBy(*_KEY).agg(
        F.sum(F.col("n") - F.col("at") + 1).alias("weight"), F.min("conv_id").alias("low"), F.max("n").alias("longest"), *[F.first(f"p{k}").alias(f"p{k}") for k in (1, 2, 3)])
    burst_root = bool(whole["weight"]) and whole["weight"] > burst
    heads = cut_lineage(heads.where((F.col("weight") > burst) & F.lit(burst_root)).drop("weight"))
    on = salted_join(full.select("conv_id", *_KEY, "n", "size", "upto"), heads.select(*_KEY, "low", "longest"), _KEY, "conv_id")
    if burst_root:
        root = members.select("conv_id", *[F.lit(0).cast("bigint").alias(c) for c in _KEY], "n", *[F.lit(0).cast("bigint").alias(c) for c in ("size", "upto")],
                              F.lit(whole["low"]).alias("low"), F.lit(whole["longest"]).alias("longest"))
        on = on.select(*root.columns).union(root)
    on = cut_lineage(on)
    mine = F.col("low") == F.col("conv_id")
    placed = on.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.when(mine, F.col("at"))).alias("since"), F.max_by("low", "at").alias("parent"),
        F.coalesce(F.max(F.when(~mine, F.col("upto"))), F.lit(0)).alias("shared"),
        F.coalesce(F.max(F.when(mine & (F.col("at") == F.col("n")) & (F.col("longest") == F.col("n")), F.lit(1))), F.lit(0)).alias("leaf"))
    placed = cut_lineage(members.join(placed, "conv_id", "left").withColumn("k", F.coalesce("k", F.lit(0))))

    # containers: the suffixes of a conversation that go on below its last head
    inside = placed.where("n >= k").select("conv_id", "k", "parent")
    last = salted_join(full.select("conv_id", *_KEY, "t1", "t2", "size"), inside.select("conv_id", "k"), ["conv_id"], "at").where("at >= k")
    turn = F.sort_array(F.collect_list(F.struct("at", "t1", "t2", "size")))  # of a container: ``burst`` turns at most
    suffix = last.groupBy("conv_id").agg(turn.alias("turns"), F.max(F.when(F.col("at") == F.col("k"), F.struct("h1", "h2", "h3"))).alias("h"))
    held = inside.join(suffix, "conv_id", "left").select(
        F.col("k").alias("at"), *[F.coalesce(f"h.{c}", F.lit(0)).alias(c) for c in ("h1", "h2", "h3")], "parent", "conv_id",
        *[F.coalesce(f"turns.{c}", F.array().cast("array<bigint>")).alias(c) for c in ("t1", "t2", "size")])
    swept = held.repartition(n, *_KEY).sortWithinPartitions(*_KEY, F.arrays_zip("t1", "t2"), "conv_id").mapInArrow(_sweep, f"{_NODES}, top boolean")
    swept = cut_lineage(swept)
    nodes = swept.drop("top")
    if not burst_root:
        return nodes

    tops = swept.where("top").select("conv_id", F.col("n_leaves").alias("below"), F.col("saved_tokens").alias("saved"))
    told = placed.join(tops, "conv_id", "left").select(
        "conv_id", "k", "shared", "leaf", "below", "saved", F.least("since", F.when(F.col("below").isNotNull(), F.col("k"))).alias("since"))
    each = salted_join(on.drop("n"), told.join(members, "conv_id"), ["conv_id"], "at")
    repeated = F.greatest(F.lit(0), F.col("shared") - F.col("upto") + F.col("size"))
    summed = each.groupBy(*_KEY).agg(
        F.first("low").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.when((F.col("n") > F.col("at")) & (F.col("since") <= F.col("at") + 1), 1).otherwise(0)).alias("n_children"),
        F.sum(F.coalesce("below", F.lit(0)) + F.col("leaf")).alias("n_leaves"), F.sum(F.coalesce("saved", F.lit(0)) + repeated).alias("saved_tokens"))
    parent = heads.select("at", *[F.col(f"h{k}").alias(f"p{k}") for k in (1, 2, 3)], F.col("low").alias("parent_conv_id"))
    parent = parent.union(rows.sparkSession.createDataFrame([(0, 0, 0, 0, whole["low"])], "at bigint, p1 bigint, p2 bigint, p3 bigint, parent_conv_id bigint"))
    hung = salted_join(heads.select(*_KEY, "p1", "p2", "p3"), parent.select((F.col("at") + 1).alias("at"), "p1", "p2", "p3", "parent_conv_id"), ["at", "p1", "p2", "p3"], "h1")
    ends = _digests(on.where("at = n"))
    return nodes.union(summed.join(hung.select(*_KEY, "parent_conv_id"), _KEY, "left").join(ends, _KEY, "left").select(
        "conv_id", F.col("at").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256")))


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): turns in order from 1 on; rows without a conversation id are left out."""
    return numbered(turns.where(turns["conv_id"].isNotNull())).select("conv_id", "at", "role", "text")


def prefix_trie(turns: DataFrame, burst: int = BURST) -> DataFrame:
    """The trie of conversations as logged: one row per distinct beginning, see ``trie_nodes``.

    Turns are ordered by turn, null first, ties by role and text; null roles and texts count as empty, repeated rows as
    further turns. Rows without a conversation id take no part. Only conv_id, turn, role and text are read, so other columns
    cannot clash. Long conversations and texts have no limit: what outgrows a container is summed from rows. An empty table
    has no node.
    """
    rows = cut_lineage(ordered(turns))
    return trie_nodes(rows, rows.select("conv_id").distinct(), burst)


def rebuilt(rows: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: rows (conv_id, at, role, text), and members (conv_id).

    Conversation c begins with the first h turns of c - c % ``group``, h = crc32 of c in decimals modulo ``spread``, and goes
    on with its own turns behind its first h.
    """
    length = rows.groupBy("conv_id").agg(F.max("at").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).alias("h")
    first = (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("first")
    members = cut_lineage(length.select("conv_id", h, first))
    lent = members.join(length.select(F.col("conv_id").alias("first"), "n"), "first", "left").select("conv_id", F.least("h", F.coalesce("n", F.lit(0))).alias("lent"))
    begin = rows.where((F.col("at") < spread) & (F.pmod("conv_id", F.lit(group)) == 0)).withColumnRenamed("conv_id", "first")
    head = begin.join(members, "first").where("at <= h").select("conv_id", "at", "role", "text")  # spread turns for group conversations
    own = salted_join(rows.where(F.col("at") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread), lent, ["conv_id"], "at")
    h_of = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    return head.union(own.select("conv_id", (F.col("at") - h_of + F.col("lent")).alias("at"), "role", "text")), members.select("conv_id")


ORACLE = """
WITH o AS (SELECT conv_id, list(md5(coalesce(role, '') || chr(1) || coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
                  list(CAST(strlen(coalesce(text, '')) AS BIGINT) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS b
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                          lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                          lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 9 AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(list_slice(f.t, 1, h.h), []), list_slice(h.t, h.h + 1, len(h.t))) AS t,
             list_concat(coalesce(list_slice(f.b, 1, h.h), []), list_slice(h.b, h.h + 1, len(h.b))) AS b
      FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(t) AS n, coalesce(b[d], 0) AS size, array_to_string(list_slice(t, 1, d), ' ') AS path, array_to_string(list_slice(t, 1, d - 1), ' ') AS up
      FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM c)),
v AS (SELECT d, path, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, path),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
sub AS (SELECT a.d, a.path, sum(CAST(v.leaf AS INT)) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved
        FROM v JOIN p a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.d, a.path)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN sub USING (d, path) LEFT JOIN kids USING (d, path) LEFT JOIN v u ON u.d = v.d - 1 AND u.path = v.up
"""
