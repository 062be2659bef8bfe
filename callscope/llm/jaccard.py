"""Jaccard join over word n-grams by vertical partitioning: components of near-equal documents.

The global order of n-grams is the order of their 64-bit hashes, so equal cuts of the hash range are fragments of equal
expected weight without a pass over the corpus. Two sets of at least the threshold's resemblance differ in so few
members that, cut into one more fragment than that, they agree on a whole one: equal fragments name the candidates.
Within a family of candidates, overlaps are counted per fragment of the order and summed per pair.

Copies collapse to one representative first, families are compared in blocks of bounded size, and a block returns only
a spanning forest of its links, so no group is held in one task and no pair is emitted for its own sake.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.shared import ascii_lower, batch, parts, shingle_hashes, words
from callscope.operators.graph import components
from callscope.operators.ranking import running_totals
from callscope.session import cut_lineage, small_batches

#: Members that one block of a family may hold; a document counts as ``LIGHT`` at least, so its rows are bounded too.
BLOCK_MEMBERS = 300_000
LIGHT = 400
#: Signatures that one task sorts, about, at so many characters a word.
DEAL, CHARS_PER_WORD = 2_000_000, 6
#: Columns of one fragment's matrix.
FRAGMENT = 4096


def fragments(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(level, fragments, differences) under which a set of n members names its candidates.

    Level l holds sizes from (den/num)^l. Sizes that can match lie in the same or the next level, so a set uses its own
    level and the one above. Two matching sets that meet there differ in at most floor((den - num) / (den + num) *
    (n1 + n2)) members, and in at most floor(n * (den - num) / num), whichever of them has n. With more fragments than
    that, one at least is equal; three in ten more are cut, so that small fragments can be left out.
    """
    ratio = den / num
    level = int(math.log(n) / math.log(ratio) + 1e-9)
    out = []
    for at in (level, level + 1):
        apart = (den - num) * 2 * math.ceil(ratio ** (at + 1) + 1e-6) // (den + num)
        out.append((at, apart + 1 + (1 + apart * 3 // 10 if apart else 0), min(apart, n * (den - num) // num)))
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A second hash of 64-bit hashes."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _signatures(sets: np.ndarray, num: int, den: int) -> np.ndarray:
    """One value per fragment and level: a sum over its members, mixed with level and fragment.

    A set names its fragments of k members or more, with the largest k that leaves more fragments than it can differ in.
    Of two matching sets, the one with the larger k has an equal fragment among those it names, and the other names it
    too. Empty fragments are named where even k = 1 leaves too few.
    """
    out = []
    for level, count, apart in fragments(len(sets), num, den):
        of = ((sets >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums, size = np.add.reduceat(_mix(sets, 1), cuts), np.diff([*cuts, len(sets)])
        least = int(np.sort(size)[::-1][apart]) if len(cuts) > apart else 1
        big = cuts[size >= least]
        out.append(_mix(sums[size >= least], 2) ^ _mix(of[big] + np.uint64(level << 40), 3))
        if len(cuts) <= apart:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), of)
            out.append(_mix(empty + np.uint64(level << 40), 4))
    return np.concatenate(out).view(np.int64)


_SETS = "array<struct<id:bigint,th:bigint,node:bigint,n:bigint>>"


def _signed(num: int, den: int, deals: int):
    """The sets of some rows, in rows of deal -1, and their signatures, packed by the deal that a signature falls into.

    A node is a hash of a whole set. Its signatures are sent once per task: a group of copies costs one set from every
    task that reads some.
    """
    member = pa.struct([(c, pa.int64()) for c in ("id", "th", "node", "n")])
    schema = pa.schema([("deal", pa.int32()), ("sig", pa.binary()), ("at", pa.binary()), ("nodes", pa.binary()), ("sets", pa.list_(member))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                flat, offsets = s.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64), s.column(2).offsets.to_numpy()
                offsets, nodes, signs, sets = (offsets - offsets[0]).tolist(), [], [], []
                for key, th, first, end in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), offsets, offsets[1:]):
                    x = flat[first:end]
                    node = int(np.bitwise_xor.reduce(_mix(x, 9)).view(np.int64)) if first < end else 0
                    sets.append({"id": key, "th": th, "node": node, "n": end - first})
                    if first < end and key is not None and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        signs.append(_signatures(np.sort(x), num, den))
                yield batch(schema, deal=[-1], sig=[None], at=[None], nodes=[None], sets=[sets])
                if not nodes:
                    continue
                sig, owner = np.concatenate(signs), np.repeat(np.arange(len(nodes)), [len(x) for x in signs])
                deal = (sig.view(np.uint64) >> np.uint64(20)) % np.uint64(deals)
                order = np.argsort(deal, kind="stable")
                cuts = np.searchsorted(deal[order], np.arange(deals + 1).astype(np.uint64))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    some = order[cuts[k]:cuts[k + 1]]
                    own, at = np.unique(owner[some], return_inverse=True)
                    yield batch(schema, deal=[k], sig=[sig[some].tobytes()], at=[at.astype("<u2").tobytes()],
                                nodes=[np.array(nodes, np.int64)[own].tobytes()], sets=[None])
    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of nodes with an equal signature, one per node: to the least node that its deal's ties reach."""
    sig, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        for s, at, nodes in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            sig.append(np.frombuffer(s, np.int64))
            node.append(np.frombuffer(nodes, np.int64)[np.frombuffer(at, "<u2")])
    s, n = np.concatenate(sig), np.concatenate(node)
    order = np.lexsort((n, s))
    s, n = s[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    low = np.repeat(n[begin], np.diff([*begin, len(n)]))
    ids, ends = np.unique(np.stack([n, low], axis=1)[n != low], return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    reach = np.arange(len(ids))
    while True:
        least, new = np.minimum(reach[a], reach[b]), reach.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == reach).all():
            break
        reach = new
    tied = np.flatnonzero(reach != np.arange(len(ids)))
    for lo in range(0, len(tied), 100_000):
        some = tied[lo:lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[reach[some]])], names=["a", "b"])


def _blocks(num: int, den: int):
    """Links inside one pair of blocks: partial overlaps per fragment of the order, summed, then a spanning forest."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, side = t.column("node").to_numpy(), t.column("block").to_numpy()
        lists = t.column("grams").chunk(0) if t.num_rows else None
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), size)
        grams, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        # members of one document only count for nothing; the others keep the global order
        rank = np.cumsum(count > 1) - 1
        keep = count[column] > 1
        owner, column = owner[keep], rank[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = int(column[-1]) + 1 if len(column) else 0
        both = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, width, FRAGMENT):
            a, b = np.searchsorted(column, [lo, lo + FRAGMENT])
            m = np.zeros((len(ids), min(FRAGMENT, width - lo)), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            both += m @ m.T

        def linked(u: int) -> np.ndarray:
            row = (den + num) * both[u].astype(np.float64) >= num * (size[u] + size)
            return row & (side != side[u]) if i != j else row

        # breadth first from each row: one link per row reached
        left, out = np.ones(len(ids), bool), []
        for root in range(len(ids)):
            if not left[root]:
                continue
            left[root], queue = False, [root]
            while queue:
                u = queue.pop()
                new = np.flatnonzero(linked(u) & left)
                left[new] = False
                out += [(u, v) for v in new.tolist()]
                queue += new.tolist()
        a, b = (np.array([e[k] for e in out], np.int64) for k in (0, 1))
        return pa.table({"a": ids[a], "b": ids[b]})
    return run


def linked_classes(plain: DataFrame, reps: DataFrame, ties: DataFrame, grams: Column, num: int, den: int) -> DataFrame:
    """(node, class) of the nodes with a link; candidates (a, b) in ``ties`` are closed to families, which are compared exactly.

    ``reps`` names the row of ``plain`` (id, th, text) that each node's set of n members is made from again.
    """
    ends = ties.select(F.col("a").alias("id")).union(ties.select(F.col("b").alias("id"))).distinct()
    family = cut_lineage(components(ends, ties).select(F.col("id").alias("node"), F.col("label").alias("family")))

    # blocks of a family by size, so that blocks whose sizes can't match are never paired
    sized = family.join(reps, "node").withColumn("w", F.greatest("n", F.lit(LIGHT)))
    dealt = running_totals(sized, ["family"], ["n", "node"], {"upto": "w"})
    member = cut_lineage(dealt.select("id", "th", "node", "family", "n", F.floor((F.col("upto") - 1) / BLOCK_MEMBERS).alias("block")))
    block = member.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = block.alias("x"), block.alias("y")
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block"))
                   & (F.col("x.most") * den >= F.col("y.least") * num)).select(
        F.col("x.family").alias("family"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.select("family", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # shingles are made again, for members only; repeated rows are one where the join has brought them together
    texts = plain.join(member.drop("n"), ["id", "th"]).distinct()
    held = texts.select("node", "family", "block", grams.alias("grams"))
    links = (held.join(sides, ["family", "block"]).select("family", "i", "j", "block", "node", "grams")
             .groupBy("family", "i", "j").applyInArrow(_blocks(num, den), "a bigint, b bigint"))
    links = cut_lineage(links.distinct())

    linked = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    return components(linked, links).select(F.col("id").alias("node"), F.col("label").alias("class"))


def near_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents are linked where den * |both| >= num * |either|.

    A document's set is its distinct ``size``-word shingles, A-Z lower-cased; with fewer words the whole sequence is its
    one shingle; without words it is empty and linked with nothing. ``component_id`` is the smallest id reachable by
    links. One row per input row, repeated rows too. Rows without an id link nothing; where a row with an id has the same
    set, they share its component, else theirs is null.
    """
    small_batches(docs.sparkSession)
    grams = shingle_hashes(words(ascii_lower(F.col("text"))), size)
    plain = docs.select(docs[id].cast("bigint").alias("id"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    # a set of n words has about as many signatures as its levels have fragments: deals are sized by the length of all texts
    chars = docs.agg(F.sum(F.length(docs[text])).alias("n")).first()["n"] or 0
    each = sum(f[1] for f in fragments(1 << 16, num, den)) / (1 << 16)
    deals = max(parts(docs.sparkSession), math.ceil(chars / CHARS_PER_WORD * each / DEAL))
    told = cut_lineage(plain.select("id", "th", grams.alias("grams")).mapInArrow(
        _signed(num, den, deals), f"deal int, sig binary, at binary, nodes binary, sets {_SETS}"))
    sets = told.where("deal < 0").select(F.inline("sets"))
    least = F.min(F.struct("id", "th"))
    reps = sets.where("n > 0 AND id IS NOT NULL").groupBy("node").agg(least.alias("l"), F.first("n").alias("n")).select(
        "node", F.col("l.id").alias("id"), F.col("l.th").alias("th"), "n")

    # candidates: the sets of an equal fragment, each tied to the smallest of them
    ties = told.where("deal >= 0").select("deal", "sig", "at", "nodes").repartitionById(deals, "deal").mapInArrow(_ties, "a bigint, b bigint").distinct()
    ties = cut_lineage(ties)
    whole = linked_classes(plain, reps, ties, grams, num, den)
    known = cut_lineage(reps.select("node", "id").join(whole, "node", "left").select("node", "id", F.coalesce("class", "node").alias("class")))
    first = known.groupBy("class").agg(F.min("id").alias("component_id"))
    out = sets.select("id", "node", "n").join(known.join(first, "class").select("node", "component_id"), "node", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
