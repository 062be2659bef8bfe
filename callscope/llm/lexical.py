"""Exact ranked lexical search by a dual tree.

Documents become sparse vectors over the items' terms, kept in chunks whose order follows their vectors, so that every run
of documents is a node of a hierarchy; items are split in halves down to small leaves. A node holds the maximum of each
coordinate below it, so the product of two nodes' maxima bounds the score of every item under the one with every document
under the other. A pair of nodes goes no further where its bound is below the weakest k-th score among its items.

A first pass scores each item's most promising leaf of each chunk. The k-th score that some task has seen for an item is
below none of its k best, so the second pass starts from there and all tasks prune with what the others have found.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.shared import batch, bounded_batches, slices, term_pieces
from callscope.session import cut_lineage

#: Terms of the items that are searched for at once: what is broadcast and the width of a vector.
TERMS = 1 << 16
#: Documents and entries of a chunk, documents of a leaf, leaves under an inner node, items of a leaf.
CHUNK, ENTRIES, LEAF, FAN, ITEMS = 2048, 500_000, 64, 8, 8
#: Coordinates in which vectors are put in order.
AXES = 16
ROWS = 256


class Node(NamedTuple):
    """Items [first, last) of the tree's order, and the maximum of each of their coordinates."""
    first: int
    last: int
    terms: np.ndarray
    most: np.ndarray
    below: tuple


class Items(NamedTuple):
    """Items in tree order: ids, coordinates, and the root."""
    ids: list[int]
    vectors: list[tuple[np.ndarray, np.ndarray]]
    root: Node


def in_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order in which near points are near: halves along the axis of most variance, down to ``leaf`` points."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        some = todo.pop()
        if len(some) <= leaf:
            done.append(some)
            continue
        x = points[some] - points[some].mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        half = -(-len(some) // (2 * leaf)) * leaf  # whole leaves on the left
        some = some[np.argsort(x @ axes[:, -1], kind="stable")]
        todo += [some[half:], some[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def _points(term: np.ndarray, value: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Vectors in a few random directions, of length one."""
    directions = np.random.default_rng(17).standard_normal((width, AXES)).astype(np.float32)
    p = np.add.reduceat(directions[term] * value[:, None].astype(np.float32), starts, axis=0)
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)


def item_tree(items: list[tuple[int, Counter]], number: dict[bytes, int], weight: np.ndarray) -> Items:
    """The hierarchy over items: (id, terms) with one coordinate a term, its weight times its repeats."""
    vectors = []
    for _, terms in items:
        at = np.array(sorted(number[t] for t in terms), np.int64)
        by = {number[t]: n for t, n in terms.items()}
        vectors.append((at, weight[at] * np.array([by[int(k)] for k in at], np.int64)))
    starts = np.cumsum([0] + [len(v[0]) for v in vectors])[:-1]
    order = in_order(_points(np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors]), starts, len(weight)), ITEMS)
    vectors = [vectors[k] for k in order]

    def node(first: int, last: int) -> Node:
        below: tuple = ()
        if last - first > ITEMS:
            middle = first + -(-(last - first) // (2 * ITEMS)) * ITEMS
            below = (node(first, middle), node(middle, last))
        parts = [(n.terms, n.most) for n in below] or vectors[first:last]
        term, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.argsort(term, kind="stable")
        cuts = np.flatnonzero(np.diff(term[by], prepend=-1))
        return Node(first, last, term[by][cuts], np.maximum.reduceat(value[by], cuts), below)

    return Items([items[k][0] for k in order], vectors, node(0, len(vectors)))


class Chunk:
    """Documents of one row: coordinates, and the maxima of leaves, inner nodes and the whole."""

    def __init__(self, ids: list[int | None], packed: bytes, n_docs: int, total: int, width: int):
        raw = np.frombuffer(_unpack(packed), "<i4")
        count = len(ids)
        length, size = raw[:count].astype(np.int64), raw[count:2 * count].astype(np.int64)
        term, tf = raw[2 * count:].reshape(2, -1)
        self.ids, self.term = ids, term
        self.starts = np.concatenate([[0], np.cumsum(size)])
        if 25 * int(length.max(initial=0)) * n_docs < 2**63:
            m = 75 + 25 * length * n_docs // total
        else:
            m = np.array([75 + 25 * int(n) * n_docs // total for n in length], np.int64)
        self.value = 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 12 * np.repeat(m, size))
        leaves = -(-count // LEAF)
        most = np.zeros((leaves, width), np.int64)
        np.maximum.at(most, (np.repeat(np.arange(count) // LEAF, size), term), self.value)
        inner = np.maximum.reduceat(most, np.arange(0, leaves, FAN), axis=0)
        self.levels = [inner.max(axis=0, keepdims=True), inner, most]
        self.width, self.dense = width, {}

    def leaf(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of a leaf's documents as a matrix over its own terms, and each term's column; the last one is zero."""
        if k not in self.dense:
            first, last = k * LEAF, min(len(self.ids), (k + 1) * LEAF)
            a, b = self.starts[first], self.starts[last]
            own, column = np.unique(self.term[a:b], return_inverse=True)
            m = np.zeros((last - first, len(own) + 1), np.int64)
            m[np.repeat(np.arange(last - first), np.diff(self.starts[first:last + 1])), column] = self.value[a:b]
            place = np.full(self.width, len(own), np.int32)
            place[own] = np.arange(len(own))
            self.dense[k] = m, place
        return self.dense[k]

    def scores(self, k: int, vector: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        m, place = self.leaf(k)
        return m[:, place[vector[0]]] @ vector[1]


def _pack(*arrays: np.ndarray) -> bytes:
    raw = np.concatenate(arrays).astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


class Best:
    """The k best documents of each item so far, and the score that a further one has to reach."""

    def __init__(self, items: Items, k: int, floor: np.ndarray):
        self.items, self.k, self.least = items, k, floor.copy()
        self.held: list[list[tuple[int, bool, int]]] = [[] for _ in items.ids]

    def add(self, item: int, chunk: Chunk, leaf: int) -> None:
        scores = chunk.scores(leaf, self.items.vectors[item])
        good = np.flatnonzero(scores >= self.least[item])
        if not len(good):
            return
        new = [(-int(scores[d]), chunk.ids[leaf * LEAF + d] is None, chunk.ids[leaf * LEAF + d] or 0) for d in good]
        self.held[item] = sorted(self.held[item] + new)[:self.k]
        if len(self.held[item]) == self.k:
            self.least[item] = max(self.least[item], -self.held[item][-1][0])


def greedy(best: Best, chunk: Chunk) -> None:
    """Score each item's leaf of the highest bound."""
    most = chunk.levels[-1]
    for i, (terms, value) in enumerate(best.items.vectors):
        bound = most[:, terms] @ value
        leaf = int(np.argmax(bound))
        if bound[leaf] >= best.least[i]:
            best.add(i, chunk, leaf)


def dual(best: Best, chunk: Chunk) -> None:
    """Walk both hierarchies at once; pairs of nodes whose bound is below their items' weakest k-th score are left out."""
    todo = [(best.items.root, 0, np.zeros(1, np.int64))]
    while todo:
        node, level, spots = todo.pop()
        bound = chunk.levels[level][spots][:, node.terms] @ node.most
        spots = spots[bound >= best.least[node.first:node.last].min()]
        if not len(spots):
            continue
        deeper = min(level + 1, len(chunk.levels) - 1)
        if level == 0:
            spots = np.arange(len(chunk.levels[1]))
        elif level == 1:
            spots = (spots[:, None] * FAN + np.arange(FAN)).ravel()
            spots = spots[spots < len(chunk.levels[2])]
        elif not node.below:
            for i in range(node.first, node.last):
                terms, value = best.items.vectors[i]
                bound = chunk.levels[2][spots][:, terms] @ value
                for k in np.argsort(-bound, kind="stable"):
                    if bound[k] < best.least[i]:
                        break
                    best.add(i, chunk, int(spots[k]))
            continue
        todo += [(child, deeper, spots) for child in node.below or (node,)]


def _vectors(docs: DataFrame, shared, width: int, text: str, id: str) -> DataFrame:
    """Chunks of document vectors (ids, packed), and for each task one row of its counts (n, total, df)."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("packed", pa.binary()), ("n", pa.int64()), ("total", pa.int64()), ("df", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rare = shared.value
        df, n, total, held, entries = np.zeros(width, np.int64), 0, 0, [], 0

        def chunk() -> pa.RecordBatch:
            size = np.array([len(h[2]) for h in held], np.int64)
            term, tf = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            np.add.at(df, term, 1)
            starts = np.concatenate([[0], np.cumsum(size)])
            order = in_order(_points(term, np.sqrt(tf) * rare[term], starts[:-1], width), LEAF)
            at = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in order])
            return batch(schema, ids=[[held[k][0] for k in order]], packed=[_pack(np.array([held[k][1] for k in order]), size[order], term[at], tf[at])], n=[None], total=[None], df=[None])

        for b in batches:
            for s in slices(b, 1, ROWS):
                for key, said in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    found: Counter = Counter()
                    for piece in term_pieces(said or ""):
                        found.update(piece)
                    length = found.total()
                    if not length:
                        continue
                    n, total = n + 1, total + length
                    own = sorted((number[t], c) for t, c in found.items() if t in number)
                    if not own:
                        continue
                    pairs = np.array(own, np.int64)
                    held.append((key, length, pairs[:, 0], pairs[:, 1]))
                    entries += len(own)
                    if len(held) == CHUNK or entries >= ENTRIES:
                        yield chunk()
                        held, entries = [], 0
        if held:
            yield chunk()
        yield batch(schema, ids=[None], packed=[None], n=[n], total=[total], df=[df])

    rows = docs.select(docs[id].cast("bigint").alias("id"), docs[text].alias("text"))
    return cut_lineage(rows.mapInArrow(run, "ids array<bigint>, packed binary, n bigint, total bigint, df array<bigint>"))


def _searched(chunks: DataFrame, shared, walk, k: int, last: bool) -> DataFrame:
    """Walk every chunk; each task gives its k best of every item, or just the k-th score where it has k."""
    schema = pa.schema([(c, pa.int64()) for c in ("item_id", "doc_id", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor, n, total, width = shared.value
        best = Best(items, k, floor)
        for b in batches:
            for ids, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                walk(best, Chunk(ids, packed, n, total, width))
        rows = [(item, None if no_id else key, -score) for item, held in zip(items.ids, best.held, strict=True)
                for score, no_id, key in (held if last else held[k - 1:])]
        yield batch(schema, **{c: [r[i] for r in rows] for i, c in enumerate(("item_id", "doc_id", "score"))})

    return chunks.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties to the smaller id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. The score sums over the item's terms,
    repeats included, the term's weight times its share in the document damped by the document's length, in 64-bit integers.
    Counts are over all documents. Rows without a document id rank last among ties, repeated rows each for itself; null and
    empty texts have no terms and rank nowhere. Rows without an item id ask nothing; of rows that repeat one the least text
    asks. Very long texts are read in pieces. Only ids and texts are read, so other columns cannot clash. Empty tables give
    no rows. Items of more than ``TERMS`` terms in all are searched in batches, each with a pass of its own over the texts.
    """
    spark = docs.sparkSession
    asked = items.where(items[item_id].isNotNull()).groupBy(items[item_id].cast("bigint").alias("item_id")).agg(F.min(items[item_text]).alias("said")).where("said IS NOT NULL")
    out = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for part in bounded_batches(asked, ["item_id"], F.octet_length("said") / 2 + 1, TERMS):  # a term has a byte and a separator at least
        told = [(r["item_id"], Counter(t for piece in term_pieces(r["said"]) for t in piece)) for r in part.collect()]  # TERMS terms and one item at most
        told = [t for t in told if t[1]]
        if not told:
            continue
        asking = Counter(t for _, terms in told for t in terms)
        number = {t: i for i, t in enumerate(sorted(asking))}
        width = len(number)
        rare = np.log(1 + len(told) / np.array([asking[t] for t in number], np.float64))
        vectors = _vectors(docs, spark.sparkContext.broadcast((number, rare)), width, text, id)
        counts = vectors.where("df IS NOT NULL")
        sums = counts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        if not sums["n"]:
            continue
        df = np.zeros(width, np.int64)
        for r in counts.select(F.posexplode("df").alias("at", "df")).where("df > 0").groupBy("at").agg(F.sum("df").alias("df")).collect():  # one row a term
            df[r["at"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        tree = item_tree(told, number, weight)
        chunks = vectors.where("packed IS NOT NULL").select("ids", "packed")
        floor = np.ones(len(tree.ids), np.int64)
        seen = _searched(chunks, spark.sparkContext.broadcast((tree, floor, sums["n"], sums["total"], width)), greedy, k, False)
        known = {r["item_id"]: r["score"] for r in seen.groupBy("item_id").agg(F.max("score").alias("score")).collect()}  # one row an item
        floor = np.array([known.get(i, 1) for i in tree.ids], np.int64)
        out = out.union(_searched(chunks, spark.sparkContext.broadcast((tree, floor, sums["n"], sums["total"], width)), dual, k, True))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
           FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, tot),
q AS (SELECT item_id, term, count(*) AS qtf
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id))
      GROUP BY ALL),
s AS (SELECT item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len USING (r), tot GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
