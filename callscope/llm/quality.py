"""Quality classifier: nearest-neighbour voting between latent-semantic vectors.

Texts become counts of character-shape runs (hashed) and a few measures of repetition and layout; a singular value
decomposition of a bounded labelled sample gives the latent space. The sample's vectors are broadcast, every document's
exact cosine with all of them is computed in blocks, and the nearest vote with their labels.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.shared import batch, slices, text_bytes, word_hashes
from callscope.session import small_batches

#: Labelled rows of each class that the classifier is fitted on, at most; the first by a hash of their id.
PER_CLASS = 2048
#: Hashed shape runs, latent dimensions, neighbours that vote, power of the similarity that weighs a vote.
HASHED, LATENT, NEIGHBOURS, POWER = 1024, 48, 25, 6
#: Documents of one block of cosine products.
ROWS = 256
#: Measures beside the shape runs, and their weight against them.
MEASURES, MEASURE_WEIGHT = 9, 0.6


def _classes() -> np.ndarray:
    """A class per byte: letters of either case, digits, blanks, line ends, and each ASCII sign by itself."""
    out = np.zeros(256, np.uint32)
    signs = iter(range(6, 64))
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if b < 32 or b == 127 else next(signs)
    return out


CLASS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """Shape-run counts and measures of each whole text, one row per text; null as empty."""
    data, offsets = text_bytes(texts)
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    cls = CLASS[data]

    # runs of one class count as two signs at most, so that a word's shape doesn't depend on its length
    keep = np.ones(len(cls), bool)
    keep[2:] = ~((cls[2:] == cls[1:-1]) & (cls[1:-1] == cls[:-2]) & (doc[2:] == doc[:-2]))
    c, d = cls[keep], doc[keep]
    code = (c[:-3] | c[1:-2] << np.uint32(6) | c[2:-1] << np.uint32(12) | c[3:] << np.uint32(18)) if len(c) > 3 else np.zeros(0, np.uint32)
    same = d[3:] == d[:-3]
    slot = (code * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
    counts = np.bincount((d[:-3] * HASHED + slot)[same] if len(c) > 3 else [], minlength=n * HASHED).reshape(n, HASHED)

    # words by hash: how often they repeat
    word, of, _ = word_hashes(texts)
    per = lambda index, weights=None: np.bincount(index, weights, minlength=n)
    total = np.maximum(per(of), 1)
    again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    _, first = np.unique(word ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    lines = per(doc[cls == 4]) + 1
    signs = np.maximum(size, 1)
    m = np.stack([
        np.log1p(per(of)), per(of[first]) / total, per(of[1:][again]) / total, np.log1p(size / total), per(doc[cls == 1]) / signs,
        per(doc[cls == 2]) / signs, per(doc[cls > 4]) / signs, np.log1p(total / lines), np.log(total / np.maximum(per(of[first]), 1)),
    ], axis=1)
    return np.concatenate([np.log1p(counts), m], axis=1).astype(np.float32)


@dataclass
class Model:
    """What a worker needs to score: weights of the features, the latent axes, and the labelled vectors."""

    idf: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float

    def weighted(self, x: np.ndarray) -> np.ndarray:
        runs = x[:, :HASHED] * self.idf
        runs /= np.maximum(np.linalg.norm(runs, axis=1, keepdims=True), 1e-9)
        return np.concatenate([runs, np.clip((x[:, HASHED:] - self.mean) / self.spread, -6, 6) * (MEASURE_WEIGHT / 3)], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        v = self.weighted(x) @ self.axes
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.labels) == 0:
            return np.full(len(x), self.prior)
        near = self.project(x) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** POWER * self.votes[top]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-30), self.prior)


def held_out(id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled documents of each class outside the held-out fold.

    Only text and label reach the model. Labels of one id are averaged, .5 counts as 1; null ids and labels are left out;
    of several texts of an id the least is taken. Votes are weighted back to the classes' shares among all labels.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    some = F.broadcast(drawn[0].unionAll(drawn[1]))  # 2 * per_class ids
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").join(some, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, 2, ROWS):
                yield batch(schema, doc_id=s.column(0), y=s.column(1), x=[r.tobytes() for r in features(s.column(2))])

    rows = sorted(texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, x binary").collect(), key=lambda r: r["doc_id"])
    total = sum(share.values())
    prior = share.get(1, 0) / total if total else 0.5
    y = np.array([r["y"] for r in rows], np.float64)
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), HASHED + MEASURES)
    if not len(rows):
        z = np.zeros(0)
        return Model(z, z, z, z, z, y, z, prior)
    idf = np.log((1 + len(x)) / (1 + (x[:, :HASHED] > 0).sum(axis=0))) + 0.1
    model = Model(idf.astype(np.float32), x[:, HASHED:].mean(axis=0), x[:, HASHED:].std(axis=0) + 1e-3, np.zeros(0), np.zeros(0), y, np.zeros(0), prior)
    w = model.weighted(x).astype(np.float64)
    _, axes = np.linalg.eigh(w.T @ w)
    model.axes = axes[:, ::-1][:, :LATENT].astype(np.float32)
    model.vectors = model.project(x)
    model.votes = np.array([share.get(int(c), 0) / max(1, int((y == c).sum())) for c in y])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the weighted share of label 1 among the nearest labelled vectors, 0 to 1, for every row.

    A null, empty or blank text scores 0: it holds nothing to keep. Repeated rows stay and score alike. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitted sample
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for s in slices(b, 1, ROWS):
                x = features(s.column(1))
                p = np.where(x[:, HASHED] > 0, np.clip(m.score(x), 0, 1), 0.0)
                yield batch(schema, doc_id=s.column(0), score=p)

    return docs.select(docs["doc_id"].cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    The score is computed beside the row, so no join on ids is needed and repeated ids are judged each by its text.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for s in slices(b, at_text, ROWS):
                x = features(s.column(at_text))
                yield s.filter(pa.array((x[:, HASHED] > 0) & (m.score(x) >= threshold)))

    return docs.mapInArrow(run, docs.schema)
