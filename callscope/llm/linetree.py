"""Line deduplication by a log-template tree of fixed depth.

Lines are sorted into leaves by their number of tokens and their leading tokens; tokens with digits are variable. In a
leaf, a token that recurs at its position in enough documents is constant and any other variable, which generalises the
lines to templates without an order among them. Templates that recur across independent documents are dropped. A line too
long to be chance is dropped as it stands from two independent documents on.

Copies of a document are no independent sightings of its lines: every text counts as one over the size of its group of
near copies, at the resemblance at which the Jaccard join of the pipeline drops them. So a group of copies keeps its lines
for that join, and what recurs in documents that it leaves goes here. Candidates for that share a band of minimum hashes and
are compared exactly; two texts of resemblance 0.8 share no band once in about 14,000 pairs. ``exact`` takes the candidates of
the Jaccard join instead, which misses none.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.jaccard import linked_classes, near_components
from callscope.llm.shared import ascii_lower, batch, likely, salted_join, shingle_hashes, slices, text_list, unused, word_hashes, words
from callscope.session import cut_lineage, small_batches

#: Leading tokens that name a leaf.
DEPTH = 3
#: Independent sightings that make a template recur. Their share of the texts that hold it does not matter.
SIGHTINGS = 4.0
#: Tokens without digits from which a line is long, and the independent sightings that make it recur as it stands.
LONG, LONG_SIGHTINGS = 20, 2.0
#: Share of constant tokens, among those behind the leaf's own, below which a line is not generalised.
CONSTANT = 0.6
#: Texts are near copies where the Jaccard join links them: NEAR_DEN * |both| >= NEAR_NUM * |either| over ``SHINGLE`` words.
NEAR_NUM, NEAR_DEN = 4, 5
#: Sums of weights are compared with a bar less this: thirds add up to a little less than one.
ROUNDING = 1e-9
#: Words of a shingle.
SHINGLE = 5
#: Bands of minimum hashes and the minima of each: (1 - 0.8 ** 5) ** 24 of the pairs at the threshold share no band.
BANDS, WIDE = 24, 5
#: Tasks among which the rows of one text are dealt.
SALTS = 8
ROWS = 512

_DIGIT = regex.compile(r"\p{N}")
VARIABLE = "<*>"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def masked_tokens(line: str) -> list[str]:
    """Tokens of a line; those that hold a digit are variable, unless so few others are left that they are the line."""
    tokens = line.split()
    if not _DIGIT.search(line):
        return tokens
    masked = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return masked if masked.count(VARIABLE) <= (1 - CONSTANT) * len(tokens) else tokens


def line_keys(text: str) -> tuple[list[int | None], list[int | None], list[bool]]:
    """Leaf and masked hash of each line, and whether it is long; blank lines have no hashes."""
    leaves, masks, longs = [], [], []
    for line in text.split("\n"):
        tokens = masked_tokens(line)
        leaves.append(_hash(f"{len(tokens)} " + " ".join(tokens[:DEPTH])) if tokens else None)
        masks.append(_hash(" ".join(tokens)) if tokens else None)
        longs.append(len(tokens) - tokens.count(VARIABLE) >= LONG)
    return leaves, masks, longs


_FACTORS = np.random.default_rng(23).integers(1, 2**63, BANDS * WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(29).integers(1, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(x: np.ndarray) -> np.ndarray:
    """A second hash, so that sums and products of hashes are spread again."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def set_bands(texts: pa.Array) -> tuple[list[int], list[list[int]]]:
    """Distinct shingles of each text, A-Z lower-cased, and a hash of each band of their minima; a text without words has neither."""
    value, owner, n = word_hashes(pc.ascii_lower(texts))
    sizes, bands = np.zeros(n, np.int64), [[] for _ in range(n)]
    if not len(value):
        return sizes.tolist(), bands
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    # a shingle begins at each word that has enough behind it, or at the first word of a text of fewer
    place = np.arange(len(value)) - first[owner]
    at = np.flatnonzero((place + SHINGLE <= count[owner]) | ((place == 0) & (count[owner] < SHINGLE)))
    doc, value, grams = owner[at], _spread(value), np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        inside = place[at] + k < count[doc]
        grams[inside] += _spread(value[at[inside] + k] * _PLACES[k])
    grams = _spread(grams)
    # the upper bits name the text, so one sort of plain numbers counts all texts' distinct shingles
    low = np.uint64(64 - n.bit_length())
    told = np.sort((doc.astype(np.uint64) << low) | (grams >> np.uint64(n.bit_length())))
    once = np.concatenate([[True], told[1:] != told[:-1]])
    sizes = np.bincount((told[once] >> low).astype(np.int64), minlength=n)
    held = np.flatnonzero(count)
    starts = np.searchsorted(doc, held)
    out, product = np.zeros((len(held), BANDS), np.uint64), np.empty_like(grams)
    for k, factor in enumerate(_FACTORS):
        out[:, k // WIDE] = _spread(out[:, k // WIDE] + np.minimum.reduceat(np.multiply(grams, factor, out=product), starts) + np.uint64(k))
    for d, row in zip(held.tolist(), out.view(np.int64).tolist(), strict=True):
        bands[d] = row
    return sizes.tolist(), bands


def _described(texts: DataFrame) -> DataFrame:
    """(th, leaves, masks, longs, n, bands) of each distinct text; ``th`` is a hash of the text."""
    lists = ("leaves", "masks", "bands")
    schema = pa.schema([("th", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in lists), ("longs", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, 1, ROWS):
                keys = [line_keys(t) for t in text_list(s.column(1))]
                sizes, bands = set_bands(s.column(1))
                yield batch(schema, th=s.column(0), n=sizes, leaves=[k[0] for k in keys], masks=[k[1] for k in keys], longs=[k[2] for k in keys], bands=bands)

    rows = texts.mapInArrow(run, "th bigint, n bigint, leaves array<bigint>, masks array<bigint>, bands array<bigint>, longs array<boolean>")
    return cut_lineage(rows.groupBy("th").agg(*[F.first(c).alias(c) for c in ("n", "leaves", "masks", "bands", "longs")]))


def _once(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, text) of the distinct texts that may be wanted; copies are one before they are sent."""
    return likely(texts, wanted, "th").groupBy("th").agg(F.first("text").alias("text"))


def _groups(texts: DataFrame, described: DataFrame, exact: bool) -> DataFrame:
    """(th, group) of the distinct texts that a link of near copies reaches."""
    if exact:
        near = near_components(texts, size=SHINGLE, num=NEAR_NUM, den=NEAR_DEN, id="th")
        return near.select(F.col("doc_id").alias("th"), F.col("component_id").alias("group")).distinct()
    each = described.select("th", F.posexplode("bands").alias("band", "value"))
    # a value that several texts have ties each to the least of them
    least = each.groupBy("band", "value").agg(F.min("th").alias("low"), F.max("th").alias("high")).where("low < high").drop("high")
    ties = salted_join(each, least, ["band", "value"], "th").where("th <> low").select(F.col("th").alias("a"), F.col("low").alias("b"))
    reps = described.where("n > 0").select(F.col("th").alias("node"), F.col("th").alias("id"), "th", "n")
    ties = cut_lineage(ties.distinct())
    plain = _once(texts, ties.select(F.explode(F.array("a", "b")).alias("th"))).select(F.col("th").alias("id"), "th", "text")
    grams = shingle_hashes(words(ascii_lower(F.col("text"))), SHINGLE)
    return linked_classes(plain, reps, ties, grams, NEAR_NUM, NEAR_DEN).select(F.col("node").alias("th"), F.col("class").alias("group"))


def _weights(texts: DataFrame, described: DataFrame, exact: bool = False) -> DataFrame:
    """(th, w) of each distinct text: one over the texts of its component of near copies."""
    each = cut_lineage(_groups(texts, described, exact))
    many = each.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = salted_join(each, many, ["group"], "th").select("th", (1.0 / F.col("n")).alias("w"))
    return described.select("th").join(copies, "th", "left").select("th", F.coalesce("w", F.lit(1.0)).alias("w"))


def _tokens(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(leaf, mask, tokens) of the lines wanted; each is read from the one text that ``wanted`` names for it."""
    schema = pa.schema([("th", pa.int64()), ("leaf", pa.int64()), ("mask", pa.int64()), ("tokens", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for th, text, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines, seen = text.split("\n"), {}
                for leaf, mask, _, line in zip(*line_keys(text), lines, strict=True):
                    if mask in want and mask not in seen:
                        seen[mask] = (leaf, masked_tokens(line))
                yield batch(schema, th=[th] * len(seen), leaf=[v[0] for v in seen.values()], mask=list(seen), tokens=[v[1] for v in seen.values()])

    want = cut_lineage(wanted.groupBy("th").agg(F.collect_list("mask").alias("want")))  # lines of one text
    found = _once(texts, want).join(want, "th").select("th", "text", "want").mapInArrow(run, "th bigint, leaf bigint, mask bigint, tokens array<string>")
    return found.groupBy("leaf", "mask").agg(F.first("tokens").alias("tokens"))


def recurring_lines(docs: DataFrame, text: str = "text", sightings: float = SIGHTINGS, long_sightings: float = LONG_SIGHTINGS, exact: bool = False) -> DataFrame:
    """(th, drop): numbers of the lines of each distinct text whose template recurs; ``th`` is xxhash64 of the text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(docs[text]).alias("th"), docs[text].alias("text")).where(docs[text].isNotNull())
    described = _described(texts)
    w = cut_lineage(_weights(texts, described, exact))
    lines = described.select("th", F.explode(F.array_distinct(F.arrays_zip(F.col("leaves").alias("leaf"), F.col("masks").alias("mask"), F.col("longs").alias("long")))).alias("l"))
    lines = cut_lineage(lines.select("th", "l.leaf", "l.mask", "l.long").where("mask IS NOT NULL").join(w, "th"))

    long = lines.where("long").select("th", "mask", "w")
    whole = long.groupBy("mask").agg(F.sum("w").alias("s")).where(F.col("s") >= long_sightings - ROUNDING).select("mask")
    repeated = salted_join(long, whole, ["mask"], "th").select("th", "mask")

    # leaves first: one that fewer documents reach holds no recurring template
    alive = lines.select("th", "leaf", "w").distinct().groupBy("leaf").agg(F.sum("w").alias("s")).where(F.col("s") >= sightings - ROUNDING).select("leaf")
    lines = cut_lineage(salted_join(lines, alive, ["leaf"], "th"))
    known = lines.groupBy("leaf", "mask").agg(F.sum("w").alias("s"), F.min("th").alias("th"))
    told = cut_lineage(_tokens(texts, known.select("th", "mask")).join(known.drop("th"), ["leaf", "mask"]))

    # a token is constant where it recurs at its position of the leaf; the leaf's own recur as often as the leaf does
    behind = told.select("leaf", "mask", "s", (F.size("tokens") - DEPTH).alias("of"),
                         F.posexplode(F.slice("tokens", F.lit(DEPTH + 1), F.greatest(F.size("tokens") - DEPTH, F.lit(0)))).alias("at", "token")).where(F.col("token") != VARIABLE)
    firm = behind.groupBy("leaf", "at", "token").agg(F.sum("s").alias("sum")).where(F.col("sum") >= sightings - ROUNDING).drop("sum")
    general = salted_join(behind, firm, ["leaf", "at", "token"], "mask").groupBy("leaf", "mask").agg(
        F.sort_array(F.collect_list(F.struct("at", "token"))).alias("t"), F.max("of").alias("of")).where(F.size("t") / F.col("of") >= CONSTANT)
    template = F.when(F.col("t").isNotNull(), F.xxhash64("leaf", "t")).otherwise(F.xxhash64("leaf", "mask", F.lit("itself")))
    named = cut_lineage(told.select("leaf", "mask").join(general, ["leaf", "mask"], "left").select("leaf", "mask", template.alias("template")))

    seen = salted_join(lines, named, ["leaf", "mask"], "th")
    drop = (seen.select("th", "template", "w").distinct().groupBy("template").agg(F.sum("w").alias("s"))
            .where(F.col("s") >= sightings - ROUNDING).select("template"))
    gone = salted_join(seen, drop, ["template"], "th").select("th", "mask").union(repeated).groupBy("th").agg(F.collect_set("mask").alias("gone"))  # lines of one text
    at = F.filter(F.sequence(F.lit(0), F.size("masks") - 1), lambda i: F.array_contains("gone", F.get("masks", i)))
    return described.join(gone, "th").select("th", at.alias("drop"))


def drop_lines(docs: DataFrame, text: str = "text", **options: float) -> DataFrame:
    """``docs`` with its recurring lines taken out, and n_lines and n_dropped beside.

    Lines end with a line feed; blank lines stay. A null text stays null with 0 lines; a text of recurring lines alone
    becomes empty. Equal texts lose equal lines; other columns are kept as they are, but for the two names added. An empty
    table stays empty; very long texts are read whole, in batches of their own.
    """
    th, drop, salt = unused(docs, "_th", "_drop", "_salt")
    cut = recurring_lines(docs, text, **options).withColumnRenamed("th", th).withColumnRenamed("drop", drop)
    # rows of one text, and those without one, are dealt out by the part they lie in
    cut = cut.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = docs.withColumn(th, F.xxhash64(docs[text])).withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(cut, [th, salt], "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[F.when(F.col(drop).isNull() | F.col(text).isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in others],
                         F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
                         F.when(F.col(text).isNull(), 0).otherwise(F.coalesce(F.size(drop), F.lit(0))).cast("bigint").alias("n_dropped"))
