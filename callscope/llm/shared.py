"""Small helpers of the operators: tables, words, partition counts, Arrow columns."""
from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.lookup import salted_join  # noqa: F401  the operators take it from here
from callscope.operators.ranking import running_totals
from callscope.session import cut_lineage

#: ASCII white space: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle that this library deals out itself."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The runs ``[^\\x20\\x09-\\x0D]+`` of a text; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def comparable(df: DataFrame) -> list[Column]:
    """All columns of ``df`` in a form that can be hashed and ordered: what holds a map as its JSON text."""
    return [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once where ``then`` uses it often: a lambda computes again what it names by an expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingle_hashes(word_list: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the runs of ``size`` words; fewer words count as one run, none as no run."""
    def runs(w: Column) -> Column:
        n = F.size(w)
        full = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.array_distinct(F.when(n >= size, full).when(n > 0, F.array(F.xxhash64(w, F.lit("short"))))
                                .otherwise(F.array().cast("array<bigint>")))
    return let(word_list, runs)


#: Bits of the filter of ``likely``, in rows of 4 KB.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15


def likely(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key may be among ``keys``, without a shuffle: 2^26 bits are broadcast, 8 MB however many keys there are.

    More keys let more other rows through and lose none, so a join with the keys has to follow. Rows without a key go.
    """
    bit, names = F.pmod(F.xxhash64(on), F.lit(FILTER_BITS)), [F.col(f"`{c}`") for c in rows.columns]
    row, at, bits = unused(rows, "_row", "_at", "_bits")
    split = {row: F.shiftright(bit, 15), at: F.pmod(bit, F.lit(FILTER_ROW)).cast("int")}
    held = keys.where(F.col(on).isNotNull()).select(*[c.alias(k) for k, c in split.items()]).groupBy(row).agg(F.bitmap_construct_agg(at).alias(bits))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.where(F.col(on).isNotNull()).withColumns(split).join(F.broadcast(held), row)
            .where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*names))


def text_list(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_MIXED = np.where(_BLANK, np.uint64(0), _MIX)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and where each begins and the last ends; null as empty."""
    arr = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """A 64-bit hash of every word of every text in order, the text each is of, and the number of texts."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    blank = _BLANK[data]
    begin = ~blank
    begin[1:] &= blank[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begin[edge] = ~blank[edge]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n
    # a byte weighs its odd number within the word: its number within the column, less twice the word's start
    value = _MIXED[data]
    whole = np.add.reduceat(value, starts)
    value *= np.arange(1, 2 * len(data), 2, dtype=np.uint64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return np.add.reduceat(value, starts) - 2 * starts.astype(np.uint64) * whole, doc, n


def slices(b: pa.RecordBatch, column: int, rows: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``rows`` rows and ``size`` bytes of one text column, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))))
        yield b.slice(at, end - at)
        at = end


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


@functools.cache
def public_vocabulary(name: str) -> str:
    """Path of a vocabulary file that is installed beside the tokenizer libraries."""
    import public_tokenizers
    return public_tokenizers.path(name)


#: Bytes of ``[0-9A-Za-z]`` lower-cased and those of all other characters beyond ASCII; the rest separates terms.
_TERM_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def term_pieces(text: str, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in lists of about ``size`` bytes: A-Z lower-cased, cut at ASCII signs, blanks and controls."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last character of each term of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(raw.tobytes().translate(_TERM_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return upto[np.flatnonzero(edge == 1)], upto[np.flatnonzero(edge == -1)]


def bounded_batches(rows: DataFrame, order: list[str], weight: Column, bound: int) -> list[DataFrame]:
    """Rows in batches whose weights sum to at most ``bound`` and one row's own, so that each may be broadcast."""
    dealt = cut_lineage(running_totals(rows.withColumn("_one", F.lit(1)).withColumn("_weight", weight.cast("bigint")), ["_one"], order, {"_upto": "_weight"}))
    number = F.floor((F.col("_upto") - F.col("_weight")) / bound)
    numbers = sorted(int(r["n"]) for r in dealt.select(number.alias("n")).distinct().collect())  # one row a batch
    names = [F.col(f"`{c}`") for c in rows.columns]
    return [dealt.where(number == k).select(*names) for k in numbers]
