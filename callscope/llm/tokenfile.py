"""Token-id files: one wavelet matrix per shard of consecutive documents.

A shard is one row of a zstd Parquet file: for each bit of an id, from the highest, a bit-plane of the ids in the
order that stably sorting by the bits above gives, and the count of ones before every 512 bits. That answers access,
counting and occurrence lookup from the planes alone. Files follow ascending document ids; ``part`` numbers the files.
"""
from __future__ import annotations

import functools
import os
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.shared import batch, parts, slices

#: Bits that one entry of the rank directory covers.
BLOCK = 512
#: A shard is closed with the document that reaches so many ids.
SHARD_IDS = 1 << 20
#: Units kept per Python worker between batches.
KEPT_UNITS = 700_000
ROWS = 4096

SHARD = ("part int, shard int, before bigint, n_ids bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
         "zeros array<bigint>, planes array<binary>, ranks array<binary>")
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())),
                    ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


class WaveletMatrix:
    """Bit-planes of a sequence of unsigned ids with rank and select."""

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.levels, self.zeros, self._raw = n, len(planes), zeros, planes
        self._ranks = [np.frombuffer(r, "<u4").astype(np.int64) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, ranks, zeros, cur = [], [], [], ids
        for shift in range(levels - 1, -1, -1):
            one = (cur >> ids.dtype.type(shift)) & ids.dtype.type(1) != 0
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            sums = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes())
            low = cur[~one]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[one]])
        return cls(len(ids), planes, ranks, zeros)

    def row(self) -> dict:
        return {"n_ids": self.n, "zeros": self.zeros, "planes": self._raw, "ranks": [r.astype("<u4").tobytes() for r in self._ranks]}

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._raw[level], np.uint8), count=self.n, bitorder="little").astype(bool)

    def values(self) -> np.ndarray:
        """All ids in order: each plane says which half an id came from, from the last plane up."""
        cur = np.zeros(self.n, np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one, z = self._bits(level), self.zeros[level]
            up = np.empty_like(cur)
            up[~one] = cur[:z]
            up[one] = cur[z:] | np.uint32(1 << (self.levels - 1 - level))
            cur = up
        return cur

    def rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position, 0 <= position <= n."""
        at = np.asarray(at, np.int64)
        words = np.frombuffer(self._raw[level], "<u8").reshape(-1, BLOCK // 64)
        words = np.concatenate([words, np.zeros((1, BLOCK // 64), np.uint64)])
        block = at // BLOCK
        take = np.clip((at % BLOCK)[:, None] - 64 * np.arange(BLOCK // 64), 0, 64)
        mask = np.where(take == 64, np.uint64(2**64 - 1), (np.uint64(1) << (take % 64).astype(np.uint64)) - np.uint64(1))
        return self._ranks[level][block] + np.bitwise_count(words[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of that value in a plane."""
        ones = self._ranks[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = np.searchsorted(before, k, "right") - 1
        raw = np.frombuffer(self._raw[level], np.uint8).reshape(-1, BLOCK // 8)
        out = np.empty(len(k), np.int64)
        for lo in range(0, len(k), 4096):  # 4096 blocks are unpacked at a time
            b = block[lo:lo + 4096]
            bits = np.unpackbits(raw[b], axis=1, bitorder="little")
            hit = np.cumsum(bits if bit else 1 - bits, axis=1, dtype=np.int32) > (k[lo:lo + 4096] - before[b])[:, None]
            out[lo:lo + 4096] = b * BLOCK + hit.argmax(axis=1)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level in range(self.levels):
            ones = self.rank1(level, at)
            one = self.rank1(level, at + 1) > ones
            out = out << 1 | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int) -> tuple[int, int]:
        lo, hi = 0, self.n
        if token < 0 or token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            ones = self.rank1(level, np.array([lo, hi]))
            lo, hi = (self.zeros[level] + ones).tolist() if token >> (self.levels - 1 - level) & 1 else (int(lo - ones[0]), int(hi - ones[1]))
        return lo, hi

    def count(self, token: int) -> int:
        lo, hi = self._range(token)
        return hi - lo

    def locate(self, token: int) -> np.ndarray:
        """Ascending positions of a token."""
        at = np.arange(*self._range(token))
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return np.sort(at)


#: Trailing signs of a stretch that are looked up apart from it, as RE2 reads them.
_SIGNS = string.punctuation
_TAIL = r"^(?s:.*?)([!-/:-@\[-`{-~]*)$"


class LibraryUnits:
    """Encodes through the tokenizers library, each stretch between spaces once while it is kept.

    For a vocabulary that lower-cases, splits text at white space and into runs of letters and of other signs, so that no
    token spans two of them, and marks the last token of each run. A stretch is looked up as its core and the signs behind
    it. New cores of letters go to the library together, and the marks cut the answer; others go with a special token in
    between. Texts with a core that may not be cut so (normalizing could join it to the signs) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab(False).items() if suffix and t.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}

    def _call(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _letters(self, words: list[str]) -> None:
        """Words of letters alone: one marked token each, unless normalizing adds a sign, which the count shows."""
        for at in range(0, len(words), 2000):
            some = words[at:at + 2000]
            ids = self._call(" ".join(some))
            cuts = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            if len(cuts) != len(some) + 1:
                self._others(some)
                continue
            raw, w = ids.tobytes(), ids.itemsize
            self.words.update((u, raw[a * w:b * w]) for u, a, b in zip(some, cuts, cuts[1:]))

    def _others(self, units: list[str]) -> None:
        mark, cut = next(iter(self.special.items()), (None, None))
        for u in units:
            if mark is None or "<" in u:  # may hold a special token itself
                self.words[u] = self._call(u).tobytes()
        together = [u for u in units if mark is not None and "<" not in u]
        for at in range(0, len(together), 2000):
            some = together[at:at + 2000]
            ids = self._call(mark.join(some))
            ends, start = [*np.flatnonzero(ids == cut).tolist(), len(ids)], 0
            for u, end in zip(some, ends, strict=True):
                self.words[u] = ids[start:end].tobytes()
                start = end + 1

    def _look_up(self, units: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_UNITS:
            self.words.clear()
        found = list(map(self.words.get, units))
        if new := [u for u, f in zip(units, found) if f is None]:
            self._letters([u for u in new if u.isalpha()])
            self._others([u for u in new if not u.isalpha()])
            found = list(map(self.words.__getitem__, units))
        return found

    @staticmethod
    def _uncuttable(core: str) -> bool:
        if core.isascii():
            return "<|" in core or bool(core) and not core[-1].isalnum()
        return not core.lower().isalpha() or not unicodedata.is_normalized("NFC", core)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, null as empty; texts of one call are looked up by their distinct stretches."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        units = lists.flatten().dictionary_encode()
        cores = pc.ascii_lower(pc.ascii_rtrim(units.dictionary, characters=_SIGNS)).dictionary_encode()
        tails = pc.replace_substring_regex(units.dictionary, _TAIL, r"\1").dictionary_encode()
        core = cores.dictionary.to_pylist()
        pieces = self._look_up(core + tails.dictionary.to_pylist())

        def gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Runs of ``flat`` in order of ``index``, and their sizes."""
            take = sizes[index]
            at = np.cumsum(take) - take
            start = np.cumsum(sizes) - sizes
            return flat[np.repeat(start[index] - at, take) + np.arange(take.sum())], take

        flat = np.frombuffer(b"".join(pieces), self.width)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // flat.itemsize
        halves = np.stack([cores.indices.to_numpy(), tails.indices.to_numpy() + len(core)], axis=1).ravel()
        flat, half = gather(flat, sizes, halves)
        unit = units.indices.to_numpy()
        ids, take = gather(flat, half.reshape(-1, 2).sum(axis=1), unit)
        offsets = lists.offsets.to_numpy()
        cuts = np.concatenate([[0], np.cumsum(take)])[offsets - offsets[0]].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        odd = np.fromiter((self._uncuttable(c) for c in core), bool, len(core))
        if odd.any():
            hit = np.concatenate([[0], np.cumsum(odd[cores.indices.to_numpy()][unit])])[offsets - offsets[0]]
            for i in np.flatnonzero(np.diff(hit)).tolist():
                out[i] = self._call(texts[i].as_py()).tobytes()
        return out


@functools.lru_cache(2)
def library_units(path: str) -> LibraryUnits:
    return LibraryUnits(path)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", id: str = "doc_id", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id`` to each and write the shards below ``path``.

    One shuffle, of ids: cut points come from quantiles of the document ids, so texts are read once and encoded where
    they are read. A null or empty text holds the end id alone; null document ids come first; rows with equal ids stay
    and are ordered by their ids' bytes. A shard holds ``shard_ids`` ids and the rest of its last document.
    """
    n = parts(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(docs[id], [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    cuts = sorted(set(cuts or []))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = library_units(vocabulary)
        end = np.array([end_id], units.width).tobytes()
        for b in batches:
            for s in slices(b, 1, ROWS, 12 << 20):
                keys = s.column(0).to_pylist()
                part = [0 if k is None else int(np.searchsorted(cuts, k, "left")) for k in keys]
                yield batch(schema, part=part, doc_id=keys, ids=[i + end for i in units.encode(s.column(1))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = library_units(vocabulary)
        levels = max(1, max(units.library.get_vocab_size() - 1, end_id).bit_length())
        part, shard, before, held, raw, keys = -1, 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal shard, before, held, raw, keys
            sizes = [len(r) // np.dtype(units.width).itemsize for r in raw]
            m = WaveletMatrix.build(np.frombuffer(b"".join(raw), units.width), levels)
            row = {"part": part, "shard": shard, "before": before, "doc_ids": keys, "doc_tokens": sizes, **m.row()}
            shard, before, held, raw, keys = shard + 1, before + m.n, 0, [], []
            return batch(_SHARD, **{k: [v] for k, v in row.items()})

        for b in batches:
            for p, key, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if raw:
                        yield close()
                    part, shard, before = p, 0, 0
                raw.append(ids)
                keys.append(key)
                held += len(ids) // np.dtype(units.width).itemsize
                if held >= shard_ids:
                    yield close()
        if raw:
            yield close()

    rows = docs.select(docs[id].cast("bigint"), docs[text]).mapInArrow(encode, "part int, doc_id bigint, ids binary")
    dealt = rows.repartitionById(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(build, SHARD).write.option("compression", "zstd").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards with the number of ids in all files before theirs: one row per file is summed up."""
    s = spark.read.schema(SHARD).parquet(path)
    files = s.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return s.join(F.broadcast(earlier), "part")  # one row per file


def _matrix(r: dict) -> WaveletMatrix:
    return WaveletMatrix(r["n_ids"], r["planes"], r["ranks"], r["zeros"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids, read from the planes, as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                ids = _matrix(r).values().astype("<u4")
                ends = np.cumsum(r["doc_tokens"])
                starts = ends - r["doc_tokens"]
                yield batch(schema, doc_id=r["doc_ids"], start=(starts + r["base"] + r["before"]).tolist(),
                            ids=[ids[s:e].tobytes() for s, e in zip(starts, ends)])

    return _shards(spark, path).mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, shard, n): occurrences of one id in each shard, by rank alone."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                yield batch(schema, part=[r["part"]], shard=[r["shard"]], n=[_matrix(r).count(token)])

    return _shards(spark, path).mapInArrow(run, "part int, shard int, n bigint")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position, offset): each occurrence of an id, in the whole sequence and in its document."""
    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                at, ends = _matrix(r).locate(token), np.cumsum(r["doc_tokens"])
                doc = np.searchsorted(ends, at, "right")
                yield batch(schema, doc_id=[r["doc_ids"][d] for d in doc], position=(at + r["base"] + r["before"]).tolist(),
                            offset=(at - (ends - r["doc_tokens"])[doc]).tolist())

    return _shards(spark, path).mapInArrow(run, "doc_id bigint, position bigint, offset bigint")


def tokens_at(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(position, token) for low <= position < high: random access; shards outside are not opened."""
    schema = pa.schema([("position", pa.int64()), ("token", pa.int64())])
    first: Column = F.col("base") + F.col("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                base = r["base"] + r["before"]
                at = np.arange(max(low, base), min(high, base + r["n_ids"]))
                yield batch(schema, position=at.tolist(), token=_matrix(r).access(at - base).tolist())

    return _shards(spark, path).where((first < high) & (first + F.col("n_ids") > low)).mapInArrow(run, "position bigint, token bigint")
