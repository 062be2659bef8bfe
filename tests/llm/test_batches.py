import numpy as np
import pyarrow as pa

from callscope.llm import linetree, quality, shared
from callscope.session import small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def seen(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])
    wide = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('x', 4000) AS text")
    return [tuple(r) for r in wide.mapInArrow(run, "n long, size long").collect()]


def test_batches_of_wide_rows_are_bounded_by_bytes(spark):
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.unset(KEY)
        docs = spark.createDataFrame([(1, "a b c"), (4, "d e f")], "doc_id long, text string")
        quality.keep_good(docs, spark.createDataFrame([(1, 1.0), (4, 0.0)], "doc_id long, quality double"))
        got = seen(spark)
        assert sum(n for n, _ in got) == 6000 and max(size for _, size in got) < 6 << 20
        spark.conf.set(KEY, "1m")  # a bound that the session names stays
        small_batches(spark)
        assert spark.conf.get(KEY) == "1m"
    finally:
        spark.conf.set(KEY, before) if before is not None else spark.conf.unset(KEY)


def test_word_hashes_are_sums_over_the_bytes_of_a_word():
    texts = ["", None, " a", "a", "b c\n\x0bdé", " ", "\n", "x", "y  zz zz", None, "ß"]
    want, of = [], []
    for k, text in enumerate(texts):
        for word in (text or "").encode().replace(b"\x0b", b" ").split():
            want.append(sum(int(shared._MIX[c]) * (2 * i + 1) for i, c in enumerate(word)) % 2**64)
            of.append(k)
    value, owner, n = shared.word_hashes(pa.array(texts))
    assert (value.tolist(), owner.tolist(), n) == (want, of, len(texts))
    value, owner, n = shared.word_hashes(pa.array(["u v", *texts, "w"]).slice(1, len(texts)))
    assert (value.tolist(), owner.tolist(), n) == (want, of, len(texts))


def test_set_bands_counts_distinct_shingles_of_each_text():
    rng = np.random.default_rng(5)
    texts = [None, "", *[" ".join(rng.choice(list("abc"), k)) for k in (1, 4, 5, 6, 60, 400)], "same same same same same same same"]

    def count(text):
        w = (text or "").split()
        return len({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0
    sizes, bands = linetree.set_bands(pa.array(texts))
    assert sizes == [count(t) for t in texts]
    assert [len(b) for b in bands] == [linetree.BANDS if (t or "").split() else 0 for t in texts]
