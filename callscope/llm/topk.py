"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block, in each round. A round counts scores in bins of one width;
the bins' global sums show in which one each query's k-th score lies, and the next round refines that bin. When bins are
one score wide the k-th value is known: a last pass keeps what lies above it and fills up with the smallest ids among its
ties. Scores themselves are never stored or shuffled.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.shared import parts
from callscope.session import cut_lineage

#: Rows of a block of candidates and of queries: one task holds their products.
CANDIDATES, QUERIES = 2048, 1024
#: Bins of a round.
BINS = 1024
#: What is wanted of a query with fewer than k candidates: all of them.
ALL = 1 << 40


def whole_vectors(df: DataFrame, id: str, vector: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors null, empty, or with a null or non-finite component are left out."""
    x = F.transform(df[vector], lambda c: c.cast("double"))
    rows = df.select(df[id].cast("bigint").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(sound).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _packed(rows: DataFrame, most: int, sizes: DataFrame, count: str) -> DataFrame:
    """(dim, block, ids, mat): about ``most`` vectors of one length in a row, as a matrix of 64-bit integers."""
    def pack(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        mat = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.table({"dim": t.column("dim")[:1], "block": t.column("block")[:1], "ids": pa.array([ids[order].tolist()], pa.list_(pa.int64())),
                         "mat": pa.array([np.ascontiguousarray(mat).tobytes()], pa.binary())})

    dealt = rows.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col(count) / most)).cast("int"))
    return cut_lineage(dealt.select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids array<bigint>, mat binary"))


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(n, -1)


def _scores(q: dict, c: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner products, exact: in floating point while no partial sum can pass 2**53, else in integers."""
    qi, ci = np.array(q["ids"]), np.array(c["ids"])
    a, b = _matrix(q["mat"], len(qi)), _matrix(c["mat"], len(ci))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        s = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    else:
        s = a @ b.T
    return s, qi, ci


def _pairs(cand: DataFrame, quer: DataFrame, sizes: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Run ``work`` on every pair of a query block and a candidate block of one length; each pair is a group of two rows."""
    n = parts(cand.sparkSession)
    up_to = lambda count, most: F.sequence(F.lit(0), F.ceil(F.col(count) / most).cast("int") - 1)
    c = cand.join(sizes, "dim").select("dim", F.col("block").alias("cb"), F.explode(up_to("queries", QUERIES)).alias("qb"), F.lit(1).alias("side"),
                                       "ids", "mat", F.lit(None).cast("array<bigint>").alias("low"), F.lit(None).cast("array<bigint>").alias("need"))
    q = quer.join(sizes, "dim").select("dim", F.explode(up_to("rows", CANDIDATES)).alias("cb"), F.col("block").alias("qb"), F.lit(0).alias("side"),
                                       "ids", "mat", "low", "need")

    def run(t: pa.Table) -> pa.Table:
        sides = {r["side"]: r for r in t.to_pylist()}
        return work(sides.get(0), sides.get(1))

    return c.unionByName(q).repartition(n, "dim", "cb", "qb").groupBy("dim", "cb", "qb").applyInArrow(run, schema)


def _histogram(width: int) -> Callable:
    def work(q: dict | None, c: dict | None) -> pa.Table:
        """Bins from the top down to where the block alone holds what is wanted: the k-th score can't lie lower."""
        ids, bins, counts = [], [], []
        if q and c:
            s, qi, ci = _scores(q, c)
            at = (s - np.array(q["low"])[:, None]) // width
            at[(at < 0) | (at >= BINS) | (qi[:, None] == ci[None, :])] = BINS
            n = np.bincount((at + np.arange(len(qi))[:, None] * (BINS + 1)).ravel(), minlength=len(qi) * (BINS + 1)).reshape(len(qi), -1)[:, :BINS]
            above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
            row, b = np.nonzero((n > 0) & (above < np.array(q["need"])[:, None]))
            ids, bins, counts = qi[row], b, n[row, b]
        return pa.table({"id": pa.array(ids, pa.int64()), "bin": pa.array(bins, pa.int64()), "n": pa.array(counts, pa.int64())})
    return work


def _winners(q: dict | None, c: dict | None) -> pa.Table:
    out: Iterator = ([], [], [])
    if q and c:
        s, qi, ci = _scores(q, c)
        low, need = np.array(q["low"])[:, None], np.array(q["need"])[:, None]
        other = qi[:, None] != ci[None, :]
        tie = (s == low) & other
        # candidates are in order of id, so the first ties of a block are its smallest
        row, col = np.nonzero(((s > low) & other) | (tie & (np.cumsum(tie, axis=1) <= need)))
        out = (qi[row], ci[col], s[row, col])
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("query_id", "vec_id", "score"), out)})


def top_k(df: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of another id. Vectors of different
    lengths have no product and are not compared. A query without candidates has no rows; repeated ids stay candidates
    each for itself, and of a repeated query's vectors the least asks. Sums must stay below 2**63.
    """
    rows = cut_lineage(whole_vectors(df, id, vector).withColumn("dim", F.size("v")))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    sizes = cut_lineage(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows")).join(asked.groupBy("dim").agg(F.count(F.lit(1)).alias("queries")), "dim"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = F.sqrt(F.max(square))
    bound = int((rows.agg(longest.alias("n")).first()["n"] or 0.0) * (asked.agg(longest.alias("n")).first()["n"] or 0.0)) + 2
    cand, quer = _packed(rows, CANDIDATES, sizes, "rows"), _packed(asked, QUERIES, sizes, "queries")

    width = 1
    while BINS * width < 2 * bound + 1:
        width *= BINS
    state = quer.select("dim", "block", F.explode("ids").alias("id"), F.lit(-bound).cast("bigint").alias("low"), F.lit(k).cast("bigint").alias("need"))

    def held(state: DataFrame) -> DataFrame:
        """Query blocks with their queries' bounds, in order of id as the matrix is."""
        packed = state.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "low", "need"))).alias("s"))  # QUERIES entries
        return quer.join(packed, ["dim", "block"]).select("dim", "block", "ids", "mat", F.col("s.low").alias("low"), F.col("s.need").alias("need"))

    while True:
        found = _pairs(cand, held(state), sizes, _histogram(width), "id bigint, bin bigint, n bigint")
        sums = found.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.col("bin").desc())
        upto = sums.withColumn("upto", F.sum("n").over(down)).join(state, "id")
        hit = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select(
            "id", "bin", (F.col("need") - F.col("upto") + F.col("n")).alias("ties"))
        state = cut_lineage(state.join(hit, "id", "left").select(
            "dim", "block", "id", F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.col("low") + F.col("bin") * width).alias("low"),
            F.coalesce("ties", F.lit(ALL)).alias("need")))
        if width == 1:
            break
        width //= BINS

    best = _pairs(cand, held(state), sizes, _winners, "query_id bigint, vec_id bigint, score bigint")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
