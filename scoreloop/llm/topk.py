"""Exact inner-product search over vectors in the order of their lengths.

Vectors become integers first, so scores are exact. They are sorted by falling length
and cut into blocks; queries are cut into blocks as well. Every query meets the block of
the longest vectors first, which gives it a bound: its k-th score so far. Against any
other block,

* a query whose length times the block's greatest length stays below the bound is done;
* else, inner products are summed along rotated axes that carry most of the length first
  (from the singular vectors of the corpus). What the axes still to come can add is at
  most the product of the two residual lengths (Cauchy-Schwarz); pairs that cannot reach
  the bound are dropped after each step;
* the pairs that remain are scored exactly, on the integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import stored
from scoreloop.llm.vectors import numbered, packed, principal_axes, usable

BLOCK_ROWS, QUERY_ROWS = 1024, 256
# Shares of the axes after which pairs are tested.
STEPS = (0.125, 0.25, 0.5)
# Integers up to here are exact in double precision.
EXACT = 2.0**53


def _exact(q: np.ndarray, x: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly; 0 where a pair is not asked for."""
    if np.sqrt((q * q).sum(1)).max(initial=0) * np.sqrt((x * x).sum(1)).max(initial=0) < EXACT / 2:
        return np.where(asked, q @ x.T, 0).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    found = np.where(asked, whole(q) @ whole(x).T, 0)
    if any(abs(v) >= 1 << 63 for v in found.ravel()):
        raise OverflowError("a score does not fit into 64 bits")
    return found.astype(np.int64)


def block_hits(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, bound: np.ndarray, axes: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query row, vector row, score)``: per query the k best of this block that reach its bound.

    Ties go to the smaller id; a query's own id is left out.
    """
    q_len, x_len = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    # The margin covers the rounding of rotated sums, so pruning never drops a hit.
    slack = 1e-9 * q_len * x_len.max(initial=0) + 1e-9
    rows = np.flatnonzero(q_len * x_len.max(initial=0) + slack >= bound)
    if not len(rows) or not len(x):
        return []
    q_turned, x_turned = q[rows] @ axes, x @ axes
    width = axes.shape[1]
    alive = q_len[rows, None] * x_len[None, :] + slack[rows, None] >= bound[rows, None]
    alive &= x_ids[None, :] != q_ids[rows, None]
    partial, done = np.zeros(alive.shape), 0
    for share in STEPS:
        upto = max(1, int(width * share))
        if upto <= done:
            continue
        partial += q_turned[:, done:upto] @ x_turned[:, done:upto].T
        done = upto
        q_rest = np.sqrt((q_turned[:, done:] ** 2).sum(1))
        x_rest = np.sqrt((x_turned[:, done:] ** 2).sum(1))
        alive &= partial + q_rest[:, None] * x_rest[None, :] + slack[rows, None] >= bound[rows, None]
    keep_q, keep_x = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    if not len(keep_q):
        return []
    alive = alive[np.ix_(keep_q, keep_x)]
    scores = _exact(q[rows[keep_q]], x[keep_x], alive)
    out = []
    for i, row in enumerate(rows[keep_q]):
        at = np.flatnonzero(alive[i] & (scores[i] >= bound[row]))
        best = at[np.lexsort((x_ids[keep_x[at]], -scores[i, at]))[:k]]
        out += [(int(row), int(keep_x[j]), int(scores[i, j])) for j in best]
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vec: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the k best of ``rows``.

    A component x counts as floor(scale * x), x in double precision; the score is the
    integer inner product. Ties go to the smaller key, a row with the query's own key is no
    candidate, and fewer than k candidates are all returned. Vectors that are null or hold
    null or non-finite components take no part, nor do rows without a key; rows that repeat
    (same key and integers) count once; a shorter vector ends in zeros. A score beyond 64
    bits is an error.
    """

    def whole(df: DataFrame) -> DataFrame:
        floor = lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double") + F.lit(0.0)
        good = df.filter(F.col(key).isNotNull() & usable(vec))
        return good.select(F.col(key).cast("long").alias("id"), F.transform(vec, floor).alias("v")).distinct()

    schema = "query_id long, rank int, vec_id long, score long"
    spark = rows.sparkSession
    squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    vectors = stored(whole(rows).withColumn("down", -squared), "integers")
    asked = stored(whole(queries).withColumn("h", F.xxhash64("id", "v")), "queries")
    width = max(df.agg(F.max(F.size("v"))).head()[0] or 0 for df in (vectors, asked))
    if vectors.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], schema)
    width = max(1, width)
    axes = principal_axes(vectors, "v", width)
    data = numbered(vectors, ["down", "id", "v"])
    data = stored(packed(data, F.expr(f"pos div {block_rows}"), {"id": "long"}, "v", width), "blocks")
    wanted = numbered(asked, ["h", "id", "v"])
    wanted = stored(packed(wanted, F.expr(f"pos div {query_rows}"), {"id": "long"}, "v", width), "query-blocks")

    def sides(row: dict) -> tuple[np.ndarray, ...]:
        part = lambda name: np.frombuffer(row[name]).reshape(-1, width)
        return part("q_x"), np.array(row["q_id"], np.int64), part("x"), np.array(row["id"], np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, q_ids, x, x_ids = sides(row)
                hits = block_hits(q, q_ids, x, x_ids, np.full(len(q), -np.inf), axes, k)
                bound = np.full(len(q), -np.inf)
                for i in range(len(q)):
                    own = [s for r, _, s in hits if r == i]
                    if len(own) == k:
                        bound[i] = min(own)
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]]), pa.array([bound.tolist()], pa.list_(pa.float64()))], names=["q_block", "bound"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, q_ids, x, x_ids = sides(row)
                hits = block_hits(q, q_ids, x, x_ids, np.array(row["bound"]), axes, k)
                cols = [q_ids[[r for r, _, _ in hits]], x_ids[[j for _, j, _ in hits]], np.array([s for _, _, s in hits], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    one = wanted.select(F.col("block").alias("q_block"), F.col("id").alias("q_id"), F.col("x").alias("q_x"))
    # The block of the longest vectors: block_rows of them at most.
    longest = data.filter("block = 0")
    seeds = one.withColumn("block", F.lit(0).cast("long")).join(F.broadcast(longest), "block")
    bounds = stored(seeds.mapInArrow(first, "q_block long, bound array<double>"), "bounds")
    n_blocks = data.agg(F.max("block")).head()[0] + 1
    visits = one.join(bounds, "q_block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    hits = visits.join(data, "block").mapInArrow(rest, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
