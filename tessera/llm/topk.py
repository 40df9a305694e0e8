"""Exact top-k by inner product over integer vectors, with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its standard deviation. For two vectors x and q,
|x - q|^2 >= sum over segments of length * ((mean_x - mean_q)^2 + (dev_x - dev_q)^2), and with the exact norms this
bounds the inner product from above. Bounds are taken from one segment to ever finer ones; only pairs whose bound
reaches the query's k-th best score so far are carried on (with a margin for the rounding of both norms), and survivors
get the exact integer product: in doubles while the norms prove that every sum of products stays below 2**53, in 64-bit
integers below 2**62, in whole numbers of any size beyond; a score that does not fit a long is an error. Queries come in
blocks of bounded bytes, each broadcast to one pass over all rows; its candidates are written and the broadcast destroyed
before the next block is read, so memory does not grow with either side. A task keeps k candidates per query.

Vectors that are null, empty, of another length than the block's, or hold null or non-finite components take no part.
Ties go to the smaller id. Repeated rows are separate candidates, but an id is asked about once (with its smallest
vector), and no row of its own id answers it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BATCH_BYTES, gathered, prepare, query_blocks, stored

#: Segments per vector, coarse to fine.
RESOLUTIONS = (1, 4, 16)
#: Rows compared with the queries at a time, and (row, query) pairs bounded at a time.
ROW_BLOCK, PAIR_BLOCK = 256, 1 << 21
#: Slack for rounding in the bounds: scores are whole numbers, so a bound within half a unit decides nothing; and a share of
#: the product of the norms, thousands of times the rounding of sums of that size.
SLACK, ROUNDING = 0.5, 1e-11


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment lengths, means and deviations (rows x segments)."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    n = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / n
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / n
    return n, mean, np.sqrt(np.maximum(square - mean * mean, 0))


def weighted_stats(x: np.ndarray) -> list[np.ndarray]:
    """Per resolution: means and deviations scaled by the root of the segment length, side by side. The product of two
    rows is the upper bound of the inner product: half of both squared norms minus the lower-bound distance."""
    out = []
    for s in RESOLUTIONS:
        n, mean, dev = segment_stats(x, s)
        out.append(np.hstack([mean * np.sqrt(n), dev * np.sqrt(n)]))
    return out


def exact_products(x: np.ndarray, q: np.ndarray, norms: np.ndarray, q_norm: float) -> np.ndarray:
    """Integer products of the rows of ``x`` with ``q`` (int64), exact whatever their size."""
    reach = norms.max(initial=0) * q_norm
    if reach < 2.0 ** 52:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    if reach < 2.0 ** 62:  # the sum of the products' sizes is at most the product of the norms
        return x @ q
    whole = [sum(map(int.__mul__, row, q.tolist())) for row in x.tolist()]
    if any(not -2 ** 63 <= s < 2 ** 63 for s in whole):
        raise OverflowError("an inner product does not fit a 64-bit integer")
    return np.array(whole, np.int64)


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = block.value
        q_norm, qstats = np.sqrt((q.astype(float) ** 2).sum(axis=1)), weighted_stats(q.astype(float))
        least = np.iinfo(np.int64).min
        best = np.full((len(qid), k), least)
        full = np.zeros((len(qid), k), bool)
        ids = np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            vec_id = batch.column("vec_id").to_numpy()
            col = batch.column("vector")
            x_all = col.flatten().to_numpy(zero_copy_only=False).reshape(len(vec_id), -1)
            for at in range(0, len(vec_id), ROW_BLOCK):
                rid, x = vec_id[at:at + ROW_BLOCK], x_all[at:at + ROW_BLOCK]
                norms = np.sqrt((x.astype(float) ** 2).sum(axis=1))
                xstats = weighted_stats(x.astype(float))
                step = max(1, PAIR_BLOCK // len(rid))
                for lo in range(0, len(qid), step):
                    part = slice(lo, lo + step)
                    margin = SLACK + ROUNDING * (q_norm[part, None] * norms[None, :] + np.abs(best[part, -1:].astype(float)))
                    floor = np.where(full[part, -1:], best[part, -1:].astype(float), -np.inf) - margin
                    keep = qstats[0][part] @ xstats[0].T >= floor
                    for a, b in zip(qstats[1:], xstats[1:]):
                        rows = np.flatnonzero(keep.any(axis=1))
                        keep[rows] &= a[part][rows] @ b.T >= floor[rows]
                    keep &= qid[part][:, None] != rid[None, :]
                    for r in np.flatnonzero(keep.any(axis=1)):
                        some = np.flatnonzero(keep[r])
                        score = exact_products(x[some], q[lo + r], norms[some], q_norm[lo + r])
                        had = full[lo + r]
                        s, i = np.concatenate([best[lo + r][had], score]), np.concatenate([ids[lo + r][had], rid[some]])
                        top = np.lexsort((i, ~s))[:k]  # ~s falls as s grows, for the smallest number too
                        best[lo + r, :len(top)], ids[lo + r, :len(top)], full[lo + r, :len(top)] = s[top], i[top], True
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(qid, full.sum(axis=1))), pa.array(ids[full]), pa.array(best[full])],
            ["query_id", "vec_id", "score"])
    return run


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vector of floor(scale * x)) of the rows whose components are all finite numbers."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(ok)
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("vector")))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows with the largest inner product, its
    own id left out. Both are (vec_id, vector of longs)."""
    spark = prepare(rows.sparkSession)
    rows = stored(rows, "vectors")
    schema = "query_id bigint, vec_id bigint, score bigint"

    def candidates(block) -> DataFrame:
        size = block.value[1].shape[1]
        return rows.where(F.size("vector") == size).mapInArrow(_search(block, k), schema)
    found = gathered(spark, query_blocks(queries, block_bytes), candidates, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
