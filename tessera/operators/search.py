"""Vector search, and its fusion with text search (``textindex``) over embedded texts (``embedding``).

* ``cosine_topk`` — exact nearest neighbours. Queries come in blocks of bounded bytes; per block each task multiplies
  its vectors with the block in numpy and keeps the best k per query over all its batches, so no vector × query pair
  rows are materialized; a per-query top-k over those candidates finishes it.
* ``build_cells`` / ``search_cells`` — inverted lists: KMeans cells over normalized vectors, stored by cell; probe the
  nearest cells only, exact re-rank inside them (``ivf_search`` does both).
* ``hybrid_search`` — reciprocal-rank fusion of the text and vector rankings.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.embedding import (batch_embed, embed_batch, hash_embedder, letter_embedder,  # noqa: F401
                                         resume_embed)
from tessera.operators.layout import spread, written_once
from tessera.operators.textindex import (StoredIndex, fts_index, fts_match, fts_phrase, query_terms,  # noqa: F401
                                         stop_words, store_index, tokens)

# Query vectors sent to the tasks at a time.
QUERY_BLOCK_BYTES = 16 << 20


def _normalize(v):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def truncate_dims(df: DataFrame, id_col: str, vec: str, d: int) -> DataFrame:
    """Keep the first ``d`` dimensions of a nested (Matryoshka) embedding and L2-normalize them."""
    return df.select(F.col(id_col).alias("id"), _normalize(F.slice(F.col(vec), 1, d)).alias("vector"))


def _query_blocks(queries: DataFrame, id_col: str, vec_col: str) -> Iterator[tuple[list, np.ndarray]]:
    """The queries in blocks of at most ``QUERY_BLOCK_BYTES``: (ids, normalized vectors). Rows come to the driver one
    partition at a time, so neither the number of queries nor a block's size is limited by what came before."""
    ids, rows = [], []
    for r in queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).toLocalIterator():
        ids.append(r["q"])
        rows.append(np.asarray(r["v"], dtype=np.float64))
        if len(rows) * rows[0].nbytes >= QUERY_BLOCK_BYTES:
            yield ids, _unit(np.array(rows))
            ids, rows = [], []
    if rows:
        yield ids, _unit(np.array(rows))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _ranked(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (cand.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint")))


def _search_blocks(vectors: DataFrame, queries: DataFrame, k: int, q_id: str, q_vec: str, id_type: str,
                   cells_of=None, stored: bool = False) -> DataFrame:
    """One pass over ``vectors`` (id, v and, with ``cells_of``, cell) per block of queries; each task keeps the best k
    per query over all its batches. ``cells_of`` maps a block's matrix to its mask (cells × queries). The queries, and
    for more than one block the vectors (unless they are ``stored``), are computed once; a block's candidates are written
    before its broadcast is destroyed and the next block is read, so that one block at a time is held."""
    spark = vectors.sparkSession
    q_type = queries.schema[q_id].dataType.simpleString()
    schema = f"query_id {q_type}, vec_id {id_type}, score double"
    blocks = _query_blocks(written_once(queries.select(q_id, q_vec), "queries"), q_id, q_vec)
    block, found = next(blocks, None), []
    while block is not None:
        after = next(blocks, None)
        if after is not None and not stored:
            vectors, stored = written_once(vectors, "vectors"), True
        qids, qm = block
        mask = cells_of(qm) if cells_of else None
        own = vectors
        if mask is not None:
            own = own.where(F.col("cell").isin([int(c) for c in np.flatnonzero(mask.any(axis=1))]))
        sent = spark.sparkContext.broadcast((qids, qm, mask))
        found.append(written_once(own.mapInPandas(_topk_kernel(sent, k), schema), "candidates"))
        sent.destroy()
        block = after
    out = found[0] if found else spark.createDataFrame([], schema)
    for part in found[1:]:
        out = out.unionByName(part)
    return _ranked(out, k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                vec_col: str = "embedding", q_id: str = "query_id", q_vec: str = "vector") -> DataFrame:
    """Exact top-k by cosine similarity per query: (query_id, vec_id, score rounded to 6, rank); equal rounded scores
    rank by id."""
    own = spread(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")))
    return _search_blocks(own, queries, k, q_id, q_vec, vectors.schema[id_col].dataType.simpleString())


@dataclass(frozen=True)
class CellIndex:
    """Vectors stored by cell (partitioned), the cells' centroids and sizes."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    sizes: np.ndarray

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def build_cells(vectors: DataFrame, path: str, lists: int = 16, seed: int = 42, id_col: str = "vec_id",
                vec_col: str = "embedding") -> CellIndex:
    """Fit KMeans (``lists`` cells) on L2-normalized vectors — on those, Euclidean cells follow cosine distance — and
    store (id, v) partitioned by cell. The normalized vectors are written once; fitting and assigning read them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    vectors.select(F.col(id_col).alias("id"), _normalize(F.col(vec_col)).alias("v")).write.mode("overwrite") \
        .parquet(f"{path}-normalized")
    feats = spark.read.parquet(f"{path}-normalized").withColumn("features", array_to_vector("v"))
    model = KMeans(k=lists, seed=seed, featuresCol="features", predictionCol="cell").fit(feats)
    model.transform(feats).select("id", "v", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    centroids = _unit(np.array(model.clusterCenters()))
    sizes = np.zeros(len(centroids), np.int64)
    for r in spark.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
        sizes[r["cell"]] = r["n"]
    return CellIndex(spark, path, centroids, sizes)


def search_cells(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 4, q_id: str = "query_id",
                 q_vec: str = "vector") -> DataFrame:
    """Approximate top-k: each query scores the vectors of its ``probes`` nearest cells, and of further cells while
    those hold fewer than k vectors, and keeps the exact best k of them. Cells that no query probes are not read."""
    def cells_of(qm: np.ndarray) -> np.ndarray:
        order = np.argsort(-(qm @ index.centroids.T), axis=1, kind="stable")
        held = np.cumsum(index.sizes[order], axis=1)
        take = np.maximum(probes, 1 + (held < k).sum(axis=1))
        mask = np.zeros((len(index.centroids), len(qm)), dtype=bool)
        for i, row in enumerate(order):
            mask[row[:take[i]], i] = True
        return mask

    stored = index.vectors
    return _search_blocks(stored, queries, k, q_id, q_vec, stored.schema["id"].dataType.simpleString(), cells_of,
                          stored=True)


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 16, probes: int = 4,
               seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding", q_id: str = "query_id",
               q_vec: str = "vector") -> DataFrame:
    """Build the cells (stored under the shared checkpoint folder) and search them once."""
    from tessera.session import scratch_path
    path = scratch_path(vectors.sparkSession, f"cells-{uuid.uuid4().hex}")
    return search_cells(build_cells(vectors, path, lists, seed, id_col, vec_col), queries, k, probes, q_id, q_vec)


# Vectors scored against a block of queries at a time.
SCORE_ROWS = 512


def _topk_kernel(sent, k: int):
    """Cosine scores of a few hundred vectors against the block's queries (one matrix product), optionally masked to
    the (cell, query) pairs, rounded as the result is. Per query the best k by (score, id) are carried over all batches
    of the task and given out at its end."""
    def best(batches):
        qids, qm, mask = sent.value
        kept: list[list] = [[] for _ in qids]            # per query: (-score, id), ascending
        floor = np.full(len(qids), -np.inf)              # the k-th best score so far
        for pdf in batches:
            for at in range(0, len(pdf), SCORE_ROWS):
                some = pdf.iloc[at:at + SCORE_ROWS]
                ids = some["id"].tolist()
                sims = np.round(_unit(np.vstack([np.asarray(v, dtype=np.float64) for v in some["v"]])) @ qm.T, 6)
                if mask is not None:
                    sims = np.where(mask[some["cell"].to_numpy()], sims, -np.inf)
                ahead = (sims >= floor) & np.isfinite(sims)
                for j in np.flatnonzero(ahead.any(axis=0)):
                    new = [(-float(sims[i, j]), ids[i]) for i in np.flatnonzero(ahead[:, j])]
                    kept[j] = heapq.nsmallest(k, kept[j] + new)
                    if len(kept[j]) == k:
                        floor[j] = -kept[j][-1][0]
        rows = [(q, i, -s) for q, own in zip(qids, kept) for s, i in own]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
    return best


def hybrid_search(index: DataFrame | StoredIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, c: int = 60,
                  id_col: str = "vec_id", vec_col: str = "embedding", candidates: int | None = None) -> DataFrame:
    """Text + vector search fused by reciprocal rank: ``queries`` = (query_id, text, vector). Each side ranks
    ``candidates`` (default k) documents per query; the fused top-k is returned (query_id, doc_id, score, rank)."""
    n = candidates or k
    queries = written_once(queries.select("query_id", "text", "vector"), "hybrid-queries")
    text_hits = fts_match(index, queries.select("query_id", "text"), n)
    vec_hits = cosine_topk(vectors, queries.select("query_id", "vector"), n, id_col=id_col, vec_col=vec_col)
    return rrf_fuse(text_hits, vec_hits, k, c)


def rrf_fuse(text_hits: DataFrame, vector_hits: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: Σ 1 / (c + rank) over the text and vector rankings (query_id, doc_id, rank)."""
    t = text_hits.select("query_id", "doc_id", (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("_s"))
    v = vector_hits.select("query_id", F.col("vec_id").alias("doc_id"),
                           (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("_s"))
    fused = t.unionByName(v).groupBy("query_id", "doc_id").agg(F.round(F.sum("_s"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return (fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))
