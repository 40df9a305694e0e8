"""Approximate nearest neighbours by Euclidean distance over robust-pruned directed graphs, one per shard.

Rows are dealt evenly into shards of about ``shard_rows``. Inside a shard the distinct vectors are the nodes of a
directed graph. Nodes enter in batches: a greedy search through the graph so far proposes neighbours for each; relaxed
distance pruning keeps the nearest and drops every candidate that a kept one is nearer to by the factor ``ALPHA``, so the
``DEGREE`` edges left point in different directions; the kept neighbours get edges back and are pruned the same way where
they have too many. A node that cannot be reached from the entry (the node nearest to the mean) gets an edge from a near
one that can. A query walks every shard's graph with a beam of the nearest nodes seen, expanding the nearest not yet
expanded, until the whole beam is expanded; the beam's nodes are then measured exactly.

The index is a table in the shared folder, one row per shard (ids, vectors, edges), written once and kept for any number
of searches. Searches read it without a shuffle; queries come in blocks of a bounded size, each broadcast to one pass
whose candidates are written before the next block. A task keeps k rows per query over all its shards. The memory of a
task does not depend on the table's size.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; queries
are compared with vectors of their own length. Equal vectors are one node that lists all its ids, so copies cost no recall.
Repeated rows are separate candidates; an id is asked about once (with its smallest vector) and no row of its own id
answers it. Ties go to the smaller id. A shard of at most ``SCAN`` nodes is measured whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BATCH_BYTES, ROW, gathered, prepare, query_blocks, scratch, with_row

#: Rows of a shard; its vectors and edges are held by one task (4 MB at 64 dimensions).
SHARD_ROWS = 8192
#: Edges per node, beam while building and while searching, relaxation of the pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 128, 256, 1.2
#: Nodes expanded per step; the most nodes or queries that walk the graph side by side, and the numbers they gather.
EXPAND, BATCH, GATHER = 4, 256, 1 << 21
#: Shards of so few nodes are measured whole.
SCAN = 256
INDEX_SCHEMA = "shard int, dim int, entry int, id_ends binary, ids binary, vectors binary, edges binary"


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, components as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(ok)


# --- one shard's graph -----------------------------------------------------------------------------------------------

def _scaled(x: np.ndarray) -> np.ndarray:
    """Single precision, in a range in which squares neither overflow nor vanish."""
    top = np.abs(x).max(initial=0)
    return (x / top if top else x).astype(np.float32)


def _side_by_side(x: np.ndarray, each: int) -> int:
    return max(1, min(BATCH, GATHER // (each * x.shape[1])))


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, asked: np.ndarray, beam: int) -> tuple:
    """Ids and squared distances of the ``beam`` nearest nodes met by each row of ``asked``, nearest first (id -1 where
    fewer were met). ``edges``: node x slots, -1 where empty."""
    b, slots = len(asked), edges.shape[1]
    ids = np.full((b, beam), -1, np.int64)
    near = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    seen = np.zeros((b, len(x) + 1), bool)  # the last column stands for empty slots
    seen[:, -1] = True
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    near[:, 0] = ((asked - x[entry]) ** 2).sum(axis=1)
    live = np.arange(b)
    while len(live):
        order = np.argsort(~open_[live], axis=1, kind="stable")[:, :EXPAND]
        rows = live[:, None]
        picked = np.where(open_[rows, order], ids[rows, order], -1)
        open_[rows, order] = False
        met = np.where(picked[:, :, None] >= 0, edges[picked], -1).reshape(len(live), EXPAND * slots)
        met[seen[rows, met]] = -1
        met.sort(axis=1)
        met[:, 1:][met[:, 1:] == met[:, :-1]] = -1
        width = int((met >= 0).sum(axis=1).max(initial=0))
        if width:
            met.sort(axis=1)
            met = met[:, -width:]
            seen[rows, met] = True
            step = x[met] - asked[live][:, None, :]
            far = np.einsum("ijk,ijk->ij", step, step)
            far[met < 0] = np.inf
            all_near = np.hstack([near[live], far])
            best = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
            at = np.arange(len(live))[:, None]
            near[live] = all_near[at, best]
            ids[live] = np.hstack([ids[live], met])[at, best]
            open_[live] = np.hstack([open_[live], met >= 0])[at, best]
        live = live[open_[live].any(axis=1)]
    return ids, near


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Of each row of ``cand`` (-1 where empty) the neighbours that node ``own`` keeps: the nearest, then the nearest
    that no kept one is nearer to by the factor ``ALPHA``, and so on, at most ``degree``."""
    out = np.full((len(own), degree), -1, np.int64)
    width = cand.shape[1]
    step = max(1, GATHER // (width * max(width, x.shape[1])))
    for lo in range(0, len(own), step):
        out[lo:lo + step] = _prune(x, own[lo:lo + step], cand[lo:lo + step], degree)
    return out


def _prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    cand = np.sort(np.where(cand == own[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    points = x[cand] - x[own][:, None, :]  # seen from the node: no precision is lost among near copies
    far = np.einsum("ijk,ijk->ij", points, points)
    length, far[cand < 0] = far.copy(), np.inf
    between = length[:, :, None] + length[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
    rows, left = np.arange(len(own)), far.copy()
    out = np.full((len(own), degree), -1, np.int64)
    for slot in range(degree):
        first = left.argmin(axis=1)
        some = left[rows, first] < np.inf
        if not some.any():
            break
        out[some, slot] = cand[rows, first][some]
        left[ALPHA * ALPHA * between[rows, first] <= far] = np.inf
        left[rows, first] = np.inf
    return out


def _add_back_edges(x: np.ndarray, edges: np.ndarray, own: np.ndarray, kept: np.ndarray) -> None:
    """Edges from every kept neighbour back to the node that kept it; full lists are pruned."""
    to, source = kept[kept >= 0], np.repeat(own, (kept >= 0).sum(axis=1))
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
    by_size = np.argsort(counts, kind="stable")
    for lo in range(0, len(nodes), BATCH):
        part = by_size[lo:lo + BATCH]
        width = int(counts[part].max())
        slot = starts[part][:, None] + np.arange(width)
        fresh = np.where(np.arange(width) < counts[part][:, None], source[np.minimum(slot, len(source) - 1)], -1)
        cand = np.hstack([edges[nodes[part], :DEGREE], fresh])
        cand = np.sort(cand, axis=1)[:, ::-1]
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand = np.sort(cand, axis=1)[:, ::-1]
        full = (cand[:, DEGREE:] >= 0).any(axis=1) if cand.shape[1] > DEGREE else np.zeros(len(part), bool)
        edges[nodes[part][~full], :DEGREE] = cand[~full, :DEGREE]
        if full.any():
            edges[nodes[part][full], :DEGREE] = robust_prune(x, nodes[part][full], cand[full])


def _reached(edges: np.ndarray, entry: int) -> np.ndarray:
    seen = np.zeros(len(edges) + 1, bool)
    front = np.array([entry])
    seen[[entry, -1]] = True
    while len(front):
        front = np.unique(edges[front])
        front = front[~seen[front]]
        seen[front] = True
    return seen[:-1]


def _connect(x: np.ndarray, edges: np.ndarray, entry: int) -> np.ndarray:
    """Every node can be reached: one that cannot gets an edge, in a slot beyond the degree, from the nearest node that
    a search from the entry finds."""
    while not (reached := _reached(edges, entry)).all():
        lost = np.flatnonzero(~reached)[:BATCH]
        ids, _ = beam_search(x, edges, entry, x[lost], BUILD_BEAM)
        for node, host in zip(lost, ids[:, 0]):
            free = np.flatnonzero(edges[host] < 0)
            if not len(free):
                edges = np.hstack([edges, np.full((len(edges), 8), -1, edges.dtype)])
                free = np.flatnonzero(edges[host] < 0)
            edges[host, free[0]] = node
    return edges


def build_graph(vectors: np.ndarray, seed: int = 0) -> tuple[int, np.ndarray]:
    """Entry node and edges (node x slots, -1 where empty) over distinct vectors."""
    x, n = _scaled(vectors), len(vectors)
    edges = np.full((n, DEGREE), -1, np.int64)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = min(n, DEGREE + 1)  # the first nodes are all each other's neighbours
    for node in order[:at]:
        edges[node, :at - 1] = order[:at][order[:at] != node]
    while at < n:
        own = order[at:at + min(_side_by_side(x, EXPAND * DEGREE), max(8, at // 4))]
        at += len(own)
        found, _ = beam_search(x, edges, entry, x[own], BUILD_BEAM)
        kept = robust_prune(x, own, found)
        edges[own] = kept
        _add_back_edges(x, edges, own, kept)
    return entry, _connect(x, edges, entry)


# --- the index as a table --------------------------------------------------------------------------------------------

def _shard_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition are one shard: a row per vector length."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    vectors = table.column("vector").combine_chunks()
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(vectors.value_lengths().to_numpy())
    dims, ids = vectors.value_lengths().to_numpy(), table.column("vec_id").to_numpy()
    shard = table.column("shard")[0].as_py()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        own = flat[(ends[rows] - dim)[:, None] + np.arange(dim)] + 0.0  # -0.0 and 0.0 are one value
        by_id = np.argsort(ids[rows], kind="stable")
        x, node = np.unique(own[by_id], axis=0, return_inverse=True)
        grouped = np.argsort(node.ravel(), kind="stable")
        entry, edges = (0, np.zeros((len(x), 0), np.int64)) if len(x) <= SCAN else build_graph(x, seed=shard)
        id_ends = np.cumsum(np.bincount(node.ravel(), minlength=len(x)))
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()),
            "entry": pa.array([entry], pa.int32()),
            "id_ends": [id_ends.astype(np.int64).tobytes()], "ids": [ids[rows][by_id][grouped].astype(np.int64).tobytes()],
            "vectors": [x.tobytes()], "edges": [edges.astype(np.int32).tobytes()]})


@dataclass
class AnnIndex:
    """The written index: one row per shard and vector length."""
    path: str
    shards: int

    def rows(self, spark) -> DataFrame:
        return spark.read.schema(INDEX_SCHEMA).parquet(self.path)


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, path: str | None = None) -> AnnIndex:
    """Index every row of ``vectors`` (vec_id, vector) at ``path`` (a scratch folder if none is given)."""
    spark = prepare(vectors.sparkSession)
    rows = with_row(vectors.select("vec_id", "vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    path = path or scratch(spark, "ann-index")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(ROW), F.lit(shards)).cast("int")).drop(ROW)
    (dealt.repartitionById(shards, F.col("shard")).mapInArrow(_shard_graphs, INDEX_SCHEMA)
     .write.option("compression", "zstd").parquet(path))
    return AnnIndex(path, shards)


def _nearest_in(entry: int, x: np.ndarray, edges: np.ndarray, asked: np.ndarray, beam: int) -> Iterator[tuple]:
    """(first query, node ids, exact squared distances) for blocks of queries; id -1 where there is none."""
    whole = len(x) <= SCAN
    small = None if whole else _scaled(np.vstack([x, asked]))
    batch = _side_by_side(x, EXPAND * max(DEGREE, edges.shape[1]))
    for lo in range(0, len(asked), batch):
        own = asked[lo:lo + batch]
        if whole:
            ids = np.broadcast_to(np.arange(len(x)), (len(own), len(x)))
        else:
            ids, _ = beam_search(small[:len(x)], edges, entry, small[len(x) + lo:len(x) + lo + len(own)], beam)
        exact = np.empty(ids.shape)
        step = max(1, GATHER // (ids.shape[1] * x.shape[1]))
        for a in range(0, len(own), step):
            exact[a:a + step] = ((x[ids[a:a + step]] - own[a:a + step, None, :]) ** 2).sum(axis=2)
        yield lo, ids, np.sqrt(exact)


def _rows_of(nodes: np.ndarray, dist: np.ndarray, ids: np.ndarray, ends: np.ndarray, own: int, k: int) -> tuple:
    """(ids, distances) of the rows at ``nodes`` that may be among the k nearest: per node its k smallest ids other than
    ``own``."""
    starts = np.where(nodes > 0, ends[nodes - 1], 0)
    if (ends[nodes] - starts == 1).all():
        vec, keep = ids[starts], ids[starts] != own
        return vec[keep], dist[keep]
    each = [(seg := ids[a:b])[seg != own][:k] for a, b in zip(starts, ends[nodes])]
    return np.concatenate(each), np.repeat(dist, [len(v) for v in each])


def _searcher(block, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, asked = block.value
        dim = asked.shape[1]
        best = np.full((len(qid), k), np.inf)
        held = np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] != dim:
                    continue
                x = np.frombuffer(r["vectors"]).reshape(-1, dim)
                ids, ends = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["id_ends"], np.int64)
                edges = np.frombuffer(r["edges"], np.int32).reshape(len(x), -1).astype(np.int64)
                for lo, nodes, far in _nearest_in(r["entry"], x, edges, asked, beam):
                    for q, (node, dist) in enumerate(zip(nodes, far), lo):
                        use = (node >= 0) & (dist <= best[q, -1])
                        if use.sum() > k + 1:  # the query's own node and k others, and all that tie with the last
                            use &= dist <= np.partition(dist[use], k)[k]
                        if use.any():
                            vec, near = _rows_of(node[use], dist[use], ids, ends, qid[q], k)
                            s, v = np.concatenate([best[q], near]), np.concatenate([held[q], vec])
                            top = np.lexsort((v, s))[:k]
                            best[q], held[q] = s[top], v[top]
        have = best < np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, have.sum(axis=1))), pa.array(held[have]),
                                          pa.array(best[have])], ["query_id", "vec_id", "score"])
    return run


def search(index: AnnIndex, queries: DataFrame, k: int = 10, beam: int = BEAM, block_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, vector) the ``k`` nearest rows found, other
    than its own id; ``score`` is the exact distance."""
    spark = prepare(queries.sparkSession)
    rows = index.rows(spark)

    def candidates(block) -> DataFrame:
        return rows.mapInArrow(_searcher(block, k, max(beam, 2 * k)), "query_id bigint, vec_id bigint, score double")
    found = gathered(spark, query_blocks(queries, block_bytes), candidates, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
