"""Approximate nearest neighbours: recall against brute force, exact scores, copies and odd rows."""

import numpy as np
import pytest

from tessera.llm import ann, queries
from tests.llm.conftest import SMALL


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows],
                                 "vec_id bigint, embedding array<float>, rank string, score double")


def brute(ids, x, asked, k=10):
    out = {}
    for q in asked:
        own = x[np.flatnonzero(ids == q)[0]]
        far = np.sqrt(((x - own) ** 2).sum(axis=1))
        order = np.lexsort((ids, far))
        out[q] = [(int(ids[i]), far[i]) for i in order if ids[i] != q][:k]
    return out


def hits(got, want, k=10):
    """Share of the true rows found; scores must be the exact distances, in order."""
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    n = 0
    for q, rows in want.items():
        own = sorted(found.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(rows) + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        n += len({v for _, v, _ in own} & {v for v, _ in rows})
    return n / sum(map(len, want.values()))


def test_query_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = queries.QUERIES["op11_ann"](spark, SMALL).collect()
    assert hits(got, brute(ids, x, [i for i in ids if i % 100 == 0])) >= 0.95
    place = {i: v for i, v in zip(ids, x)}
    assert all(abs(r["score"] - np.sqrt(((place[r["query_id"]] - place[r["vec_id"]]) ** 2).sum())) < 1e-12 for r in got)


@pytest.mark.parametrize("shard_rows, block", [(3000, 1 << 20), (700, 4096)])
def test_recall_over_several_shards_with_copies(spark, monkeypatch, shard_rows, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24)) * 0.6).astype(np.float32)
    x[2000:2300] = x[5]                                                # exact copies
    x[2300:2700] = x[6] + rng.normal(size=(400, 24)) * 1e-4            # near copies
    ids = rng.permutation(3000) * 3
    index = ann.build(ann.usable_vectors(frame_of(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])), shard_rows)
    asked = ann.usable_vectors(frame_of(spark, [(int(i), v.tolist()) for i, v in zip(ids, x) if i % 30 == 0]))
    got = ann.search(index, asked, 10, block_bytes=block).collect()
    assert hits(got, brute(ids, x.astype(float), [int(i) for i in ids if i % 30 == 0])) >= 0.95
    # an index is kept and can be asked again
    again = ann.search(index, asked.limit(1), 3).collect()
    assert len(again) == 3 and index.rows(spark).count() == index.shards


def test_pruned_edges_keep_their_distance_and_reach_every_node():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(900, 8)), rng.normal(size=(50, 8)) + 40])
    entry, edges = ann.build_graph(x)
    assert ann._reached(edges, entry).all() and edges[:, :ann.DEGREE].shape[1] == ann.DEGREE
    kept = ann.robust_prune(x, np.array([3]), np.array([[i for i in range(60)]]))[0]
    kept = kept[kept >= 0]
    d = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum())
    assert list(kept) == sorted(kept, key=lambda i: d(3, i)) and kept[0] == min(set(range(60)) - {3}, key=lambda i: d(3, i))
    for j, c in enumerate(kept):
        assert all(ann.ALPHA * d(s, c) > d(3, c) for s in kept[:j])
    for c in set(range(60)) - {3, *kept}:
        assert any(ann.ALPHA * d(s, c) <= d(3, c) for s in kept)


def test_odd_rows(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [None, 1.0]), (None, [1.0, 1.0]),
             (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0]), (200, [5.0, 5.0]), (200, [0.0, 1.0]), (200, [0.0, 1.0])]
    own = ann.usable_vectors(frame_of(spark, rows))
    assert own.count() == 44
    index = ann.build(own, 10)
    got = ann.search(index, own.where("vec_id in (0, 106, 200)"), 4).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: (r[0], r[1]))] == [
        (0, 1, 7, 0.0), (0, 2, 14, 0.0), (0, 3, 21, 0.0), (0, 4, 28, 0.0),
        (200, 1, 0, 0.0), (200, 2, 7, 0.0), (200, 3, 14, 0.0), (200, 4, 21, 0.0)]
    few = ann.search(ann.build(own.where("vec_id < 4")), own.where("vec_id = 0"), 10).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert ann.search(ann.build(own.limit(0)), own.limit(0), 10).count() == 0
    assert ann.search(index, own.limit(0), 10).count() == 0
    tied = ann.search(ann.build(own), own.where("vec_id = 39"), 50).collect()
    assert len(tied) == 42  # all rows of this length but its own id's, repeated rows one by one
